"""Vectors of catalogue rows: which are stale, making those anew, and the protocol of an outside kernel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing

HASH_KERNEL = "hash256"
BODY = 2000


def document_text(name: Column, about: Column, body: Column) -> Column:
    """What is embedded: the name twice, the description, and the beginning of the body."""
    return F.concat_ws(" ", name, name, about, F.left(body, F.lit(BODY)))


def with_columns(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with the named columns (name to type) that they lack, as nulls; done twice it changes nothing."""
    missing = {c: F.lit(None).cast(t) for c, t in columns.items() if c.lower() not in (x.lower() for x in rows.columns)}
    return rows.withColumns(missing) if missing else rows


def stale(rows: DataFrame, kernel: str, key: str = "content_key") -> Column:
    """Whether a row's vector was made by another kernel, for other content, or not at all."""
    return ~F.col("signature").eqNullSafe(hashing.signature(kernel, F.col(key)))


def spread(rows: DataFrame) -> DataFrame:
    """rows (narrow, before their vectors) dealt evenly over tasks: a file of a few MB is a task or two, and a kernel takes far longer for a row than a scan does.

    How many tasks follows the rows' bytes, by adaptive execution; where that is off, rows stay as they come.
    """
    return rows.hint("rebalance")


def regenerated(rows: DataFrame, embed: Callable[[DataFrame], DataFrame], kernel: str = HASH_KERNEL, force: bool = False, key: str = "content_key") -> DataFrame:
    """rows (id, text, content key, and vector and signature if they have been made before) with every stale vector made anew, and whether it was.

    embed takes (id, text) and gives (id, vector); only stale rows go through it.  If it has a `column`, which makes a text's vector, no row is shuffled.
    """
    known = with_columns(rows, {"vector": "array<float>", "signature": "string"})
    again = F.lit(True) if force else stale(known, kernel, key)
    marked = known.withColumn("regenerated", again)
    signed = F.when(F.col("regenerated"), hashing.signature(kernel, F.col(key))).otherwise(F.col("signature"))
    if column := getattr(embed, "column", None):
        asked = F.when(F.col("regenerated"), F.coalesce("text", F.lit("")))  # Python sees every row, but others without their text
        return marked.withColumn("vector", F.when(F.col("regenerated"), column(asked)).otherwise(F.col("vector"))).withColumn("signature", signed)
    made = embed(marked.filter("regenerated").select("id", "text")).select("id", F.col("vector").alias("_vector"))
    both = marked.join(made, "id", "left")
    return both.withColumn("vector", F.coalesce("_vector", "vector")).withColumn("signature", signed).drop("_vector")


def hash_kernel(rows: DataFrame) -> DataFrame:
    """(id, vector) of (id, text) by hashed tokens, a row for each row."""
    return rows.select("id", hash_vector(F.col("text")).alias("vector"))


def hash_vector(text: Column) -> Column:
    return hashing.hash_embedding(text, single=True)


#: A kernel that works row by row says so by its column: its vectors are made in place, without a join.
hash_kernel.column = hash_vector


def remote_kernel(ask: Callable[[list[str]], list[dict]], dimensions: int, batch: int = 64) -> Callable[[DataFrame], DataFrame]:
    """An outside kernel: ask gets a batch of texts and gives {index, embedding} in any order. Answers go by index; a missing one or one of another dimension is an error."""

    def embed(rows: DataFrame) -> DataFrame:
        kind = dict(rows.dtypes)["id"]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), batch):
                    part = frame.iloc[at : at + batch]
                    yield pd.DataFrame({"id": part["id"], "vector": ordered_answers(ask(part["text"].fillna("").tolist()), len(part), dimensions)})

        return rows.select("id", "text").mapInPandas(run, f"id {kind}, vector array<float>")

    return embed


def ordered_answers(answers: list[dict], n: int, dimensions: int) -> list[list[float]]:
    by = {a["index"]: a["embedding"] for a in answers}
    if sorted(by) != list(range(n)):
        raise ValueError(f"{len(answers)} vectors for {n} texts")
    if wrong := {len(v) for v in by.values()} - {dimensions}:
        raise ValueError(f"vectors of {sorted(wrong)} dimensions, not {dimensions}")
    return [by[i] for i in range(n)]
