"""Snapshot synchronisation: what an upsert or a full sync does to each row, and the next snapshot."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def upsert_actions(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, action) of every new row: added, updated or same. Nothing is deleted."""
    was = old.select(key, F.col(content).alias("_was"), F.lit(True).alias("_known"))
    action = F.when(F.col("_known").isNull(), "added").when(F.col("_was").eqNullSafe(F.col(content)), "same").otherwise("updated")
    return new.join(was, key, "left").select(key, action.alias("action"))


def sync_actions(old: DataFrame, new: DataFrame, key: str, content: list[str]) -> DataFrame:
    """(key, action) of every row of either side: added, updated, same or deleted; all content columns take part."""
    a = old.select(key, F.struct(*content).alias("_was"), F.lit(True).alias("_in_old"))
    b = new.select(key, F.struct(*content).alias("_now"), F.lit(True).alias("_in_new"))
    action = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "deleted").when(F.col("_was").eqNullSafe(F.col("_now")), "same").otherwise("updated")
    return a.join(b, key, "full").select(key, action.alias("action"))


def next_snapshot(old: DataFrame, new: DataFrame, key: str, delete: bool) -> DataFrame:
    """The rows after the sync; without delete, rows that vanished stay."""
    return new if delete else new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The rows to insert: keys that the table hasn't got, the first of each."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return new.join(old.select(*keys), keys, "left_anti").withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def merge_content(rows: DataFrame, content: str, order: str, interfaces: str) -> DataFrame:
    """One row for equal content: the first id, all interfaces."""
    first = rows.groupBy(content).agg(F.min(order).alias(order), F.count("*").alias("n_copies"))
    sets = rows.select(content, F.explode(interfaces).alias("_one")).groupBy(content).agg(F.array_sort(F.collect_set("_one")).alias(interfaces))
    return first.join(sets, content, "left")


def numbered(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Names made unique in order: a name that is taken gets the next free number, x, x#2, x#3; a name may itself be x#2 and then be taken too.

    Only names of one family (equal up to their numbers) can meet, so families are dealt over tasks and each is walked in order.  A
    task keeps the last number of each name and the names given otherwise, of the family at hand only: copies of one name need no memory.
    """
    root = F.regexp_replace(name, "(#[0-9]+)+$", "")
    ordered = rows.withColumn("_family", root).repartition("_family").sortWithinPartitions("_family", order)
    columns = rows.columns
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "unique_name string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, given, numbers = object(), set(), {}
        for batch in batches:
            out = []
            for here, asked in zip(batch.column("_family").to_pylist(), batch.column(name).to_pylist()):
                if here != family:
                    family, given, numbers = here, set(), {}
                out.append(None if asked is None else free_name(asked, given, numbers))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, pa.string())], names=[*columns, "unique_name"])

    return ordered.mapInArrow(run, schema)


def free_name(asked: str, given: set[str], numbers: dict[str, int]) -> str:
    """The name or its first free number; given holds names taken as they were asked, numbers the last number of a name, below which none is free."""

    def taken(x: str) -> bool:
        base, mark, n = x.rpartition("#")
        return x in given or bool(mark) and n.isdigit() and str(int(n)) == n and 2 <= int(n) <= numbers.get(base, 1)

    if not taken(asked):
        given.add(asked)
        return asked
    n = numbers.get(asked, 1) + 1
    while taken(f"{asked}#{n}"):
        n += 1
    numbers[asked] = n
    return f"{asked}#{n}"


def digest(table: DataFrame, columns: list[str], order: str, width: int = 1024) -> DataFrame:
    """n_rows and a sha256 over the table's rows in order: a tree of digests over ranges of the integer key `order`, `width` children a node.

    A node hashes the digests of its children in order, so no task holds more than `width` distinct keys of a range and the root is
    reached after as many levels as the range of keys needs.  Rows without a key come first, in a range of their own.
    """
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    level = table.select(F.floor(F.col(order) / width).alias("at"), F.col(order).alias("o"), F.sha2(row, 256).alias("d"), F.lit(1).cast("bigint").alias("n"))
    ends = table.agg(F.min(order).alias("a"), F.max(order).alias("b")).first()
    low, high = (0 if x is None else int(x) // width for x in (ends["a"], ends["b"]))

    def folded(rows: DataFrame) -> DataFrame:
        children = F.transform(F.array_sort(F.collect_list(F.struct("o", "d"))), lambda x: x["d"])
        return rows.groupBy("at").agg(F.sum("n").alias("n"), F.sha2(F.array_join(children, "\n"), 256).alias("d"))

    level = folded(level)
    while low != high and (low, high) != (-1, 0):  # either side of 0 never meets
        low, high = low // width, high // width
        level = folded(level.select(F.floor(F.col("at") / width).alias("at"), F.col("at").alias("o"), "d", "n"))
    return folded(level.select(F.lit(0).alias("at"), F.col("at").alias("o"), "d", "n")).select(F.col("n").alias("n_rows"), F.col("d").alias("digest"))
