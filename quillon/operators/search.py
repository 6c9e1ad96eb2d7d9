"""Ranked retrieval: BM25, exact cosine, fusion, fallback.

Without a stored index (see index) a search reads its corpus once: every document
leaves its length and the counts of the terms it is asked for in a narrow table, one
aggregate of it gives corpus statistics, and the scores are a projection of it with a
top-k behind.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.hashing import dot
from .spool import spooled

K1, B = 1.2, 0.75
TITLE_WEIGHT = 3
#: Letters of a stem, see text.stems.
STEM = 5
MODES = ("bm25", "vector", "fused", "vector-then-bm25")


def _is(term: str):
    return lambda t: t == term


def overfetch(limit: int) -> int:
    return max(4 * limit, 8)


def bm25(documents: DataFrame, terms: list[str], limit: int | None, least_average: float = 0.0, id_column: str = "id", token_column: str = "tokens") -> DataFrame:
    """(id, score) of the best documents; a term that the query repeats counts again. Scores are rounded to six places, ties go by id."""
    times = Counter(terms)
    if not times:
        return documents.select(id_column).limit(0).withColumn("score", F.lit(0.0))
    held = F.filter(token_column, lambda t: t.isin(list(times)))
    short = documents.select(id_column, F.size(token_column).alias("_length"), held.alias("_held"))
    found = spooled(short.select(id_column, "_length", *(F.size(F.filter("_held", _is(w))).alias(f"_tf{i}") for i, w in enumerate(times))), "bm25")
    stats = found.agg(F.count("*").alias("_n"), F.greatest(F.avg("_length"), F.lit(least_average)).alias("_mean"), *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(times))))
    score: Column = F.lit(0.0)
    for i, n in enumerate(times.values()):
        tf, df = F.col(f"_tf{i}").cast("double"), F.col(f"_df{i}").cast("double")
        idf = F.ln(1.0 + (F.col("_n") - df + 0.5) / (df + 0.5))
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_length") / F.col("_mean")))
        score = score + n * F.when(tf > 0, idf * part).otherwise(0.0)
    out = found.crossJoin(F.broadcast(stats)).select(id_column, F.round(score, 6).alias("score")).filter("score > 0")
    return out if limit is None else out.orderBy(F.desc("score"), id_column).limit(limit)


def scan(documents: DataFrame, terms: list[str], stemmed: bool, id_column: str = "id", token_column: str = "tokens") -> DataFrame:
    """(id, dl, held) of every document: its length and those of its tokens that are, or begin with, a term asked for; one pass, written once.

    With few queries to ask at once this costs a fraction of building an index.
    """
    of = (lambda t: F.left(t, F.lit(STEM))) if stemmed else (lambda t: t)
    held = F.filter(token_column, lambda t: of(t).isin(terms)) if terms else F.array().cast("array<string>")
    return spooled(documents.select(F.col(id_column).alias("id"), F.greatest(F.size(token_column), F.lit(0)).alias("dl"), F.coalesce(held, F.array().cast("array<string>")).alias("held")), "scan")


def scores(scanned: DataFrame, queries: dict, stemmed: bool = False) -> DataFrame:
    """(query_id, id, score) of all scanned documents that hold a term of a query, as Index.scores gives them; queries: terms by query id, a term that repeats counts again."""
    spark = scanned.sparkSession
    stats = scanned.agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).first()
    n, mean = stats["n"], stats["mean"] or 0.0
    wanted = sorted({t for terms in queries.values() for t in terms})
    token = F.left("t", F.lit(STEM)) if stemmed else F.col("t")
    tf = scanned.select("id", "dl", F.explode("held").alias("t")).select("id", "dl", token.alias("term")).filter(F.col("term").isin(wanted)).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    tf = spooled(tf, "tf")
    kind = "string" if any(isinstance(q, str) for q in queries) else "bigint"
    asked = spark.createDataFrame([(q, t, k) for q, terms in queries.items() for t, k in Counter(terms).items()], f"query_id {kind}, term string, times int")
    df = F.col("df").cast("double")
    weighted = asked.join(tf.groupBy("term").agg(F.count("*").alias("df")), "term").select("query_id", "term", (F.col("times") * F.ln(1.0 + (n - df + 0.5) / (df + 0.5))).alias("w"))
    length = F.col("dl") / mean if mean > 0 else F.lit(0.0)
    part = F.col("w") * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length)))
    return tf.join(F.broadcast(weighted), "term").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score")).filter("score > 0")


def cosine(documents: DataFrame, query: Column | list[float] | DataFrame, floor: float, limit: int | None, id_column: str = "id", vector_column: str = "vector") -> DataFrame:
    """(id, score) of the vectors nearest to the query: a list, or a table of one row with column `query`."""
    if isinstance(query, DataFrame):
        both = documents.crossJoin(F.broadcast(query.select("query").limit(1)))
        target = F.col("query")
    else:
        both, target = documents, F.array(*(F.lit(float(x)) for x in query)) if isinstance(query, list) else query
    out = both.filter(F.col(vector_column).isNotNull()).select(id_column, F.round(dot(F.col(vector_column), target), 6).alias("score")).filter(F.col("score") > floor)
    return out if limit is None else out.orderBy(F.desc("score"), id_column).limit(limit)


def fuse(text: DataFrame, vector: DataFrame, weight: float, limit: int, id_column: str = "id") -> DataFrame:
    """Each channel over its own maximum, then weighted and summed; both channels are top-k lists."""

    def share(channel: DataFrame, part: float) -> DataFrame:
        top = F.max("score").over(W.partitionBy(F.lit(0)))  # over a top-k list, which is one task's anyway
        return channel.withColumn("_top", top).select(id_column, F.when(F.col("_top") > 0, part * F.col("score") / F.col("_top")).otherwise(0.0).alias("score"))

    both = share(text, weight).unionByName(share(vector, 1 - weight))
    return both.groupBy(id_column).agg(F.round(F.sum("score"), 6).alias("score")).orderBy(F.desc("score"), id_column).limit(limit)


def first_that_answers(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first channel's rows, or the second's where the first has none; `channel` says which."""
    both = first.withColumn("channel", F.lit("vector")).unionByName(second.withColumn("channel", F.lit("bm25")))
    answered = F.max((F.col("channel") == "vector").cast("int")).over(W.partitionBy(F.lit(0)))  # over two top-k lists
    return both.withColumn("_first", answered).filter((F.col("_first") == 0) | (F.col("channel") == "vector")).drop("_first")


def search(documents: DataFrame, terms: list[str], vector, mode: str = "vector-then-bm25", limit: int = 5, floor: float = 0.0, weight: float = 0.5) -> DataFrame:
    """The catalogue's search over (id, tokens, vector)."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if mode == "bm25":
        return bm25(documents, terms, limit)
    near = cosine(documents, vector, floor, limit if mode != "fused" else overfetch(limit))
    if mode == "vector":
        return near
    if mode == "fused":
        return fuse(bm25(documents, terms, overfetch(limit)), near, weight, limit)
    return first_that_answers(near, bm25(documents, terms, limit))


def late(top: DataFrame, wide: DataFrame, id_column: str = "id") -> DataFrame:
    """The full rows of a top-k list; the list is short, so it is the broadcast side."""
    return wide.join(F.broadcast(top), id_column)
