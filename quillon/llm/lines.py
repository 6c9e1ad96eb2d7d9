"""What line-based operators share: normalised lines of a text and how many documents of a host hold each. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, forget, written

HOST = "_host"


def bind(value: Column, use) -> Column:
    """use(value) with value evaluated once in a row, whatever the optimiser merges."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def has_word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(SPACE_CHARS))) > 0


def line_key(line: Column) -> Column:
    """Hash of the line in lower case, with single spaces."""
    return F.xxhash64(F.lower(F.regexp_replace(F.btrim(line, F.lit(SPACE_CHARS)), f"[{SPACE}]+", " ")))


def host_key(column: str) -> Column:
    """A null host is a host of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def common_lines(documents: DataFrame, text: str, host: str, least: int, ratio: float) -> DataFrame:
    """For each host that has any: _docs, its documents, and _common, the keys of lines that more than `ratio` of them, and `least` at least, hold.

    Each document counts a line once.  Counting combines on the map side, so a line of a third of all documents costs one row a
    task.  An array has at most (mean distinct lines of a document / ratio) keys, whatever the size of the corpus.
    """
    keys = F.array_distinct(F.transform(F.filter(lines_of(text_of(text)), has_word), line_key))
    each = documents.select(host_key(host).alias(HOST), F.explode(F.concat(F.array(F.lit(None).cast("bigint")), keys)).alias("_line"))
    counts = written(each.groupBy(HOST, "_line").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least), "line-counts")
    hosts = counts.filter("_line is null").select(HOST, F.col("_n").alias("_docs"))
    often = counts.filter("_line is not null").join(hosts, HOST).filter(F.col("_n") > ratio * F.col("_docs"))
    found = written(often.groupBy(HOST, "_docs").agg(F.collect_list("_line").alias("_common")), "common-lines")
    forget(counts)
    return found


def with_common(documents: DataFrame, text: str, host: str, least: int, ratio: float, few: int = 20_000) -> DataFrame:
    """documents with _common, the keys of their host's common lines (null: none).

    The table is broadcast while its hosts are few.  Beyond that only the `few` // 10 largest hosts are, and just the documents of
    others are shuffled by host, so no host that holds a great part of all documents lands in one task.
    """
    common = common_lines(documents, text, host, least, ratio)
    keyed = documents.withColumn(HOST, host_key(host))
    if common.count() <= few:
        return keyed.join(F.broadcast(common.drop("_docs")), HOST, "left").drop(HOST)
    largest = common.orderBy(F.desc("_docs"), HOST).limit(few // 10).withColumn("_large", F.lit(True)).drop("_docs")
    split = keyed.join(F.broadcast(largest), HOST, "left")
    rest = common.drop("_docs").join(F.broadcast(largest.select(HOST)), HOST, "left_anti")
    others = split.filter("_large is null").drop("_common", "_large").join(rest, HOST, "left")
    return split.filter("_large").drop("_large").unionByName(others).drop(HOST)
