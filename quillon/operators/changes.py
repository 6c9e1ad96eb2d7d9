"""Change capture by snapshot difference, result differences, pruning, gaps and output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import tsv_cell
from .spool import spooled

#: Letters of the operations in a change log.
INSERT, UPDATE, DELETE = "e", "g", "s"
RESERVED = "quillon_"


def require_key(rows: DataFrame, key: list[str]) -> None:
    """Refuses keys that are missing, empty or repeated."""
    if not key:
        raise ValueError("a key column must be named")
    if missing := [k for k in key if k not in rows.columns]:
        raise ValueError(f"no such key column: {', '.join(missing)}")
    if rows.groupBy(*key).count().filter("count > 1").limit(1).count():
        raise ValueError("the key isn't unique")


def resolve_column(columns: list[str], name: str) -> str:
    """The column of that name; ASCII case doesn't count unless two columns differ in it alone."""
    if name in columns:
        return name
    found = [c for c in columns if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} column {name}")
    return found[0]


def result_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key..., op, old, new): rows added (+), deleted (-) and changed (~); equality treats nulls as equal."""
    a = old.select(*(F.col(k).alias(f"_a_{k}") for k in key), F.struct(*old.columns).alias("old"))
    b = new.select(*(F.col(k).alias(f"_b_{k}") for k in key), F.struct(*old.columns).alias("new"))
    same_key = reduce(lambda x, y: x & y, (F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}")) for k in key))
    op = F.when(F.col("old").isNull(), "+").when(F.col("new").isNull(), "-").when(~F.col("old").eqNullSafe(F.col("new")), "~")
    both = a.join(b, same_key, "full").withColumn("op", op).filter("op is not null")
    return both.select(*(F.coalesce(f"_a_{k}", f"_b_{k}").alias(k) for k in key), "op", "old", "new")


def change_rows(old: DataFrame, new: DataFrame, key: list[str], table: str) -> DataFrame:
    """(table_name, op, row_key): what triggers would have logged, keys as JSON arrays."""
    op = F.when(F.col("op") == "+", INSERT).when(F.col("op") == "-", DELETE).otherwise(UPDATE)
    text = F.to_json(F.array(*(F.col(k).cast("string") for k in key)))
    return result_diff(old, new, key).select(F.lit(table).alias("table_name"), op.alias("op"), text.alias("row_key"), *key)


def numbered_log(rows: DataFrame, order: list[str], after: int) -> DataFrame:
    """Numbers that go on after the last: ranges are counted first, so that no task numbers the whole log."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written, because range bounds come from a sample and may differ when the plan runs again
    placed = spooled(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "change-log")
    inner = placed.withColumn("_n", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    sizes = inner.groupBy("_part").agg(F.count("*").alias("_rows"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_rows")
    return inner.join(F.broadcast(offsets), "_part").withColumn("no", F.col("_n") + F.col("_before") + after).drop("_part", "_n", "_before")


def read_after(log: DataFrame, cursor: int, limit: int) -> DataFrame:
    return log.filter(F.col("no") > cursor).orderBy("no").limit(limit)


def prune(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """What stays: rows from the slowest cursor on, and always the last row. Cursors are one row a consumer."""
    slow = cursors.agg(F.min("cursor").alias("_slow"))
    last = log.agg(F.max("no").alias("_last"))
    both = log.crossJoin(F.broadcast(slow)).crossJoin(F.broadcast(last))
    return both.filter((F.col("no") >= F.coalesce("_slow", "_last")) | (F.col("no") == F.col("_last"))).drop("_slow", "_last")


def gap(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """For each consumer: whether rows it hasn't read were pruned, or numbers have gone back."""
    ends = log.agg(F.min("no").alias("first_no"), F.coalesce(F.max("no"), F.lit(0)).alias("last_no"))
    lost = (F.coalesce("first_no", F.lit(0)) > F.col("cursor") + 1) | (F.col("last_no") < F.col("cursor"))
    return cursors.crossJoin(F.broadcast(ends)).withColumn("gap", lost)


def last_per_table(log: DataFrame, n: int) -> DataFrame:
    """The last n rows of each table, oldest first."""
    rank = F.row_number().over(W.partitionBy("table_name").orderBy(F.desc("no")))
    return log.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank").orderBy("table_name", "no")


def tsv(rows: DataFrame, columns: list[str]) -> Column:
    """A row as one line of tab-separated, escaped cells."""
    kinds = dict(rows.dtypes)
    return F.array_join(F.array(*(tsv_cell(F.col(c), kinds[c] == "binary") for c in columns)), "\t")


def user_tables(names: DataFrame, column: str = "name") -> DataFrame:
    """Tables a log may watch: none with the reserved prefix."""
    return names.filter(~F.col(column).startswith(RESERVED))
