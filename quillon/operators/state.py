"""Batch forms of the stateful operators: the hot set and mailboxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TTL_MS = 30 * 60_000
CAP = 12


def hot_set(uses: DataFrame, owner: str, name: str, now_ms: int | None = None, ttl: int = TTL_MS, cap: int = CAP) -> DataFrame:
    """What is hot for each owner: names used less than the time to live ago, the latest `cap` of them; ties by name. Uses have t in ms.

    Now is each owner's last use, or the time given.
    """
    last = uses.groupBy(owner, name).agg(F.max("t").alias("last_ms"), F.count("*").alias("n_uses"))
    now = F.max("last_ms").over(W.partitionBy(owner)) if now_ms is None else F.lit(now_ms)
    alive = last.withColumn("_now", now).filter(F.col("_now") - F.col("last_ms") < ttl)
    rank = F.row_number().over(W.partitionBy(owner).orderBy(F.desc("last_ms"), name))
    return alive.withColumn("rank", rank).filter(F.col("rank") <= cap).drop("_now")


def waiting(messages: DataFrame, polls: DataFrame, box: str) -> DataFrame:
    """(box, waiting): messages sent after the box's last poll, by box; boxes with none are left out."""
    drained = polls.groupBy(box).agg(F.max("t").alias("_drained"))
    left = messages.join(drained, box, "left").filter(F.col("_drained").isNull() | (F.col("t") > F.col("_drained")))
    return left.groupBy(box).agg(F.count("*").alias("waiting")).orderBy(box)
