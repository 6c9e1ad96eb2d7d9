"""Attribution joins between searches, calls and results.

Every join has an equality on the session (or tool and digest) and on a second
key: a time bucket where time bounds the pair, a piece of the path where a path
does.  Uses until the next search need one sort by session instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import has_path, normal_path, path_runs, path_variants

TOLERANCE_MS = 60_000
WINDOW_MS = 30 * 60_000


def nearest(left: DataFrame, right: DataFrame, on: list[str], tolerance: int, left_id: str = "left_id", right_id: str = "right_id", tie: list[str] | None = None) -> DataFrame:
    """(left_id, right_id, gap_ms): for each left row the right row nearest in time, both ends included; left and right have t in ms.

    Buckets as wide as the tolerance make the pair an equi-join: a left row looks into its own bucket and the two beside it.
    """
    a = left.select(left_id, *on, F.col("t").alias("_t"), F.explode(F.array(*(F.floor(F.col("t") / (tolerance + 1)) + d for d in (-1, 0, 1)))).alias("_bucket"))
    b = right.select(right_id, *on, *(tie or []), F.col("t").alias("_u"), F.floor(F.col("t") / (tolerance + 1)).alias("_bucket"))
    gap = F.abs(F.col("_t") - F.col("_u"))
    near = a.join(b, [*on, "_bucket"]).filter(gap <= tolerance)
    best = F.min(F.struct(gap.alias("gap_ms"), *(tie or []), F.col("_u"), F.col(right_id)))
    return near.groupBy(left_id).agg(best.alias("_best")).select(left_id, F.col(f"_best.{right_id}").alias(right_id), F.col("_best.gap_ms").alias("gap_ms"))


def uses_until_next(events: DataFrame, session: str, is_search: Column, window: int, event_id: str = "event_id") -> DataFrame:
    """(search_id, event_id): events after a search, within the window, before the session's next search; events have t in ms.

    One sort by session and time: the last search before an event is the only one that can claim it.
    """
    order = W.partitionBy(session).orderBy("t", event_id).rowsBetween(W.unboundedPreceding, -1)
    here = F.when(is_search, F.struct(F.col("t").alias("t"), F.col(event_id).alias("id")))
    seen = events.withColumn("_s", F.last(here, ignorenulls=True).over(order)).filter(~is_search & F.col("_s").isNotNull())
    gap = F.col("t") - F.col("_s.t")
    return seen.filter((gap > 0) & (gap <= window)).select(F.col("_s.id").alias("search_id"), event_id)


def first_use(results: DataFrame, calls: DataFrame, session: str) -> DataFrame:
    """(search_id, path, rank, call_id, t): the first later call of the session whose text holds the path; results have search_id, t, rank, path.

    A path that stands whole in a text brings its last run of path characters as a whole run of the text, so results and calls meet by
    (session, run); a path without such characters meets every call of its session.
    """
    order = W.partitionBy("search_id", "path").orderBy("rank")
    once = results.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    wanted = once.select(session, "search_id", "path", "rank", F.col("t").alias("_t"), F.explode(path_variants(F.col("path"))).alias("_path"))
    wanted = wanted.withColumn("_run", F.coalesce(F.element_at(F.nullif(path_runs(F.col("_path")), F.array().cast("array<string>")), -1), F.lit("")))
    said = calls.join(results.select(session).distinct(), session, "left_semi").select(session, "call_id", F.col("t").alias("_u"), normal_path(F.col("text")).alias("_text"))
    said = said.withColumn("_run", F.explode(F.array_distinct(F.concat(path_runs(F.col("_text")), F.array(F.lit(""))))))
    found = wanted.join(said, [session, "_run"]).filter((F.col("_u") > F.col("_t")) & has_path(F.col("_text"), F.col("_path")))
    return found.groupBy("search_id", "path", "rank").agg(F.min(F.struct(F.col("_u").alias("t"), F.col("call_id"))).alias("_first")).select("search_id", "path", "rank", F.col("_first.call_id").alias("call_id"), F.col("_first.t").alias("t"))


def touched(calls: DataFrame, session: str, touches: Column) -> DataFrame:
    """All calls of the sessions that touched the server."""
    return calls.join(calls.filter(touches).select(session).distinct(), session, "left_semi")


def uses_result(identifier: Column, tool: Column, digest: Column) -> Column:
    """Whether a call uses the result: an mcp/server/tool call by name, a skill by name or by reading its file."""
    part = F.split(identifier, "/")
    name, lower = F.element_at(part, -1), F.lower(tool)
    server = lower.startswith("mcp__") & F.endswith(lower, F.concat(F.lit("__"), F.lower(name))) & F.contains(lower, F.lower(F.get(part, 1)))
    skill = (tool == "Skill") & ((digest == name) | F.endswith(digest, F.concat(F.lit(":"), name)))
    read = (tool == "Read") & F.endswith(F.replace(digest, F.lit("\\"), F.lit("/")), F.concat(F.lit("/"), name, F.lit("/SKILL.md")))
    return F.when((F.size(part) == 3) & (F.get(part, 0) == "mcp"), server).when(F.size(part) >= 2, skill | read).otherwise(F.lit(False))


def report(searches: DataFrame, results: DataFrame, calls: DataFrame, session: str) -> DataFrame:
    """One row: searches, those without a session, and those with results whose session has no calls."""
    known = calls.select(session).distinct()
    with_results = searches.join(results.select("search_id").distinct(), "search_id", "left_semi").filter(F.col(session).isNotNull())
    orphans = with_results.join(known, session, "left_anti").agg(F.count("*").alias("no_archive"))
    return searches.agg(F.count("*").alias("searches"), (F.count("*") - F.count(session)).alias("no_session")).crossJoin(orphans)
