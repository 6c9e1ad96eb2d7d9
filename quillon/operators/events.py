"""Event logs of tool calls: what a call's row holds, the sink that appends rows, and the reader that joins them again."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sessions import argument_digest

#: Fixed values of the log format: our names to those of the fields, the mark before the channel, and the name of an unknown interface.
FIELDS = {"session": "oturum", "interface": "arayuz", "time_ms": "zaman_ms", "tool": "arac", "arguments": "arguman", "results": "sonuclar", "channel": "kanal", "error": "hata", "took_ms": "sure_ms"}
CHANNEL_MARK = "kanal: "
UNKNOWN = "bilinmiyor"
ARGUMENT_LENGTH = 500
HOT_RESULTS = 3


def _rows(output: Column, form: str) -> Column:
    """The JSON array behind the first line of a search's output; null where there's none."""
    body = F.when(F.locate("\n", output) > 0, F.substring(output, F.locate("\n", output) + 1, F.length(output)))
    return F.from_json(body, form)


def result_ids(output: Column) -> Column:
    """Identifiers in a search's output, in order; none where the form isn't known."""
    ids = F.transform(_rows(output, "array<struct<id:string>>"), lambda x: x["id"])
    return F.coalesce(F.filter(ids, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def channel(output: Column) -> Column:
    """The channel that the first line names."""
    return F.nullif(F.regexp_extract(F.split(output, "\n", 2)[0], CHANNEL_MARK + r"\s*(\S+)", 1), F.lit(""))


def hot_candidates(output: Column, n: int = HOT_RESULTS, left_out: str = "mcp/") -> Column:
    """(id, about) of the first n results of a search's output that aren't tools."""
    rows = _rows(output, "array<struct<id:string,aciklama:string>>")
    kept = F.filter(rows, lambda x: x["id"].isNotNull() & ~x["id"].startswith(left_out))
    shown = F.transform(kept, lambda x: F.struct(x["id"].alias("id"), F.coalesce(x["aciklama"], F.lit("")).alias("about")))
    return F.slice(F.coalesce(shown, F.array().cast("array<struct<id:string,about:string>>")), 1, n)


def event_lines(calls: DataFrame) -> DataFrame:
    """(session, value): a JSON line for each call (session, interface, time_ms, tool, arguments, output, error, took_ms); arguments are a map of texts, long ones cut."""
    short = F.transform_values("arguments", lambda _, v: F.when(F.char_length(v) > ARGUMENT_LENGTH, F.concat(F.left(v, F.lit(ARGUMENT_LENGTH)), F.lit("…"))).otherwise(v))
    shown = F.when(F.col("error").isNull(), F.col("output"))
    values = {"session": F.col("session"), "interface": F.coalesce("interface", F.lit(UNKNOWN)), "time_ms": F.col("time_ms"), "tool": F.col("tool"), "arguments": short, "results": result_ids(shown), "channel": channel(shown), "error": F.col("error"), "took_ms": F.col("took_ms")}
    line = F.to_json(F.struct(*(v.alias(FIELDS[k]) for k, v in values.items())), {"ignoreNullFields": "false"})
    return calls.select("session", line.alias("value"))


def append_events(calls: DataFrame, path: str) -> bool:
    """Appends the calls' lines, a folder a session. A log that can't be written mustn't stop the caller: it is told on the error output."""
    try:
        event_lines(calls).write.mode("append").partitionBy("session").text(path)
        return True
    except Exception as e:  # noqa: BLE001
        print(f"! events not written: {e}", file=sys.stderr)
        return False


def read_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Events of log lines; lines that aren't JSON, or lack session, time or tool, are dropped."""
    form = f"{FIELDS['session']} string, {FIELDS['interface']} string, {FIELDS['time_ms']} bigint, {FIELDS['tool']} string, {FIELDS['arguments']} string, {FIELDS['results']} array<string>, {FIELDS['channel']} string"
    parsed = lines.select(F.from_json(value, form).alias("e"))
    of = lambda k: F.col(f"e.{FIELDS[k]}")
    found = parsed.select(
        of("session").alias("session"), F.coalesce(of("interface"), F.lit(UNKNOWN)).alias("interface"), of("time_ms").alias("t"), of("tool").alias("tool"),
        argument_digest(of("arguments")).alias("digest"), F.filter(F.coalesce(of("results"), F.array().cast("array<string>")), lambda x: x.isNotNull()).alias("results"), of("channel").alias("channel"),
    )
    return found.filter("session is not null and t is not null and tool is not null")


def event_log(spark: SparkSession, path: str) -> DataFrame:
    return read_events(spark.read.option("recursiveFileLookup", "true").text(path))


def ordered_results(searches: DataFrame, results: DataFrame, session: str = "session", kind: str = "mcp") -> DataFrame:
    """(search_id, t, session, results): the results of each search of one channel in order; searches without any are left out. Results have search_id, rank and path.

    A search has a page of results, so a list is short.
    """
    both = searches.filter(F.col("channel") == kind).join(results, "search_id")
    rows = F.array_sort(F.collect_list(F.struct("rank", "path")))
    return both.groupBy("search_id", "t", session).agg(F.transform(rows, lambda x: x["path"]).alias("results"))
