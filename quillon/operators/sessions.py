"""Session logs: JSON lines to tool calls and archive records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clipping import FIELD, clipped_json
from ..functions.text import iso_ms

#: The arguments that say most about a call, best first; their order is the behaviour.
ARGUMENTS = ("command", "file_path", "pattern", "query", "description", "skill", "url", "prompt", "path")
KINDS = ("boundary", "summary", "user", "model", "tool", "result")

BLOCK = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "text", "id", "name", "input", "tool_use_id", "content")] + [T.StructField("is_error", T.BooleanType())])
LINE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("type", "subtype", "uuid", "timestamp", "sessionId", "content", "compactMetadata")]
    + [T.StructField(n, T.BooleanType()) for n in ("isSidechain", "isMeta", "isCompactSummary")]
    + [T.StructField("message", T.StructType([T.StructField("content", T.StringType())]))]
)


def cut(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)


def argument_digest(arguments: Column, limit: int = 200) -> Column:
    """What a call was about: its first known argument, else its first text, else the names of its arguments."""
    fields = F.from_json(arguments, "map<string,string>")
    kinds = F.try_variant_get(F.try_parse_json(arguments), "$", "map<string,variant>")
    is_text = lambda k: F.schema_of_variant(F.element_at(kinds, k)) == "STRING"
    known = F.coalesce(*(F.when(is_text(F.lit(a)), F.trim(F.element_at(fields, F.lit(a)))) for a in ARGUMENTS))
    names = F.array_sort(F.map_keys(fields))
    texts = F.filter(names, is_text)
    first = F.when(F.size(texts) > 0, F.concat_ws("=", F.get(texts, 0), F.trim(F.element_at(fields, F.get(texts, 0)))))
    return cut(F.coalesce(known, first, F.concat(F.lit("("), F.array_join(names, ", "), F.lit(")")), arguments), limit)


def blocks_of(content: Column) -> Column:
    """A message's content blocks; a plain text is one text block."""
    text = F.when(~F.ltrim(content).startswith("["), F.to_json(F.array(F.struct(F.lit("text").alias("type"), content.alias("text")))))
    return F.from_json(F.coalesce(text, content), T.ArrayType(BLOCK))


def calls(lines: DataFrame, value: str = "value", session: str = "session", number: str = "line") -> DataFrame:
    """Tool calls of transcripts (session, line, value), each with its result: the last of its id, error flag, duration in ms."""
    asked = lines.filter(F.col(value).contains('"tool_use"') | F.col(value).contains('"tool_result"'))
    parsed = asked.select(session, number, F.from_json(value, LINE).alias("d")).filter("d.message.content is not null")
    each = parsed.select(session, number, F.col("d.timestamp").alias("at"), F.posexplode(blocks_of(F.col("d.message.content"))).alias("block", "b"))
    uses = each.filter("b.type = 'tool_use' and b.id is not null and b.name is not null").select(
        session, number, "block", F.col("b.id").alias("call_id"), F.col("b.name").alias("tool"), argument_digest(F.col("b.input")).alias("digest"), F.col("at").alias("started")
    )
    results = each.filter("b.type = 'tool_result' and b.tool_use_id is not null").groupBy(session, F.col("b.tool_use_id").alias("call_id")).agg(
        F.max_by(F.struct(F.col("at"), F.coalesce("b.is_error", F.lit(False)).alias("error")), F.struct(number, "block")).alias("_r")
    )
    took = iso_ms(F.col("_r.at")) - iso_ms(F.col("started"))
    return uses.join(results, [session, "call_id"], "left").withColumns({"error": F.coalesce("_r.error", F.lit(False)), "duration_ms": took}).drop("_r")


def records(lines: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Archive records of transcript lines: uuid, block, session, kind, time, time_ms, tool, side, text, and the columns of lines to keep.

    Lines without a uuid or a time, meta lines, blank texts, thinking and images give none; malformed lines give none.
    """
    parsed = lines.filter(F.col(value).contains('"uuid"')).select(F.from_json(value, LINE).alias("d"), *keep).filter("d.uuid is not null and d.timestamp is not null")
    side, summary = F.coalesce("d.isSidechain", F.lit(False)), F.coalesce("d.isCompactSummary", F.lit(False))
    common = [F.col("d.uuid").alias("uuid"), F.coalesce("d.sessionId", F.lit("")).alias("session"), F.col("d.timestamp").alias("time"), iso_ms(F.col("d.timestamp")).alias("time_ms"), side.alias("side"), *keep]
    edge = parsed.filter("d.type = 'system' and d.subtype = 'compact_boundary'").select(
        *common, F.lit(0).alias("block"), F.lit("boundary").alias("kind"), F.lit(None).cast("string").alias("tool"), F.trim(F.concat(F.coalesce("d.content", F.lit("")), F.lit(" "), F.coalesce("d.compactMetadata", F.lit("")))).alias("text")
    )
    talk = parsed.filter(F.col("d.type").isin("user", "assistant") & (summary | ~F.coalesce("d.isMeta", F.lit(False))) & F.col("d.message.content").isNotNull())
    each = talk.select(*common, summary.alias("_summary"), F.col("d.type").alias("_type"), F.posexplode(blocks_of(F.col("d.message.content"))).alias("block", "b"))
    # inputs under the length of one field need no cut, so few go through Python
    each = each.withColumn("_long", clipped_json(F.when((F.col("b.type") == "tool_use") & (F.char_length("b.input") > FIELD), F.col("b.input"))))
    kind = (
        F.when((F.col("b.type") == "text") & (F.trim(F.coalesce("b.text", F.lit(""))) == ""), None)
        .when((F.col("b.type") == "text") & F.col("_summary"), "summary")
        .when((F.col("b.type") == "text") & ~F.col("side"), F.when(F.col("_type") == "user", "user").otherwise("model"))
        .when((F.col("b.type") == "tool_use") & ~F.col("_summary"), "tool")
        .when((F.col("b.type") == "tool_result") & ~F.col("_summary") & ~F.col("side"), "result")
    )
    text = (
        F.when(F.col("b.type") == "text", F.col("b.text"))
        .when(F.col("b.type") == "tool_use", F.coalesce("_long", "b.input", F.lit("")))
        .otherwise(F.concat(F.lit("tool_use_id="), F.coalesce("b.tool_use_id", F.lit("?")), F.lit(" error="), F.coalesce("b.is_error", F.lit(False)).cast("int").cast("string"), F.lit(" length="), result_length(F.col("b.content")).cast("string")))
    )
    tool = F.when(F.col("b.type") == "tool_use", F.coalesce("b.name", F.lit("?")))
    rest = each.withColumns({"kind": kind, "tool": tool, "text": text}).filter("kind is not null").select(*edge.columns)
    return edge.unionByName(rest)


def result_length(content: Column) -> Column:
    """Characters of a result: of the text, or of all texts in its blocks."""
    inner = F.from_json(content, "array<struct<text:string>>")
    many = F.aggregate(inner, F.lit(0), lambda a, x: a + F.coalesce(F.char_length(x["text"]), F.lit(0)))
    return F.when(content.isNull(), F.lit(0)).when(F.ltrim(content).startswith("["), many).otherwise(F.char_length(content))


def kind_ladder(role: Column, text: Column) -> Column:
    """The kind of a plain conversation turn."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", None).when(role == "system", "boundary").when(role == "user", "user").when(role == "assistant", "model")
