"""Queries of session logs, attribution joins, state and text functions.

Events stand for a session log: the user is the session, the type the tool, a view is a search. Events are sparse, so
tolerances are hours here; the operators' defaults stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import attribution, sessions, state
from ..sources import files
from .common import ms, read, sql_tokens

HOUR = 3_600_000
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _events(spark, d) -> DataFrame:
    return read(spark, d, "events").withColumn("t", ms("ts"))


def json_args(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n_calls"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


def arg_digest(spark: SparkSession, d: str) -> DataFrame:
    """Digests of three shapes of arguments: a known key, a text under another key, no text."""
    shapes = (
        F.when(F.col("p_type") == "ECONOMY", F.to_json(F.struct(F.col("p_size").alias("n"), F.col("p_name").alias("pattern"), F.lit(" go ").alias("command"))))
        .when(F.col("p_type") == "SMALL", F.to_json(F.struct(F.col("p_size").alias("a"), F.col("p_name").alias("label"))))
        .otherwise(F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_partkey").alias("key"))))
    )
    return read(spark, d, "part").select("p_partkey", sessions.argument_digest(shapes).alias("digest"))


def _lines(spark, d) -> DataFrame:
    """Each event as a tool call, and for values under 50 its result, as transcript lines."""
    e = _events(spark, d)
    stamp = lambda x: F.date_format(F.timestamp_millis(x), ISO)
    identifier = F.concat(F.lit("c"), F.col("event_id"))
    use = F.struct(F.lit("tool_use").alias("type"), identifier.alias("id"), F.col("event_type").alias("name"), F.from_json("props", "k int").alias("input"))
    result = F.struct(F.lit("tool_result").alias("type"), identifier.alias("tool_use_id"), (F.col("event_type") == "error").alias("is_error"))
    line = lambda at, block: F.to_json(F.struct(stamp(at).alias("timestamp"), F.struct(F.array(block).alias("content")).alias("message")))
    session = F.col("user_id").cast("string").alias("session")
    a = e.select(session, (F.col("event_id") * 2).alias("line"), line(F.col("t"), use).alias("value"))
    b = e.filter("value < 50").select(session, (F.col("event_id") * 2 + 1).alias("line"), line(F.col("t") + F.floor(F.col("value") * 1000), result).alias("value"))
    return a.unionByName(b).unionByName(e.filter("event_type = 'view'").select(session, F.col("event_id").alias("line"), F.lit('{"half": "tool_use').alias("value")))


def call_result_pairs(spark: SparkSession, d: str) -> DataFrame:
    return sessions.calls(_lines(spark, d)).select("session", "call_id", "tool", "digest", "error", "duration_ms")


def _turns(spark, d) -> DataFrame:
    """Conversations as transcript lines; system turns are compaction boundaries."""
    c = read(spark, d, "conversations")
    kind = F.when(F.col("role") == "system", "system").otherwise(F.col("role"))
    row = F.struct(
        kind.alias("type"), F.when(F.col("role") == "system", "compact_boundary").alias("subtype"), F.concat_ws("-", "conv_id", "turn").alias("uuid"),
        F.lit("2026-01-02T03:04:05.678Z").alias("timestamp"), F.col("conv_id").cast("string").alias("sessionId"),
        F.when(F.col("role") == "system", F.col("text")).alias("content"), F.when(F.col("role") != "system", F.struct(F.col("text").alias("content"))).alias("message"),
    )
    return c.select(F.to_json(row).alias("value"))


def record_kinds(spark: SparkSession, d: str) -> DataFrame:
    return sessions.records(_turns(spark, d)).select("uuid", "block", "session", "kind", "time_ms", F.char_length("text").alias("n_chars"))


def tool_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Conversation texts, repeated until they are long, as inputs of tool calls: long fields are cut one by one, and the whole."""
    c = read(spark, d, "conversations")
    long = F.repeat("text", F.when(F.col("turn") % 2 == 0, 60).otherwise(1))
    block = F.struct(F.lit("tool_use").alias("type"), F.lit("Write").alias("name"), F.struct(long.alias("body"), F.col("turn").alias("n"), F.array_repeat(long, 9).alias("parts")).alias("input"))
    row = F.struct(F.lit("assistant").alias("type"), F.concat_ws("-", "conv_id", "turn").alias("uuid"), F.lit("2026-01-02T03:04:05.678Z").alias("timestamp"), F.struct(F.array(block).alias("content")).alias("message"))
    return sessions.records(c.select(F.to_json(row).alias("value"))).select("uuid", "kind", "tool", F.char_length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return sessions.records(_turns(spark, d)).groupBy("kind").agg(F.count("*").alias("n_records"))


def turn_kinds(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", sessions.kind_ladder(F.col("role"), F.col("text")).alias("kind"))


def log_summary(spark: SparkSession, d: str) -> DataFrame:
    """Calls, errors and the latest time of each session."""
    return _events(spark, d).groupBy("user_id").agg(F.count("*").alias("n_calls"), F.sum((F.col("event_type") == "error").cast("int")).alias("n_errors"), F.max("t").alias("last_ms"))


def insert_calls(spark: SparkSession, d: str) -> DataFrame:
    """Copied lines dropped: the first row of each (session, kind, argument) key, in order of time."""
    from ..operators import sync

    rows = _events(spark, d).select("event_id", "user_id", "event_type", "props", "t")
    return sync.insert_if_absent(rows.limit(0), rows, ["user_id", "event_type", "props"], ["t", "event_id"]).select("user_id", "event_type", "props", "event_id")


def asof_match(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    left = e.filter("event_type = 'view'").select(F.col("event_id").alias("search_id"), "user_id", "t")
    right = e.filter("event_type = 'click'").select(F.col("event_id").alias("call_id"), "user_id", "t")
    return attribution.nearest(left, right, ["user_id"], 6 * HOUR, "search_id", "call_id")


def event_match(spark: SparkSession, d: str) -> DataFrame:
    """Each view with the nearest click of any session that has its argument, as tool and digest; ties go by session and time."""
    e = _events(spark, d).withColumns({"tool": F.lit("page"), "digest": _k().cast("string"), "t": F.floor(F.col("t") / HOUR) * HOUR})
    left = e.filter("event_type = 'view'").select(F.col("event_id").alias("search_id"), "tool", "digest", "t")
    right = e.filter("event_type = 'click'").select(F.col("event_id").alias("call_id"), "tool", "digest", "user_id", "t")
    return attribution.nearest(left, right, ["tool", "digest"], 6 * HOUR, "search_id", "call_id", tie=["user_id"])


def match_totals(spark: SparkSession, d: str) -> DataFrame:
    searches = _events(spark, d).filter("event_type = 'view'").select(F.col("event_id").alias("search_id"))
    matched = searches.join(asof_match(spark, d).select("search_id", F.lit(1).alias("_m")), "search_id", "left")
    return matched.agg(F.count("*").alias("n_searches"), F.count("_m").alias("n_matched"), F.count_if(F.col("_m").isNull()).alias("n_unmatched"))


def window_use(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("event_id", "user_id", "t", "event_type")
    return attribution.uses_until_next(e, "user_id", F.col("event_type") == "view", 12 * HOUR)


def _k():
    return F.from_json("props", "k int")["k"]


def first_use(spark: SparkSession, d: str) -> DataFrame:
    """Views find a file by its Windows path, purchases and clicks name it in two other ways."""
    e = _events(spark, d)
    results = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("search_id"), "t", F.lit(1).alias("rank"), F.concat(F.lit("C:\\repo\\k"), _k(), F.lit(".rs")).alias("path"))
    said = F.when(F.col("event_type") == "click", F.concat(F.lit("cat /c/repo/k"), _k(), F.lit(".rs | head"))).otherwise(F.concat(F.lit('{"file":"c:/Repo//k'), _k(), F.lit('.rs"}')))
    calls = e.filter("event_type in ('click', 'purchase')").select("user_id", F.col("event_id").alias("call_id"), "t", said.alias("text"))
    return attribution.first_use(results, calls, "user_id").select("search_id", "path", "call_id", "t")


def touched_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return attribution.touched(e, "user_id", (F.col("event_type") == "error") & (F.col("value") > 60)).groupBy("user_id").agg(F.count("*").alias("n_calls"))


def attribution_report(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    searches = e.filter("event_type = 'view'").select(F.col("event_id").alias("search_id"), F.when(F.col("value") > 5, F.col("user_id")).alias("session"))
    results = e.filter("event_type = 'view' and value < 40").select(F.col("event_id").alias("search_id"))
    calls = e.filter("event_type = 'purchase' and value > 30").select(F.col("user_id").alias("session"))
    return attribution.report(searches, results, calls, "session")


def used_results(spark: SparkSession, d: str) -> DataFrame:
    """Whether calls named after parts use the results named after their brands."""
    p = read(spark, d, "part")
    identifier = F.when(F.col("p_type") == "SMALL", F.concat(F.lit("skills/x/"), F.col("p_name"))).otherwise(F.concat(F.lit("mcp/Ring/"), F.col("p_brand")))
    tool = F.when(F.col("p_type") == "SMALL", "Skill").otherwise(F.concat(F.lit("mcp__my_ring__"), F.lower("p_brand")))
    return p.select("p_partkey", attribution.uses_result(identifier, tool, F.concat(F.lit("a:"), F.col("p_name"))).alias("used"))


def hot_set(spark: SparkSession, d: str) -> DataFrame:
    """Times are whole days, so that many uses are exactly as old as the time to live allows."""
    uses = _events(spark, d).select("user_id", F.concat_ws("-", "event_type", _k().cast("string")).alias("name"), F.floor(F.col("t") / (24 * HOUR)).alias("t"))
    return state.hot_set(uses, "user_id", "name", ttl=20)


def mailbox_waiting(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return state.waiting(e.filter("event_type = 'click'").select("user_id", "t"), e.filter("event_type = 'view'").select("user_id", "t"), "user_id")


def fold_tokens(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.size(text.tokens("text")).alias("n_tokens"), F.md5(F.array_join(text.stems(text.tokens("text")), " ")).alias("stems_md5"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.char_length(text.plain_html("html")).alias("n_chars"), F.md5(text.plain_html("html")).alias("text_md5"))


def readme_lines(spark: SparkSession, d: str) -> DataFrame:
    """Page lines as README lines: without tags, link targets and markers."""
    return read(spark, d, "pages").select("page_id", F.md5(text.plain_line("html")).alias("line_md5"))


def clip_say(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.clip("text", 80).alias("clipped"), text.snippet("text", 40).alias("snippet"))


def tags(spark: SparkSession, d: str) -> DataFrame:
    joined = F.concat_ws(" , ", "p_brand", F.lit(""), "p_name", "p_type")
    return read(spark, d, "part").select("p_partkey", F.explode(text.tags(joined)).alias("tag"))


def sanitise_name(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", text.tool_name("url").alias("tool_name"))


def path_id(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?://|[?#].*$", "")
    return read(spark, d, "pages").select("page_id", text.path_id(F.lit("web"), F.concat(F.lit("skills/"), path)).alias("path_id"), text.normal_path(F.concat(F.lit("C:\\\\"), F.col("url"))).alias("normal_path"))


def iso_times(spark: SparkSession, d: str) -> DataFrame:
    """ISO times with three endings; only Z is read."""
    base = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    stamp = F.when(F.col("event_type") == "error", F.concat(base, F.lit("+03:00"))).when(F.col("event_type") == "view", F.concat(F.left(base, F.lit(19)), F.lit("Z"))).otherwise(F.concat(base, F.lit("Z")))
    return read(spark, d, "events").select("event_id", text.iso_ms(stamp).alias("t"))


def manifest_names(spark: SparkSession, d: str) -> DataFrame:
    """Names in manifest lines."""
    manifest = F.concat(F.lit("[package]\nname = \""), F.col("p_name"), F.lit("\"\nversion = \"1\"\n[[bin]]\nname=\""), F.col("p_brand"), F.lit("\"\n"))
    return read(spark, d, "part").select("p_partkey", F.array_join(files.manifest_names(manifest), "|").alias("names"))


QUERIES = {
    f.__name__: f
    for f in (
        json_args, arg_digest, call_result_pairs, record_kinds, tool_inputs, kind_counts, turn_kinds, log_summary, insert_calls, asof_match, event_match, match_totals, window_use, first_use,
        touched_sessions, attribution_report, used_results, hot_set, mailbox_waiting, fold_tokens, html_text, readme_lines, clip_say, tags, sanitise_name, path_id,
        iso_times, manifest_names,
    )
}

_T = "(epoch_us(ts) // 1000)"
_K = "json_extract(props, '$.k')::INT"
_ASOF = f"""p AS (SELECT a.event_id AS search_id, b.event_id AS call_id, abs((epoch_us(a.ts) // 1000) - (epoch_us(b.ts) // 1000)) AS gap_ms, (epoch_us(b.ts) // 1000) AS u FROM events a JOIN events b USING (user_id)
  WHERE a.event_type = 'view' AND b.event_type = 'click' AND abs((epoch_us(a.ts) // 1000) - (epoch_us(b.ts) // 1000)) <= {6 * HOUR}),
  m AS (SELECT search_id, call_id, gap_ms FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY gap_ms, u, call_id) AS r FROM p) WHERE r = 1)"""
_KINDS = """SELECT conv_id || '-' || turn AS uuid, 0 AS block, conv_id::VARCHAR AS session, CASE role WHEN 'system' THEN 'boundary' WHEN 'user' THEN 'user' ELSE 'model' END AS kind,
  1767323045678 AS time_ms, length(CASE WHEN role = 'system' THEN trim(text) ELSE text END) AS n_chars FROM conversations WHERE role = 'system' OR trim(text) <> ''"""
_CUT = "CASE WHEN length({0}) > {1} THEN left({0}, {1}) || '…(+' || (length({0}) - {1}) || ' characters)' ELSE {0} END"
_HTML = "trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))"

ORACLE_SQL = {
    "json_args": f"SELECT event_type, count(*) AS n_calls, sum({_K})::BIGINT AS k_sum, max({_K}) AS k_max FROM events GROUP BY 1",
    "arg_digest": "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'go' WHEN 'SMALL' THEN 'label=' || trim(p_name) ELSE '(key, size)' END AS digest FROM part",
    "call_result_pairs": """SELECT user_id::VARCHAR AS session, 'c' || event_id AS call_id, event_type AS tool, '(k)' AS digest, event_type = 'error' AND value < 50 AS error,
    CASE WHEN value < 50 THEN floor(value * 1000)::BIGINT END AS duration_ms FROM events""",
    "record_kinds": _KINDS,
    "tool_inputs": f"""WITH t AS (SELECT conv_id || '-' || turn AS uuid, turn, repeat(text, CASE WHEN turn % 2 = 0 THEN 60 ELSE 1 END) AS x FROM conversations WHERE text IS NOT NULL),
    f AS (SELECT uuid, turn, to_json({_CUT.format('x', 2000)})::VARCHAR AS j FROM t),
    w AS (SELECT uuid, '{{"body":' || j || ',"n":' || turn || ',"parts":[' || array_to_string(list_transform(range(9), lambda i: j), ',') || ']}}' AS w FROM f),
    o AS (SELECT uuid, {_CUT.format('w', 16384)} AS o FROM w)
    SELECT uuid, 'tool' AS kind, 'Write' AS tool, length(o) AS n_chars, md5(o) AS text_md5 FROM o""",
    "kind_counts": f"SELECT kind, count(*) AS n_records FROM ({_KINDS}) GROUP BY 1",
    "turn_kinds": "SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN NULL WHEN role = 'system' THEN 'boundary' WHEN role = 'user' THEN 'user' WHEN role = 'assistant' THEN 'model' END AS kind FROM conversations",
    "log_summary": f"SELECT user_id, count(*) AS n_calls, sum((event_type = 'error')::INT)::BIGINT AS n_errors, max({_T}) AS last_ms FROM events GROUP BY 1",
    "insert_calls": f"SELECT user_id, event_type, props, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY {_T}, event_id) AS r FROM events) WHERE r = 1",
    "asof_match": f"WITH {_ASOF} SELECT search_id, call_id, gap_ms FROM m",
    "event_match": f"""WITH e AS (SELECT event_id, event_type, user_id, {_K} AS k, {_T} // {HOUR} * {HOUR} AS t FROM events),
    p AS (SELECT a.event_id AS search_id, b.event_id AS call_id, abs(a.t - b.t)::BIGINT AS gap_ms, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - b.t), b.user_id, b.t, b.event_id) AS r
      FROM e a JOIN e b ON a.k = b.k AND a.event_type = 'view' AND b.event_type = 'click' AND abs(a.t - b.t) <= {6 * HOUR})
    SELECT search_id, call_id, gap_ms FROM p WHERE r = 1""",
    "match_totals": f"WITH {_ASOF} SELECT count(*) AS n_searches, count(call_id) AS n_matched, count(*) - count(call_id) AS n_unmatched FROM (SELECT event_id AS search_id FROM events WHERE event_type = 'view') LEFT JOIN m USING (search_id)",
    "window_use": f"""WITH s AS (SELECT event_id, {_T} AS t, event_type, max(CASE WHEN event_type = 'view' THEN {_T}::HUGEINT * 1000000000 + event_id END)
      OVER (PARTITION BY user_id ORDER BY {_T}, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM events)
    SELECT (v % 1000000000)::BIGINT AS search_id, event_id FROM s WHERE event_type <> 'view' AND v IS NOT NULL AND t - (v // 1000000000) BETWEEN 1 AND {12 * HOUR}""",
    "first_use": f"""WITH v AS (SELECT event_id AS search_id, user_id, {_T} AS t, {_K} AS k FROM events WHERE event_type = 'view'),
    c AS (SELECT event_id AS call_id, user_id, {_T} AS t, {_K} AS k FROM events WHERE event_type IN ('click', 'purchase'))
    SELECT search_id, 'C:\\repo\\k' || k || '.rs' AS path, call_id, t FROM (SELECT search_id, v.k, call_id, c.t, row_number() OVER (PARTITION BY search_id ORDER BY c.t, call_id) AS r
    FROM v JOIN c ON v.user_id = c.user_id AND v.k = c.k AND c.t > v.t) WHERE r = 1""",
    "touched_sessions": "SELECT user_id, count(*) AS n_calls FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 60) GROUP BY 1",
    "attribution_report": """WITH s AS (SELECT event_id, CASE WHEN value > 5 THEN user_id END AS session, value FROM events WHERE event_type = 'view')
    SELECT count(*) AS searches, count(*) - count(session) AS no_session, count(*) FILTER (WHERE value < 40 AND session IS NOT NULL
      AND session NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 30)) AS no_archive FROM s""",
    "used_results": "SELECT p_partkey, true AS used FROM part",
    "hot_set": f"""WITH l AS (SELECT user_id, event_type || '-' || {_K} AS name, max({_T} // {24 * HOUR}) AS last_ms, count(*) AS n_uses FROM events GROUP BY 1, 2),
    a AS (SELECT *, max(last_ms) OVER (PARTITION BY user_id) AS now FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_ms DESC, name) AS rank FROM a WHERE now - last_ms < 20)
    SELECT user_id, name, last_ms, n_uses, rank FROM r WHERE rank <= {state.CAP}""",
    "mailbox_waiting": f"""WITH p AS (SELECT user_id, max({_T}) AS t FROM events WHERE event_type = 'view' GROUP BY 1)
    SELECT e.user_id, count(*) AS waiting FROM events e LEFT JOIN p ON p.user_id = e.user_id WHERE event_type = 'click' AND (p.t IS NULL OR (epoch_us(e.ts) // 1000) > p.t) GROUP BY 1""",
    "fold_tokens": f"SELECT doc_id, len(ts) AS n_tokens, md5(array_to_string(list_transform(ts, lambda t: left(t, 5)), ' ')) AS stems_md5 FROM (SELECT doc_id, {sql_tokens('text')} AS ts FROM documents)",
    "html_text": f"SELECT page_id, length({_HTML}) AS n_chars, md5({_HTML}) AS text_md5 FROM pages",
    "readme_lines": "SELECT page_id, md5(trim(regexp_replace(translate(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\\]\\([^)]*\\)?', '', 'g'), '*_`[]!>#|', '         '), '\\s+', ' ', 'g'))) AS line_md5 FROM pages",
    "clip_say": "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '…(+' || (length(text) - 80) || ' characters)' ELSE text END AS clipped, CASE WHEN length(text) > 40 THEN left(text, 40) || '…' ELSE text END AS snippet FROM documents",
    "tags": "SELECT p_partkey, trim(tag) AS tag FROM (SELECT p_partkey, unnest(string_split(p_brand || ' ,  , ' || p_name || ' , ' || p_type, ',')) AS tag FROM part) WHERE trim(tag) <> ''",
    "sanitise_name": "SELECT page_id, left('y_' || regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), 64) AS tool_name FROM pages",
    "path_id": """WITH p AS (SELECT page_id, url, list_filter(string_split('skills/' || regexp_replace(url, '^https?://|[?#].*$', '', 'g'), '/'), lambda x: x <> '' AND x <> 'skills' AND NOT regexp_matches(x, '^[0-9]')) AS xs FROM pages)
    SELECT page_id, CASE WHEN len(xs) = 0 THEN 'web' ELSE 'web/' || array_to_string(xs, '/') END AS path_id, regexp_replace('c:/' || lower(url), '/+', '/', 'g') AS normal_path FROM p""",
    "iso_times": f"SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN {_T} // 1000 * 1000 ELSE {_T} END AS t FROM events",
    "manifest_names": "SELECT p_partkey, p_name || '|' || p_brand AS names FROM part",
}
