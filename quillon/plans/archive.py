"""Queries of the archive sink, event logs, consumers, vectors made anew and catalogue discovery."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import archive, events, search, vectors
from ..operators.spool import shared_dir
from ..sources import catalogue, files
from ..streaming import consumer
from .common import ms, read, sql_tokens
from .search import _COS, _DOCS, _FNV, _T, FLOOR, LIMIT, QUERY, _bm25_sql, _vectors
from .sessions import _turns
from .store import _LOG, _log


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _local(spark: SparkSession, name: str) -> str:
    """A folder that the driver opens, too."""
    at = spark._jvm.org.apache.hadoop.fs.Path(_place(spark, name))
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() != "file":
        raise ValueError("the driver lists files in a mounted folder")
    return at.toUri().getPath()


def _archived(spark: SparkSession, d: str) -> archive.Archive:
    """Conversations ingested in two batches: the first turns, then all of them from the files' starts, with a malformed line each."""
    c = read(spark, d, "conversations")
    key = F.concat_ws("-", "conv_id", "turn")
    lines = _turns(spark, d).withColumn("uuid", F.get_json_object("value", "$.uuid")).join(c.select(key.alias("uuid"), "conv_id", "turn"), "uuid")
    lines = lines.withColumn("path", F.concat(F.lit("f"), F.col("conv_id") % 3))
    numbered = lambda rows: rows.withColumn("line", F.row_number().over(W.partitionBy("path").orderBy("turn", "conv_id")).cast("bigint")).select("path", "line", "value")
    broken = c.select("conv_id").distinct().select(F.concat(F.lit("f"), F.col("conv_id") % 3).alias("path"), F.lit(1_000_000).cast("bigint").alias("line"), F.lit('{"uuid": "half').alias("value"))
    store = archive.Archive(spark, _place(spark, "archive"))
    store.ingest(numbered(lines.filter("turn < 2")), 0)
    for _ in range(2):  # a batch that is delivered again changes nothing
        store.ingest(numbered(lines).unionByName(broken), 1)
    return store


def archive_records(spark: SparkSession, d: str) -> DataFrame:
    return _archived(spark, d).records().select("uuid", "block", "session", "kind", "path", F.md5("text").alias("text_md5"))


def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    return _archived(spark, d).summaries()


def _calls(spark, d) -> DataFrame:
    e = read(spark, d, "events").withColumn("t", ms("ts"))
    k = F.from_json("props", "k int")["k"].cast("string")
    body = F.concat(F.lit('[{"id":"mcp/x/'), k, F.lit('"},{"id":"s/'), k, F.lit('","aciklama":"about '), k, F.lit('"},{"no":1},{"id":"s/b"},{"id":"s/c"},{"id":"s/d"}]'))
    head = F.concat(F.lit("6 / 9 · 3 ms"), F.when(F.col("event_type") == "view", F.lit(" · kanal: bm25")).otherwise(F.lit("")))
    output = F.when(F.col("event_type") == "click", F.lit("no rows")).otherwise(F.concat(head, F.lit("\n"), body))
    return e.select(
        F.concat(F.lit("u"), F.col("user_id") % 5).alias("session"), F.when(F.col("user_id") % 2 == 0, "shell").alias("interface"), F.col("t").alias("time_ms"), F.col("event_type").alias("tool"),
        F.create_map(F.lit("query"), F.concat(F.lit("find "), k), F.lit("long"), F.repeat(F.lit("x"), 600)).alias("arguments"), output.alias("output"),
        F.when(F.col("event_type") == "error", "failed").alias("error"), F.floor("value").cast("bigint").alias("took_ms"), "event_id",
    )


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """Calls appended to a log and read back."""
    at = _place(spark, "events")
    if not events.append_events(_calls(spark, d), at):
        raise RuntimeError("the log wasn't written")
    found = events.event_log(spark, at)
    return found.groupBy("session", "interface", "tool", "digest", F.array_join("results", ",").alias("results"), "channel").agg(F.count("*").alias("n_events"), F.sum("t").alias("t_sum"))


def hot_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The first three results of each search's output that aren't tools."""
    return _calls(spark, d).select("event_id", F.posexplode(events.hot_candidates(F.col("output"))).alias("rank", "c")).select("event_id", "rank", "c.id", "c.about")


def search_results(spark: SparkSession, d: str) -> DataFrame:
    """Searches of one channel with their results in order."""
    e = read(spark, d, "events").withColumn("t", ms("ts")).filter("event_type = 'view'")
    searches = e.select(F.col("event_id").alias("search_id"), "t", F.col("user_id").alias("session"), F.when(F.col("value") > 20, "mcp").otherwise("shell").alias("channel"))
    results = e.select(F.col("event_id").alias("search_id"), F.explode(F.slice(F.sequence(F.lit(9), F.lit(1), F.lit(-1)), 1, (F.col("event_id") % 6).cast("int"))).alias("rank"))
    results = results.withColumn("path", F.concat_ws("/", F.lit("p"), "search_id", "rank"))
    return events.ordered_results(searches, results).select("search_id", "t", "session", F.array_join("results", ",").alias("results"))


def consumer_polls(spark: SparkSession, d: str) -> DataFrame:
    """Three polls of a consumer that stood at 1200, and none of one that begins at the log's end."""
    log = _log(spark, d)
    cursors = consumer.Cursors(spark, _place(spark, "cursors"))
    cursors.write("slow", 1200)
    found: list[DataFrame] = []
    for name in ("slow", "new"):
        one = consumer.Consumer(cursors, name, lambda: log)
        for poll in range(3):
            one.poll(lambda rows: found.append(rows.select(F.lit(name).alias("consumer"), F.lit(poll).alias("poll"), "no", "op", "row_key")))
    ends = cursors.table().select("consumer", F.lit(-1).alias("poll"), F.col("cursor").alias("no"), F.lit("cursor").alias("op"), F.lit("").alias("row_key"))
    return reduce(DataFrame.unionByName, found, ends)


def regenerated_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose vectors are of this kernel and content, of another one, or missing; the latter two are made anew."""
    p = vectors.spread(read(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand"))
    key = hashing.content_key(F.col("p_name"), F.col("p_type"), F.col("p_brand"))
    rows = p.select(F.col("p_partkey").alias("id"), vectors.document_text(F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("text"), key.alias("content_key"))
    kind = F.col("id") % 3
    rows = rows.withColumn("vector", F.when(kind < 2, F.array(F.lit(0.5).cast("float")))).withColumn("signature", F.when(kind < 2, hashing.signature(F.when(kind == 0, vectors.HASH_KERNEL).otherwise("old"), F.col("content_key"))))
    made = vectors.regenerated(rows, vectors.hash_kernel)
    cells = F.size(F.array_remove("vector", F.lit(0).cast("float"))).cast("bigint")
    return made.select("id", "regenerated", F.size("vector").alias("dims"), cells.alias("n_cells"), F.left("signature", F.lit(8)).alias("kernel"))


def vector_answers(spark: SparkSession, d: str) -> DataFrame:
    """The vector channel first, and here it answers, so the text channel isn't asked."""
    from ..functions import text

    near, query = _vectors(spark, d)
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), text.tokens("text").alias("tokens"))
    return search.first_that_answers(search.cosine(near, query, FLOOR, LIMIT), search.bm25(docs, text.query_tokens(QUERY), LIMIT))


def snapshot_read(spark: SparkSession, d: str) -> DataFrame:
    """Orders by status from a copy."""
    copy = catalogue.snapshot(spark, f"{d}/orders.parquet", _place(spark, "snapshot"))
    return copy.groupBy("o_orderstatus").agg(F.count("*").alias("n_orders"))


def tool_cache(spark: SparkSession, d: str) -> DataFrame:
    """Cached listings of servers: brands with the names of their parts as tools; half of the servers are configured."""
    at = _place(spark, "tools")
    tools = F.sort_array(F.collect_list(F.struct(F.concat_ws("-", "p_name", "p_partkey").alias("name"), F.col("p_type").alias("description"))))
    listed = read(spark, d, "part").groupBy("p_brand").agg(F.to_json(F.struct(F.col("p_brand").alias("name"), tools.alias("tools"))).alias("value"))
    listed.write.partitionBy("p_brand").text(at)
    known = [r["p_brand"].lower() for r in listed.select("p_brand").toLocalIterator() if int(r["p_brand"][-1]) % 2]
    return files.tool_cache(spark, at, known, glob="*.txt")


def repositories(spark: SparkSession, d: str) -> DataFrame:
    """Nations as repositories in folders of their regions; one has a repository inside, which isn't looked for."""
    root = _local(spark, "repositories")
    both = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    for n, name, region in sorted(map(tuple, both.collect())):  # of fixed size: there are 25
        here = os.path.join(root, region, name)
        for p in (".git", "inner/.git", "src"):
            os.makedirs(os.path.join(here, p))
        texts = {".git/config": f"[remote]\n url = https://x/{name}.git\n" if n % 2 else "[core]\n", "README.md": f"# {name}\n\n[![a b c d](e)](f)\nThe *land* of {name} lies in {region}.\n", "Cargo.toml": f'[package]\nname = "n{n}"\n'}
        for p, text in texts.items():
            with open(os.path.join(here, p), "w", encoding="utf-8") as f:
                f.write(text)
    return files.repositories(spark, root).select("id", "name", "remote", "digest", F.array_join("names", ",").alias("names"))


def table_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns and types of the tables."""
    tables = {n: read(spark, d, n) for n in ("region", "nation", "customer", "part", "orders", "lineitem", "documents", "labels")}
    return spark.createDataFrame(files.schema_table(tables), "table_name string, column_name string, type string")


def document_keys(spark: SparkSession, d: str) -> DataFrame:
    """Content keys of whole documents."""
    return read(spark, d, "documents").select("doc_id", hashing.content_key(F.col("source"), F.col("lang"), F.col("text")).alias("content_key"))


def document_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Hash embeddings of documents: how many cells hold something, the fullest, and its weight."""
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("id"), vectors.document_text(F.col("source"), F.col("lang"), F.col("text")).alias("text"))
    made = vectors.hash_kernel(rows)
    top = F.array_max("vector")
    return made.select(F.col("id").alias("doc_id"), F.size(F.filter("vector", lambda x: x != 0)).cast("bigint").alias("n_cells"), F.round(top.cast("double"), 4).alias("top_weight"))


QUERIES = {
    f.__name__: f
    for f in (
        archive_records, ingest_summary, event_log, hot_candidates, search_results, consumer_polls, regenerated_vectors, vector_answers, snapshot_read, tool_cache,
        repositories, table_columns, document_keys, document_embeddings,
    )
}

_K = "json_extract(props, '$.k')::INT"
_MS = "(epoch_us(ts) // 1000)"
_KEY = _FNV.format("s", 14695981039346656037, 1099511628211, 18446744073709551616)
_PART_CELLS = f"""t AS (SELECT p_partkey AS id, unnest({sql_tokens("p_name || ' ' || p_name || ' ' || p_type || ' ' || left(p_brand, 2000)")}) AS t FROM part),
    k AS (SELECT id, 't:' || t AS s FROM t UNION ALL SELECT id, 'g:' || substring(t, i, 3) FROM (SELECT id, t, unnest(range(1, greatest(length(t) - 2, 1) + 1)) AS i FROM t)),
    h AS (SELECT s, ({_KEY} % 256)::BIGINT AS cell FROM (SELECT DISTINCT s FROM k)), c AS (SELECT id, count(DISTINCT cell) AS n FROM k JOIN h USING (s) GROUP BY 1)"""
_DOC_CELLS = f"""t AS (SELECT doc_id AS id, unnest({sql_tokens("concat_ws(' ', source, source, lang, left(text, 2000))")}) AS t FROM documents),
    k AS (SELECT id, 't:' || t AS s, 1.0::DOUBLE AS w FROM t UNION ALL SELECT id, 'g:' || substring(t, i, 3), 0.5 FROM (SELECT id, t, unnest(range(1, greatest(length(t) - 2, 1) + 1)) AS i FROM t)),
    h AS (SELECT s, ({_KEY.replace('(s)::BLOB', 'encode(s)')} % 256)::BIGINT AS cell FROM (SELECT DISTINCT s FROM k)),
    c AS (SELECT id, cell, greatest(ln(sum(w)) + 1, 0) AS w FROM k JOIN h USING (s) GROUP BY id, cell)"""
ORACLE_SQL = {
    "archive_records": """WITH k AS (SELECT *, conv_id || '-' || turn AS uuid FROM conversations)
    SELECT uuid, 0 AS block, conv_id::VARCHAR AS session, CASE role WHEN 'system' THEN 'boundary' WHEN 'user' THEN 'user' ELSE 'model' END AS kind, 'f' || (conv_id % 3) AS path,
      md5(CASE WHEN role = 'system' THEN trim(text) ELSE text END) AS text_md5 FROM k WHERE role = 'system' OR trim(text) <> ''""",
    "ingest_summary": """WITH k AS (SELECT *, role = 'system' OR trim(text) <> '' AS held FROM conversations)
    SELECT 0::BIGINT AS batch, count(*) AS n_lines, 0::BIGINT AS n_malformed, count(*) FILTER (WHERE held) AS n_new, 0::BIGINT AS n_restarted FROM k WHERE turn < 2
    UNION ALL SELECT 1, count(*) + count(DISTINCT conv_id), count(DISTINCT conv_id), count(*) FILTER (WHERE held AND turn >= 2), count(DISTINCT conv_id % 3) FILTER (WHERE held AND turn < 2) FROM k""",
    "event_log": f"""SELECT 'u' || (user_id % 5) AS session, CASE WHEN user_id % 2 = 0 THEN 'shell' ELSE 'bilinmiyor' END AS interface, event_type AS tool, 'find ' || {_K} AS digest,
    CASE WHEN event_type IN ('click', 'error') THEN '' ELSE 'mcp/x/' || {_K} || ',s/' || {_K} || ',s/b,s/c,s/d' END AS results, CASE WHEN event_type = 'view' THEN 'bm25' END AS channel,
    count(*) AS n_events, sum({_MS})::BIGINT AS t_sum FROM events GROUP BY ALL""",
    "hot_candidates": f"""SELECT event_id, unnest([0, 1, 2]) AS rank, unnest(['s/' || {_K}, 's/b', 's/c']) AS id, unnest(['about ' || {_K}, '', '']) AS about FROM events WHERE event_type <> 'click'""",
    "search_results": f"""WITH s AS (SELECT event_id AS search_id, {_MS} AS t, user_id AS session FROM events WHERE event_type = 'view' AND value > 20 AND event_id % 6 > 0)
    SELECT search_id, t, session, array_to_string(list_transform(range((10 - search_id % 6)::BIGINT, 10), lambda r: 'p/' || search_id || '/' || r), ',') AS results FROM s""",
    "consumer_polls": f"""{_LOG} SELECT 'slow' AS consumer, ((no - 1201) // 500)::INT AS poll, no, op, row_key FROM log WHERE no BETWEEN 1201 AND 2700
    UNION ALL SELECT 'slow', -1, least(max(no), 2700), 'cursor', '' FROM log UNION ALL SELECT 'new', -1, max(no), 'cursor', '' FROM log""",
    "regenerated_vectors": f"""WITH {_PART_CELLS} SELECT p_partkey AS id, p_partkey % 3 <> 0 AS regenerated, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 256 END AS dims,
    CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE n END AS n_cells, 'hash256:' AS kernel FROM part JOIN c ON c.id = p_partkey""",
    "vector_answers": f"""
    WITH c AS (SELECT * FROM ({_COS}) WHERE score > {FLOOR} ORDER BY score DESC, id LIMIT {LIMIT}), b AS ({_bm25_sql(_DOCS, _T, LIMIT)})
    SELECT id, score, 'vector' AS channel FROM c UNION ALL SELECT id, score, 'bm25' FROM b WHERE NOT EXISTS (SELECT 1 FROM c)""",
    "snapshot_read": "SELECT o_orderstatus, count(*) AS n_orders FROM orders GROUP BY 1",
    "tool_cache": "SELECT lower(p_brand) AS server, p_name || '-' || p_partkey AS tool, p_type AS description, right(p_brand, 1)::INT % 2 = 1 AS known FROM part",
    "repositories": """SELECT r_name || '/' || n_name AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 1 THEN 'https://x/' || n_name || '.git' END AS remote,
    'The land of ' || regexp_replace(trim(regexp_replace(translate(n_name, '*_`[]!>#|', '         '), '\\s+', ' ', 'g')), '$', '') || ' lies in ' || r_name || '.' AS digest, 'n' || n_nationkey AS names FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "table_columns": """SELECT table_name, column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' ELSE 'timestamp_ntz' END AS type
    FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'part', 'orders', 'lineitem', 'documents', 'labels')""",
    "document_embeddings": f"""WITH {_DOC_CELLS}, n AS (SELECT id, count(*) AS n_cells, round((max(w) / sqrt(sum(w * w)))::FLOAT::DOUBLE, 4) AS top_weight FROM c GROUP BY 1)
    SELECT doc_id, coalesce(n_cells, 0) AS n_cells, coalesce(top_weight, 0) AS top_weight FROM documents LEFT JOIN n ON id = doc_id""",
}
