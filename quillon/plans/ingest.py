"""Queries of parsers, discovery and streams. SQL has no equal for most, so they are checked by rows only and by tests."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sessions, spool
from ..sources import files, tail
from ..streaming import live
from .common import read


def prose_digest(spark: SparkSession, d: str) -> DataFrame:
    """The first prose of each document read as a README."""
    return read(spark, d, "documents").select("doc_id", files.prose(F.col("text")).alias("digest"))


def front_matter(spark: SparkSession, d: str) -> DataFrame:
    """Parts written as skill files and read back."""
    md = F.concat(F.lit("---\nname: "), F.col("p_name"), F.lit("\ndescription: >\n  "), F.col("p_type"), F.lit("\n  "), F.col("p_brand"), F.lit("\n---\n\nsize "), F.col("p_size"), F.lit("\n"))
    return read(spark, d, "part").select("p_partkey", files.front_matter_of(md).alias("f")).select("p_partkey", "f.name", "f.description", "f.body")


def vector_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Vectors through their byte form and back."""
    rows = read(spark, d, "embeddings").select("vec_id", "embedding", files.blob_of_vector("embedding").alias("blob"))
    return rows.select("vec_id", F.octet_length("blob").alias("n_bytes"), (files.vector_of_blob("blob") == F.col("embedding")).alias("same"))


def clipped_arguments(spark: SparkSession, d: str) -> DataFrame:
    """Long texts inside nested arguments, cut."""
    arguments = F.to_json(F.struct(F.col("role"), F.struct(F.col("text").alias("body"), F.array("text").alias("list")).alias("nested")))
    return read(spark, d, "conversations").select("conv_id", "turn", F.length(files.clipped_json(arguments)).alias("n_chars"))


def server_names(spark: SparkSession, d: str) -> DataFrame:
    """Server names of a tool configuration made of brands; values are never read."""
    config = F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_set(F.struct("p_brand", F.lit("secret"))))).alias("mcpServers")))
    return read(spark, d, "part").groupBy("p_type").agg(config.alias("config")).select("p_type", F.explode(files.server_names(F.col("config"))).alias("server"))


def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files whose size isn't the recorded offset: orders stand for files."""
    now = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.floor("o_totalprice").alias("size"))
    known = read(spark, d, "orders").filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").cast("string").alias("path"), F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(0)).otherwise(F.floor("o_totalprice")).alias("bytes"))
    return files.changed(now, known)


def tail_source(spark: SparkSession, d: str) -> DataFrame:
    """Conversations written as transcripts, followed by byte offset to records by kind; a half-written line at the end waits."""
    tail.register(spark)
    shared = spark._jvm.org.apache.hadoop.fs.Path(spool.shared_dir(spark))
    if shared.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() != "file":
        raise ValueError("the tail source follows files in a mounted folder")
    root = os.path.join(shared.toUri().getPath(), f"tail-{uuid.uuid4().hex}")
    turns = read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    lines = turns.select(F.to_json(F.struct(F.col("role").alias("type"), F.concat_ws("-", "conv_id", "turn").alias("uuid"), F.lit("2026-01-02T03:04:05Z").alias("timestamp"), F.struct(F.col("text").alias("content")).alias("message"))).alias("value"))
    lines.write.text(f"file://{root}/log")
    with open(os.path.join(root, "log", "late.txt"), "w", encoding="utf-8") as f:
        f.write('{"uuid": "half')
    stream = spark.readStream.format("tail").option("path", f"{root}/log").option("suffix", ".txt").load()
    query = stream.writeStream.format("parquet").option("path", f"file://{root}/lines").option("checkpointLocation", f"file://{root}/checkpoint").trigger(processingTime="0 seconds").start()
    query.processAllAvailable()
    query.stop()
    return sessions.records(spark.read.schema(tail.SCHEMA).parquet(f"file://{root}/lines")).groupBy("kind").agg(F.count("*").alias("n_records"))


def live_query(spark: SparkSession, d: str) -> DataFrame:
    """A subscribed count of orders by status: what two changes of the table add, change and delete."""
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    view = "quillon_live_orders"
    orders.createOrReplaceTempView(view)
    subscribed = live.LiveQuery(spark, f"SELECT o_orderstatus, count(*) AS n_orders FROM {view} GROUP BY o_orderstatus", ["orders"], ["o_orderstatus"])
    found: list[DataFrame] = []
    log = lambda rows: spark.createDataFrame(rows, "no bigint, table_name string")
    orders.filter("o_orderstatus <> 'F'").createOrReplaceTempView(view)
    found.append(subscribed.poll(log([(1, "orders")])))
    orders.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", "X").otherwise(F.col("o_orderstatus"))).createOrReplaceTempView(view)
    assert subscribed.poll(log([(2, "part")])) is None
    found.append(subscribed.poll(log([(3, "orders")])))
    both = found[0].withColumn("poll", F.lit(1)).unionByName(found[1].withColumn("poll", F.lit(2)))
    return both.select("poll", "o_orderstatus", "op", F.col("old.n_orders").alias("n_old"), F.col("new.n_orders").alias("n_new"))


QUERIES = {f.__name__: f for f in (prose_digest, front_matter, vector_blobs, clipped_arguments, server_names, changed_files, tail_source, live_query)}
_PROSE = """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\r\\n|\\r|\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')),
      lambda x: NOT (starts_with(x, '#') OR starts_with(x, '```') OR contains(x, '](README'))) AS ls FROM documents),
    u AS (SELECT doc_id, list_transform(ls, lambda x: regexp_replace(x, '<[^>]*>?', '', 'g')) AS ls FROM l),
    p AS (SELECT doc_id, list_transform(ls, lambda x: CASE WHEN len(list_filter(string_split_regex(regexp_replace({out}, '[\\[(].*$', ''), '\\s+'), lambda w: length(w) > 1 AND regexp_matches(w, '\\p{{L}}'))) >= 4
      THEN trim(regexp_replace(translate(regexp_replace(x, '\\]\\([^)]*\\)?', '', 'g'), '*_`[]!>#|', '         '), '\\s+', ' ', 'g')) END) AS ps FROM u),
    f AS (SELECT doc_id, list_reduce(list_prepend({{'parts': []::VARCHAR[], 'line': NULL::VARCHAR, 'done': false}}, list_transform(ps, lambda x: {{'parts': []::VARCHAR[], 'line': x, 'done': false}})),
      lambda s, e: CASE WHEN s.done OR (e.line IS NULL AND len(s.parts) = 0) THEN s WHEN e.line IS NULL THEN {{'parts': s.parts, 'line': NULL::VARCHAR, 'done': true}}
      ELSE {{'parts': list_append(s.parts, e.line), 'line': NULL::VARCHAR, 'done': len(s.parts) >= 2 OR length(array_to_string(list_append(s.parts, e.line), '')) >= 120}} END).parts AS ps FROM p)
    SELECT doc_id, CASE WHEN len(ps) > 0 THEN left(array_to_string(ps, ' '), 300) END AS digest FROM f"""
_OUT = "x"
for _ in range(6):  # deeper brackets than these don't occur in the tables
    _OUT = f"regexp_replace({_OUT}, '[\\[(][^\\[\\]()]*[\\])]', '', 'g')"
_CUT = "CASE WHEN length({0}) > {1} THEN left({0}, {1}) || '…(+' || (length({0}) - {1}) || ' characters)' ELSE {0} END"

ORACLE_SQL = {
    "prose_digest": _PROSE.format(out=_OUT),
    "clipped_arguments": f"""WITH f AS (SELECT conv_id, turn, role, to_json({_CUT.format('text', 2000)})::VARCHAR AS j FROM conversations),
    w AS (SELECT conv_id, turn, '{{"role":' || to_json(role)::VARCHAR || ',"nested":{{"body":' || j || ',"list":[' || j || ']}}}}' AS w FROM f)
    SELECT conv_id, turn, length({_CUT.format('w', 16384)}) AS n_chars FROM w""",
    "front_matter": "SELECT p_partkey, p_name AS name, p_type || ' ' || p_brand AS description, 'size ' || p_size AS body FROM part",
    "vector_blobs": "SELECT vec_id, 4 * len(embedding) AS n_bytes, true AS same FROM embeddings",
    "server_names": "SELECT DISTINCT p_type, lower(p_brand) AS server FROM part",
    "changed_files": """SELECT o_orderkey::VARCHAR AS path, floor(o_totalprice)::BIGINT AS size FROM orders
    WHERE o_orderstatus = 'O' OR (o_orderpriority = '1-URGENT' AND floor(o_totalprice) <> 0)""",
    "tail_source": "SELECT CASE role WHEN 'user' THEN 'user' ELSE 'model' END AS kind, count(*) AS n_records FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '' GROUP BY 1",
    "live_query": """WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)
    SELECT 1 AS poll, o_orderstatus, '-' AS op, n AS n_old, NULL::BIGINT AS n_new FROM c WHERE o_orderstatus = 'F'
    UNION ALL SELECT 2, o_orderstatus, '+', NULL, n FROM c WHERE o_orderstatus = 'F'
    UNION ALL SELECT 2, 'P', '-', n, NULL FROM c WHERE o_orderstatus = 'P' UNION ALL SELECT 2, 'X', '+', NULL, n FROM c WHERE o_orderstatus = 'P'""",
}
