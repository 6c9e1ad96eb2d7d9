"""Queries of the store, snapshot synchronisation and the change log.

Snapshots of the orders table stand for two states of a catalogue: the old one ends
before 1998, the new one begins in 1993 and has urgent orders under another status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import changes, store, sync
from .common import read

OLD_BEFORE, NEW_FROM = "1998-01-01", "1993-01-01"


def _old(spark, d) -> DataFrame:
    return read(spark, d, "orders").filter(F.col("o_orderdate") < F.to_timestamp(F.lit(OLD_BEFORE))).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


def _new(spark, d) -> DataFrame:
    rows = read(spark, d, "orders").filter(F.col("o_orderdate") >= F.to_timestamp(F.lit(NEW_FROM)))
    status = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat("o_orderstatus", F.lit("!"))).otherwise(F.col("o_orderstatus"))
    return rows.select("o_orderkey", "o_custkey", status.alias("o_orderstatus"), "o_orderpriority")


def table_counts(spark: SparkSession, d: str) -> DataFrame:
    names = ("region", "nation", "part", "orders", "documents", "pages")
    counts = [read(spark, d, n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n in names]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def list_paged(spark: SparkSession, d: str) -> DataFrame:
    return store.page(read(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey", 25, 50)


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").filter("c_custkey = 42").select("c_custkey", "c_name", "c_mktsegment")


def coalesce_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each id's text from the first of three sources that has it."""
    a = read(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("body"))
    b = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("body"))
    c = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    found = store.first_source([a, b, c], "id", "body")
    return found.select("id", F.col("source_rank").alias("source_rank"), F.md5("body").alias("body_md5"))


def like_search(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    return store.like_search(rows, "AR", ["p_name", "p_type", "p_brand"], "p_partkey", 50).select("p_partkey", "p_name", "score", "match_type")


def _rules(spark, d) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("tags"), (F.col("c_acctbal") > 0).alias("active"), F.col("c_acctbal").alias("created"))


def rule_search(spark: SparkSession, d: str) -> DataFrame:
    return store.rule_search(_rules(spark, d), "build", ["c_name", "tags"], "created", "c_custkey", 30).select("c_custkey", "c_name", "tags")


def rule_list(spark: SparkSession, d: str) -> DataFrame:
    return store.rules_with_tag(_rules(spark, d), "HOUSE", "tags").groupBy("tags").agg(F.count("*").alias("n_rules"))


def list_by_category(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select("p_partkey", "p_name", F.nullif("p_brand", F.lit("Brand#13")).alias("category"))
    return store.by_category(rows, None, "category", "p_name", "p_partkey").groupBy("category").agg(F.count("*").alias("n_items"), F.min("p_name").alias("first_name"))


def ratings_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Line items as ratings of parts: quantity twice is the score; scores over 100 are refused."""
    items = read(spark, d, "part").select(F.col("p_partkey").alias("item_id"), "p_name")
    new = read(spark, d, "lineitem").select(F.col("l_partkey").alias("item_id"), (F.col("l_quantity") * 2).alias("score"))
    _, rated = store.rate(items, new.limit(0), new)
    return rated.select("item_id", F.round("mean_score", 6).alias("mean_score"), F.col("n_ratings").cast("bigint").alias("n_ratings"))


def iso_week(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy(text.iso_week("l_shipdate").cast("bigint").alias("week")).agg(F.count("*").alias("n_ratings"), F.round(F.avg(F.col("l_quantity") * 2), 6).alias("mean_score"))


def upsert_actions(spark: SparkSession, d: str) -> DataFrame:
    return sync.upsert_actions(_old(spark, d), _new(spark, d), "o_orderkey", "o_orderstatus").groupBy("action").agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("key_sum"))


def sync_actions(spark: SparkSession, d: str) -> DataFrame:
    return sync.sync_actions(_old(spark, d), _new(spark, d), "o_orderkey", ["o_orderstatus", "o_orderpriority"])


def next_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return sync.next_snapshot(_old(spark, d), _new(spark, d), "o_orderkey", delete=False).groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"))


def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """Customers' first orders that the old snapshot has no row of."""
    return sync.insert_if_absent(_old(spark, d), _new(spark, d), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


def dedup_union(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", F.md5("text").alias("content"), F.array("source", "lang").alias("interfaces"))
    return sync.merge_content(rows, "content", "doc_id", "interfaces").select("content", "doc_id", "n_copies", F.array_join("interfaces", ",").alias("interfaces"))


def interface_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("lang", F.explode(F.array("source", F.concat_ws("-", F.lit("any"), "lang"))).alias("interface"))
    return rows.groupBy("lang", "interface").agg(F.count("*").alias("n_rows"))


def collision_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Part names made unique; some are literally another's name with a number."""
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit("#2"))).when(F.col("p_partkey") % 7 == 0, F.concat("p_name", F.lit("#3"))).otherwise(F.col("p_name"))
    return sync.numbered(read(spark, d, "part").select("p_partkey", name.alias("name")), "name", "p_partkey").select("p_partkey", "unique_name")


def rules_after(spark: SparkSession, d: str) -> DataFrame:
    """Rules of which some are retired, and those added with names of nations as their texts."""
    rules = _rules(spark, d).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("body"), "tags", "active")
    retired = store.retire(rules, "id", [r["id"] for r in rules.filter("id % 10 = 3").select("id").toLocalIterator()])
    return store.add_rules(retired, read(spark, d, "nation").select(F.col("n_name").alias("body"), F.lit("nation").alias("tags"))).select("id", "body", "tags", "active")


def ratings_twice(spark: SparkSession, d: str) -> DataFrame:
    """New ratings beside those there are; scores over 100 and unknown parts are refused."""
    items, lines = read(spark, d, "part").select(F.col("p_partkey").alias("item_id"), "p_name"), read(spark, d, "lineitem")
    old = lines.filter("l_linenumber = 1").select(F.col("l_partkey").alias("item_id"), (F.col("l_quantity") * 2).alias("score"))
    new = lines.filter("l_linenumber > 1").select((F.col("l_partkey") + F.when(F.col("l_linenumber") == 3, 1_000_000_000).otherwise(0)).alias("item_id"), (F.col("l_quantity") * 2.5).alias("score"))
    _, rated = store.rate(items, old, new)
    return rated.select("item_id", F.round("mean_score", 6).alias("mean_score"), F.col("n_ratings").cast("bigint").alias("n_ratings"))


def insert_new(spark: SparkSession, d: str) -> DataFrame:
    """First orders of customers and priorities that the old snapshot hasn't got."""
    keys = ["o_custkey", "o_orderpriority"]
    return sync.insert_if_absent(_old(spark, d), _new(spark, d), keys, ["o_orderkey"]).select(*keys, "o_orderkey")


def snapshot_rows(spark: SparkSession, d: str) -> DataFrame:
    """All rows of the snapshot after an upsert."""
    return sync.next_snapshot(_old(spark, d), _new(spark, d), "o_orderkey", delete=False)


def pruned_log(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the log that pruning leaves."""
    return changes.prune(_log(spark, d), _cursors(spark).filter("consumer <> 'lost'")).select("no", "op", "row_key")


def table_digest(spark: SparkSession, d: str) -> DataFrame:
    """Digest of the orders, in steps of 16 keys so that small tables have several levels, too."""
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return sync.digest(orders, orders.columns, "o_orderkey", width=16)


def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def _log(spark, d) -> DataFrame:
    rows = changes.change_rows(_old(spark, d), _new(spark, d), ["o_orderkey"], "orders")
    return changes.numbered_log(rows, ["o_orderkey"], 1000)


def change_log(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).select("no", "table_name", "op", "row_key")


def result_diff(spark: SparkSession, d: str) -> DataFrame:
    diff = changes.result_diff(_old(spark, d), _new(spark, d), ["o_orderkey"])
    return diff.select("o_orderkey", "op", F.col("old.o_orderstatus").alias("old_status"), F.col("new.o_orderstatus").alias("new_status"))


def _cursors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("fast", 4000), ("slow", 1500), ("lost", 10)], "consumer string, cursor bigint")


def read_after(spark: SparkSession, d: str) -> DataFrame:
    return changes.read_after(_log(spark, d), 1200, 500).select("no", "op", "row_key")


def prune(spark: SparkSession, d: str) -> DataFrame:
    return changes.prune(_log(spark, d), _cursors(spark).filter("consumer <> 'lost'")).agg(F.count("*").alias("n_rows"), F.min("no").alias("first_no"), F.max("no").alias("last_no"))


def gap_check(spark: SparkSession, d: str) -> DataFrame:
    return changes.gap(_log(spark, d), _cursors(spark))


def last_n_per_table(spark: SparkSession, d: str) -> DataFrame:
    """The last 50 changes of each status."""
    log = _log(spark, d).withColumn("table_name", F.concat_ws("_", "table_name", "op"))
    return changes.last_per_table(log, 50).select("table_name", "no")


def log_bounds(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).agg(F.coalesce(F.max("no"), F.lit(0)).alias("last_no"), F.min("no").alias("first_no"))


def tsv_escape(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.nullif("role", F.lit("system")).alias("role"), F.encode(F.left("role", F.lit(2)), "UTF-8").alias("bytes"), "text")
    return rows.select("conv_id", "turn", changes.tsv(rows, ["conv_id", "role", "bytes", "text"]).alias("line"))


def user_tables(spark: SparkSession, d: str) -> DataFrame:
    """The tables of the folder that a log may watch, beside a log's own."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(d)
    listed = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = [(s.getPath().getName().removesuffix(".parquet"),) for s in listed if s.getPath().getName().endswith(".parquet")]
    return changes.user_tables(spark.createDataFrame([*names, ("quillon_log",)], "name string"))


QUERIES = {
    f.__name__: f
    for f in (
        table_counts, list_paged, point_lookup, coalesce_lookup, like_search, rule_search, rule_list, list_by_category, ratings_rollup, iso_week, upsert_actions,
        sync_actions, next_snapshot, insert_if_absent, dedup_union, interface_counts, collision_numbering, table_digest, duplicate_keys, change_log, result_diff,
        read_after, prune, gap_check, last_n_per_table, log_bounds, tsv_escape, user_tables, rules_after, ratings_twice, insert_new, snapshot_rows, pruned_log,
    )
}

_OLD = f"SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '{OLD_BEFORE}'"
_NEW = f"SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus || '!' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '{NEW_FROM}'"
_BOTH = f"WITH a AS ({_OLD}), b AS ({_NEW})"
_DIFF = f"""{_BOTH}, diff AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderstatus AS old_status, b.o_orderstatus AS new_status,
  CASE WHEN a.o_orderkey IS NULL THEN '+' WHEN b.o_orderkey IS NULL THEN '-'
  WHEN (a.o_custkey, a.o_orderstatus, a.o_orderpriority) IS DISTINCT FROM (b.o_custkey, b.o_orderstatus, b.o_orderpriority) THEN '~' END AS op
  FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)"""
_LOG = f"""{_DIFF}, log AS (SELECT 1000 + row_number() OVER (ORDER BY o_orderkey) AS no, 'orders' AS table_name,
  CASE op WHEN '+' THEN 'e' WHEN '-' THEN 's' ELSE 'g' END AS op, '["' || o_orderkey || '"]' AS row_key FROM diff WHERE op IS NOT NULL),
  cursors AS (SELECT * FROM (VALUES ('fast', 4000), ('slow', 1500), ('lost', 10)) v(consumer, cursor))"""
_LIKE = "translate({0}, '" + text.UPPER + "', '" + text.LOWER + "') LIKE '%{1}%'"
_RULES = "SELECT c_custkey, c_name, c_mktsegment AS tags, c_acctbal > 0 AS active, c_acctbal AS created FROM customer"
_ESC = "replace(replace(replace(replace({0}, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r')"



def _digest_sql(width: int, levels: int) -> str:
    """The tree of digests with a fixed number of levels; a level over a single node is left out as the operator leaves it out."""
    row = """'{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}'"""
    text = f"WITH l0 AS (SELECT o_orderkey // {width} AS k, count(*) AS n, sha256(string_agg(sha256({row}), chr(10) ORDER BY o_orderkey)) AS d FROM orders GROUP BY 1)"
    for i in range(1, levels + 1):
        text += f""", l{i} AS (SELECT k // {width} AS k, sum(n) AS n, sha256(string_agg(d, chr(10) ORDER BY k)) AS d FROM l{i - 1} WHERE (SELECT min(k) <> max(k) FROM l{i - 1}) GROUP BY 1
        UNION ALL SELECT k, n, d FROM l{i - 1} WHERE (SELECT min(k) = max(k) FROM l{i - 1}))"""
    return text + f" SELECT sum(n)::BIGINT AS n_rows, sha256(string_agg(d, chr(10) ORDER BY k)) AS digest FROM l{levels}"


ORACLE_SQL = {
    "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in ("region", "nation", "part", "orders", "documents", "pages")),
    "list_paged": "SELECT p_partkey, p_name, p_brand FROM part ORDER BY p_partkey LIMIT 25 OFFSET 50",
    "point_lookup": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 42",
    "coalesce_lookup": """WITH u AS (SELECT item_id AS id, text AS body, 0 AS r FROM benchmark UNION ALL SELECT p_partkey, p_name, 1 FROM part UNION ALL SELECT doc_id, text, 2 FROM documents)
    SELECT id, min(r) AS source_rank, md5(arg_min(body, r)) AS body_md5 FROM u GROUP BY id""",
    "like_search": f"SELECT p_partkey, p_name, 1.0::DOUBLE AS score, 'FullText' AS match_type FROM part WHERE {' OR '.join(_LIKE.format(c, 'ar') for c in ('p_name', 'p_type', 'p_brand'))} ORDER BY p_partkey LIMIT 50",
    "rule_search": f"SELECT c_custkey, c_name, tags FROM ({_RULES}) WHERE active AND ({_LIKE.format('c_name', 'build')} OR {_LIKE.format('tags', 'build')}) ORDER BY created, c_custkey LIMIT 30",
    "rule_list": f"SELECT tags, count(*) AS n_rules FROM ({_RULES}) WHERE active AND {_LIKE.format('tags', 'house')} GROUP BY tags",
    "list_by_category": "SELECT coalesce(nullif(p_brand, 'Brand#13'), 'GENERAL') AS category, count(*) AS n_items, min(p_name) AS first_name FROM part GROUP BY 1",
    "ratings_rollup": """SELECT p_partkey AS item_id, round(avg(l_quantity * 2), 6) AS mean_score, count(l_partkey) AS n_ratings
    FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity * 2 BETWEEN 0 AND 100) ON l_partkey = p_partkey GROUP BY 1""",
    "iso_week": "SELECT (isoyear(l_shipdate) * 100 + week(l_shipdate))::BIGINT AS week, count(*) AS n_ratings, round(avg(l_quantity * 2), 6) AS mean_score FROM lineitem GROUP BY 1",
    "upsert_actions": f"""{_BOTH} SELECT CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus THEN 'same' ELSE 'updated' END AS action,
    count(*) AS n_rows, sum(b.o_orderkey)::BIGINT AS key_sum FROM b LEFT JOIN a ON a.o_orderkey = b.o_orderkey GROUP BY 1""",
    "sync_actions": f"""{_BOTH} SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'deleted'
    WHEN (a.o_orderstatus, a.o_orderpriority) IS NOT DISTINCT FROM (b.o_orderstatus, b.o_orderpriority) THEN 'same' ELSE 'updated' END AS action FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""",
    "next_snapshot": f"{_BOTH} SELECT o_orderstatus, count(*) AS n_rows FROM (SELECT * FROM b UNION ALL SELECT * FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)) GROUP BY 1",
    "insert_if_absent": f"{_BOTH} SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a) GROUP BY 1",
    "dedup_union": """WITH s AS (SELECT md5(text) AS content, unnest([source, lang]) AS i FROM documents)
    , i AS (SELECT content, string_agg(DISTINCT i, ',' ORDER BY i) AS interfaces FROM s GROUP BY 1), c AS (SELECT md5(text) AS content, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1)
    SELECT content, doc_id, n_copies, interfaces FROM c JOIN i USING (content)""",
    "interface_counts": "SELECT lang, interface, count(*) AS n_rows FROM (SELECT lang, unnest([source, 'any-' || lang]) AS interface FROM documents) GROUP BY 1, 2",
    "collision_numbering": """WITH n AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 5 = 0 THEN p_name || '#2' WHEN p_partkey % 7 = 0 THEN p_name || '#3' ELSE p_name END AS x FROM part),
    f AS (SELECT list(p_partkey ORDER BY p_partkey) AS ks, list_reduce(list_prepend([]::VARCHAR[], list([x] ORDER BY p_partkey)), lambda acc, e: list_append(acc, CASE WHEN list_contains(acc, e[1])
      THEN e[1] || '#' || list_min(list_filter(range(2, len(acc) + 3), lambda k: NOT list_contains(acc, e[1] || '#' || k))) ELSE e[1] END)) AS us FROM n GROUP BY p_name)
    SELECT unnest(ks) AS p_partkey, unnest(us) AS unique_name FROM f""",
    "table_digest": _digest_sql(16, 6),
    "duplicate_keys": "SELECT l_orderkey, l_partkey, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "change_log": f"{_LOG} SELECT no, table_name, op, row_key FROM log",
    "result_diff": f"{_DIFF} SELECT o_orderkey, op, old_status, new_status FROM diff WHERE op IS NOT NULL",
    "read_after": f"{_LOG} SELECT no, op, row_key FROM log WHERE no > 1200 ORDER BY no LIMIT 500",
    "prune": f"""{_LOG}, s AS (SELECT min(cursor) AS slow FROM cursors WHERE consumer <> 'lost'), l AS (SELECT max(no) AS last FROM log)
    SELECT count(*) AS n_rows, min(no) AS first_no, max(no) AS last_no FROM log, s, l WHERE no >= slow OR no = last""",
    "gap_check": f"""{_LOG}, e AS (SELECT min(no) AS first_no, coalesce(max(no), 0) AS last_no FROM log)
    SELECT consumer, cursor, first_no, last_no, coalesce(first_no, 0) > cursor + 1 OR last_no < cursor AS gap FROM cursors, e""",
    "last_n_per_table": f"""{_LOG}, r AS (SELECT table_name || '_' || op AS table_name, no, row_number() OVER (PARTITION BY op ORDER BY no DESC) AS r FROM log)
    SELECT table_name, no FROM r WHERE r <= 50""",
    "log_bounds": f"{_LOG} SELECT coalesce(max(no), 0) AS last_no, min(no) AS first_no FROM log",
    "tsv_escape": f"SELECT conv_id, turn, conv_id || chr(9) || coalesce({_ESC.format("nullif(role, 'system')")}, 'NULL') || chr(9) || 'x' || chr(39) || lower(hex(left(role, 2))) || chr(39) || chr(9) || coalesce({_ESC.format('text')}, 'NULL') AS line FROM conversations",
    "rules_after": """WITH r AS (SELECT c_custkey AS id, c_name AS body, c_mktsegment AS tags, c_acctbal > 0 AND c_custkey % 10 <> 3 AS active FROM customer),
    n AS (SELECT n_name AS body, 'nation' AS tags, row_number() OVER (ORDER BY n_name) + (SELECT max(id) FROM r) AS id FROM nation)
    SELECT id, body, tags, active FROM r UNION ALL SELECT id, body, tags, true FROM n""",
    "ratings_twice": """WITH v AS (SELECT l_partkey, l_quantity * 2 AS score FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_partkey + (CASE WHEN l_linenumber = 3 THEN 1000000000 ELSE 0 END), l_quantity * 2.5 FROM lineitem WHERE l_linenumber > 1 AND l_quantity * 2.5 BETWEEN 0 AND 100)
    SELECT p_partkey AS item_id, round(avg(score), 6) AS mean_score, count(l_partkey) AS n_ratings FROM part LEFT JOIN v ON l_partkey = p_partkey GROUP BY 1""",
    "insert_new": f"""{_BOTH}, k AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM b GROUP BY 1, 2)
    SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.o_custkey = k.o_custkey AND a.o_orderpriority = k.o_orderpriority)""",
    "snapshot_rows": f"{_BOTH} SELECT * FROM b UNION ALL SELECT * FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)",
    "pruned_log": f"""{_LOG}, s AS (SELECT min(cursor) AS slow FROM cursors WHERE consumer <> 'lost'), l AS (SELECT max(no) AS last FROM log)
    SELECT no, op, row_key FROM log, s, l WHERE no >= slow OR no = last""",
    "user_tables": "SELECT unnest(string_split('region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations', ' ')) AS name",
}
