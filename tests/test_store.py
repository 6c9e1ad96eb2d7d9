import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import archive, changes, state, store, sync, vectors


def test_ratings(spark):
    items = spark.createDataFrame([("a",), ("b",)], "item_id string")
    none = spark.createDataFrame([], "item_id string, score double")
    kept, rated = store.rate(items, none, spark.createDataFrame([("a", 70.0), ("a", 90.0), ("zz", 50.0), ("a", 101.0), ("b", -1.0)], none.schema))
    assert kept.count() == 2
    assert {r["item_id"]: (r["mean_score"], r["n_ratings"]) for r in rated.collect()} == {"a": (80.0, 2), "b": (None, 0)}


def test_rules(spark):
    rules = spark.createDataFrame([(1, "Wash hands", "kitchen, café", True, 2), (2, "wash later", "x", False, 1), (3, "dishes", "washing", True, 1)], "id int, body string, tags string, active boolean, created int")
    assert [r["id"] for r in store.rule_search(rules, "WASH", ["body", "tags"], "created", "id").collect()] == [3, 1]
    with pytest.raises(ValueError):
        store.rule_search(rules, "  ", ["body"], "created", "id")
    assert [r["id"] for r in store.rules_with_tag(store.retire(rules, "id", [3]), None, "tags").collect()] == [1]


def test_sync(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "c", "z")], "id int, v string, w string")
    new = spark.createDataFrame([(1, "a", "x"), (2, "b", "now"), (4, "d", None)], "id int, v string, w string")
    got = {r["id"]: r["action"] for r in sync.sync_actions(old, new, "id", ["v", "w"]).collect()}
    assert got == {1: "same", 2: "updated", 3: "deleted", 4: "added"}
    assert {r["id"]: r["action"] for r in sync.upsert_actions(old, new, "id", "v").collect()} == {1: "same", 2: "same", 4: "added"}
    assert sync.next_snapshot(old, new, "id", delete=False).count() == 4 and sync.next_snapshot(old, new, "id", delete=True).count() == 3


def test_content_is_merged_and_numbered(spark):
    rows = spark.createDataFrame([(2, "h", ["b"]), (1, "h", ["a"]), (3, "k", ["a", "b"])], "id int, h string, i array<string>")
    got = {r["h"]: (r["id"], r["n_copies"], r["i"]) for r in sync.merge_content(rows, "h", "id", "i").collect()}
    assert got == {"h": (1, 2, ["a", "b"]), "k": (3, 1, ["a", "b"])}
    names = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "x#2")], "id int, n string")
    assert [r["unique_name"] for r in sync.numbered(names, "n", "id").orderBy("id").collect()] == ["x", "x#2", "x#3", "x#2#2"]


def test_names_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a#2", "a#2#2", "a#3", "a#03", "b", "b#2", "#2", "", None, "a#"])) for i in range(400)]
    taken, want = set(), []
    for _, name in rows:
        if name is None:
            want.append(None)
            continue
        now, n = name, 2
        while now in taken:
            now, n = f"{name}#{n}", n + 1
        taken.add(now)
        want.append(now)
    got = sync.numbered(spark.createDataFrame(rows, "id int, n string").repartition(5), "n", "id").orderBy("id").collect()
    assert [r["unique_name"] for r in got] == want


def test_digest_is_a_tree(spark):
    rows = [(i, f"v{i}") for i in (*range(-40, 300, 3), 5000, 70_000)]
    df = spark.createDataFrame(rows, "k long, v string")
    one = sync.digest(df, ["k", "v"], "k", width=8).first()
    assert one == sync.digest(df.repartition(7), ["k", "v"], "k", width=8).first() and one["n_rows"] == len(rows)
    other = df.withColumn("v", F.when(F.col("k") == 5000, "x").otherwise(F.col("v")))
    assert sync.digest(other, ["k", "v"], "k", width=8).first()["digest"] != one["digest"]
    assert sync.digest(df.limit(0), ["k", "v"], "k").count() == 0


def test_rules_are_added(spark):
    rules = spark.createDataFrame([(4, "old", False)], "id bigint, body string, active boolean")
    new = spark.createDataFrame([("second",), ("first",)], "body string")
    assert sorted((r["id"], r["body"], r["active"]) for r in store.add_rules(rules, new).collect()) == [(4, "old", False), (5, "first", True), (6, "second", True)]
    with pytest.raises(ValueError):
        store.add_rules(rules, spark.createDataFrame([(" ",)], "body string"))


def test_vectors_made_anew(spark):
    rows = spark.createDataFrame([(1, "a b", "k1"), (2, None, "k2"), (3, "c", "k3")], "id long, text string, content_key string")
    first = vectors.regenerated(rows, vectors.hash_kernel)
    assert {r["id"]: (r["regenerated"], len(r["vector"])) for r in first.collect()} == {1: (True, 256), 2: (True, 256), 3: (True, 256)}
    changed = first.drop("regenerated").withColumn("content_key", F.when(F.col("id") == 3, "new").otherwise(F.col("content_key")))
    again = {r["id"]: r["regenerated"] for r in vectors.regenerated(changed, vectors.hash_kernel).collect()}
    assert again == {1: False, 2: False, 3: True}
    assert all(r["regenerated"] for r in vectors.regenerated(changed, vectors.hash_kernel, force=True).collect())
    remote = vectors.remote_kernel(lambda texts: [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(texts)))], 2, batch=2)
    assert {r["id"]: r["vector"] for r in vectors.regenerated(rows, remote, "remote").collect()} == {1: [3.0, 1.0], 2: [0.0, 1.0], 3: [1.0, 1.0]}
    for answers in ([{"index": 0, "embedding": [1.0, 2.0]}], [{"index": 0, "embedding": [1.0]}, {"index": 1, "embedding": [1.0, 2.0]}], [{"index": 1, "embedding": [1.0, 2.0]}] * 2):
        with pytest.raises(ValueError):
            vectors.ordered_answers(answers, 2, 2)
    assert vectors.with_columns(rows, {"Text": "string", "v": "int"}).columns == ["id", "text", "content_key", "v"]


def test_archive_takes_each_record_once(spark, tmp_path):
    line = lambda u, t: json.dumps({"uuid": u, "timestamp": "2026-01-01T00:00:00Z", "type": "user", "message": {"content": t}})
    batch = lambda *rows: spark.createDataFrame([(p, n, v) for p, n, v in rows], "path string, line bigint, value string")
    store = archive.Archive(spark, f"{tmp_path}/a")
    assert store.records().count() == 0 and store.summaries().count() == 0
    store.ingest(batch(("p", 1, line("u1", "one")), ("p", 2, line("u2", "two")), ("p", 3, "{half"), ("q", 1, line("u1", "one"))), 0)
    store.ingest(batch(("p", 1, line("u1", "one")), ("p", 2, line("u3", "three")), ("r", 1, "[1]")), 1)
    store.ingest(batch(("p", 1, line("u1", "one")), ("p", 2, line("u3", "three")), ("r", 1, "[1]")), 1)
    assert sorted((r["uuid"], r["path"], r["line"]) for r in store.records().collect()) == [("u1", "p", 1), ("u2", "p", 2), ("u3", "p", 2)]
    assert sorted(map(tuple, store.summaries().collect())) == [(0, 4, 1, 2, 0), (1, 3, 1, 1, 1)]


def test_diff(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "c", 3.0)], "k int, ad string, v double")
    new = spark.createDataFrame([(1, "a", 2.0), (2, "b", None), (4, "d", 4.0)], "k int, ad string, v double")
    got = {(r["k"], r["op"]) for r in changes.result_diff(old, new, ["k"]).collect()}
    assert got == {(1, "~"), (3, "-"), (4, "+")}
    assert changes.result_diff(old, old, ["k"]).count() == 0


def test_log_prune_gap(spark):
    rows = spark.createDataFrame([(k,) for k in range(60)], "n int")
    log = changes.numbered_log(rows.withColumn("table_name", F.lit("t")), ["n"], 100)
    assert [r["no"] for r in log.orderBy("n").collect()] == list(range(101, 161))
    assert [r["n"] for r in changes.last_per_table(log, 50).collect()] == list(range(10, 60))
    short = log.filter("no > 157")
    cursors = lambda *x: spark.createDataFrame([(str(i), c) for i, c in enumerate(x)], "consumer string, cursor bigint")
    assert sorted(r["no"] for r in changes.prune(short, cursors(159, 160)).collect()) == [159, 160]
    assert [r["no"] for r in changes.prune(short, cursors().limit(0)).collect()] == [160]
    assert {r["cursor"]: r["gap"] for r in changes.gap(short, cursors(100, 157, 160, 200)).collect()} == {100: True, 157: False, 160: False, 200: True}


def test_keys_are_checked(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "K int, v string")
    with pytest.raises(ValueError):
        changes.require_key(df, [])
    with pytest.raises(ValueError):
        changes.require_key(df, ["K"])
    assert changes.resolve_column(["K", "v"], "k") == "K"
    with pytest.raises(ValueError):
        changes.resolve_column(["k", "K"], "κ")


def test_hot_set(spark):
    uses = spark.createDataFrame([("o", f"n{i:02d}", i * 10) for i in range(15)] + [("o", "n00", 900)], "o string, n string, t bigint")
    got = state.hot_set(uses, "o", "n", now_ms=1000, ttl=1000).orderBy("rank").collect()
    assert len(got) == 12 and got[0]["n"] == "n00" and "n01" not in {r["n"] for r in got}
    assert state.hot_set(uses, "o", "n", now_ms=5000, ttl=1000).count() == 0
    exact = spark.createDataFrame([("o", "at", 0), ("o", "in", 1)], "o string, n string, t bigint")
    assert [r["n"] for r in state.hot_set(exact, "o", "n", now_ms=1000, ttl=1000).collect()] == ["in"]


def test_mailbox(spark):
    sent = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2), ("c", 3)], "box string, t bigint")
    polls = spark.createDataFrame([("a", 3), ("c", 9)], "box string, t bigint")
    assert [tuple(r) for r in state.waiting(sent, polls, "box").collect()] == [("a", 1), ("b", 1)]


def test_hash_kernel_row_by_row(spark):
    """Rows of one id, or of none, each get the vector of their own text, and none is shuffled."""
    from quillon.operators import vectors

    rows = spark.createDataFrame([(1, "a b", "k1"), (1, "c", "k2"), (None, "a b", "k3"), (2, None, "k4")], "id long, text string, content_key string")
    made = vectors.hash_kernel(rows)
    assert "Exchange" not in made._jdf.queryExecution().toString()
    alone = {t: vectors.hash_kernel(spark.createDataFrame([(0, t)], "id long, text string")).first()["vector"] for t in ("a b", "c", "")}
    assert [r["vector"] for r in made.collect()] == [alone["a b"], alone["c"], alone["a b"], alone[""]]
    again = vectors.regenerated(rows, vectors.hash_kernel)
    assert "Exchange" not in again._jdf.queryExecution().toString()
    assert {(r["content_key"], r["regenerated"]): r["vector"] for r in again.collect()} == {("k1", True): alone["a b"], ("k2", True): alone["c"], ("k3", True): alone["a b"], ("k4", True): alone[""]}
    kept = rows.withColumn("vector", F.array(F.lit(0.5).cast("float"))).withColumn("signature", F.when(F.col("id") == 1, F.concat(F.lit("hash256:"), "content_key")))
    assert [len(r["vector"]) for r in vectors.regenerated(kept, vectors.hash_kernel).orderBy("content_key").collect()] == [1, 1, 256, 256]


def test_parts_of_one_row_group_are_spread(spark, tmp_path):
    """Vectors of a table that is one small file are made in several tasks, each part once; the copies of a part have its cells."""
    from quillon.plans import archive as plans

    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet")
    many = part.crossJoin(spark.range(10)).withColumn("p_partkey", F.col("p_partkey") + F.col("id") * 30_000).drop("id")
    many.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    least = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(least, "16k")
    try:
        made = plans.regenerated_vectors(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).toPandas()
    finally:
        spark.conf.unset(least)
    assert made["task"].nunique() > 1
    alone = plans.regenerated_vectors(spark, "/root/testdata/sf0.01").toPandas().set_index("id")
    assert sorted(made["id"]) == sorted(k + 30_000 * i for k in alone.index for i in range(10))
    assert (made["regenerated"] == (made["id"] % 3 != 0)).all() and (made["dims"] == made["regenerated"].map({True: 256, False: 1})).all()
    assert (made["n_cells"].to_numpy() == alone.loc[made["id"] % 30_000, "n_cells"].to_numpy()).all()
