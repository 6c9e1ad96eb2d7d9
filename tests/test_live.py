import json
import time

import pytest

from quillon.streaming import consumer, live, stateful


def test_only_reading_statements(spark):
    spark.range(3).createOrReplaceTempView("t_live")
    for good in ("select * from t_live", "  -- note\n/* x */ WITH a AS (SELECT 1 AS k) SELECT * FROM a", "VALUES (1)"):
        live.check_read_only(spark, good)
    for bad in ("DELETE FROM t_live", "INSERT INTO t_live VALUES (1)", "DROP TABLE t_live", "", "CREATE TABLE x AS SELECT 1"):
        with pytest.raises(Exception):
            live.check_read_only(spark, bad)


def log(spark, *rows):
    return spark.createDataFrame(list(rows), "no bigint, table_name string")


def test_polls(spark):
    view = lambda rows: spark.createDataFrame(rows, "k int, v int").createOrReplaceTempView("k_live")
    view([(1, 1), (2, 2)])
    q = live.LiveQuery(spark, "SELECT k, v FROM k_live WHERE v < 10", ["k"], ["K"])
    view([(1, 1), (2, 3), (4, 4)])
    assert q.poll(log(spark, (1, "other"))) is None
    assert {(r["k"], r["op"]) for r in q.poll(log(spark, (2, "k"))).collect()} == {(2, "~"), (4, "+")}
    view([(1, 1), (2, 3), (4, 4), (5, 50)])
    assert q.poll(log(spark, (3, "k"))).count() == 0
    view([(1, 1)])
    assert q.poll(log(spark, (9, "other"))).count() == 2  # rows 4 to 8 were pruned
    view([(1, 1), (1, 2)])
    with pytest.raises(ValueError):
        q.poll(log(spark, (10, "k")))
    assert q.last_no == 9


def test_bad_subscriptions(spark):
    spark.createDataFrame([(1, 1), (1, 2)], "k int, v int").createOrReplaceTempView("k_twice")
    for tables, key in ((["k"], ["k"]), ([], ["v"]), (["k"], []), (["k"], ["none"])):
        with pytest.raises(ValueError):
            live.LiveQuery(spark, "SELECT * FROM k_twice", tables, key)


def stream(spark, root, rows):
    for no, table in rows:
        (root / f"{no:04d}.json").write_text(json.dumps({"no": no, "table_name": table}) + "\n")
    return spark.readStream.schema("no bigint, table_name string").json(str(root))


def test_consumer_restarts_without_loss(spark, tmp_path):
    (tmp_path / "log").mkdir()
    seen = []

    def run(rows):
        q = live.consume(stream(spark, tmp_path / "log", rows), lambda df: seen.extend(r["no"] for r in df.collect()), str(tmp_path / "cp"), once=True)
        q.awaitTermination()

    run([(1, "a"), (2, "b")])
    run([(3, "a")])
    assert seen == [1, 2, 3]


def test_notifications_and_resources(spark, tmp_path):
    (tmp_path / "log").mkdir()
    sent = []
    live.notify(stream(spark, tmp_path / "log", [(1, "a"), (2, "a")]), {"quillon://s/table/a": ["a"], "quillon://s/table/b": ["b"]}, sent.append, str(tmp_path / "cp"), once=True).awaitTermination()
    assert sent == ["quillon://s/table/a"]
    assert live.resource("quillon://s/table/a", ["s"]) == ("s", "table", "a")
    for bad in ("quillon://x/last", "quillon://s/table", "http://s/last", "quillon://s/last/a"):
        with pytest.raises(ValueError):
            live.resource(bad, ["s"])


def test_stateful(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("send", "m1", 1), ("send", "m2", 2), ("poll", "", 3), ("poll", "", 4)]
    (tmp_path / "in/a.json").write_text("".join(json.dumps({"box": "x", "kind": k, "body": b, "t": t}) + "\n" for k, b, t in rows))
    events = spark.readStream.schema("box string, kind string, body string, t bigint").json(str(tmp_path / "in"))
    q = stateful.mailboxes(events, "box").writeStream.format("memory").queryName("boxes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["t"], r["messages"]) for r in spark.table("boxes").collect()) == [(3, ["m1", "m2"]), (4, [])]


def test_subscriptions_outlive_their_process(spark, tmp_path):
    view = lambda rows: spark.createDataFrame(rows, "k int, v int").createOrReplaceTempView("d_live")
    (tmp_path / "log").mkdir()
    found = []

    def run(rows, fail=False):
        def deliver(diff, _):
            if fail:
                raise RuntimeError("not now")
            found.append(sorted((r["k"], r["op"]) for r in diff.collect()))

        q = live.LiveQuery(spark, "SELECT k, v FROM d_live", ["d"], ["k"], f"file://{tmp_path}/state")
        s = q.subscribe(stream(spark, tmp_path / "log", rows), deliver, f"{tmp_path}/cp", once=True)
        if fail:
            with pytest.raises(Exception):
                s.awaitTermination()
        else:
            s.awaitTermination()

    view([(1, 1)])
    run([(1, "other")])
    view([(1, 1), (2, 2)])  # changes while nobody listens
    run([(2, "d")])
    view([(2, 3)])
    run([(3, "d")], fail=True)
    run([])
    view([(2, 3)])
    run([(4, "d")])
    assert found == [[(2, "+")], [(1, "-"), (2, "~")], []]


def test_hot_sets(spark, tmp_path):
    (tmp_path / "in").mkdir()
    state = {}

    def run(n, rows, want):
        """Runs until the owner's set is as wanted: with timeouts on, a stream never ends by itself."""
        (tmp_path / f"in/{n}.json").write_text("".join(json.dumps({"o": o, "name": name, "t": t}) + "\n" for o, name, t in rows))
        uses = spark.readStream.schema("o string, name string, t bigint").json(str(tmp_path / "in"))
        out = stateful.hot_sets(uses, "o", ttl=100_000, cap=2)
        keep = lambda df, _: state.update({r["owner"]: (r["version"], r["names"]) for r in df.collect()})
        q = out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
        end = time.time() + 40
        while state.get("a") != want and time.time() < end:
            time.sleep(0.1)
        q.stop()
        assert state["a"] == want

    run(1, [("a", "x", 0), ("a", "y", 5_000), ("b", "x", 1)], (1, ["x", "y"]))
    assert state["b"] == (1, ["x"])
    run(2, [("a", "z", 100_000)], (2, ["y", "z"]))  # x is exactly as old as the time to live
    run(3, [("a", "w", 100_001)], (3, ["w", "z"]))


def test_consumers(spark, tmp_path):
    rows = {"log": spark.range(1, 2201).selectExpr("id as no", "'t' as table_name")}
    cursors = consumer.Cursors(spark, f"file://{tmp_path}/cursors")
    with pytest.raises(ValueError):
        cursors.read("../x")
    late = consumer.Consumer(cursors, "late", lambda: rows["log"])
    assert cursors.read("late") == 2200 and late.poll(lambda df: None) == 0
    cursors.write("one", 0)
    one, seen = consumer.Consumer(cursors, "one", lambda: rows["log"]), []

    def keep(df):
        df.write.parquet(f"{tmp_path}/log{len(seen)}")
        rows["log"] = spark.read.parquet(f"{tmp_path}/log{len(seen)}")

    def fail(df):
        raise RuntimeError("not now")

    with pytest.raises(RuntimeError):
        one.poll(fail)
    while n := one.poll(lambda df: seen.extend(r["no"] for r in df.collect()), prune=keep):
        assert n <= consumer.POLL_ROWS
    assert seen == list(range(1, 2201)) and cursors.read("one") == 2200
    assert rows["log"].count() == 201  # pruned behind 2,000 rows, with the row of the cursor
    assert sorted(map(tuple, cursors.table().collect())) == [("late", 2200), ("one", 2200)]


def test_a_resource_that_fails_does_not_stop_others(spark, tmp_path):
    (tmp_path / "log").mkdir()
    sent = []

    def send(uri):
        if uri.endswith("/a"):
            raise RuntimeError("gone")
        sent.append(uri)

    live.notify(stream(spark, tmp_path / "log", [(1, "a"), (2, "b")]), {"quillon://s/table/a": ["a"], "quillon://s/table/b": ["b"]}, send, str(tmp_path / "cp"), once=True).awaitTermination()
    assert sent == ["quillon://s/table/b"]
