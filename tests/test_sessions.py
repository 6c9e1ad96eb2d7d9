import json

from pyspark.sql import functions as F

from quillon.operators import attribution, events, sessions


def lines(spark, objects):
    return spark.createDataFrame([("s", i, o if isinstance(o, str) else json.dumps(o)) for i, o in enumerate(objects)], "session string, line int, value string")


def block(at, *blocks, **more):
    return {"timestamp": at, "message": {"content": list(blocks)}, **more}


def test_calls(spark):
    rows = lines(
        spark,
        [
            block("2026-01-01T00:00:00Z", {"type": "tool_use", "id": "1", "name": "Bash", "input": {"command": " ls ", "description": "x"}}),
            block("2026-01-01T00:00:02.5Z", {"type": "tool_result", "tool_use_id": "1", "is_error": True, "content": "no"}),
            block("2026-01-01T00:00:03Z", {"type": "tool_use", "id": "2", "name": "mcp__x", "input": {"n": 1, "label": "a"}}),
            '{"message": {"content": [{"type": "tool_use", "id": "3"',
            block("2026-01-01T00:00:04Z", {"type": "text", "text": "about \"tool_use\""}),
        ],
    )
    got = {r["call_id"]: (r["tool"], r["digest"], r["error"], r["duration_ms"]) for r in sessions.calls(rows).collect()}
    assert got == {"1": ("Bash", "ls", True, 2500), "2": ("mcp__x", "label=a", False, None)}


def test_digests(spark):
    cases = {'{"command":" a "}': "a", '{"old_string":"q","file_path":"/f"}': "/f", '{"b":"x","n":1}': "b=x", '{"n":1,"m":true}': "(m, n)", '{"command":5,"z":"t"}': "z=t", '{"command":"' + "y" * 300 + '"}': "y" * 200 + "…"}
    df = spark.createDataFrame([(c,) for c in cases], "a string").select("a", sessions.argument_digest(F.col("a")))
    assert dict(map(tuple, df.collect())) == cases


def test_records(spark):
    base = {"uuid": "u", "timestamp": "2026-01-01T00:00:00Z", "sessionId": "s"}
    rows = lines(
        spark,
        [
            base | {"type": "user", "message": {"content": "hello"}},
            base | {"type": "assistant", "message": {"content": [{"type": "thinking", "text": "t"}, {"type": "text", "text": "answer"}, {"type": "tool_use", "name": "Read", "input": {"a": 1}}]}},
            base | {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "9", "content": [{"text": "abc"}, {"text": "de"}]}]}},
            base | {"type": "user", "isCompactSummary": True, "message": {"content": "so far"}},
            base | {"type": "user", "isMeta": True, "message": {"content": "meta"}},
            base | {"type": "user", "isSidechain": True, "message": {"content": "side"}},
            base | {"type": "user", "message": {"content": "  "}},
            base | {"type": "system", "subtype": "compact_boundary", "content": "cut", "compactMetadata": {"n": 1}},
            {"type": "user", "message": {"content": "no uuid"}},
            '{"uuid": "half',
        ],
    )
    got = sorted((r["kind"], r["block"], r["tool"], r["text"]) for r in sessions.records(rows).fillna("", ["tool"]).collect())
    assert got == [
        ("boundary", 0, "", 'cut {"n":1}'), ("model", 1, "", "answer"), ("result", 0, "", "tool_use_id=9 error=0 length=5"), ("summary", 0, "", "so far"), ("tool", 2, "Read", '{"a":1}'), ("user", 0, "", "hello"),
    ]


def test_nearest(spark):
    calls = spark.createDataFrame([("far", "t", 30_000), ("near", "t", 100_500), ("late", "t", 160_001), ("other", "u", 100_000), ("edge", "v", 160_000)], "right_id string, k string, t bigint")
    events = spark.createDataFrame([("e", "t", 100_000), ("none", "t", 1_000_000), ("edge", "v", 100_000)], "left_id string, k string, t bigint")
    got = {r["left_id"]: (r["right_id"], r["gap_ms"]) for r in attribution.nearest(events, calls, ["k"], attribution.TOLERANCE_MS).collect()}
    assert got == {"e": ("near", 500), "edge": ("edge", 60_000)}


def test_uses_until_next_search(spark):
    rows = [(1, "s", 0, "q"), (2, "s", 10, "u"), (3, "s", 20, "q"), (4, "s", 30, "u"), (5, "s", 20 + attribution.WINDOW_MS, "u"), (6, "s", 21 + attribution.WINDOW_MS, "u"), (7, "t", 5, "u")]
    df = spark.createDataFrame(rows, "event_id int, s string, t bigint, kind string")
    got = {tuple(r) for r in attribution.uses_until_next(df, "s", F.col("kind") == "q", attribution.WINDOW_MS).collect()}
    assert got == {(1, 2), (3, 4), (3, 5)}


def test_first_use_and_report(spark):
    results = spark.createDataFrame([("m", 5, 10, 1, "D:\\src\\Main.kt"), ("m", 5, 10, 4, "D:\\src\\Main.kt"), ("m", 5, 10, 2, "/opt/lib/util.py"), ("m", 6, 40, 1, "/opt/lib/util.py"), ("m", 6, 40, 2, "never.txt"), ("n", 7, 0, 1, ":")], "s string, search_id int, t bigint, rank int, path string")
    calls = spark.createDataFrame(
        [
            ("m", 1, 5, "d:/src/main.kt"), ("m", 2, 20, "open /opt/lib/util.pyc, /usr/opt/lib/util.py and x/opt/lib/util.py"), ("m", 3, 30, "'/opt//lib/util.py'"), ("m", 4, 50, "D:\\\\SRC\\main.kt twice D:/src/main.kt"),
            ("m", 8, 60, "[/OPT/lib/util.py]"), ("k", 9, 70, "/opt/lib/util.py"), ("n", 10, 1, "a : b"), ("m", 11, 15, "less /d/src/Main.kt.orig"), ("m", 12, 16, None),
        ], "s string, call_id int, t bigint, text string",
    )
    got = {(r["search_id"], r["path"], r["rank"], r["call_id"], r["t"]) for r in attribution.first_use(results, calls, "s").collect()}
    assert got == {(5, "D:\\src\\Main.kt", 1, 4, 50), (5, "/opt/lib/util.py", 2, 3, 30), (6, "/opt/lib/util.py", 1, 8, 60), (7, ":", 1, 10, 1)}
    searches = spark.createDataFrame([(5, "m"), (6, "m"), (7, None), (8, "none"), (9, None)], "search_id int, s string")
    found = spark.createDataFrame([(5,), (8,), (9,)], "search_id int")
    assert tuple(attribution.report(searches, found, calls, "s").first()) == (5, 2, 1)


def test_result_identity(spark):
    rows = [
        ("mcp/Weather/get_rain", "mcp__local_weather__GET_RAIN", "", True), ("mcp/weather/get_rain", "mcp__weather__get_sun", "", False), ("mcp/weather/get_rain", "get_rain", "", False),
        ("home/pack/cook", "Skill", "cook", True), ("home/cook", "Skill", "pack:cook", True), ("home/cook", "Skill", "cooking", False), ("home/cook", "Read", "/a/cook/SKILL.md", True), ("home/cook", "Read", "/a/cook/README.md", False), ("cook", "Skill", "cook", False),
    ]
    df = spark.createDataFrame(rows, "i string, tool string, d string, want boolean")
    assert df.filter(attribution.uses_result(F.col("i"), F.col("tool"), F.col("d")) != F.col("want")).count() == 0


def test_long_inputs_are_cut_field_by_field(spark):
    call = {"type": "tool_use", "name": "Write", "input": {"a": "x" * 2003, "b": ["y" * 10, "z" * 2500], "n": 1}}
    many = {"type": "tool_use", "name": "Write", "input": {"list": ["q" * 1999] * 12}}
    rows = lines(spark, [{"uuid": str(i), "timestamp": "2026-01-01T00:00:00Z", "type": "assistant", "message": {"content": [c]}} for i, c in enumerate((call, many))])
    got = {r["uuid"]: r["text"] for r in sessions.records(rows).collect()}
    assert json.loads(got["0"]) == {"a": "x" * 2000 + "…(+3 characters)", "b": ["y" * 10, "z" * 2000 + "…(+500 characters)"], "n": 1}
    whole = json.dumps(many["input"], separators=(",", ":"))
    assert got["1"] == f"{whole[:16384]}…(+{len(whole) - 16384} characters)"


def test_outputs_of_searches(spark):
    head = "2 / 7 rows · kanal: vector · 3 ms"
    rows = [(head + '\n[{"id":"mcp/t"},{"id":"a","aciklama":"x"},{"x":1},{"id":"b"},{"id":"c"},{"id":"d"}]', ["mcp/t", "a", "b", "c", "d"], "vector", [("a", "x"), ("b", ""), ("c", "")]), ("kanal:\nnot json", [], None, []), ("one line", [], None, []), (None, [], None, [])]
    df = spark.createDataFrame([(o, i) for i, (o, *_) in enumerate(rows)], "o string, i int")
    got = df.select("i", events.result_ids(F.col("o")).alias("ids"), events.channel(F.col("o")).alias("channel"), events.hot_candidates(F.col("o")).alias("hot")).orderBy("i").collect()
    assert [(r["ids"], r["channel"], [tuple(h) for h in r["hot"]]) for r in got] == [(a, b, c) for _, a, b, c in rows]


def test_event_log_drops_broken_lines(spark, tmp_path):
    df = spark.createDataFrame([("s1", None, 5, "search", {"query": "q", "x": "y" * 700}, "1 / 1 · kanal: k\n[{\"id\":\"i\"}]", None, 3), ("s2", "shell", 6, "list", {}, "out", "failed", 1)], "session string, interface string, time_ms bigint, tool string, arguments map<string,string>, output string, error string, took_ms bigint")
    assert events.append_events(df, f"{tmp_path}/log") and events.append_events(df.filter("session = 's2'"), f"{tmp_path}/log")
    assert not events.append_events(df, "nofs://x/y")
    extra = spark.createDataFrame([("{\"oturum\":\"s\"}",), ("half",), ("{\"oturum\":\"s\",\"zaman_ms\":1,\"arac\":\"t\"}",), ("",)], "value string")
    got = events.event_log(spark, f"{tmp_path}/log").unionByName(events.read_events(extra)).collect()
    assert sorted((r["session"], r["interface"], r["t"], r["tool"], r["digest"], r["results"], r["channel"]) for r in got if r["session"] != "s") == [
        ("s1", "bilinmiyor", 5, "search", "q", ["i"], "k"), ("s2", "shell", 6, "list", "()", [], None), ("s2", "shell", 6, "list", "()", [], None),
    ]
    assert [(r["interface"], r["t"], r["results"]) for r in got if r["session"] == "s"] == [("bilinmiyor", 1, [])]
