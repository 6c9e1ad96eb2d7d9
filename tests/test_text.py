from pyspark.sql import functions as F

from quillon.functions import hashing, text


def values(spark, rows, column, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {column} string")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_fold_and_tokens(spark):
    got = values(spark, ["İSTANBUL", "IŞIK", "kaynakça", "ağaç şüphe örgü", "kâğıt é", "e\u0301te", None, ""], "x", text.tokens("x"))
    assert got == [["istanbul"], ["isik"], ["kaynakca"], ["agac", "suphe", "orgu"], ["kagit", "e"], ["ete"], [], []]
    assert text.query_tokens("İSTANBUL IŞIK") == ["istanbul", "isik"]


def test_stems(spark):
    stems = F.array_join(text.stems(text.tokens("x")), " ")
    assert values(spark, ["Belgesi belge", "belge belge"], "x", stems) == ["belge belge", "belge belge"]


def test_clip_and_snippet(spark):
    assert values(spark, ["abcdef", "abc"], "x", text.clip("x", 4)) == ["abcd…(+2 characters)", "abc"]
    assert values(spark, ["abcdef", "abc"], "x", text.snippet("x", 4)) == ["abcd…", "abc"]


def test_tags(spark):
    assert values(spark, [" a, b ,,c", "", None], "x", text.tags("x")) == [["a", "b", "c"], [], []]


def test_names_and_paths(spark):
    assert values(spark, ["mcp/a b", "x" * 80], "x", text.tool_name("x")) == ["y_mcp_a_b", "y_" + "x" * 62]
    assert values(spark, ["skills/a/1x/b", "skills", "c"], "x", text.path_id(F.lit("web"), F.col("x"))) == ["web/a/b", "web", "web/c"]
    assert values(spark, ["C:\\\\A\\b//c"], "x", text.normal_path("x")) == ["c:/a/b/c"]
    assert values(spark, ["C:\\x\\y", "/r/a"], "x", text.path_variants("x")) == [["c:/x/y", "/c/x/y"], ["/r/a"]]


def test_whole_paths(spark):
    cases = [("see lib/x.py for it", True), ("lib/x.py", True), ("(lib/x.py)", True), ("lib/x.pyi", False), ("src/lib/x.py", False), ("_lib/x.py", False), (" ", False), ("lib/x.pyi, lib/x.py", True), ("lib/x-py", False)]
    assert values(spark, [c for c, _ in cases], "x", text.has_path(F.col("x"), F.lit("lib/x.py"))) == [w for _, w in cases]
    assert values(spark, ["a/b: c.d (é-1)", ":", ""], "x", text.path_runs(F.col("x"))) == [["a/b", "c.d", "é-1"], [], []]


def test_like_ignores_only_ascii_case(spark):
    rows = ["Bun kullan", "BUN", "ŞA", "a\\b", "50%x", None]
    assert values(spark, rows, "x", text.ascii_like("x", "bun")) == [True, True, False, False, False, None]
    assert values(spark, rows, "x", text.ascii_like("x", "şa"))[2] is False
    assert values(spark, rows, "x", text.ascii_like("x", "a\\"))[3] is True


def test_iso_times(spark):
    good = {"1970-01-01T00:00:00Z": 0, "2026-01-02T03:04:05Z": 1767323045000, "2026-01-02T03:04:05.6Z": 1767323045600, "2026-01-02T03:04:05.678901Z": 1767323045678, "2026-01-02T03:04:05.Z": 1767323045000}
    bad = ["2026-01-02T03:04:05+03:00", "2026-01-02 03:04:05Z", "", "2026-01-02", None]
    assert values(spark, list(good), "x", text.iso_ms("x")) == list(good.values())
    assert values(spark, bad, "x", text.iso_ms("x")) == [None] * len(bad)


def test_iso_weeks(spark):
    days = {0: 197001, 20454: 202601, 20736: 202641, 20088: 202501, 20089: 202501, 20818: 202653, 20821: 202653, 20822: 202701}
    df = spark.createDataFrame([(d,) for d in days], "d int").select("d", text.iso_week(F.date_add(F.to_date(F.lit("1970-01-01")), F.col("d"))))
    assert dict(map(tuple, df.collect())) == days


def fnv(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h


def test_fnv(spark):
    rows = ["", "a", "foobar", "şüphe", "x" * 300]
    assert values(spark, rows, "x", hashing.fnv64_hex(F.col("x"))) == [f"{fnv(r.encode()):016x}" for r in rows]
    assert values(spark, rows, "x", hashing.fnv_cell(F.col("x"))) == [fnv(r.encode()) % 256 for r in rows]


def test_fnv_of_long_texts_in_linear_time(spark):
    import time

    rows = ["şa" * 100_000, None, "", "b" * (1 << 18), "c"]
    began = time.time()
    got = values(spark, rows, "x", hashing.fnv64_hex(F.col("x")))
    assert time.time() - began < 20
    assert got == [None if r is None else f"{fnv(r.encode()):016x}" for r in rows]


def test_fnv_in_pieces(monkeypatch):
    import numpy as np

    runs = [b"", b"ab", bytes(range(256)), b"", b"z" * 41, b""]
    for piece in (1, 7, 64):
        monkeypatch.setattr(hashing, "PIECE", piece)
        hashing._powers.cache_clear()
        assert hashing.fnv64(np.frombuffer(b"".join(runs), np.uint8), np.cumsum([len(r) for r in runs])).tolist() == [fnv(r) for r in runs]
    hashing._powers.cache_clear()


def test_embedding_by_hand(spark):
    import math
    from collections import Counter

    rows = ["Kaynakça, belge belge x!", None, "?", "ab " * 70_000]
    for text, got in zip(rows, values(spark, rows, "x", hashing.hash_embedding(F.col("x")))):
        sums = Counter()
        for t in (text or "").lower().replace("ç", "c").replace(",", "").replace("!", "").replace("?", "").split():
            for key, weight in [("t:" + t, 1.0), *(("g:" + t[i : i + 3], 0.5) for i in range(max(len(t) - 2, 1)))]:
                sums[fnv(key.encode()) % 256] += weight
        weights = [max(math.log(sums[c]) + 1, 0) if sums[c] else 0.0 for c in range(256)]
        norm = math.sqrt(sum(w * w for w in weights)) or 1.0
        assert all(abs(a - w / norm) < 1e-12 for a, w in zip(got, weights, strict=True))


def test_hash_embedding(spark):
    rows = ["kaynakça belgeleri", "kaynakca", "tepsi simgesi", ""]
    a, b, c, none = values(spark, rows, "x", hashing.hash_embedding(F.col("x")))
    assert len(a) == 256 and abs(sum(x * x for x in a) - 1) < 1e-9 and not any(none)
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    assert dot(a, b) > dot(c, b)


def test_dot_of_unequal_lengths(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(hashing.dot(F.col("a"), F.col("b"))).collect()] == [11.0, 0.0]


def test_tsv(spark):
    from quillon.operators import changes

    df = spark.createDataFrame([("a\tb", "c\\d\ne", None)], "x string, y string, z string")
    assert df.select(changes.tsv(df, ["x", "y", "z"])).first()[0] == "a\\tb\tc\\\\d\\ne\t"
