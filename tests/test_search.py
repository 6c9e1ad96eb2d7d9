import pytest
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import evaluate, index, search


def docs(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, body string").select("id", F.concat(*[text.tokens("title")] * 3, text.tokens("body")).alias("tokens"))


def test_bm25_prefers_titles(spark):
    d = docs(spark, [(4, "Tea and coffee", "a shop for both"), (9, "Opening hours", "the kitchen has tea until six"), (11, "Parking", "behind the house")])
    got = search.bm25(d, ["tea"], 5).collect()
    assert [r["id"] for r in got] == [4, 9] and got[0]["score"] > got[1]["score"]
    assert search.bm25(docs(spark, [(1, "Parking", "behind the house")]), ["tea"], 5).count() == 0
    assert search.bm25(d, [], 5).count() == 0
    assert search.bm25(d.limit(0), ["tea"], 5).count() == 0
    twice = {r["id"]: r["score"] for r in search.bm25(d, ["tea", "tea"], None).collect()}
    assert all(abs(twice[r["id"]] - 2 * r["score"]) < 3e-6 for r in got)


def ranked(spark, rows):
    return spark.createDataFrame(rows, "id long, score double")


def test_fusion(spark):
    words, near, none = ranked(spark, [(21, 8.0), (22, 6.0), (23, 2.0)]), ranked(spark, [(22, 0.8), (24, 0.6), (21, 0.2)]), ranked(spark, [])
    rows = lambda df: [(r["id"], r["score"]) for r in df.collect()]
    assert rows(search.fuse(words, near, 0.5, 9)) == [(22, 0.875), (21, 0.625), (24, 0.375), (23, 0.125)]
    assert rows(search.fuse(words, none, 0.25, 2)) == [(21, 0.25), (22, 0.1875)] and rows(search.fuse(none, near, 0.25, 1)) == [(22, 0.75)]
    assert rows(search.fuse(none, none, 0.5, 3)) == []
    assert [i for i, _ in rows(search.fuse(ranked(spark, [(8, 1.5), (6, 1.5), (7, 1.5)]), none, 0.5, 2))] == [6, 7]
    assert rows(search.fuse(ranked(spark, [(1, 0.0)]), none, 0.5, 3)) == [(1, 0.0)]


def test_fallback_and_modes(spark):
    d = spark.createDataFrame([(5, ["red", "apple"], None), (6, ["pear"], None)], "id long, tokens array<string>, vector array<float>")
    got = search.search(d, ["apple"], [1.0, 0.0]).collect()
    assert [(r["id"], r["channel"]) for r in got] == [(5, "bm25")]
    v = spark.createDataFrame([(0, ["x"], [1.0, 0.0]), (1, ["y"], [0.0, 1.0]), (2, ["y"], [1.0])], "id long, tokens array<string>, vector array<float>")
    assert [r["id"] for r in search.search(v, ["y"], [1.0, 0.0], "vector").collect()] == [0]
    assert [r["id"] for r in search.search(v, ["y"], [1.0, 0.0]).collect()] == [0]
    with pytest.raises(ValueError):
        search.search(v, ["y"], [1.0, 0.0], "other")


def test_quality(spark):
    rows = [(1, 1, 0.9, False), (1, 2, 0.8, True), (2, 1, 0.9, True), (3, 1, 0.9, False)]
    ranks = evaluate.ranked(spark.createDataFrame(rows, "query_id long, id long, score double, relevant boolean"))
    got = evaluate.quality(ranks).first()
    assert (got["n_queries"], got["recall"], got["mrr"]) == (3, round(2 / 3, 6), 0.5)


def test_alternatives_of_an_expected_id(spark):
    ranks = spark.createDataFrame([(1, "a/x-tool", 1), (1, "a/y", 2), (2, "b", 1), (2, "a/y", 6), (3, "q", 1)], "query_id long, id string, rank int")
    expected = spark.createDataFrame([(1, ["y", "z"]), (2, ["y"]), (3, ["Q"]), (4, ["b"])], "query_id long, wanted array<string>")
    got = evaluate.against_expected(ranks, expected)
    assert {r["query_id"]: (r["hit"], r["reciprocal"]) for r in got.collect()} == {1: (1, 0.5), 2: (0, 0.0), 3: (0, 0.0), 4: (0, 0.0)}
    row = evaluate.channel_scores(got.withColumn("channel", F.lit("c"))).first()
    assert (row["n_queries"], row["recall"], row["mrr"]) == (4, 0.25, 0.125)


def test_stored_index(spark, tmp_path):
    rows = [(i, [f"w{i % 7}", "all", f"w{i % 3}"] * (1 + i % 2)) for i in range(60)] + [(99, []), (100, None)]
    d = spark.createDataFrame(rows, "id long, tokens array<string>")
    root, current = f"file://{tmp_path}", index.stamp(d, "id", "tokens")
    assert index.refresh(d, root, current) and not index.refresh(d, root, current) and index.stamp(d.repartition(4), "id", "tokens") == current
    held = index.Index(spark, f"{root}/{current}")
    full = d.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    for terms in (["all"], ["w1", "w5", "w1"], ["w2", "none"], ["none"], []):
        assert held.search(terms, 10).collect() == search.bm25(full, terms, 10).collect()
    plan = held.postings(["w1"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [In(term, [w1])" in plan or "EqualTo(term,w1)" in plan
    other = d.filter("id > 3")
    after = index.stamp(other, "id", "tokens")
    assert after != current and index.refresh(other, root, after)
    with pytest.raises(ValueError):
        index.Index(spark, f"{root}/{current}")
    both = {(r["query_id"], r["id"]): r["score"] for r in index.Index(spark, f"{root}/{after}").scores({"a": ["w1"], "b": ["w1", "w1"]}).collect()}
    assert both and all(abs(2 * both["a", i] - both["b", i]) < 3e-6 for q, i in both if q == "a")
    nothing = index.stamp(d.limit(0), "id", "tokens")
    index.refresh(d.limit(0), root, nothing)
    assert index.Index(spark, f"{root}/{nothing}").search(["all"], 5).count() == 0


def test_passages_in_long_documents(spark, tmp_path):
    """Words are split once a document: 40,000 of them took a minute and more when they were split for every gram."""
    import time

    from quillon.plans import search as plans

    long = " ".join(f"w{i}" for i in range(40_000))
    spark.createDataFrame([(1, long, "s"), (2, "a b c w7 w8", "s"), (3, None, "s"), (4, "", "s")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    passages = [(1, "39990 w39991 w39992 w39993 w39994 w3999"), (2, "w7 w8"), (3, "w1 w2 w3 w4 w5 w7"), (4, None)]
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    began = time.time()
    assert {r["item_id"]: r["n_documents"] for r in plans.golden_recall(spark, str(tmp_path)).collect()} == {1: 1, 2: 2, 3: 0, 4: 0}
    assert time.time() - began < 40


def test_scores_of_a_scan_are_those_of_the_index(spark, tmp_path):
    """Many queries asked of one scan, over words and stems: documents without tokens count, repeated terms count again, no index is built."""
    rows = [(1, "belgeler belge kaynak"), (2, "belge x x x"), (3, ""), (4, None), (5, "kaynaklar belgesi kaynakca x")]
    docs = spark.createDataFrame(rows, "id long, text string").withColumn("tokens", text.tokens("text"))
    asked = {7: ["belge", "x", "x"], 8: ["kayna"], 9: ["none"], 10: []}
    scanned = search.scan(docs, sorted({t for ts in asked.values() for t in ts}), stemmed=True)
    for stemmed in (False, True):
        path = str(tmp_path / str(stemmed))
        index.build(docs.select("id", (text.stems(F.col("tokens")) if stemmed else F.col("tokens")).alias("tokens")), path)
        want = sorted(map(tuple, index.Index(spark, path).scores(asked).collect()))
        assert sorted(map(tuple, search.scores(scanned, asked, stemmed).select("query_id", "id", "score").collect())) == want
        assert {q for q, _, _ in want} == ({7, 8} if stemmed else {7})
