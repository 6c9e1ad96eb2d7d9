import hashlib

import corpus_pipeline
from quillon.llm import bpe, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = docs, stage(spark, docs, SF)
        assert sorted(out.columns) == sorted(columns)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name == "line_dedup":
            assert docs.count() == before.count()
    ids = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, d in kept.items()}
    assert ids["jaccard_join"] <= ids["line_dedup"] == ids["toxicity"] and ids["mixing"] <= ids["jaccard_join"]
    assert kept["jaccard_join"].count() == len(ids["jaccard_join"])
    # toxic documents go and clean ones stay
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [d for d, t in labels.items() if not t]
    assert sum(d in ids["toxicity"] for d in clean) >= 0.97 * len(clean)
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    model = bpe.Model(queries.vocabulary())
    texts = sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in docs.collect())
    assert sorted(r["decoded_sha256"] for r in final) == texts
    assert all(r["n_tokens"] == len(r["ids"]) for r in final) and bpe.decode(model, final[0]["ids"]) is not None


def test_stages_take_odd_and_empty_tables(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "x y z", None, "a", 5), (3, "x y z", None, "a", 5), (None, "q", "en", None, 1)]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).count()


def test_a_passage_of_two_documents_is_mixed_from_one(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(200)) + "\n" + passage, "en", f"s{i}", 0) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    mixed = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    assert len({r["doc_id"] for r in mixed if "p59" in r["text"]}) <= 1 and {r["doc_id"] for r in mixed} == {0, 1}


def test_one_row_of_each_group_stays(spark):
    def words(name):
        return " ".join(f"{name}{i}" for i in range(30))

    texts = [(1, words("a")), (1, words("a")), (2, words("a") + " more"), (3, words("b")), (3, words("b")), (4, "x"), (4, "x"), (5, "y"), (5, "z"), (5, "z"), (6, ""), (6, ""), (6, None)]
    unnamed = [(None, words("b")), (None, words("c")), (None, words("c")), (None, ""), (None, ""), (None, None)]
    named = [(1, words("a")), (3, words("b")), (4, "x"), (5, "y"), (5, "z"), (6, ""), (6, None)]
    rest = [(None, words("c")), (None, ""), (None, ""), (None, None)]
    for given, want in ((texts, named), (texts + unnamed, named + rest), (unnamed[1:2] + texts[5:6], unnamed[1:2] + texts[5:6])):
        docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in given], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        out = corpus_pipeline.drop_copies(spark, docs.repartition(3), SF)
        assert out.columns == docs.columns and sorted(map(str, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(str, want))
