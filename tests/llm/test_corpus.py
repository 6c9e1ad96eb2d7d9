"""Operators on whole tables, against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import jaccard, line_dedup, lines, mixing, quality

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in SPACES.split(text or "") if w]


def components(rows, k, percent):
    sets = []
    for _, text in rows:
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(k, len(w))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(find(i)))) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    rows = []
    for size in (6, 12, 25, 60, 150):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(rng.choice([3, 25])):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w))
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    rows += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))) + "\n" + passage for _ in range(40)]
    rows += [None, "", " \t", "a", "a b", "A B", "a b c", "a  b\tC", "Ä b", "ä b", "x " * 500, "x " * 400]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("words, percent, bounds", [(3, 90, {}), (5, 80, {"SPLIT": 3, "ROW": 2, "FILTER_BITS": 1 << 14})])
def test_jaccard_join(spark, monkeypatch, words, percent, bounds):
    monkeypatch.setattr(jaccard, "CHUNK_TOKENS", 2000)  # many chunks
    for name, value in bounds.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(words) + [(None, "a b"), (7, "same id again"), (7, "same id again")]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id bigint, text string, n int, token string").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.join(df, words, percent).collect())
    assert got == components(rows, words, percent)


def test_jaccard_join_of_nothing(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_shingles_are_those_of_the_words():
    shingle = jaccard.Shingler(3)
    a, b = shingle("One two  THREE four"), shingle("one Two three\tfour")
    assert (a == b).all() and len(a) == 2 and len(shingle(None)) == 0 and len(shingle("x y")) == 1
    assert len(shingle("a b c " * 30_000)) == 3 and (shingle("É b c") != shingle("é b c")).all()


def test_targets():
    assert mixing.targets([10, 10, 10]) == [5.0, 10.0, 15.0]
    assert mixing.targets([100, 1, 1]) == [96.0, 3.0, 3.0]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]
    rng = random.Random(4)
    for _ in range(50):
        sizes = [rng.randint(0, 1000) for _ in range(rng.randint(1, 30))]
        t = mixing.targets(sizes)
        assert abs(sum(t) - sum(sizes)) < 1e-6 and all(x <= 3 * s + 1e-9 for x, s in zip(t, sizes))


def test_permutations_and_draws():
    for n in (1, 2, 3, 5, 64, 65, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 1, 2)) == list(range(n))
    counts, slots = [500, 0, 1234, 77], 64
    shards = -(-sum(counts) // slots)
    at = np.zeros(4, dtype=np.int64)
    for s in range(shards):  # shards follow one another without gaps
        first, n = mixing.shard_slots(s, shards, counts, slots)
        assert (first == at).all() and n.sum() == min(slots, sum(counts) - s * slots)
        at = at + n
    assert at.tolist() == counts


def test_draws_beyond_the_sampler_are_random():
    counts = np.array([700_000_000, 5_000, 0, 600_000_000, 300], dtype=np.int64)
    total, take = int(counts.sum()), 650_002_650
    got = np.array([mixing._left(counts, take, (1, 2, i)) for i in range(400)])
    assert (got.sum(axis=1) == take).all() and (got >= 0).all() and (got <= counts).all()
    share = take / total
    sd = np.sqrt(counts * share * (1 - share) * (total - counts) / (total - 1))
    assert (abs(got.mean(axis=0) - counts * share) <= 0.25 * sd).all() and (abs(got.std(axis=0) - sd) <= 0.2 * sd).all()
    assert (mixing._left(counts, total, (1,)) == counts).all() and not mixing._left(counts, 0, (1,)).any()


def documents(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 400))), rng.choice(["a", "b", "b", "b", "é", None])) for i in range(300)]
    rows += [(900, None, "a"), (901, "", "b"), (902, "x " * 30_000, "long"), (903, "again", "a"), (903, "again", "a"), (None, "no id", "a")]
    return rows, spark.createDataFrame([(*r, 3, 4, "k") for r in rows], "doc_id bigint, text string, source string, size int, uid int, key string")


def test_mix_plan(spark):
    rows, df = documents(spark)
    got = mixing.plan(df).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words_of(t))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(order, mixing.targets([size[s] for s in order])))
    source = {d: s for d, _, s in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in size)
    again = mixing.plan(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.plan(df.limit(0)).count() == 0


def mixed_by_hand(rows, sizes, order):
    """Words taken of each row (doc_id, source, size), blocks and slots walked one by one; rows come in the order in which they are packed."""
    taken = Counter()
    aims = mixing.targets([sizes[s] for s in order])
    plans = [mixing.slots_of(sizes[s], t) for s, t in zip(order, aims)]
    for k, (s, (slots, cut)) in enumerate(zip(order, plans)):
        words = [d for d, source, n in rows if source == s for _ in range(n)]
        blocks = -(-len(words) // mixing.BLOCK)
        for t in range(slots):
            b = int(mixing.blocks_of(np.array([t % blocks]), len(words), k, t // blocks)[0])
            taken.update(words[b * mixing.BLOCK : (b + 1) * mixing.BLOCK][: cut if t == slots - 1 else None])
    return taken


def test_mix_by_brute_force(spark):
    rng = random.Random(10)
    rows = [(i, " ".join(f"w{i}" for _ in range(rng.choice([0, 1, 3, 10, 63, 64, 65, 300]))), rng.choice(["a", "b", "ü", None])) for i in range(120)]
    rows += [(200 + i, "x " * 10, s) for i, s in enumerate("pqr")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    packed = [(r["doc_id"], r["source"], r["size"]) for r in sorted(mixing.sized(df).collect(), key=lambda r: (r["key"], r["doc_id"], r["uid"]))]
    sizes = Counter()
    for _, s, n in packed:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = mixed_by_hand(packed, sizes, order)
    got = {r["doc_id"]: r["taken"] for r in mixing.plan(df).collect()}
    assert {d: n for d, n in got.items() if n} == {d: n for d, n in want.items() if n}
    small = spark.createDataFrame([(i, "x " * 10, s) for i, s in enumerate("abc")], "doc_id bigint, text string, source string")
    assert sorted((r["doc_id"], r["taken"]) for r in mixing.plan(small).collect()) == [(0, 5), (1, 10), (2, 15)]


def test_mixed_texts(spark):
    rows, df = documents(spark)
    plan, mixed = mixing.plan(df).collect(), mixing.mix(df)
    assert mixed.columns == df.columns
    words = Counter()
    for r in mixed.collect():
        assert r["size"] == 3 and r["key"] == "k"
        words[r["doc_id"]] += len(words_of(r["text"]))
    want = Counter()
    for r in plan:
        want[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in want.items() if v} == dict(words)


def quality_of(text):
    w = words_of(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rng = random.Random(6)
    texts = [None, "", " \n\t", "a " * 7, "a " * 8, "a " * 9, "#*$%&|<> é 😀\n\n x", "l\nl\n l\nl"]
    for _ in range(120):
        texts.append("".join(rng.choice(["a", "b", "c", "d"]) + rng.choice([" ", "  ", "\n", "\t", "\r\n", "\x0b"]) for _ in range(rng.randint(0, 60))))
    sentence = " ".join(f"s{i}" for i in range(12))
    texts += [f"{sentence}\nx y z\n{sentence}", "w " * 20_000]
    df = spark.createDataFrame([(i, t, "s", "h", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, source string, _host string, n_words int")
    for r in quality.judge(df).collect():
        n, *_ = want = quality_of(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, texts[r["doc_id"]]
        assert r["base_failed"] == (n < 20 or 100 * want[4] > 30 * n) and not (r["base_failed"] and r["kept"])


def lined(spark):
    rng = random.Random(8)
    rows = []
    for i in range(200):
        own = "\n".join(" ".join(f"t{rng.randrange(9999)}" for _ in range(12)) for _ in range(3))
        rows.append((i, own + ("\nCookie  notice here" if i % 2 else "") + ("\n\ncookie notice HERE " if i % 7 == 0 else ""), "big" if i < 190 else None))
    rows += [(500 + i, "only the cookie line\nwith one more of it that all of them have as their own text of twenty words or more for the base rule", "big") for i in range(40)]
    rows += [(700, None, "big"), (701, "", "small"), (702, "lone line", "small"), (702, "lone line", "small")]
    return rows, spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, source string, _line string")


def common(rows, least, ratio):
    pages, hold = Counter(), defaultdict(set)
    for i, (_, text, source) in enumerate(rows):
        pages[source] += 1
        for x in (text or "").split("\n"):
            if words_of(x):
                hold[source, " ".join(words_of(x)).lower()].add(i)
    return {k for k, v in hold.items() if len(v) >= least and len(v) > ratio * pages[k[0]]}


def test_line_dedup(spark):
    rows, df = lined(spark)
    bad = common(rows, line_dedup.LEAST_DOCUMENTS, line_dedup.RATIO)
    want = sorted(str((d, None if t is None else "\n".join(x for x in t.split("\n") if (s, " ".join(words_of(x)).lower()) not in bad))) for d, t, s in rows)
    got = line_dedup.clean(df)
    assert sorted(str((r["doc_id"], r["text"])) for r in got.collect()) == want and bad
    assert "_line" in got.columns and line_dedup.clean(df.limit(0)).count() == 0


def test_many_hosts(spark):
    rows = [(i, f"own text {i}\nthe notice of host {i % 40}\n{'x' * (i % 3)}", f"h{i % 40}" if i % 2 else None if i % 4 else "big") for i in range(600)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, n int")
    want = sorted(map(str, lines.with_common(df, "text", "source", 5, 0.05).withColumn("_common", F.sort_array("_common")).collect()))
    for few in (0, 9, 10, 35):
        assert sorted(map(str, lines.with_common(df, "text", "source", 5, 0.05, few).withColumn("_common", F.sort_array("_common")).collect())) == want


def test_depleted_documents_go(spark):
    rows, df = lined(spark)
    bad = common(rows, quality.LEAST_DOCUMENTS, quality.LIMIT)
    for r in quality.judge(df.dropDuplicates(["doc_id"])).collect():
        _, text, source = next(x for x in rows if x[0] == r["doc_id"])
        lost = sum(len(words_of(x)) for x in (text or "").split("\n") if (source, " ".join(words_of(x)).lower()) in bad)
        assert r["removed_words"] == lost and r["kept"] == (not r["base_failed"] and 100 * (r["n_words"] - lost) >= quality.KEEP_PERCENT * r["n_words"])
        if 500 <= r["doc_id"] < 540:
            assert not r["kept"]


def test_long_passages_stay_in_one_text(spark):
    long, other = " ".join(f"p{i}" for i in range(51)), " ".join(f"q{i}" for i in range(50))
    rows = [(i, f"own {i}\n{long if i % 2 else long.upper()} \n{other}\nend", f"s{i % 3}") for i in range(4)]
    rows += [(9, f"{rows[0][1]}", "s9"), (10, None, "s"), (11, "", None), (12, f"{long} x\n{long} x", "s")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, source string, _line string").repartition(3)
    got = line_dedup.passages_once(df)
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert got.columns == df.columns and len(texts) == len(rows) and texts[0] == texts[9]
    assert len({texts[i] for i in range(4) if "P50" in texts[i].upper()}) == 1
    assert all(texts[i] in (rows[i][1], f"own {i}\n{other}\nend") for i in range(4))
    assert (texts[10], texts[11], texts[12]) == (None, "", rows[-1][1])
    assert line_dedup.passages_once(df.limit(0)).count() == 0
