"""Toxic passages by maximum-scoring segments.

Token scores are log-odds of toxic against clean text.  A token's share of
toxic occurrences has a Dirichlet prior centred on that of its prefix, whose
prior is that of the shorter prefix, down to the share of all tokens, so rare
and unseen words take the score of the words they resemble.  Every score is
lowered by DRIFT, which makes the expected score of clean text negative; one
linear scan then finds all maximal scoring segments of a text.  Segment scores
become extreme-value statistics with Karlin-Altschul parameters of the clean
training text, those that are significant are summed, and a logistic curve,
fitted on out-of-fold scores, turns the sum into a probability.

The model is fitted on at most TRAIN_ROWS labelled documents, the first by hash
of doc_id among those given.  Labels without a doc_id or a value teach nothing;
of several labels of a document the greatest counts.  Null and empty texts have
no segment and get the probability of that; very long texts are scored whole,
and repeated rows alike.  Without labels of both kinds every score is 0.  An
empty table gives an empty result.  Only the columns kept and text are read,
whatever others are called.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

TRAIN_ROWS = 4000
PREFIXES = (3, 4, 5, 6)
PRIOR = 6.0
DRIFT = 1.0
CAP = 4.0
FOLDS = 2
#: Least normalised scores that count as significant; fit() takes the one with the least out-of-fold loss.
CUTS = (0.0, 2.0, 3.0, 4.0, 5.0, 6.0)
REMEMBERED = 1 << 16
#: A word is kept beside its prefix only if it moves the logarithm of the share by this much.
MOVES = 0.05

WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, begin, end), left to right, in linear time."""
    found: list[tuple[float, float, int, int, int]] = []  # total before, total after, begin, end, last entry with a lower total before
    total = 0.0
    for i, s in enumerate(scores):
        before = total
        total += s
        if s <= 0:
            continue
        begin, j = i, len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= before:
                j = found[j][4]
            if j < 0 or found[j][1] >= total:
                found.append((before, total, begin, i + 1, j))
                break
            before, begin = found[j][0], found[j][2]
            del found[j:]
            j = len(found) - 1
    return [(b - a, x, y) for a, b, x, y, _ in found]


@dataclass
class Model:
    """Shares of toxic occurrences by prefix and word, the extreme-value parameters and the curve."""

    base: float = 0.5
    shares: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    scale: float = 1.0
    slope: float = 0.0
    level: float = -30.0
    cut: float = 0.0
    cache: dict[str, float] = field(default_factory=dict)

    def score_of(self, word: str) -> float:
        share = self.shares.get("=" + word)
        if share is None:
            for n in reversed(PREFIXES):
                if len(word) >= n and (share := self.shares.get(word[:n])) is not None:
                    break
            else:
                share = self.base
        odds = math.log(share / (1 - share)) - math.log(self.base / (1 - self.base))
        return max(-CAP, min(CAP, odds)) - DRIFT

    def scores(self, words: list[str]) -> list[float]:
        cache, out = self.cache, []
        for w in words:
            s = cache.get(w)
            if s is None:
                if len(cache) > REMEMBERED:
                    cache.clear()
                s = cache[w] = self.score_of(w)
            out.append(s)
        return out

    def significant(self, words: list[str], cut: float | None = None) -> list[tuple[float, int, int]]:
        """Segments whose normalised score, less the logarithm of the text's length, is over the cut."""
        least, cut = math.log(self.scale * max(1, len(words))), self.cut if cut is None else cut
        found = ((self.rate * s - least, a, b) for s, a, b in segments(self.scores(words)))
        return [x for x in found if x[0] > cut]

    def statistic(self, words: list[str]) -> float:
        return math.log1p(sum(x[0] for x in self.significant(words)))

    def probability(self, statistic: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * statistic + self.level)))) if self.shares else 0.0


def token_model(rows: list[tuple[list[str], int]]) -> Model:
    """Scores and extreme-value parameters; both kinds of rows are needed."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for words, toxic in rows:
        seen[toxic].update(set(words))  # once for each text: a word that one text repeats says little
    sums = sum(seen[0].values()), sum(seen[1].values())
    model = Model(base=max(1e-6, min(0.5, (sums[1] + 0.5) / (sums[0] + sums[1] + 1))))
    counts: dict[str, list[int]] = {}
    for toxic, words in enumerate(seen):
        for word, n in words.items():
            for key in (*(word[:k] for k in PREFIXES if len(word) >= k), "=" + word):
                counts.setdefault(key, [0, 0])[toxic] += n
    for key in sorted(counts, key=lambda k: (k[0] == "=", len(k), k)):
        clean, toxic = counts[key]
        whole = key[0] == "="
        word = key[1:] if whole else key[:-1]
        prior = next((model.shares[word[:n]] for n in reversed(PREFIXES) if len(word) >= n and word[:n] in model.shares), model.base)
        share = (toxic + PRIOR * prior) / (clean + toxic + PRIOR)
        if not whole or clean + toxic > 1 and abs(math.log(share / prior)) > MOVES:
            model.shares[key] = max(1e-9, min(1 - 1e-9, share))
    # rate: the positive root of E[exp(rate * score)] = 1 over clean text
    at = Counter()
    for word, n in seen[0].items():
        at[round(model.score_of(word), 2)] += n
    mean = lambda x: sum(n * math.exp(x * s) for s, n in at.items()) / max(1, sums[0])
    low, high = 1e-3, 10.0
    if any(s > 0 for s in at):
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if mean(mid) > 1 else (mid, high)
        model.rate = low
    # scale: the mean excess of the best segments of clean texts, by the moments of the Gumbel law
    best = []
    for words, toxic in rows:
        if not toxic and words:
            top = max((s for s, _, _ in segments(model.scores(words))), default=0.0)
            best.append(model.rate * top - math.log(len(words)))
    if best:
        model.scale = math.exp(sum(best) / len(best) - 0.5772156649)
    return model


def curve(points: list[tuple[float, int]]) -> tuple[float, float, float]:
    """(loss, slope, level) of the logistic regression of one variable with a weak ridge: Newton's steps, halved until they help."""

    def loss(a, b):
        z = [a * x + b for x, _ in points]
        return sum(max(v, 0) + math.log1p(math.exp(-abs(v))) - v * t for v, (_, t) in zip(z, points)) + 5e-3 * a * a + 5e-4 * b * b

    a, b = 0.0, 0.0
    now = loss(a, b)
    for _ in range(40):
        ga, gb, haa, hab, hbb = -1e-2 * a, -1e-3 * b, 1e-2, 0.0, 1e-3
        for x, t in points:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b))))
            w = p * (1 - p)
            ga, gb = ga + (t - p) * x, gb + t - p
            haa, hab, hbb = haa + w * x * x, hab + w * x, hbb + w
        det = haa * hbb - hab * hab
        da, db, step = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det, 1.0
        while (new := loss(a + step * da, b + step * db)) > now and step > 1e-6:
            step /= 2
        if now - new < 1e-7 * now:
            break
        a, b, now = a + step * da, b + step * db, new
    return now, max(a, 0.0), b


def fit(rows: list[tuple[list[str], int]]) -> Model:
    """The whole model from (words, toxic) rows."""
    if len({t for _, t in rows}) < 2:
        return Model()
    found: list[tuple[list[float], int]] = []  # positive normalised scores out of fold
    for k in range(FOLDS):
        rest = [r for i, r in enumerate(rows) if i % FOLDS != k]
        if len({t for _, t in rest}) == 2:
            part = token_model(rest)
            found += [([x[0] for x in part.significant(w, 0.0)], t) for i, (w, t) in enumerate(rows) if i % FOLDS == k]
    model = token_model(rows)
    found = found or [([x[0] for x in model.significant(w, 0.0)], t) for w, t in rows]
    best = min((*curve([(math.log1p(sum(x for x in xs if x > cut)), t) for xs, t in found]), cut) for cut in CUTS)
    _, model.slope, model.level, model.cut = best
    model.cache = {}
    return model


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def training_rows(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[list[str], int]]:
    """Words and label of at most `rows` labelled documents whose crc32 remainder isn't 0; of several texts of one doc_id, that with the least hash."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.first("_toxic").alias("_toxic"), F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    found = sorted((zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"] or "", r["_toxic"]) for r in texts.toLocalIterator(prefetchPartitions=True))
    return [(list(map(sys.intern, words_of(text))), int(toxic > 0)) for _, _, text, toxic in found]


def score(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """score, n_passages and the significant passages (word ranges), beside the columns kept."""
    keep = keep or ["doc_id"]
    kinds = {f.name: f.dataType for f in documents.schema.fields}
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [(n, to_arrow_type(kinds[n])) for n in keep] + [("score", pa.float64()), ("n_passages", pa.int64()), ("passages", pa.list_(pa.list_(pa.int64())))]
    names = keep if "text" in keep else [*keep, "text"]
    at = names.index("text")

    def make():
        def row(*values):
            words = words_of(values[at])
            found = model.significant(words)
            p = model.probability(math.log1p(sum(x[0] for x in found)))
            return (*values[: len(keep)], p, len(found), [[a, b] for _, a, b in found])

        return row

    ddl = ", ".join(f"`{n}` {kinds[n].simpleString()}" for n in keep)
    return map_rows(documents, names, make, fields, f"{ddl}, score double, n_passages bigint, passages array<array<bigint>>")
