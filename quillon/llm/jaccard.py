"""Exact n-gram Jaccard join by a token-group matrix.

A document's set holds the 64-bit hashes of its word shingles; equal sets are
one class.  Two classes link when 100 * intersection >= PERCENT * union.

1. One pass hashes every text, names its class and counts tokens that are
   frequent within a task.  Tokens are ordered: others before the HEAVY most
   frequent ones, those by count; long ones before short ones.  The order
   steers cost only: any order is exact.
2. A second pass posts each class under the first n - need + l tokens of its
   set, need being the least overlap that a link leaves possible.  Two linked
   classes share l of these tokens at least (l = SHARED, fewer for tiny sets).
   A token whose count promises over SPLIT classes has its list dealt over as
   many slots as that takes.
3. Similar classes are partitioned into groups: within a token's list, classes
   of like size point to the hub whose own tokens are the most common, each
   class keeps its best hub, and this forest becomes groups by pointer jumping.
4. The token-group matrix has a row for each token of a group.  Two groups
   are compared only where their rows share enough tokens and their sizes fit.
5. A third read of the texts, filtered by text hash, hashes those of the
   classes in a group or in a pair of groups.  Classes that link with their hub
   make the parts of a group, each connected.  A group of several parts is
   compared with itself, all but its largest part as queries.
6. Members of a group are dealt into chunks by size.  A query's overlap with a
   chunk's token union bounds its overlap with every member, and only chunks
   that qualify are opened and compared exactly.
7. Links between parts join them into components, by label propagation with
   pointer jumping over parts.

A part is connected by verified links, so its inner pairs need no expansion;
chunks and shares of queries bound what a task holds.  Classes are told apart
by 64-bit hashes.

Null and empty texts, and texts of white space, have an empty set, no links and
themselves as component.  Repeated rows are one class and get a row each; rows
of one doc_id with different texts are different documents.  Rows with a null
doc_id take part; a component is the least doc_id that isn't null in it.  Very
long texts are hashed whole.  An empty table gives an empty result.  Only
doc_id, text and the key are read, whatever other columns are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded, broadcast_if_small, forget, give_back, slices, written

WORDS = 3
PERCENT = 90
HEAVY = 1 << 20
OFTEN = 4
SHARED = 6
#: Classes in one slot of a token's list.
SPLIT = 1 << 12
#: Groups of a matrix row whose pairs are made within the row; longer rows are joined.
ROW = 256
#: Tokens of a chunk, and of the queries that one task puts to it.
CHUNK_TOKENS = 400_000
#: Bits of the filter of text hashes, at most.
FILTER_BITS = 1 << 27

_INSIDE = np.ones(256, dtype=np.int8)
_INSIDE[[9, 10, 11, 12, 13, 32]] = 0
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_NONE = np.zeros(0, dtype=np.uint64)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted, distinct shingle hashes of a text; words are hashed by polynomial over their bytes."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.inverse = pow(_BASE, -1, 1 << 64)
        self.up, self.down = _powers(1 << 16, _BASE), _powers(1 << 16, self.inverse)

    def shingles(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Hash and length (bytes in words) of each shingle, in the order of the text."""
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_LOWER), dtype=np.uint8)
        if len(data) + 1 > len(self.up):
            self.up, self.down = _powers(2 * len(data) + 2, _BASE), _powers(2 * len(data) + 2, self.inverse)
        inside = np.zeros(len(data) + 2, dtype=np.int8)
        inside[1:-1] = _INSIDE[data]
        edge = inside[1:] - inside[:-1]
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(begin):
            return _NONE, _NONE
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data + np.uint64(1)) * self.up[: len(data)], out=total[1:])
        long = (end - begin).astype(np.uint64)
        word = mixed((total[end] - total[begin]) * self.down[begin] + long)
        k = min(self.words, len(word))
        out, size = np.zeros(len(word) - k + 1, dtype=np.uint64), np.zeros(len(word) - k + 1, dtype=np.uint64)
        for i in range(k):
            out = mixed(out + word[i : len(word) - k + 1 + i] + np.uint64(i + 1 + 16 * k))
            size += long[i : len(word) - k + 1 + i]
        return out, size

    def __call__(self, text: str | None) -> np.ndarray:
        return distinct(self.shingles(text)[0])

    def with_lengths(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The set and the length of each of its shingles."""
        tokens, size = self.shingles(text)
        at = np.argsort(tokens)
        tokens, size = tokens[at], size[at]
        first = np.ones(len(tokens), dtype=bool)
        first[1:] = tokens[1:] != tokens[:-1]
        return tokens[first], size[first]


def distinct(tokens: np.ndarray) -> np.ndarray:
    tokens = np.sort(tokens)
    first = np.ones(len(tokens), dtype=bool)
    first[1:] = tokens[1:] != tokens[:-1]
    return tokens[first]


def class_of(tokens: np.ndarray) -> int:
    """A signed 64-bit name of the set."""
    with np.errstate(over="ignore"):
        a = int(mixed(tokens * np.uint64(3) + np.uint64(len(tokens))).sum())
    return int(np.uint64(a & (1 << 64) - 1).astype(np.int64))


def need(n: int, percent: int) -> int:
    """Least overlap of a set of n with anything it links to."""
    return -(-percent * n // 100)


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_hash() -> Column:
    return F.xxhash64("text").alias("_th")


def survey(documents: DataFrame, words: int, key: str | None = None) -> DataFrame:
    """Rows (doc_id, cid, n, th) for documents, with the bigint column `key` if one is named, and (token, count) for what is frequent within a task; written."""
    ids = documents.schema["doc_id"].dataType.simpleString()
    extra = [key] if key else []
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(documents.schema["doc_id"].dataType)
    schema = pa.schema([("doc_id", arrow), ("cid", pa.int64()), ("n", pa.int32()), ("th", pa.int64()), ("token", pa.int64()), ("count", pa.int64()), *((k, pa.int64()) for k in extra)])

    def run(batches: Iterator[pa.RecordBatch]):
        shingle, seen = Shingler(words), set()
        keys, counts, fresh, waiting = _NONE, np.zeros(0, np.int64), [], 0

        def fold(keys, counts):
            k, n = np.unique(np.concatenate(fresh), return_counts=True)
            k, n = k[n > 1], n[n > 1]
            both, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
            sums = np.zeros(len(both), np.int64)
            np.add.at(sums, at, np.concatenate([counts, n]))
            if len(both) > HEAVY:
                top = np.sort(np.argpartition(-sums, HEAVY)[:HEAVY])
                both, sums = both[top], sums[top]
            return both, sums

        for batch in slices(batches):
            cid, size = [], []
            for text in batch.column(1).to_pylist():
                tokens = shingle(text)
                name = class_of(tokens)
                cid.append(name if len(tokens) else None)
                size.append(len(tokens))
                if len(tokens) and name not in seen:
                    seen.add(name)
                    fresh.append(tokens)
                    waiting += len(tokens)
                    if waiting > 1_000_000:
                        keys, counts = fold(keys, counts)
                        fresh, waiting = [], 0
            none = pa.nulls(len(cid), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cid, pa.int64()), pa.array(size, pa.int32()), batch.column(2), none, none, *(batch.column(3) for _ in extra)], schema=schema)
        if fresh:
            keys, counts = fold(keys, counts)
        if len(keys):
            n = len(keys)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(n, arrow), none, pa.nulls(n, pa.int32()), none, pa.array(_signed(keys)), pa.array(counts), *(none for _ in extra)], schema=schema)

    ddl = ", ".join([f"doc_id {ids}, cid bigint, n int, th bigint, token bigint, count bigint", *(f"`{k}` bigint" for k in extra)])
    return written(bounded(documents.select("doc_id", "text", text_hash(), *extra)).mapInArrow(run, ddl), "jaccard-survey")


def heavy_tokens(surveyed: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The frequent tokens, sorted, and the rank of each by count and the count; HEAVY at most."""
    top = surveyed.filter("token is not null").groupBy("token").agg(F.sum("count").alias("n")).filter(F.col("n") >= OFTEN).orderBy(F.desc("n"), "token").limit(HEAVY)
    found = top.toArrow()
    tokens, counts = found["token"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.lexsort((tokens, counts))
    rank = np.empty(len(tokens), np.int64)
    rank[order] = np.arange(len(tokens))
    at = np.argsort(tokens)
    return tokens[at], rank[at], counts[at]


def postings(documents: DataFrame, heavy: tuple[np.ndarray, np.ndarray, np.ndarray], words: int, percent: int) -> DataFrame:
    """(token, cid, size): the first tokens of each class; size is 1024 n + q, q telling how common the class's tokens are, and below 0 in the slots that share the list of a frequent token."""
    schema = pa.schema([("token", pa.int64()), ("cid", pa.int64()), ("size", pa.int64())])
    known, rank, counts = heavy
    slots = slots_of(counts)

    def run(batches):
        shingle, seen = Shingler(words), set()
        for batch in slices(batches):
            token, cid, size = [], [], []
            for text in batch.column(0).to_pylist():
                tokens, long = shingle.with_lengths(text)
                n = len(tokens)
                if not n or (name := class_of(tokens)) in seen:
                    continue
                seen.add(name)
                length = min(n, n - need(n, percent) + min(SHARED, need(n, percent)))
                often = np.zeros(n, dtype=bool)
                if len(known):
                    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                    often = known[at] == tokens
                mark = np.full(length, 1024 * n + 1000 * int(often.sum()) // n, np.int64)
                rare = ~often
                first = tokens[rare][np.argsort(~long[rare], kind="stable")][:length]
                if len(first) < length:
                    mine = at[often]
                    mine = mine[np.argsort(rank[mine])][: length - len(first)]
                    over = slots[mine]
                    mark[len(first) :] *= np.where(over > 0, -1, 1)
                    first = np.concatenate([first, np.where(over > 0, slot_key(known[mine], name % np.maximum(over, 1)), known[mine])])
                token.append(first)
                cid.append(np.full(length, name, np.int64))
                size.append(mark)
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (_signed(np.concatenate(token)), np.concatenate(cid), np.concatenate(size))], schema=schema)
        give_back()

    return bounded(documents.select("text")).mapInArrow(run, "token bigint, cid bigint, size bigint")


def slots_of(counts: np.ndarray) -> np.ndarray:
    """Slots of each token's list; 0: the list isn't shared out."""
    return np.where(counts > SPLIT, -(-counts // SPLIT), 0)


def slot_key(tokens: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return mixed(tokens + slot.astype(np.uint64) * np.uint64(_BASE))


def lists(posted: DataFrame, percent: int, heavy: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[DataFrame, list[DataFrame]]:
    """(token, cid, n, hub) of the lists of two classes or more, each class once in a list, and the tables it reads; one shuffle, by token or slot."""
    posted = posted.repartition("token").withColumn("n", F.floor(F.abs("size") / 1024).cast("int")).withColumn("_band", F.floor(F.log("n") / math.log(100 / percent)))
    again = W.partitionBy("token").orderBy("_band", "cid")
    posted = posted.withColumn("_same", F.lag("cid").over(again)).filter("_same is null or _same <> cid").drop("_same")
    posted = posted.withColumn("_list", F.count("*").over(W.partitionBy("token"))).filter("_list > 1 or size < 0")
    hub = F.max(F.struct(F.abs("size") % 1024, "cid"))
    found = posted.withColumn("hub", hub.over(W.partitionBy("token", "_band"))["cid"]).withColumn("q", F.when(F.col("size") < 0, F.abs("size") % 1024))
    found = written(found.select("token", "cid", "n", "_band", "hub", "q"), "jaccard-lists")
    rest = found.filter("q is null").select("token", "cid", "n", "hub")
    slots = slots_of(heavy[2])
    if not slots.any():
        return rest, [found]
    # what is dealt over slots comes back to its token, of which there are few, and takes the best hub of all its slots
    at = np.repeat(np.flatnonzero(slots), slots[slots > 0])
    number = np.arange(len(at)) - np.repeat(np.cumsum(slots[slots > 0]) - slots[slots > 0], slots[slots > 0])
    names = pa.table({"token": pa.array(_signed(slot_key(heavy[0][at], number))), "_token": pa.array(_signed(heavy[0][at]))})
    names = broadcast_if_small(found.sparkSession.createDataFrame(names), len(at))
    dealt = found.filter("q is not null").join(names, "token").select(F.col("_token").alias("token"), "cid", "n", "_band", "q")
    top = dealt.groupBy("token", "_band").agg(F.max(F.struct("q", "cid"))["cid"].alias("hub"))
    dealt = written(dealt.join(top, ["token", "_band"]).select("token", "cid", "n", "hub"), "jaccard-dealt")
    return rest.unionByName(dealt), [found, dealt]


def sets_of(documents: DataFrame, wanted: DataFrame, words: int, tag: str) -> DataFrame:
    """wanted (cid, th, ...) with the tokens of each class; a filter of bounded size over the hashes of whole texts keeps others from being split and hashed."""
    count = wanted.count()
    bits = 1 << max(13, min(FILTER_BITS.bit_length() - 1, (16 * count).bit_length()))
    places = wanted.select(F.explode(F.array(F.pmod(F.col("th"), F.lit(bits)), F.pmod(F.shiftright("th", 32), F.lit(bits)))).alias("place"))
    packed = places.groupBy(F.shiftright("place", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("value")).toArrow()
    filled = np.zeros(bits // 64, np.int64)
    filled[packed["at"].to_numpy()] = packed["value"].to_numpy()
    filled = filled.view(np.uint64)
    schema = pa.schema([("cid", pa.int64()), ("tokens", pa.binary())])

    def held(th: np.ndarray) -> np.ndarray:
        out = np.ones(len(th), dtype=bool)
        for place in (th % bits, (th >> 32) % bits):
            out &= (filled[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return out

    def run(batches):
        shingle, seen = Shingler(words), set()
        for batch in slices(batches):
            cid, sets = [], []
            for i in np.flatnonzero(held(batch.column(1).to_numpy(zero_copy_only=False))).tolist():
                tokens = shingle(batch.column(0)[i].as_py())
                if len(tokens) and (name := class_of(tokens)) not in seen:
                    seen.add(name)
                    cid.append(name)
                    sets.append(tokens.tobytes())
            if cid:
                yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(sets, pa.binary())], schema=schema)

    found = bounded(documents.select("text", text_hash())).mapInArrow(run, "cid bigint, tokens binary")
    once = found.join(wanted, "cid").groupBy("cid", *(c for c in wanted.columns if c not in ("cid", "th"))).agg(F.first("tokens").alias("tokens"))
    return written(once, tag)


def verified(sets: DataFrame, percent: int) -> DataFrame:
    """(cid, hub) where the whole sets of a class and its hub link; sets: (cid, hub, is_hub, tokens)."""
    hubs = sets.filter("is_hub").select(F.col("cid").alias("hub"), F.col("tokens").alias("_other"))
    both = sets.filter("hub is not null").select("cid", "hub", "tokens").join(hubs, "hub").select("cid", "hub", "tokens", "_other")
    schema = pa.schema([("cid", pa.int64()), ("hub", pa.int64())])

    def run(batches):
        for batch in batches:
            out = []
            for cid, hub, a, b in zip(*(batch.column(i) for i in range(4))):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                if linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), percent):
                    out.append((cid.as_py(), hub.as_py()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], schema=schema)

    return both.mapInArrow(run, "cid bigint, hub bigint")


def roots(parents: DataFrame, tag: str) -> DataFrame:
    """(cid, gid): pointer jumping over a forest (cid, hub); roots are left out."""
    now = written(parents.select("cid", F.col("hub").alias("gid")), tag)
    while True:
        up = now.select(F.col("cid").alias("gid"), F.col("gid").alias("_up"))
        new = written(now.join(up, "gid", "left").select("cid", F.coalesce("_up", "gid").alias("gid"), F.col("_up").isNotNull().alias("_moved")), tag)
        forget(now)
        if not new.filter("_moved").limit(1).count():
            return new
        now = new


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the least node reachable."""
    both = written(edges.select(F.col("a").alias("node"), F.col("b").alias("peer")).union(edges.select(F.col("b"), F.col("a"))).distinct(), tag)
    labels = written(both.groupBy("node").agg(F.least("node", F.min("peer")).alias("label")), tag)
    while True:
        # the least label of a node's peers, passed on to the node's label and then halved by a jump
        seen = both.join(labels.select(F.col("node").alias("peer"), F.col("label").alias("_l")), "peer").groupBy("node").agg(F.min("_l").alias("_l"))
        near = labels.select("node", "label").join(seen, "node").select("node", F.col("label").alias("_old"), F.least("label", "_l").alias("label"))
        hooked = near.groupBy(F.col("_old").alias("node")).agg(F.min("label").alias("_h"))
        jump = near.join(hooked, "node", "left").select("node", "_old", F.least("label", F.coalesce("_h", "label")).alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        new = written(jump.join(up, "label", "left").select("node", F.least("label", F.coalesce("_up", "label")).alias("label"), "_old"), tag)
        forget(labels)
        if not new.filter("label <> _old").limit(1).count():
            forget(both)
            return new
        labels = new


def pairs_of_groups(found: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(gid, gid_b): the token-group matrix, and the pairs of groups that its rows leave; written."""
    rows = found.select("token", "cid", "n").join(groups.select("cid", "gid"), "cid", "left").groupBy("token", F.coalesce("gid", "cid").alias("gid")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    matrix = written(rows.withColumn("_groups", F.count("*").over(W.partitionBy("token"))).filter("_groups > 1"), "jaccard-matrix")

    def fits(x, y):
        return (100 * x("high") >= percent * y("low")) & (100 * y("high") >= percent * x("low"))

    def of_row(row: Column) -> Column:
        pair = lambda x: lambda y: F.struct(x["gid"].alias("gid"), y["gid"].alias("gid_b"), x["low"].alias("low"), y["low"].alias("low_b"))
        later = lambda x: F.filter(row, lambda y: (y["gid"] > x["gid"]) & fits(x.getField, y.getField))
        return F.flatten(F.transform(row, lambda x: F.transform(later(x), pair(x))))

    short = matrix.filter(F.col("_groups") <= ROW).groupBy("token").agg(F.collect_list(F.struct("gid", "low", "high")).alias("row"))
    short = short.select(F.explode(of_row(F.col("row"))).alias("p")).select("p.*")
    long = matrix.filter(F.col("_groups") > ROW).drop("_groups")
    other = long.select("token", *(F.col(c).alias(f"{c}_b") for c in ("gid", "low", "high")))
    long = long.join(other, "token").filter((F.col("gid") < F.col("gid_b")) & fits(F.col, lambda c: F.col(f"{c}_b"))).select("gid", "gid_b", "low", "low_b")
    shared = short.unionByName(long).groupBy("gid", "gid_b").agg(F.count("*").alias("_k"), F.min("low").alias("_low"), F.min("low_b").alias("_low_b"))
    chosen = written(shared.filter(F.col("_k") >= enough(percent, "_low", "_low_b")).select("gid", "gid_b"), "jaccard-chosen")
    forget(matrix)
    return chosen


def enough(percent: int, *n: str) -> Column:
    """Posted tokens that linked sets of these sizes share at least."""
    return F.least(*(F.ceil(F.lit(percent) * F.col(c) / 100) for c in n), F.lit(SHARED))


def opened(candidates: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between parts, enough of them to connect what is linked: for candidates (a, b) of groups, the members (gid, part, cid, n, ask) of a are queries against the chunks of b that qualify.

    In a group's comparison with itself only the members marked ask are queries.
    """
    banded = members.withColumn("_band", F.floor(F.log("n") / math.log(100 / percent)))
    deal = banded.groupBy("gid", "_band").agg(F.ceil(F.sum("n") / CHUNK_TOKENS).alias("_chunks"))
    deal = written(deal, "jaccard-deal")
    narrow = banded.join(broadcast_if_small(deal, deal.count()), ["gid", "_band"]).withColumn("chunk", F.shiftleft("_band", 32) + F.pmod(F.xxhash64("cid"), F.col("_chunks")))
    narrow = written(narrow.select("gid", "part", "cid", "n", "ask", "chunk"), "jaccard-chunks")
    chunks = narrow.groupBy(F.col("gid").alias("b"), "chunk").agg(F.min("n").alias("_low"), F.max("n").alias("_high"))
    asks = candidates.join(narrow.select(F.col("gid").alias("a"), "part", "cid", "n", "ask"), "a").filter("ask or a <> b").join(chunks, "b")
    asks = asks.filter((100 * F.col("n") >= percent * F.col("_low")) & (100 * F.col("_high") >= percent * F.col("n"))).select("b", "chunk", "part", "cid", "n")
    asks = written(asks, "jaccard-asks")
    counts = asks.groupBy("b", "chunk").agg(F.ceil(F.sum("n") / CHUNK_TOKENS).alias("_shares"))
    queries = asks.join(counts, ["b", "chunk"]).select("b", "chunk", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("_shares")).alias("share"), "part", "cid", F.lit(True).alias("query"), F.lit(False).alias("member"))
    shares = counts.select("b", "chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_shares") - 1)).alias("share"))
    held = narrow.select(F.col("gid").alias("b"), "chunk", "part", "cid").join(shares, ["b", "chunk"]).select("b", "chunk", "share", "part", "cid", F.lit(False).alias("query"), F.lit(True).alias("member"))
    work = held.unionByName(queries).groupBy("b", "chunk", "share", "part", "cid").agg(F.max("query").alias("query"), F.max("member").alias("member"))
    work = written(work, "jaccard-work")
    rows = work.join(sets.select("cid", "tokens"), "cid")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(key, found):
        query, member, part = (found[c].to_numpy() for c in ("query", "member", "part"))
        tokens = [np.frombuffer(x.as_buffer(), np.uint64) for x in found["tokens"].combine_chunks()]
        inside = np.flatnonzero(member)
        if not len(inside):
            return pa.Table.from_pylist([], schema=schema)
        parts, size = part[inside], np.array([len(tokens[i]) for i in inside])
        union = np.concatenate([tokens[i] for i in inside])
        owner = np.repeat(np.arange(len(inside)), size)
        at = np.argsort(union, kind="stable")
        union, owner = union[at], owner[at]
        joined: dict[int, int] = {}

        def top(x):
            while (y := joined.get(x, x)) != x:
                joined[x] = x = joined.get(y, y)
            return x

        links = []
        for i in np.flatnonzero(query):
            mine, own = tokens[i], int(part[i])
            low, high = np.searchsorted(union, mine, "left"), np.searchsorted(union, mine, "right")
            spans = high - low
            if int((spans > 0).sum()) < need(len(mine), percent):  # the bound over the chunk's token union
                continue
            take = np.repeat(low - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(int(spans.sum()))
            common = np.bincount(owner[take], minlength=len(inside))
            hit = (100 * common >= percent * (size + len(mine) - common)) & (parts != own)
            for p in np.unique(parts[hit]).tolist():
                a, b = top(own), top(p)
                if a != b:
                    joined[max(a, b)] = min(a, b)
                    links.append((own, p))
        return pa.Table.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*links)] or [pa.array([], pa.int64())] * 2, schema=schema)

    links = written(rows.groupBy("b", "chunk", "share").applyInArrow(compare, "a bigint, b bigint").distinct(), "jaccard-links")
    forget(deal, narrow, asks, work)
    return links


def join(documents: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    With a key, a bigint column that tells rows of the same doc_id apart, also the key and head: the least (unnamed, doc_id, key) of
    the row's group, unnamed being whether the doc_id is null.  Head is null where the row is its own group.
    """
    extra = [key] if key else []
    surveyed = survey(documents, words, key)
    docs = surveyed.filter("token is null").select("doc_id", "cid", "n", *extra)
    heads = [F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", F.col(k).alias("key")) for k in extra]
    classes = surveyed.filter("cid is not null").groupBy("cid").agg(F.first("n").alias("n"), F.min("th").alias("th"), F.min("doc_id").alias("_first"), F.count("*").alias("_copies"), *(F.min(h).alias("head") for h in heads))
    classes = written(classes, "jaccard-classes")
    heavy = heavy_tokens(surveyed)
    found, tables = lists(postings(documents, heavy, words, percent), percent, heavy)
    # groups: the best hub of each class, among those of like size in its tokens' lists
    best = found.filter("hub <> cid").groupBy("cid", "n", "hub").agg(F.count("*").alias("_k"))
    best = best.filter(F.col("_k") >= enough(percent, "n")).groupBy("cid").agg(F.max(F.struct("_k", "hub")).alias("_best"))
    pairs = written(best.select("cid", F.col("_best.hub").alias("hub")), "jaccard-pairs")
    groups = roots(pairs, "jaccard-groups")
    chosen = pairs_of_groups(found, groups, percent)
    forget(*tables)
    # the sets of all classes in groups of two or more, and of those alone that are to be compared with others
    grouped = groups.select("cid", "gid").unionByName(groups.select("gid", F.col("gid").alias("cid")).distinct())
    seconds = chosen.select("gid").union(chosen.select("gid_b")).distinct().join(groups.select("gid").distinct(), "gid", "left_anti")
    hubs = pairs.select(F.col("hub").alias("cid")).distinct().withColumn("is_hub", F.lit(True))
    wanted = grouped.unionByName(seconds.select("gid", F.col("gid").alias("cid"))).join(classes.select("cid", "n", "th"), "cid").join(pairs, "cid", "left").join(hubs, "cid", "left")
    wanted = written(wanted.select("cid", "th", "gid", "n", "hub", F.coalesce("is_hub", F.lit(False)).alias("is_hub")), "jaccard-wanted")
    sets = sets_of(documents, wanted, words, "jaccard-sets")
    parts = roots(verified(sets, percent), "jaccard-parts").select("cid", F.col("gid").alias("part"))
    # the largest part of a group asks nothing of its own group, and a group of a class and its hub is decided
    members = wanted.select("gid", "cid", "n").join(parts, "cid", "left").withColumn("part", F.coalesce("part", "cid"))
    members = written(members, "jaccard-members")
    main = members.groupBy("gid", "part").agg(F.count("*").alias("_m")).groupBy("gid").agg(F.max(F.struct("_m", "part"))["part"].alias("_main"), F.count("*").alias("_parts"), F.sum("_m").alias("_members"))
    main = written(main, "jaccard-sizes")
    total = main.select("gid", "_members")
    across = chosen.join(total, "gid").join(total.select(F.col("gid").alias("gid_b"), F.col("_members").alias("_b")), "gid_b")
    swap = F.col("_members") > F.col("_b")
    across = across.select(F.when(swap, F.col("gid_b")).otherwise(F.col("gid")).alias("a"), F.when(swap, F.col("gid")).otherwise(F.col("gid_b")).alias("b"))
    within = main.filter("_parts > 1 and _members > 2").select(F.col("gid").alias("a"), F.col("gid").alias("b"))
    candidates = written(across.unionByName(within), "jaccard-candidates")
    touched = candidates.select(F.col("a").alias("gid")).union(candidates.select("b")).distinct()
    inner = members.join(touched, "gid", "left_semi").join(main.select("gid", "_main"), "gid").withColumn("ask", F.col("part") != F.col("_main"))
    links = opened(candidates, inner, sets, percent)
    top = components(links, "jaccard-components")
    # classes, documents
    named = members.join(top.select(F.col("node").alias("part"), "label"), "part", "left").select("cid", F.coalesce("label", "part").alias("label"))
    head = ["head"] if key else []
    known = classes.select("cid", "_first", "_copies", *head).join(named, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least_doc = known.groupBy("label").agg(F.min("_first").alias("component_id"), F.sum("_copies").alias("_size"), *(F.min("head").alias("head") for _ in extra)).filter("_size > 1")
    special = written(known.drop("head").join(least_doc, "label").select("cid", "component_id", *head), "jaccard-special")
    forget(classes, pairs, groups, chosen, wanted, sets, members, main, candidates, links, top)
    out = docs.join(special, "cid", "left")
    return out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *extra, *head)


#: The same in DuckDB, by all pairs that share a shingle; for small tables only.
SQL = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS u, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT u, array_to_string(list_slice(ws, i, i + {WORDS - 1}), ' ') AS g FROM (SELECT u, ws, unnest(range(1, greatest(len(ws) - {WORDS - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT u, count(*) AS n FROM s GROUP BY u),
p AS (SELECT a.u AS a, b.u AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.u < b.u GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.u = a JOIN n y ON y.u = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(u, v) AS (SELECT u, u FROM w UNION SELECT r.u, e.b FROM r JOIN e ON e.a = r.v),
m AS (SELECT r.u, min(w.doc_id) AS component_id FROM r JOIN w ON w.u = r.v GROUP BY r.u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (u) JOIN m USING (u)
"""
