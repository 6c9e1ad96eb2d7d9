"""Mixing sources to target weights.

Each source's words, document after document, are packed into blocks of BLOCK
words; only its last block may be shorter.  A mix has as many slots as its
targets have blocks, dealt over output shards.  Each shard draws how many slots
each source gets: the draws are multinomial given the totals (multivariate
hypergeometric), made by walking a binary tree of shard ranges whose nodes have
seeds of their own, so a shard needs nothing but the totals and always draws
the same.  Slot t of a source maps to a block of epoch t div n through a
pseudorandom permutation of the epoch, the short block coming last, and slots
join blocks by index.  The last slot is cut to the word, so a source takes its
target to the nearest word.  No word is used more than REPEATS times.

Sources are ranked by code point, null last, and weigh WEIGHTS in turn; a
target stops at REPEATS times its source's size and the excess is shared again
by weight.  The totals of the sources (one row each) are gathered on the
driver: a draw is a vector over the sources.

Null and empty texts have size 0 and nothing taken.  Repeated rows and rows of
one doc_id are documents of their own; rows that are equal in doc_id and text
may take each other's places.  A very long text spans blocks and may be taken
in part.  An empty table gives an empty result.  plan() reads doc_id, text and
source only; mix() keeps every column, whatever it is called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import broadcast_if_small, written
from .lines import bind, host_key, text_of
from .quality import word_count, words_of

BLOCK = 64
SHARD_SLOTS = 4096
BUCKET_WORDS = 1 << 20
REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = 20240101


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> list[float]:
    """The target of each source, in rank order."""
    weigh = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    rest = float(sum(sizes))
    while open_:
        share = rest / sum(weigh[i] for i in open_)
        over = [i for i in open_ if share * weigh[i] > repeats * sizes[i]]
        if not over:
            for i in open_:
                out[i] = share * weigh[i]
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
            rest -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def _left(counts: np.ndarray, take: int, seed: tuple[int, ...]) -> np.ndarray:
    """How many of `take` slots each source gets, drawn without replacement.

    Beyond the sampler's range sources are drawn one after the other, by the binomial (under a thousandth of the slots) or normal
    distribution that the hypergeometric one nears there, until what is left is within it.
    """
    total, rng = int(counts.sum()), np.random.default_rng(seed)
    got = np.zeros(len(counts), dtype=np.int64)
    for i, c in enumerate(counts.tolist()):
        if total < 900_000_000:
            got[i:] = rng.multivariate_hypergeometric(counts[i:], take, method="marginals")
            break
        share = take / total
        n = rng.binomial(c, share) if 1000 * c < total else round(rng.normal(c * share, (c * share * (1 - share) * (total - c) / (total - 1)) ** 0.5))
        got[i] = n = min(max(int(n), take - (total - c), 0), c, take)
        total, take = total - c, take - n
    return got


def shard_slots(shard: int, shards: int, counts: list[int], slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """First slot and number of slots of each source in a shard."""
    left_of, now = np.zeros(len(counts), dtype=np.int64), np.array(counts, dtype=np.int64)
    low, high = 0, shards
    while high - low > 1:
        mid = (low + high) // 2
        got = _left(now, (mid - low) * slots, (seed, low, high))
        if shard < mid:
            now, high = got, mid
        else:
            left_of, now, low = left_of + got, now - got, mid
    return left_of, now


def permuted(index: np.ndarray, n: int, source: int, epoch: int, seed: int = SEED) -> np.ndarray:
    """A permutation of 0..n-1, of each source and epoch: odd multiplications and shifts over the next power of two, walked until below n."""
    bits = max(1, int(n - 1).bit_length())
    mask, half = np.uint64((1 << bits) - 1), np.uint64(bits // 2 + 1)
    keys = np.random.default_rng((seed, source, epoch)).integers(0, 1 << 62, size=8).astype(np.uint64)

    def once(x):
        for k in range(4):
            x = (x * (keys[2 * k] | np.uint64(1)) + keys[2 * k + 1]) & mask
            x ^= x >> half
        return x

    with np.errstate(over="ignore"):
        out = once(index.astype(np.uint64))
        while (beyond := out >= np.uint64(n)).any():
            out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def slots_of(size: int, target: float, block: int = BLOCK, repeats: int = REPEATS) -> tuple[int, int]:
    """How many slots a source takes, and how many words of the last one."""
    words = min(round(target), repeats * size)
    if not words:
        return 0, 0
    epochs, rest = divmod(words, size)
    if not rest:
        return epochs * -(-size // block), size - (size - 1) // block * block
    return epochs * -(-size // block) + -(-rest // block), rest - (rest - 1) // block * block


def blocks_of(slots: np.ndarray, size: int, source: int, epoch: int, block: int = BLOCK) -> np.ndarray:
    """The block of each slot (counted within its epoch): whole blocks in the epoch's order, then the short one."""
    whole = size // block
    out = np.full(len(slots), whole, dtype=np.int64)
    if whole:
        out[slots < whole] = permuted(slots[slots < whole], whole, source, epoch)
    return out


def drawn(spark, shards: int, counts: list[int], cuts: list[int], sizes: list[int]) -> DataFrame:
    """(shard, k, block, cut) of every slot of the mix; cut: the words that a source's last slot takes, else null."""
    schema = pa.schema([("shard", pa.int64()), ("k", pa.int32()), ("block", pa.int64()), ("cut", pa.int32())])

    def run(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                first, n = shard_slots(shard, shards, counts)
                for k in range(len(counts)):
                    if not n[k]:
                        continue
                    t = np.arange(first[k], first[k] + n[k])
                    blocks = -(-sizes[k] // BLOCK)
                    for epoch in range(int(t[0] // blocks), int(t[-1] // blocks) + 1):
                        mine = t[t // blocks == epoch]
                        to = blocks_of(mine % blocks, sizes[k], k, epoch)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(to), shard)), pa.array(np.full(len(to), k, dtype=np.int32)), pa.array(to), pa.array(np.full(len(to), cuts[k], dtype=np.int32), mask=mine != counts[k] - 1)], schema=schema)

    parts = min(max(1, shards), 4 * spark.sparkContext.defaultParallelism + shards // 16)
    return spark.range(0, shards, 1, parts).mapInArrow(run, "shard bigint, k int, block bigint, cut int")


def takes(sized: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """From a written table (uid, key, source, size): the sources (_host, k, source_size, target), (uid, begin, words, times) of each document's pieces, and how many sources there are."""
    spark = sized.sparkSession
    keyed = sized.withColumn("_host", host_key("source"))
    found = keyed.groupBy("_host").agg(F.sum("size").alias("size"), F.max("source").alias("source")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [r["size"] for r in found]
    aims = targets(sizes)
    sources = spark.createDataFrame(
        [(r["_host"], k, r["size"], t, max(1, -(-r["size"] // BUCKET_WORDS))) for k, (r, t) in enumerate(zip(found, aims))],
        "_host string, k int, source_size bigint, target double, _buckets bigint",
    )
    known = keyed.filter("size > 0").join(broadcast_if_small(sources, len(found)), "_host")
    order = W.partitionBy("k", "_bucket").orderBy("key", "doc_id", "uid")
    placed = known.select("uid", "doc_id", "key", "k", "size", F.pmod(F.xxhash64("key"), F.col("_buckets")).alias("_bucket"))
    placed = placed.withColumn("_end", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    placed = written(placed.drop("key", "doc_id"), "mix-places")
    buckets = placed.groupBy("k", "_bucket").agg(F.sum("size").alias("_words"))
    buckets = buckets.select("k", "_bucket", (F.sum("_words").over(W.partitionBy("k").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("_words")).alias("_before"))
    planned = [slots_of(s, t) for s, t in zip(sizes, aims)]
    counts = [n for n, _ in planned]
    shards = -(-sum(counts) // SHARD_SLOTS)
    uses = drawn(spark, shards, counts, [c for _, c in planned], sizes).groupBy("k", "block").agg(F.count("*").alias("times"), F.max("cut").alias("cut"))
    n_buckets = sum(-(-s // BUCKET_WORDS) for s in sizes)
    pieces = placed.join(broadcast_if_small(buckets, n_buckets), ["k", "_bucket"]).withColumn("_end", F.col("_end") + F.col("_before")).withColumn("_begin", F.col("_end") - F.col("size"))
    pieces = pieces.select("uid", "k", "_begin", "_end", F.explode(F.sequence(F.floor(F.col("_begin") / BLOCK), F.floor((F.col("_end") - 1) / BLOCK))).alias("block"))
    low, high = F.greatest("_begin", F.col("block") * BLOCK), F.least("_end", (F.col("block") + 1) * BLOCK)
    pieces = pieces.select("uid", "k", "block", (low - F.col("_begin")).alias("begin"), (high - low).alias("words"), (low - F.col("block") * BLOCK).alias("_at"))
    # Spark takes the slots for tiny, as the range of shards is: without the hint it would broadcast a table that grows with the input
    used = pieces.join(uses.hint("merge"), ["k", "block"])
    inside = F.least("words", F.greatest(F.coalesce("cut", F.lit(BLOCK)) - F.col("_at"), F.lit(0))).cast("bigint")
    both = F.array(F.struct("begin", inside.alias("words"), "times"), F.struct((F.col("begin") + inside).alias("begin"), (F.col("words") - inside).alias("words"), (F.col("times") - 1).alias("times")))
    used = used.select("uid", F.explode(F.filter(both, lambda x: (x["words"] > 0) & (x["times"] > 0))).alias("_piece"))
    return sources.drop("_buckets"), used.select("uid", "_piece.*"), len(found)


def sized(documents: DataFrame, rows: bool = False) -> DataFrame:
    """A written table of doc_id, source, size, a uid and an order key for every row; rows: with all columns in _row."""
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(SEED)).alias("key")
    size = word_count(text_of("text")).cast("bigint").alias("size")
    whole = [F.struct("*").alias("_row")] if rows else []
    return written(documents.select("doc_id", "source", size, key, F.monotonically_increasing_id().alias("uid"), *whole), "mix-sizes")


def plan(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    base = sized(documents)
    sources, pieces, n = takes(base)
    taken = pieces.groupBy("uid").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    rows = base.withColumn("_host", host_key("source")).join(broadcast_if_small(sources, n), "_host", "left").join(taken, "uid", "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mix(documents: DataFrame) -> DataFrame:
    """The mixed documents, with the columns given: a row for each time a document, or part of it, is taken, its text the words taken then.

    A text taken whole stays as it is; of another the pieces are joined, with single spaces.
    """
    base = sized(documents, rows=True)
    _, pieces, _ = takes(base)
    mine = pieces.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("begin", "words", "times"))).alias("_pieces"))
    times = F.array_max(F.transform("_pieces", lambda p: p["times"])).cast("int")
    joined = base.select("uid", "size", "_row").join(mine, "uid").withColumn("_time", F.explode(F.sequence(F.lit(1), times)))
    now = joined.withColumn("_now", F.filter("_pieces", lambda p: p["times"] >= F.col("_time")))
    whole = F.aggregate("_now", F.lit(0).cast("bigint"), lambda a, p: a + p["words"]) == F.col("size")
    cut = bind(words_of(text_of("_row.text")), lambda w: F.flatten(F.transform("_now", lambda p: F.slice(w, (p["begin"] + 1).cast("int"), p["words"].cast("int")))))
    out = now.withColumn("_text", F.when(whole, F.col("_row.text")).otherwise(F.array_join(cut, " ")))
    new = {"text": F.col("_text")}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.length("_text").cast(documents.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in documents.columns))
