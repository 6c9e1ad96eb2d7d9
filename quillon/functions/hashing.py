"""FNV hashes, hash embeddings and vector arithmetic.

Built-in functions, but for the 64-bit hash of a text and the whole embedding: those
are folds over bytes and cells, which built-in functions walk one interpreted step at
a time. They run over Arrow batches, in numpy.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import tokens

DIMENSIONS = 256
#: Fixed values of 64-bit FNV-1a, its start and its prime.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3


def _bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text as numbers. The hexadecimal code is bound once: inside a lambda it would be made anew for every byte."""
    each = lambda c: F.transform(F.filter(F.sequence(F.lit(1), F.length(c) + 1, F.lit(2)), lambda i: i < F.length(c)), lambda i: F.conv(F.substring(c, i, F.lit(2)), 16, 10).cast("bigint"))
    return F.get(F.transform(F.array(F.hex(F.encode(text, "UTF-8"))), each), 0)


def fnv64_hex(text: Column) -> Column:
    """FNV-1a of 64 bits as 16 hex digits."""
    return _fnv64_hex(text.cast("binary"))


def content_key(*parts: Column) -> Column:
    """The key that tells whether a row's content has changed."""
    return F.concat(F.lit("fnv"), fnv64_hex(F.concat_ws("\n", *(F.coalesce(p, F.lit("")) for p in parts))))


def fnv_cell(text: Column) -> Column:
    """FNV-1a modulo 256: only the low byte of hash and prime matter."""
    return F.aggregate(_bytes(text), F.lit(0x25).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * 0xB3).bitwiseAND(F.lit(255)))


def embedding_parts(text: Column) -> Column:
    """(key, weight) of each token and of each three-letter window of it."""
    windows = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3)))
    one = F.transform(tokens(text), lambda t: F.concat(F.array(F.struct(F.concat(F.lit("t:"), t).alias("key"), F.lit(1.0).alias("weight"))), F.transform(windows(t), lambda g: F.struct(F.concat(F.lit("g:"), g).alias("key"), F.lit(0.5).alias("weight")))))
    return F.flatten(one)


def hash_embedding(text: Column, single: bool = False) -> Column:
    """256 cells of hashed tokens and windows (those of embedding_parts), weighted by logarithm, of length one; zeros where the text has no token. single: as floats."""
    return (_embedding_float if single else _embedding_double)(tokens(text))


def normalised(vector: Column) -> Column:
    """The vector at length one; zeros stay."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(vector)


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 where the lengths differ."""
    wide = lambda x: x.cast("double")
    both = F.aggregate(F.zip_with(a, b, lambda x, y: wide(x) * wide(y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), both).otherwise(F.lit(0.0))


def signature(kernel: Column | str, key: Column) -> Column:
    return F.concat_ws(":", F.lit(kernel) if isinstance(kernel, str) else kernel, key)


#: Bytes hashed at a time.
PIECE = 1 << 18
#: Token occurrences, and rows, of an embedding summed at a time.
OCCURRENCES, ROWS = 1 << 16, 1 << 10


@lru_cache(1)
def _powers() -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[1], np.full(PIECE, PRIME)]).astype(np.uint64))


def _advance(states: np.ndarray, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The states of FNV-1a after each run of bytes; run i of data stops at ends[i]. PIECE bytes at most.

    A step is h' = (h ^ b) * p. Exclusive or with b changes the low byte alone, by d, so the last state is h * p**n plus the sum of every
    d * p**(bytes left). The low byte goes its own way modulo 256, and bit k of it is an exclusive or of bits that the k bits below and
    the text give: eight prefix sums over all runs at once, in place of a step for each byte.
    """
    begins = np.concatenate([[0], ends[:-1]])
    sizes = ends - begins
    out = states * _powers()[sizes]
    if not len(data):
        return out
    low = np.repeat((states & np.uint64(255)).astype(np.uint8), sizes)
    some = sizes > 0
    firsts = begins[some]
    mixed, before = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for k in range(8):
        step = ((mixed * np.uint8(PRIME & 255) ^ data) >> np.uint8(k)) & np.uint8(1)
        before[1:] = np.bitwise_xor.accumulate(step)[:-1]
        here = before ^ np.repeat(before[firsts], sizes[some]) ^ (data ^ low) >> np.uint8(k)
        mixed |= (here & np.uint8(1)) << np.uint8(k)
    changed = mixed.astype(np.int64)
    changed -= mixed ^ data  # the low byte as it was
    left = np.repeat(ends, sizes) - np.arange(len(data))
    out[some] += np.add.reduceat(changed.view(np.uint64) * _powers()[left], firsts)
    return out


def fnv64(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """FNV-1a of 64 bits of each run of bytes, PIECE bytes at a time whatever the runs' lengths."""
    states = np.full(len(ends), OFFSET, np.uint64)
    at = first = 0
    while first < len(ends):
        last = int(np.searchsorted(ends, at + PIECE, "right"))  # runs that end in this piece
        stop = int(min(at + PIECE, ends[-1]))
        upto = min(last + 1, len(ends))
        states[first:upto] = _advance(states[first:upto], data[at:stop], np.minimum(ends[first:upto], stop) - at)
        at, first = stop, last
    return states


@F.arrow_udf(T.StringType())
def _fnv64_hex(texts: pa.Array) -> pa.Array:
    texts = texts.cast(pa.large_binary())
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    found = fnv64(data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0])
    return pa.array([f"{h:016x}" for h in found.tolist()], pa.string(), mask=np.asarray(texts.is_null()))


@lru_cache(1 << 16)
def _cell(key: str) -> int:
    h = OFFSET & 255
    for b in key.encode():
        h = (h ^ b) * (PRIME & 255) & 255
    return h


@lru_cache(1 << 15)
def _cells(token: str) -> list[int]:
    """The cells of a token and of its windows."""
    return [_cell("t:" + token), *(_cell("g:" + token[i : i + 3]) for i in range(max(len(token) - 2, 1)))]


@lru_cache(1)
def _logs() -> np.ndarray:
    """The weight of a cell by twice its sum."""
    return np.array([0.0] + [max(math.log(k / 2) + 1, 0.0) for k in range(1, 1 << 16)])


def _embedded(token_lists: pa.Array) -> np.ndarray:
    """A row of 256 cells for each list of tokens."""
    sizes = np.asarray(token_lists.value_lengths().fill_null(0))
    sums = np.zeros((len(sizes), DIMENSIONS))
    coded = token_lists.flatten().dictionary_encode()
    codes, row = np.asarray(coded.indices).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
    held = [_cells(t) for t in coded.dictionary.to_pylist()]
    n = np.array([len(c) for c in held], np.int64)
    begin = np.cumsum(n) - n
    cells = np.fromiter((x for c in held for x in c), np.int64, int(n.sum()))
    halves = np.ones(len(cells))
    halves[begin] = 2
    for at in range(0, len(codes), OCCURRENCES):
        c, r = codes[at : at + OCCURRENCES], row[at : at + OCCURRENCES]
        each = n[c]
        entry = np.repeat(begin[c] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        where = np.repeat(r - r[0], each) * DIMENSIONS + cells[entry]
        width = int(r[-1] - r[0]) + 1
        sums[r[0] : r[-1] + 1] += np.bincount(where, halves[entry], width * DIMENSIONS).reshape(width, DIMENSIONS)
    twice, logs = sums.astype(np.int64), _logs()
    weights = logs[np.minimum(twice, len(logs) - 1)]
    if (large := twice >= len(logs)).any():
        weights[large] = [math.log(k / 2) + 1 for k in twice[large].tolist()]
    norms = np.sqrt(np.cumsum(weights * weights, axis=1)[:, -1:])
    return np.divide(weights, norms, out=weights, where=norms > 0)


def _vectors(token_lists: pa.Array, kind) -> pa.Array:
    parts = [_embedded(token_lists.slice(at, ROWS)).astype(kind).ravel() for at in range(0, len(token_lists), ROWS)]
    flat = np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(token_lists) + 1, dtype=np.int32) * DIMENSIONS), pa.array(flat))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _embedding_double(token_lists: pa.Array) -> pa.Array:
    return _vectors(token_lists, np.float64)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _embedding_float(token_lists: pa.Array) -> pa.Array:
    return _vectors(token_lists, np.float32)
