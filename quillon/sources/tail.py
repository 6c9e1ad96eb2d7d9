"""A streaming source that follows growing line files by byte offset.

Only whole lines are emitted: a half-written last line waits for its end.  A file
that has shrunk, or whose first bytes have changed, is read anew from its start.

The offset of the stream maps each path to bytes read, lines read and a hash of the
file's first bytes, so a checkpoint is all a restart needs: Spark hands the last
offset back before it asks for a new one.  The driver lists files and reads of each
changed file only its first bytes and what lies between the limit and the line end
before it; tasks read what is new and nothing before it.
"""

from __future__ import annotations

import hashlib
import json
import os
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, line bigint, begin bigint, value string"
COLUMNS = ["path", "line", "begin", "value"]
#: Bytes that a task hands on at a time; a longer line goes by itself.
BATCH = 1 << 22
#: First bytes that tell a file from another of the same path.
HEAD = 1 << 10
STEP = 1 << 16


class Slice(InputPartition):
    def __init__(self, path: str, begin: int, end: int, line: int):
        super().__init__(0)
        self.path, self.begin, self.end, self.line = path, begin, end, line


def last_line_end(path: str, begin: int, end: int) -> int:
    """Where the last whole line between begin and end ends (begin: there is none), read from the end back."""
    with open(path, "rb") as f:
        at = end
        while at > begin:
            first = max(begin, at - STEP)
            f.seek(first)
            cut = f.read(at - first).rfind(b"\n")
            if cut >= 0:
                return first + cut + 1
            at = first
    return begin


def next_line_end(path: str, begin: int, size: int) -> int:
    """Where the line that goes on at begin ends (size: it hasn't yet)."""
    with open(path, "rb") as f:
        f.seek(begin)
        at = begin
        while at < size and (block := f.read(STEP)):
            cut = block.find(b"\n")
            if cut >= 0:
                return at + cut + 1
            at += len(block)
    return size


def head_hash(path: str, length: int) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read(length)).hexdigest()[:16]


def lines_between(path: str, begin: int, end: int) -> int:
    n = 0
    with open(path, "rb") as f:
        f.seek(begin)
        while begin < end and (block := f.read(min(STEP, end - begin))):
            n, begin = n + block.count(b"\n"), begin + len(block)
    return n


class TailReader(DataSourceStreamReader):
    """The offset has, for each path: bytes and lines read up to the batch before, bytes read, length and hash of the first bytes.

    A batch's lines are counted when the next one is planned, over that batch's bytes alone.
    """

    def __init__(self, options: dict):
        self.root = options["path"]
        self.suffix = options.get("suffix", ".jsonl")
        self.limit = int(options.get("maxBytesPerFile", 16 << 20))
        self.known: dict[str, dict] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def _files(self) -> list[str]:
        return sorted(os.path.join(d, f) for d, _, names in os.walk(self.root) for f in names if f.endswith(self.suffix))

    def _next(self, path: str) -> dict:
        size = os.path.getsize(path)
        was = self.known.get(path)
        if was is not None and (size < was["end"] or head_hash(path, was["head"]) != was["hash"]):
            was = None
        if was is None:
            was = {"begin": 0, "line": 0, "end": 0, "head": 0, "hash": ""}
        if size == was["end"]:
            return was
        begin, upto = was["end"], min(size, was["end"] + self.limit)
        end = last_line_end(path, begin, upto)
        if end == begin and upto < size:  # a line longer than the limit
            end = next_line_end(path, upto, size)
            end = begin if end == size and last_line_end(path, size - 1, size) != size else end
        if end == begin:
            return was
        line = was["line"] + lines_between(path, was["begin"], was["end"])
        head = min(HEAD, end)
        return {"begin": begin, "line": line, "end": end, "head": head, "hash": head_hash(path, head)}

    def latestOffset(self) -> dict:
        self.known = {path: self._next(path) for path in self._files()}
        return {"files": json.dumps(self.known, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = json.loads(start["files"]), json.loads(end["files"])
        self.known = dict(b)
        out = []
        for path, x in b.items():
            begin, line, was = x["begin"], x["line"], a.get(path)
            if was is not None and was["end"] <= x["end"] and head_hash(path, was["head"]) == was["hash"]:
                # the same file: on from the start offset, wherever the reader stood when it made the end offset
                begin, line = was["end"], was["line"] + lines_between(path, was["begin"], was["end"]) if x["end"] > was["end"] else 0
            if x["end"] > begin:
                out.append(Slice(path, begin, x["end"], line))
        return out or [Slice("", 0, 0, 0)]

    def read(self, part: Slice) -> Iterator[tuple]:
        for batch in self.batches(part):
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def batches(self, part: Slice) -> Iterator[pa.RecordBatch]:
        """The slice's lines, in batches of about BATCH bytes."""
        if not part.path:
            return
        with open(part.path, "rb") as f:
            f.seek(part.begin)
            at, line = part.begin, part.line
            while at < part.end and (lines := f.readlines(min(BATCH, part.end - at))):
                ends = list(accumulate(map(len, lines), initial=at))
                n = bisect_left(ends, part.end, 0, len(lines))  # a file that has grown since may give lines beyond the slice
                values = [x.rstrip(b"\r\n").decode("utf-8", "replace") for x in lines[:n]]
                yield pa.record_batch([pa.repeat(pa.scalar(part.path, pa.string()), n), pa.array(range(line + 1, line + 1 + n), pa.int64()), pa.array(ends[:n], pa.int64()), pa.array(values, pa.string())], names=COLUMNS)
                at, line = ends[n], line + n

    def commit(self, end: dict) -> None:
        pass


class BatchReader(TailReader):
    """What streams use: whole batches go to Spark, not row by row."""

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        return self.batches(part)


class TailSource(DataSource):
    """format("tail"): option path names a folder that the driver and all executors see."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return BatchReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailSource)
