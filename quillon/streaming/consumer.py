"""Named consumers of the change log: a cursor of their own each, polls of bounded size, and pruning behind the slowest."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes

POLL_ROWS = 500
PRUNE_EVERY = 1000
_NAME = re.compile(r"[A-Za-z0-9_-]{1,64}")


class Cursors:
    """The cursors of all consumers of a log: a small file each, replaced as a whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        if not _NAME.fullmatch(name):
            raise ValueError("a consumer's name has letters, digits, _ and - only")
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}.cursor")

    def read(self, name: str) -> int | None:
        path = self._path(name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return int(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, name: str, number: int) -> None:
        """A new file takes the place of the old one, so a reader never sees half a number."""
        path, new = self._path(name), self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/.{name}-{uuid.uuid4().hex}")
        stream = self.fs.create(new, True)
        try:
            stream.write(bytearray(str(number).encode()))
        finally:
            stream.close()
        if not self.fs.rename(new, path):  # stores that don't replace
            self.fs.delete(path, False)
            if not self.fs.rename(new, path):
                raise OSError(f"the cursor of {name} can't be written")

    def table(self) -> DataFrame:
        """(consumer, cursor) of all consumers."""
        at = self.jvm.org.apache.hadoop.fs.Path(self.root)
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        rows = [(n.removesuffix(".cursor"), self.read(n.removesuffix(".cursor"))) for n in sorted(names) if n.endswith(".cursor") and not n.startswith(".")]
        return self.spark.createDataFrame(rows, "consumer string, cursor bigint")


class Consumer:
    """One consumer: rows in order, each at least once. The first run starts at the log's end."""

    def __init__(self, cursors: Cursors, name: str, log: Callable[[], DataFrame]):
        self.cursors, self.name, self.log, self.since_pruning = cursors, name, log, 0
        if cursors.read(name) is None:
            cursors.write(name, log().agg(F.coalesce(F.max("no"), F.lit(0)).alias("n")).first()["n"])

    def poll(self, emit: Callable[[DataFrame], None], limit: int = POLL_ROWS, prune: Callable[[DataFrame], None] | None = None) -> int:
        """Emits the next rows, `limit` at most, and then moves the cursor; how many there were.

        Each PRUNE_EVERY rows prune gets what of the log no consumer needs to lose, to store it as the log.
        """
        batch = changes.read_after(self.log(), self.cursors.read(self.name), limit)
        last = batch.agg(F.max("no").alias("no"), F.count("*").alias("n")).first()
        if not last["n"]:
            return 0
        emit(batch)
        self.cursors.write(self.name, last["no"])
        self.since_pruning += last["n"]
        if prune is not None and self.since_pruning >= PRUNE_EVERY:
            prune(changes.prune(self.log(), self.cursors.table()))
            self.since_pruning = 0
        return last["n"]
