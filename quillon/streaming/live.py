"""Live queries: subscribed SQL that reports what changed in its result.

A subscription runs a read-only statement, keeps its result as a snapshot by a
unique key, and on each micro-batch of the change log that names one of its
tables runs it again and hands on the difference.  The stream's checkpoint is
the cursor; a failed run changes nothing, so the batch is delivered again.  With a
state folder snapshot and last number outlive the process, too, and are committed
after delivery; without one a new process takes the result it finds as its snapshot.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import changes
from ..operators.spool import spooled

_COMMENTS = re.compile(r"\s+|--[^\n]*(?:\n|$)|/\*.*?\*/", re.S)


def check_read_only(spark: SparkSession, statement: str) -> None:
    """Refuses all but SELECT, WITH and VALUES, and statements whose plan has a command in it."""
    at = 0
    while (m := _COMMENTS.match(statement, at)) and m.end() > at:
        at = m.end()
    word = re.match(r"[A-Za-z]+", statement[at:])
    if not word or word[0].upper() not in ("SELECT", "WITH", "VALUES"):
        raise ValueError("a live query begins with SELECT, WITH or VALUES")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    if re.search(r"\b(Insert\w*|Delete\w*|Update\w*|Merge\w*|Create\w*|Drop\w*|\w*Command)\b", " ".join(x.split("(")[0].split()[-1] for x in _nodes(plan))):
        raise ValueError("a live query only reads")


def _nodes(plan) -> list[str]:
    out, todo = [], [plan]
    while todo:
        node = todo.pop()
        out.append(node.nodeName())
        for kind in (node.children(), node.innerChildren()):
            it = kind.iterator()
            while it.hasNext():
                child = it.next()
                if hasattr(child, "nodeName"):
                    todo.append(child)
    return out


class LiveQuery:
    """A statement, the tables it watches, and the key of its rows."""

    def __init__(self, spark: SparkSession, statement: str, tables: list[str], key: list[str], state: str | None = None):
        """state: a folder that keeps the snapshot and the last number, so that a restarted subscription reports what changed meanwhile."""
        if not tables:
            raise ValueError("a live query watches a table at least")
        check_read_only(spark, statement)
        self.spark, self.statement, self.tables = spark, statement, tables
        self.state = None if state is None else state.rstrip("/")
        kept = self._kept()
        first = self.run() if kept is None else kept[0]
        self.key = [changes.resolve_column(first.columns, k) for k in key]
        self.columns = first.columns
        if kept is not None:
            self.snapshot, self.last_no = kept
            return
        changes.require_key(first, self.key)
        self.snapshot, self.last_no = self._store(first, 0), 0
        self._commit()

    def _store(self, rows: DataFrame, number: int) -> DataFrame:
        return spooled(rows, "live") if self.state is None else self._written(rows, f"{self.state}/snapshot-{number}")

    def _written(self, rows: DataFrame, path: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(path)
        table = self.spark.read.parquet(path)
        table._spooled_at = path
        return table

    def _kept(self) -> tuple[DataFrame, int] | None:
        """The snapshot and number of the last commit; the statement must be the same."""
        if self.state is None or (number := self._cursors().read("last")) is None:
            return None
        table = self.spark.read.parquet(f"{self.state}/snapshot-{number}")
        table._spooled_at = f"{self.state}/snapshot-{number}"
        return table, number

    def _cursors(self):
        from .consumer import Cursors

        return Cursors(self.spark, self.state)

    def _commit(self) -> None:
        """The number is written last: it names the snapshot that goes with it."""
        if self.state is not None:
            self._cursors().write("last", self.last_no)

    def run(self) -> DataFrame:
        return self.spark.sql(self.statement)

    def poll(self, log: DataFrame) -> DataFrame | None:
        """The difference since the last poll, given the log rows since; None if no watched table has changed.

        Numbers that don't follow the last ones seen mean that rows were pruned: then the statement runs whatever they name.
        """
        ends = log.agg(F.min("no").alias("a"), F.max("no").alias("b"), F.count_if(F.col("table_name").isin(self.tables)).alias("n")).first()
        if ends["b"] is None:
            return None
        if ends["b"] == self.last_no:  # delivered again after a restart
            return None
        lost = ends["a"] > self.last_no + 1 or ends["b"] < self.last_no
        if not ends["n"] and not lost:
            if self.state is None:
                self.last_no = ends["b"]
                return None
            self.snapshot, self.last_no = self._store(self.snapshot, ends["b"]), ends["b"]
            return None
        now = self.run()
        if now.columns != self.columns:
            raise ValueError("the columns have changed")
        changes.require_key(now, self.key)
        now = self._store(now, ends["b"])
        diff = changes.result_diff(self.snapshot, now, self.key)
        self.snapshot, self.last_no = now, ends["b"]
        return diff

    def subscribe(self, log: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "250 milliseconds", once: bool = False) -> StreamingQuery:
        """Follows a streaming log (no, table_name, …); batches that come in while one is at work are taken together."""

        def batch(rows: DataFrame, number: int) -> None:
            before = self.snapshot, self.last_no
            try:
                diff = self.poll(rows)
                if diff is not None:
                    deliver(diff, number)
                self._commit()
            except Exception:
                self.snapshot, self.last_no = before
                raise

        writer = log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def consume(log: DataFrame, emit: Callable[[DataFrame], None], checkpoint: str, interval: str = "250 milliseconds", once: bool = False) -> StreamingQuery:
    """A durable consumer of the log: rows in order of number, each at least once; the checkpoint advances after emit returns."""
    writer = log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, _: emit(rows.orderBy("no")))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def notify(log: DataFrame, resources: dict[str, list[str]], send: Callable[[str], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """One notification a micro-batch for each resource whose tables changed; one that can't be sent is told on the error output and doesn't stop the others."""

    def batch(rows: DataFrame, _: int) -> None:
        wanted = sorted({t for tables in resources.values() for t in tables})
        seen = {r["table_name"] for r in rows.filter(F.col("table_name").isin(wanted)).select("table_name").distinct().limit(len(wanted)).collect()}
        for uri in sorted(u for u, tables in resources.items() if seen & set(tables)):
            try:
                send(uri)
            except Exception as e:  # noqa: BLE001
                print(f"! {uri}: {e}", file=sys.stderr)

    writer = log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="250 milliseconds")).start()


_URI = re.compile(r"^quillon://(?P<store>[a-z0-9_-]+)/(?P<what>schema|last|table)(?:/(?P<table>[A-Za-z_][A-Za-z0-9_]*))?$")


def resource(uri: str, stores: list[str]) -> tuple[str, str, str | None]:
    """(store, what, table) of a resource address; unknown stores and shapes are refused."""
    m = _URI.match(uri)
    if not m or m["store"] not in stores or (m["what"] == "table") != (m["table"] is not None):
        raise ValueError(f"no such resource: {uri}")
    return m["store"], m["what"], m["table"]
