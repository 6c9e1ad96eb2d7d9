"""Tables in the folder that all executors share: a cut in the lineage that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where the session names none, a local master gets a folder of its own and a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def spooled(df: DataFrame, tag: str) -> DataFrame:
    """df, written once and read back. forget() takes what this returns."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _open:
        made.append(path)
    table = df.sparkSession.read.parquet(path)
    table._spooled_at = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes spooled tables that nothing still to be run reads."""
    for t in tables:
        remove(t.sparkSession, [t._spooled_at])


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables spooled meanwhile."""
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)
