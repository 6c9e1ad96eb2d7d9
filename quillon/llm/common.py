"""Shared helpers of the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spool import forget, recorded, remove, shared_dir  # noqa: F401
from ..operators.spool import spooled as written  # noqa: F401

#: The white space that separates words, as a Java and Python class body.
SPACE = "\\x20\\x09-\\x0D"
#: The same characters, as text.
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Rows that a Python worker turns into objects at a time.
ROWS_AT_ONCE = 512
#: Bytes of a batch between Spark and a Python worker.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches held to BATCH_BYTES: texts are long, and both sides hold whole batches."""
    spark = df.sparkSession
    if int(spark.conf.get(BATCH).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Returns what a task has freed to the system: workers stay on, and other stages need the memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ROWS_AT_ONCE rows, so that what a worker holds beside a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def rows_of(batches: Iterator[pa.RecordBatch], fn: Callable, schema: pa.Schema, names: list[str], together: bool = False) -> Iterator[pa.RecordBatch]:
    """Calls fn with the named columns' values of each row (together: with those of up to ROWS_AT_ONCE rows, as lists); its tuples become batches of the schema."""
    for batch in slices(batches):
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
        out = list(fn(*columns)) if together else [fn(*row) for row in zip(*columns)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def map_rows(df: DataFrame, names: list[str], make: Callable[[], Callable], fields: list[tuple[str, pa.DataType]], ddl: str, together: bool = False) -> DataFrame:
    """One output row for each row of df. make() runs once in each task and returns the row function, or (together) one from columns to rows."""
    schema = pa.schema(fields)

    def run(batches):
        yield from rows_of(batches, make(), schema, names, together)
        give_back()

    return bounded(df.select(*names)).mapInArrow(run, ddl)


def id_type(df: DataFrame, column: str = "doc_id") -> tuple[str, pa.DataType]:
    """SQL name and Arrow type of an id column, whatever its type."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[column].dataType
    return kind.simpleString(), to_arrow_type(kind)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, rows: int, bound: int = 200_000) -> DataFrame:
    """A broadcast hint only where the counted rows are within the bound; beyond it Spark shuffles."""
    return F.broadcast(df) if rows <= bound else df
