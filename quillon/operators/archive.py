"""The transcript archive: a sink of micro-batches that inserts what it hasn't got and reports what it read.

A batch writes its new records and its summary into folders named by its number, so a
batch that is delivered again replaces its own output and nothing is stored twice.
The stream's checkpoint is the offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from . import sessions, sync

#: A record of the archive; (uuid, block) is its key.
RECORD = T.StructType(
    [
        T.StructField("uuid", T.StringType()), T.StructField("block", T.IntegerType()), T.StructField("session", T.StringType()), T.StructField("kind", T.StringType()),
        T.StructField("tool", T.StringType()), T.StructField("side", T.BooleanType()), T.StructField("time", T.StringType()), T.StructField("time_ms", T.LongType()),
        T.StructField("text", T.StringType()), T.StructField("path", T.StringType()), T.StructField("line", T.LongType()),
    ]
)
SUMMARY = T.StructType([T.StructField(n, T.LongType()) for n in ("batch", "n_lines", "n_malformed", "n_new", "n_restarted")])


class Archive:
    """Records under a folder, one sub-folder a batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, what: str, schema: T.StructType) -> DataFrame:
        """The table with its batch number; empty before the first batch."""
        whole = T.StructType([*schema.fields, T.StructField("number", T.LongType())])
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{what}")
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(whole).parquet(f"{self.root}/{what}") if there else self.spark.createDataFrame([], whole)

    def records(self) -> DataFrame:
        return self._read("records", RECORD).drop("number")

    def summaries(self) -> DataFrame:
        return self._read("summaries", SUMMARY).drop("number")

    def ingest(self, lines: DataFrame, number: int) -> None:
        """Inserts the records of (path, line, value) that no earlier batch has, the first of each key, and a summary row.

        Lines that aren't JSON objects are malformed; a file is restarted if its first line comes although the archive has read it before.
        """
        spark = self.spark
        old = self._read("records", RECORD).filter(F.col("number") != number)
        found = sessions.records(lines, keep=("path", "line"))
        new = sync.insert_if_absent(old.select("uuid", "block"), found, ["uuid", "block"], ["path", "line"])
        new.select(*RECORD.names).write.mode("overwrite").parquet(f"{self.root}/records/number={number}")
        # what is stored now, and not the plan again, is counted
        n_new = spark.read.parquet(f"{self.root}/records/number={number}").agg(F.count("*").alias("n_new"))
        malformed = F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>").isNull()
        read = lines.agg(F.count("*").alias("n_lines"), F.count_if(malformed).alias("n_malformed"))
        again = lines.filter("line = 1").select("path").distinct().join(old.select("path").distinct(), "path", "left_semi").agg(F.count("*").alias("n_restarted"))
        row = read.crossJoin(n_new).crossJoin(again).withColumn("batch", F.lit(number).cast("bigint"))
        row.select(*SUMMARY.names).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/summaries/number={number}")

    def follow(self, lines: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        """Ingests a stream of (path, line, value), as the tail source gives it."""
        writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.ingest)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
