"""A stored search index: postings by term, document frequencies, corpus statistics, all under a stamp of the content.

An index is a folder named by its stamp in the folder of its corpus, so refresh()
builds only where the content has changed, and a half-built index is never
found: `stats`, written last, is what marks a whole one.  Postings lie in folders
by bucket of term, sorted by term; a search reads the buckets of its terms and of
those the row groups that hold the terms.  The list of a common term is dealt over
SHARDS files, so no task writes or reads it alone.
"""

from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import B, K1
from .spool import remove

BUCKETS = 64
SHARDS = 8


def stamp(documents: DataFrame, id_column: str, *content: str) -> str:
    """A name for the rows' content, whatever their order: number of rows, sum and exclusive or of row hashes; one pass, no shuffle of rows."""
    row = F.xxhash64(id_column, *content)
    found = documents.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.bit_xor(row).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), id_column, *content)).alias("y")).first()
    return f"{found['n']:x}-{int(found['s'] or 0) & (1 << 64) - 1:x}-{(found['x'] or 0) & (1 << 64) - 1:x}-{(found['y'] or 0) & (1 << 64) - 1:x}"


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def build(documents: DataFrame, path: str, id_column: str = "id", token_column: str = "tokens") -> None:
    """Writes the index of (id, tokens): the tokens are shuffled once, counted for each document before that."""
    spark = documents.sparkSession
    documents = documents.withColumn(token_column, F.coalesce(token_column, F.array().cast("array<string>")))  # no tokens, but a document
    each = documents.select(F.col(id_column).alias("id"), F.size(token_column).alias("dl"), F.explode(token_column).alias("term"))
    tf = each.groupBy("term", "id", "dl").agg(F.count("*").cast("int").alias("tf"))
    tf = tf.withColumn("bucket", (F.crc32("term") % BUCKETS).cast("int"))
    placed = tf.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(SHARDS))).sortWithinPartitions("bucket", "term", "id")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    written = spark.read.schema("term string, id " + documents.schema[id_column].dataType.simpleString() + ", dl int, tf int, bucket int").parquet(f"{path}/postings")
    written.groupBy("term", "bucket").agg(F.count("*").alias("df")).repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    documents.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size(token_column)), F.lit(0.0)).alias("mean"), F.lit(documents.schema[id_column].dataType.simpleString()).alias("id_type")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def refresh(documents: DataFrame, root: str, current: str, id_column: str = "id", token_column: str = "tokens") -> bool:
    """Builds the index of that stamp under root unless it is there, and deletes others; whether it was built."""
    spark = documents.sparkSession
    if _there(spark, f"{root}/{current}/stats/_SUCCESS"):
        return False
    build(documents, f"{root}/{current}", id_column, token_column)
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    others = [s.getPath() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    remove(spark, [p.toString() for p in others if p.getName() != current])
    return True


class Index:
    """An index that has been built."""

    def __init__(self, spark: SparkSession, path: str):
        if not _there(spark, f"{path}/stats/_SUCCESS"):
            raise ValueError(f"no index at {path}")
        self.spark, self.path = spark, path
        stats = spark.read.parquet(f"{path}/stats").first()
        self.n, self.mean, self.id_type = stats["n"], stats["mean"], stats["id_type"]

    def _of(self, what: str, columns: str, terms: list[str]) -> DataFrame:
        buckets = sorted({zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in terms})
        table = self.spark.read.schema(f"{columns}, bucket int").parquet(f"{self.path}/{what}")
        return table.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).drop("bucket")

    def postings(self, terms: list[str]) -> DataFrame:
        return self._of("postings", f"term string, id {self.id_type}, dl int, tf int", terms)

    def scores(self, queries: dict, least_average: float = 0.0) -> DataFrame:
        """(query_id, id, score) of all documents that hold a term of a query; queries: terms by query id, a term that repeats counts again.

        The query terms, with their idf, meet the postings: the few rows of the queries are the broadcast side.
        """
        wanted = sorted({t for terms in queries.values() for t in terms})
        kind = "string" if any(isinstance(q, str) for q in queries) else "bigint"
        if not wanted:
            return self.spark.createDataFrame([], f"query_id {kind}, id {self.id_type}, score double")
        df = F.col("df").cast("double")
        idf = F.ln(1.0 + (self.n - df + 0.5) / (df + 0.5))
        asked = self.spark.createDataFrame([(q, t, n) for q, terms in queries.items() for t, n in Counter(terms).items()], f"query_id {kind}, term string, times int")
        asked = asked.join(self._of("terms", "term string, df bigint", wanted), "term").withColumn("idf", idf)
        length = F.col("dl") / max(self.mean, least_average) if max(self.mean, least_average) > 0 else F.lit(0.0)
        part = F.col("times") * F.col("idf") * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length)))
        return self.postings(wanted).join(F.broadcast(asked), "term").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score")).filter("score > 0")

    def search(self, terms: list[str], limit: int | None, least_average: float = 0.0) -> DataFrame:
        """(id, score) of the best documents; ties go by id."""
        out = self.scores({0: terms}, least_average).drop("query_id")
        return out if limit is None else out.orderBy(F.desc("score"), "id").limit(limit)
