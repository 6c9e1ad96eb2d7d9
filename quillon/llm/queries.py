"""The queries of the corpus operators, opN_<name>, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automaton, bpe, html_text, jaccard, line_dedup, media, mixing, quality, toxicity, warc
from .common import table, written


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.scan(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(written(media.store(table(spark, sf_dir, "documents")), "media-files"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.training_rows(documents, table(spark, sf_dir, "labels")))
    held_out = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0).alias("held_out")
    return toxicity.score(documents, model).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = written(warc.write(warc.roles(table(spark, sf_dir, "pages"))), "warc-archives")
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.clean(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")


QUERIES = {f.__name__: f for f in (op1_html_text, op2_secret_scan, op3_mixing, op4_jaccard_join, op5_line_quality, op6_media_columns, op7_toxicity, op8_bpe, op9_warc, op10_line_dedup)}
ORACLE_SQL: dict[str, str] = {"op4_jaccard_join": jaccard.SQL, "op5_line_quality": quality.SQL, "op9_warc": warc.SQL, "op10_line_dedup": line_dedup.SQL}
