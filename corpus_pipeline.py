"""The corpus pipeline: toxicity, line dedup, near duplicates, mixing, encoding.

Each stage is a function (spark, docs, sf_dir) that returns a DataFrame; run()
writes what a stage returns as Parquet and hands it to the next.  Labels, which
teach the first stage, come from sf_dir.

What a stage returns has to be written before the next stage is called: a stage
begins with deleting the tables that the one before left in the shared folder.

Nulls in any column, empty and very long texts and repeated rows go through
every stage; what becomes of them is stated in the operators' modules and at
drop_copies.  A stage reads COLUMNS alone, so other columns may have any name.
Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, jaccard, line_dedup, mixing, toxicity
from quillon.llm.common import forget, recorded, remove, table, written
from quillon.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates in the pipeline: shingles of five words, similarity 0.8.
WORDS, PERCENT = 5, 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: dict[str, list[str]] = {}


def alone(stage: Stage) -> Stage:
    """The stage, which first deletes what the stage before it left behind in this application."""

    @wraps(stage)
    def run_alone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        application = spark.sparkContext.applicationId
        remove(spark, _left.pop(application, []))
        with recorded() as made:
            out = stage(spark, docs, sf_dir)
        _left[application] = made
        return out

    return run_alone


@alone
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under one half."""
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs.select(*COLUMNS), model, list(COLUMNS)).filter("score < 0.5").select(*COLUMNS)


@alone
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; all documents stay."""
    cleaned = line_dedup.clean(docs.select(*COLUMNS))
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


@alone
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the group's least doc_id, and of several with that doc_id the text with the least hash.

    Documents without a doc_id are kept only for groups that have no other.  Documents without words are in no group and stay.  A row
    repeated whole comes out once, but for rows with neither words nor a doc_id, which all stay.
    """
    docs = docs.select(*COLUMNS)
    keyed = docs.withColumn("_key", F.xxhash64(F.coalesce("text", F.lit("")), F.isnull("text")))
    joined = jaccard.join(keyed, WORDS, PERCENT, key="_key")
    stays = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("_key") == F.col("head.key"))
    grouped = joined.filter("head is not null or n_shingles = 0 and doc_id is not null")
    counts = grouped.groupBy("doc_id", "_key", (F.isnull("head") | stays).alias("_stays")).agg(F.count("*").alias("_n"))
    counts = written(counts.filter("_n > 1 or not _stays"), "pipeline-copies")

    def those(kept: DataFrame, listed: DataFrame, how: str) -> DataFrame:
        listed = listed.select(F.col("doc_id").alias("_doc"), F.col("_key").alias("_listed"))
        return kept.join(listed, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_listed")), how)

    gone, again = counts.filter("not _stays"), counts.filter("_stays")
    if not again.limit(1).count():
        return those(keyed, gone, "left_anti").select(*COLUMNS)
    once = those(keyed, again, "left_semi").groupBy("doc_id", "_key").agg(F.min(F.struct(*COLUMNS)).alias("_row")).select("_row.*")
    return those(keyed, counts, "left_anti").select(*COLUMNS).unionByName(once)


@alone
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, or parts of them, that the mix takes, as often as it takes them.

    Passages that different texts share count once.  They go here and not with the lines of a source, as near duplicates have to be found first.
    """
    return mixing.mix(line_dedup.passages_once(docs.select(*COLUMNS)))


@alone
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids of each text, and their number and digests."""
    return bpe.round_trip(docs.select(*COLUMNS), vocabulary(), with_ids=True, keep=("lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: Fitted scores, random draws and byte-pair encoding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
