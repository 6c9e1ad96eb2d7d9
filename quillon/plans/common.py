"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ms(column: str):
    """Milliseconds of a timestamp column, read as UTC whatever the session's zone."""
    return F.unix_millis(F.col(column).cast("timestamp"))


#: fold() and tokens() in DuckDB.
SQL_FOLD = f"lower(translate(regexp_replace({{0}}, '\\p{{{{M}}}}', '', 'g'), '{text.FOLD_FROM}', '{text.FOLD_TO}'))"


def sql_tokens(expression: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({SQL_FOLD.format(expression)}, ''), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
