"""Where the catalogue is, what its tables look like, and how names and texts are quoted."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import iso_week

SETTING = "spark.quillon.catalogue"


#: Tables of the store, as column lists.
SCHEMAS = {
    "items": "id string not null, name string, about string, category string, tags string, body string, content_key string, mean_score double, n_ratings int, vector array<float>, signature string",
    "repositories": "id string not null, name string, about string, body string, remote string, content_key string, vector array<float>, signature string",
    "rules": "id bigint not null, body string not null, source string, tags string, active boolean not null, created string",
    "ratings": "week int not null, agent string not null, item_id string not null, score double not null, reason string",
    "calls": "session string not null, call_id string not null, tool string not null, digest string, started string, duration_ms bigint, error boolean",
    "files": "path string not null, bytes bigint not null, lines bigint not null, updated_ms bigint",
}


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    """A table of the store before its first row."""
    return spark.createDataFrame([], SCHEMAS[name])


def located(spark: SparkSession, candidates: Iterable[str] = (), setting: str = SETTING) -> str:
    """The catalogue's folder: the one the session's setting names, which must be there, or the first candidate that is. Nothing is created."""

    def there(path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    named = spark.conf.get(setting, None)
    if named:  # an empty setting counts as none
        if not there(named):
            raise FileNotFoundError(f"{setting} names nothing: {named}")
        return named
    tried = list(candidates)
    for path in tried:
        if there(path):
            return path
    raise FileNotFoundError(f"no catalogue; looked at {', '.join(tried) or 'no place'}; {setting} names one")


def quoted_name(name: str) -> str:
    """An identifier, for SQL; quotes in it are doubled."""
    return "`" + name.replace("`", "``") + "`"


def quoted_text(text: str) -> str:
    """A text, for SQL, with what Spark would read as an escape or the end doubled."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def current_week() -> Column:
    """ISO year and week of now, in UTC whatever the session's zone."""
    return iso_week(F.to_date(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())))


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def snapshot(spark: SparkSession, source: str, target: str) -> DataFrame:
    """A copy of a table that others write to, read from the copy: the source is read once and never changed."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("a snapshot needs a place of its own")
    spark.read.parquet(source).write.mode("error").parquet(target)
    return spark.read.parquet(target)
