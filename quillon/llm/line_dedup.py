"""Line removal by site-relative frequency. Built-in functions only.

Documents are grouped by host (source); for each line, the share of the host's
documents that hold it is its boilerplate ratio, and lines over RATIO that
LEAST_DOCUMENTS documents or more hold are dropped.  Everything else stays as
it is, blank lines and order included.

Null texts stay null and have no lines; empty texts stay as they are.  A null
source is a host of its own.  Repeated rows count as documents of their own;
very long texts are cleaned whole.  An empty table gives an empty result.  All
columns stay; those called _host, _docs, _common, _cleaned, n_lines or
n_dropped would clash with ours and are dropped first.

LEAST_DOCUMENTS keeps the texts of small hosts: where a host has under 100
documents, a share alone would drop all lines of any text that it holds twice.

passages_once() is for what the ratio can't catch: long lines that few documents
of a source, or documents of several sources, share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, broadcast_if_small, forget, written
from .lines import has_word, line_key, lines_of, text_of, with_common

RATIO = 0.05
LEAST_DOCUMENTS = 5
#: Lines of more words than this hardly repeat by chance.
PASSAGE_WORDS = 50


def clean(documents: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """documents with the text cleaned, and n_lines and n_dropped (lines with a word) beside it."""
    known = with_common(documents.drop("_host", "_docs", "_common", "_cleaned", "_large", "n_lines", "n_dropped"), text, host, LEAST_DOCUMENTS, RATIO)
    lines = lines_of(text_of(text))
    stays = F.array_join(F.filter(lines, lambda x: ~(has_word(x) & F.array_contains(F.col("_common"), line_key(x)))), "\n")
    cleaned = F.when(F.col("_common").isNull() | F.col(text).isNull(), F.col(text)).otherwise(stays)
    n_lines = F.size(F.filter(lines, has_word)).cast("bigint")
    both = known.withColumns({"n_lines": n_lines, "_cleaned": cleaned})
    left = F.size(F.filter(lines_of(text_of("_cleaned")), has_word)).cast("bigint")
    return both.withColumn("n_dropped", F.col("n_lines") - left).withColumn(text, F.col("_cleaned")).drop("_cleaned", "_common")


def passages_once(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents, all of them, in which no two different texts share a line of over PASSAGE_WORDS words: the text with the least hash keeps it.

    Sources don't matter here.  Equal texts are treated alike, and so are lines equal but for case and spaces.
    """
    # so many words take so many characters, which are counted faster
    long = lambda x: (F.length(x) > 2 * PASSAGE_WORDS) & (F.size(F.split(F.btrim(x, F.lit(SPACE_CHARS)), f"[{SPACE}]+", -1)) > PASSAGE_WORDS)
    lines = lines_of(text_of(text))
    keyed = documents.withColumn("_text", F.xxhash64(text))
    each = written(keyed.select("_text", F.explode(F.array_distinct(F.transform(F.filter(lines, long), line_key))).alias("_line")), "passage-lines")
    firsts = each.groupBy("_line").agg(F.min("_text").alias("_first"), F.max("_text").alias("_last")).filter("_first <> _last")
    firsts = written(firsts.select("_line", "_first"), "passages")
    again = each.join(broadcast_if_small(firsts, firsts.count()), "_line").filter("_text <> _first")
    gone = written(again.groupBy("_text").agg(F.collect_set("_line").alias("_gone")), "passages-gone")
    forget(each, firsts)
    stays = F.array_join(F.filter(lines, lambda x: ~(long(x) & F.array_contains("_gone", line_key(x)))), "\n")
    known = keyed.join(broadcast_if_small(gone, gone.count(), 20_000), "_text", "left")
    return known.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(stays)).select(*documents.columns)


#: The same in DuckDB. Lines are compared as texts here, as hashes above.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce('=' || source, 'null') AS host, text FROM documents),
ln AS (SELECT u, host, i, xs[i] AS x, regexp_matches(xs[i], '[^\\x20\\x09-\\x0D]') AS wordy,
    lower(regexp_replace(trim(xs[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS k
  FROM (SELECT u, host, xs, unnest(range(1, len(xs) + 1)) AS i FROM (SELECT u, host, string_split(text, chr(10)) AS xs FROM d WHERE text IS NOT NULL))),
hosts AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
often AS (SELECT host, k, true AS bad FROM ln JOIN hosts USING (host) WHERE wordy GROUP BY host, k, docs
  HAVING count(DISTINCT u) >= {LEAST_DOCUMENTS} AND count(DISTINCT u) > {RATIO} * docs),
kept AS (SELECT u, string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT (wordy AND coalesce(bad, false))) AS text,
  count(*) FILTER (WHERE wordy) AS n_lines, count(*) FILTER (WHERE wordy AND bad) AS n_dropped
  FROM ln LEFT JOIN often USING (host, k) GROUP BY u)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM d LEFT JOIN kept USING (u)
"""
