"""Quality rules with cross-document line frequency. Built-in functions only.

Base rules look at one text: its words, symbols, repeated lines and repeated
8-word windows.  The method counts, for each host (source), the documents that
hold each normalised line, removes lines above the limit, and rejects
documents that keep less than KEEP_PERCENT of their words.

Null and empty texts have no words and fail the base rules; very long texts are
judged whole.  A null source is a host of its own.  Repeated rows count as
documents of their own.  Only doc_id, text and source are read, whatever other
columns are called.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS
from .lines import bind, has_word, line_key, lines_of, text_of, with_common

LEAST_DOCUMENTS = 20
LIMIT = 0.01
KEEP_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return bind(F.btrim(text, F.lit(SPACE_CHARS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"[{SPACE}]+", -1)))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of `window` words that occur twice or more in the array."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(starts, k + 1) - p, F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def of_sorted(s: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
        marked = F.transform(s, lambda e, i: F.when(same(e, i - 1) | same(e, i + 1), e["i"]))
        return bind(F.sort_array(F.filter(marked, lambda p: p.isNotNull())), covered)

    def of_windows(w: Column) -> Column:
        pairs = F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(bind(F.sort_array(pairs), of_sorted))

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(window))))
        return bind(windows, of_windows)

    return F.when(F.size(words) < window, F.lit(0)).otherwise(bind(F.transform(words, lambda x: F.xxhash64(x)), of_hashes))


def word_count(line: Column) -> Column:
    return bind(F.btrim(line, F.lit(SPACE_CHARS)), lambda t: F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, f"[{SPACE}]+", -1))))


def judge(documents: DataFrame) -> DataFrame:
    """The counts, base_failed, removed_words and kept of every document."""
    text = text_of("text")
    long = lambda c: c.cast("bigint")
    known = with_common(documents.select("doc_id", "source", "text"), "text", "source", LEAST_DOCUMENTS, LIMIT)
    both = bind(words_of(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    dup = bind(F.filter(lines_of(text), has_word), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    lost = F.aggregate(
        F.filter(lines_of(text), lambda x: F.array_contains(F.col("_common"), line_key(x))), F.lit(0), lambda a, x: a + word_count(x)
    )
    counts = known.select(
        "doc_id",
        both.alias("_w"),
        long(F.length(F.translate(text, SPACE_CHARS, ""))).alias("word_chars"),
        long(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        long(dup).alias("n_dup_lines"),
        F.when(F.col("_common").isNull(), F.lit(0)).otherwise(lost).cast("bigint").alias("removed_words"),
    )
    n, r = F.col("_w.n").cast("bigint"), F.col("_w.r").cast("bigint")
    failed = (n < 20) | (100 * r > 30 * n)
    return counts.select(
        "doc_id", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", r.alias("n_repeat_words"), "removed_words", failed.alias("base_failed"),
        (~failed & (100 * (n - F.col("removed_words")) >= KEEP_PERCENT * n)).alias("kept"),
    )


#: The same in DuckDB. Lines are compared as texts here, as hashes above.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce('=' || source, 'null') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT u, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT u, i, list_slice(ws, i, i + {WINDOW - 1}) AS s FROM (SELECT u, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
dup AS (SELECT u, i FROM (SELECT u, i, count(*) OVER (PARTITION BY u, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT u, sum(least({WINDOW}, coalesce(nx - i, {WINDOW}))) AS r FROM (SELECT u, i, lead(i) OVER (PARTITION BY u ORDER BY i) AS nx FROM dup) GROUP BY u),
ln AS (SELECT u, host, x, lower(regexp_replace(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS k
  FROM (SELECT u, host, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
nd AS (SELECT u, count(*) - count(DISTINCT x) AS n_dup_lines FROM ln GROUP BY u),
freq AS (SELECT host, k, count(DISTINCT u) AS n FROM ln GROUP BY host, k),
hosts AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
often AS (SELECT host, k FROM freq JOIN hosts USING (host) WHERE n >= {LEAST_DOCUMENTS} AND n > {LIMIT} * docs),
lost AS (SELECT u, sum(len(regexp_split_to_array(k, ' '))) AS removed FROM ln JOIN often USING (host, k) GROUP BY u),
a AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(r, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed_words
  FROM d JOIN w USING (u) LEFT JOIN rep USING (u) LEFT JOIN nd USING (u) LEFT JOIN lost USING (u))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * (n_words - removed_words) >= {KEEP_PERCENT} * n_words AS kept
FROM a
"""
