"""Text expressions: folding, tokens, stems, clipping, tags, names, paths. Built-in functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that fold to ASCII, and what they fold to, in the same order.
FOLD_FROM = "ÇĞİÖŞÜÂÎÛÁÀÄÃÅÉÈÊËÍÌÏÑÓÒÔÕÚÙÝIçğıöşüâîûáàäãåéèêëíìïñóòôõúùýÿ"
FOLD_TO = "CGIOSUAIUAAAAAEEEEIIINOOOOUUYIcgiosuaiuaaaaaeeeeiiinoooouuyy"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What LIKE takes as its escape: a character that no pattern holds.
NO_ESCAPE = "\x01"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(text: Column | str) -> Column:
    """Lower case with accents and the Turkish letters folded; i for every i. ASCII texts have nothing to fold."""
    c = col(text)
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.lower(F.translate(F.regexp_replace(c, r"\p{M}", ""), FOLD_FROM, FOLD_TO)))


def tokens(text: Column | str) -> Column:
    """Folded runs of letters and digits; null gives none."""
    return F.array_remove(F.split(F.coalesce(fold(text), F.lit("")), r"[^\p{L}\p{N}]+"), "")  # compiled, unlike a filter


def stems(token_array: Column) -> Column:
    """The first five letters of each token."""
    return F.transform(token_array, lambda t: F.left(t, F.lit(5)))


def fold_python(text: str) -> str:
    """fold() on the driver, for query texts."""
    import unicodedata

    plain = "".join(c for c in text if not unicodedata.category(c).startswith("M"))
    return plain.translate(str.maketrans(FOLD_FROM, FOLD_TO)).lower()


def query_tokens(text: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", fold_python(text)) if t]


def clip(text: Column | str, n: int) -> Column:
    """At most n characters, with how many more there were."""
    c = col(text)
    over = F.char_length(c) - n
    return F.when(over > 0, F.concat(F.left(c, F.lit(n)), F.lit("…(+"), over.cast("string"), F.lit(" characters)"))).otherwise(c)


def snippet(text: Column | str, n: int) -> Column:
    """At most n characters and an ellipsis."""
    c = col(text)
    return F.when(F.char_length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def tags(text: Column | str) -> Column:
    """Comma-separated tags, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def tool_name(identifier: Column | str) -> Column:
    """A name of 64 characters at most that tool registries accept."""
    return F.left(F.concat(F.lit("y_"), F.regexp_replace(col(identifier), "[^A-Za-z0-9_-]", "_")), F.lit(64))


def path_id(interface: Column | str, path: Column | str) -> Column:
    """interface/relative/path without `skills` and parts that begin with a digit."""
    parts = F.filter(F.split(col(path), "/"), lambda p: (p != "") & (p != "skills") & ~p.rlike("^[0-9]"))
    joined = F.array_join(parts, "/")
    return F.when(joined == "", col(interface)).otherwise(F.concat_ws("/", col(interface), joined))


def normal_path(path: Column | str) -> Column:
    """Lower case, slashes one way and single."""
    return F.regexp_replace(F.replace(F.lower(col(path)), F.lit("\\"), F.lit("/")), "/+", "/")


def path_variants(path: Column | str) -> Column:
    """The normal path; for c:/x also /c/x."""
    p = normal_path(path)
    drive = F.concat(F.lit("/"), F.left(p, F.lit(1)), F.substring(p, 3, 1 << 20))
    return F.when(p.rlike("^[a-z]:/"), F.array(p, drive)).otherwise(F.array(p))


def path_runs(text: Column) -> Column:
    """Runs of path characters, in order."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}._/-]+"), lambda x: x != "")


def has_path(text: Column, path: Column) -> Column:
    """Whether path stands in text with no path character on either side."""
    pieces = F.split(text, F.concat(F.lit(r"\Q"), path, F.lit(r"\E")), -1)
    inner = F.transform(F.sequence(F.lit(0), F.size(pieces) - 2), lambda i: ~F.get(pieces, i).rlike(r"[\p{L}\p{N}._/-]$") & ~F.get(pieces, i + 1).rlike(r"^[\p{L}\p{N}._/-]"))
    return F.when((F.length(path) == 0) | (F.size(pieces) < 2), F.lit(False)).otherwise(F.exists(inner, lambda x: x))


def ascii_like(text: Column | str, needle: str) -> Column:
    """LIKE '%needle%' that ignores the case of ASCII letters only; % and _ stay live, nothing escapes."""
    pattern = "%" + needle.translate(str.maketrans(UPPER, LOWER)) + "%"
    return F.translate(col(text), UPPER, LOWER).like(pattern.replace("\\", "\\\\"))


def plain_html(html: Column | str) -> Column:
    """Markup stripped, spaces squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(html), "<[^>]*>", ""), r"\s+", " "))


def plain_line(line: Column | str) -> Column:
    """A README line as text: no tags, no link targets, no markers, single spaces."""
    bare = F.regexp_replace(F.regexp_replace(col(line), "<[^>]*>", ""), r"\]\([^)]*\)?", "")
    return F.trim(F.regexp_replace(F.translate(bare, "*_`[]!>#|", " " * 9), r"\s+", " "))


def tsv_cell(value: Column, binary: bool = False) -> Column:
    """A cell of tab-separated output: backslash, tab and line ends escaped, bytes as x'…' in hexadecimal, NULL for null."""
    out = F.coalesce(F.concat(F.lit("x'"), F.lower(F.hex(value)), F.lit("'")) if binary else value.cast("string"), F.lit("NULL"))
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def iso_ms(stamp: Column | str) -> Column:
    """Milliseconds of an ISO time that ends in Z, fractions cut to three digits; else null."""
    c = col(stamp)
    form = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d*)?Z$"
    whole = F.unix_millis(F.try_to_timestamp(F.concat(F.left(c, F.lit(19)), F.lit("Z"))))
    part = F.rpad(F.left(F.regexp_extract(c, r"\.(\d*)Z$", 1), F.lit(3)), 3, "0").cast("int")
    return F.when(c.rlike(form), whole + part)


def iso_week(stamp: Column | str) -> Column:
    """ISO year and week as YYYYWW."""
    return (F.extract(F.lit("YEAROFWEEK"), col(stamp)) * 100 + F.weekofyear(col(stamp))).cast("int")
