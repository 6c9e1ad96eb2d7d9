"""File discovery and the parsers behind it: transcripts, skill files, manifests, caches, query sets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clipping import clipped_json  # noqa: F401

#: Folders that hold no skills of one's own.
SKIPPED = ("target", "node_modules")
SKILL_DEPTH = 8


def transcripts(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified_ms) of the .jsonl files under root, by path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root)
    return files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms")).orderBy("path")


def changed(files: DataFrame, offsets: DataFrame) -> DataFrame:
    """Files whose size isn't the recorded offset."""
    known = offsets.select("path", F.col("bytes").alias("_bytes"))
    return files.join(known, "path", "left").filter(~F.col("size").eqNullSafe(F.col("_bytes"))).drop("_bytes")


def skill_files(spark: SparkSession, root: str, depth: int = SKILL_DEPTH) -> DataFrame:
    """(path, md) of SKILL.md files, not in hidden or build folders, `depth` folders down at most."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "SKILL.md").load(root)
    below = F.filter(F.split(F.expr("substring(path, locate(regexp_replace(:r, '^file:/*|/+$', ''), path) + length(regexp_replace(:r, '^file:/*|/+$', '')))".replace(":r", "'" + root.replace("'", "\\'") + "'")), "/"), lambda p: p != "")
    dirs = F.slice(below, 1, F.greatest(F.size(below) - 1, F.lit(0)))
    bad = F.exists(dirs, lambda p: p.startswith(".") | p.isin(*SKIPPED))
    return files.filter(~bad & (F.size(dirs) <= depth)).select("path", F.decode("content", "UTF-8").alias("md"))


def optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or an empty one of the schema where there's none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def schema_table(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(table, column, type) of each table's columns."""
    return [(name, c, t) for name, df in sorted(tables.items()) for c, t in df.dtypes]


def _value(lines: list[str], key: str) -> str | None:
    for i, line in enumerate(lines):
        if line.startswith(key + ":"):
            break
    else:
        return None
    first = line[len(key) + 1 :].strip()
    more = []
    for x in lines[i + 1 :]:
        if x.strip() and x[0] not in " \t":
            break
        if x.strip():
            more.append(x.strip())
    if not first or re.fullmatch(r"[>|][-+]?", first):
        out = " ".join(more)
    elif len(first) > 1 and first[0] == first[-1] and first[0] in "\"'":
        out = first[1:-1].replace('\\"', '"').replace("''", "'")
    else:
        out = " ".join([first, *more])
    return out.strip() or None


def front_matter(md: str | None) -> tuple[str, str, str] | None:
    """(name, description, body) of a Markdown file with a front matter that has a name; else None."""
    lines = (md or "").removeprefix("﻿").splitlines()
    if not lines or lines[0].rstrip() != "---":
        return None
    for end, line in enumerate(lines[1:], 1):
        if line.rstrip() == "---":
            break
    else:
        return None
    name = _value(lines[1:end], "name")
    if name is None:
        return None
    return name, _value(lines[1:end], "description") or "", "\n".join(lines[end + 1 :]).strip()


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "description", "body")]))
def front_matter_of(md: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([front_matter(x) or (None, None, None) for x in md], columns=["name", "description", "body"])


#: Fixed values of the prose rule: words that make a line prose, characters and lines that end the passage, its greatest length.
PROSE_WORDS, PROSE_ENOUGH, PROSE_LINES, PROSE_LENGTH = 4, 120, 3, 300


def _unbracketed(line: Column) -> Column:
    """What stands outside all brackets, of either kind: innermost pairs go first, as often as there are opening ones, then what an open one begins."""
    openings = F.length(line) - F.length(F.translate(line, "[(", ""))
    pairs = F.aggregate(F.sequence(F.lit(0), openings), line, lambda text, _: F.regexp_replace(text, r"[\[(][^\[\]()]*[\])]", ""))
    return F.regexp_replace(F.when(openings > 0, pairs).otherwise(line), r"[\[(].*$", "")


def prose(readme: Column) -> Column:
    """The first passage of prose of a README: a run of lines that have words enough outside links and tags, until it is long enough.

    Headings, fences and menus of languages neither belong to a passage nor end it; any other line without prose ends it.
    """
    lines = F.transform(F.split(F.coalesce(readme, F.lit("")), r"\r\n|\r|\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    lines = F.filter(lines, lambda x: ~(x.startswith("#") | x.startswith("```") | F.contains(x, F.lit("](README"))))
    untagged = F.transform(lines, lambda x: F.regexp_replace(x, "<[^>]*>?", ""))
    words = lambda x: F.filter(F.split(_unbracketed(x), r"\s+", -1), lambda w: (F.length(w) > 1) & w.rlike(r"\p{L}"))
    plain = lambda x: F.trim(F.regexp_replace(F.translate(F.regexp_replace(x, r"\]\([^)]*\)?", ""), "*_`[]!>#|", " " * 9), r"\s+", " "))
    judged = F.transform(untagged, lambda x: F.when(F.size(words(x)) >= PROSE_WORDS, plain(x)))
    state = lambda parts, done: F.struct(parts.alias("parts"), done.alias("done"))

    def step(s: Column, line: Column) -> Column:
        more = F.concat(s["parts"], F.array(line))
        full = (F.size(more) >= PROSE_LINES) | (F.length(F.array_join(more, "")) >= PROSE_ENOUGH)
        return F.when(s["done"] | line.isNull() & (F.size(s["parts"]) == 0), s).when(line.isNull(), state(s["parts"], F.lit(True))).otherwise(state(more, full))

    parts = F.aggregate(judged, state(F.array().cast("array<string>"), F.lit(False)), step)["parts"]
    return F.when(F.size(parts) > 0, F.left(F.array_join(parts, " "), F.lit(PROSE_LENGTH)))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def vector_of_blob(blob: pd.Series) -> pd.Series:
    """Little-endian floats; null where there are none or bytes are left over."""
    import numpy as np

    return blob.map(lambda b: None if not b or len(b) % 4 else np.frombuffer(b, "<f4").tolist())


@F.pandas_udf(T.BinaryType())
def blob_of_vector(vector: pd.Series) -> pd.Series:
    import numpy as np

    return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def server_names(config: Column) -> Column:
    """Names of the servers in a tool configuration, lower case; values are never read."""
    return F.transform(F.json_object_keys(F.get_json_object(config, "$.mcpServers")), lambda k: F.lower(k))


def tool_cache(spark: SparkSession, root: str, servers: list[str], glob: str = "*.json") -> DataFrame:
    """(server, tool, description, known): tools of cached server listings, one JSON file a server, known if it is configured."""
    form = "name string, tools array<struct<name:string,description:string>>"
    rows = spark.read.schema(form).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).json(root)
    each = rows.select(F.lower("name").alias("server"), F.explode("tools").alias("t"))
    return each.select("server", F.col("t.name").alias("tool"), F.col("t.description").alias("description"), F.col("server").isin(servers).alias("known"))


def repository_folders(root: str, depth: int = 4) -> Iterator[tuple[str, str, str, str, str]]:
    """(id, name, readme, manifest, git config) of each folder with .git, which isn't looked into further."""
    todo = [(Path(root), 0)]
    while todo:
        here, level = todo.pop()
        if (here / ".git").exists():
            readme = next((p for p in sorted(here.iterdir()) if p.name.lower().startswith("readme")), None)
            held = (p.read_text(errors="replace") if p is not None and p.is_file() else "" for p in (readme, here / "Cargo.toml", here / ".git" / "config"))
            yield (here.relative_to(root).as_posix(), here.name, *held)
        elif level < depth:
            todo += [(p, level + 1) for p in sorted(here.iterdir(), reverse=True) if p.is_dir() and not p.name.startswith(".") and p.name not in SKIPPED]


def manifest_names(manifest: Column) -> Column:
    """Names that a manifest's lines give."""
    return F.regexp_extract_all(manifest, F.lit('(?m)^name\\s*=\\s*"([^"]*)"'), 1)


def repositories(spark: SparkSession, root: str, depth: int = 4) -> DataFrame:
    """A row for each repository under a folder of the driver's: id, name, remote, digest, names, readme."""
    rows = spark.createDataFrame(list(repository_folders(root, depth)), "id string, name string, readme string, manifest string, config string")
    remote = F.nullif(F.regexp_extract("config", r"url\s*=\s*(\S+)", 1), F.lit(""))
    return rows.select("id", "name", remote.alias("remote"), prose(F.col("readme")).alias("digest"), manifest_names(F.col("manifest")).alias("names"), "readme")


def query_set(text: str) -> list[tuple[str, list[str]]]:
    """(query, expected ids) of a query set of `[[query]]` blocks with `text = "…"` and `expected = ["…", …]`."""
    out: list[tuple[str, list[str]]] = []
    for block in re.split(r"^\s*\[\[[^\]]*\]\]\s*$", text, flags=re.M)[1:]:
        lines = "\n".join(x for x in block.splitlines() if not x.lstrip().startswith("#"))
        asked = re.search(r'^\s*text\s*=\s*"((?:[^"\\]|\\.)*)"', lines, re.M)
        wanted = re.search(r"^\s*expected\s*=\s*\[(.*?)\]", lines, re.M | re.S)
        if not asked or not wanted:
            raise ValueError("a query needs text and expected")
        out.append((asked[1].replace('\\"', '"'), re.findall(r'"([^"]*)"', wanted[1])))
    return out
