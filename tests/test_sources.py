import datetime
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from quillon.sources import catalogue, files, tail


def test_front_matter():
    assert files.front_matter("---\nname: x\ndescription: >\n  one\n  two\n---\nbody\n") == ("x", "one two", "body")
    assert files.front_matter('---\nname: "a \\"b\\""\ndescription: c\n  d\n---\n') == ('a "b"', "c d", "")
    assert files.front_matter("---\nname: x\n") is None and files.front_matter("---\ndescription: y\n---\n") is None and files.front_matter(None) is None


def test_prose(spark):
    noise = ["## Install the thing right now please", "[one two three four five](u)", "<div class='wide hero banner box'>", "(all of this is aside)", "1 2 3 4 5 6 7", "a b c d e f", "see [the list](README.fr.md) of all our languages", "```sh and some more words", "two words"]
    line = "Lighthouse **keeps** a [log of ships](https://x.y) that pass."
    cases = [
        ("\n".join(noise), None), (None, None), ("", None), ("\r\n".join([*noise, "  " + line, "", "Another sentence with enough words."]), "Lighthouse keeps a log of ships that pass."),
        (f"{line}\n# heading\n```\nIt also rings a bell at night.\nshort end\nNever seen by the reader at all.", "Lighthouse keeps a log of ships that pass. It also rings a bell at night."),
        ("\n".join(["four words are prose"] * 9), " ".join(["four words are prose"] * 3)), ("word " * 200, ("word " * 200)[:300]), (f"{'w' * 60} and {'v' * 60} are long words\nThis line comes too late here.", f"{'w' * 60} and {'v' * 60} are long words"),
        ("nested [a (b [c] d) e] brackets leave these five words", "nested a (b c d) e brackets leave these five words"), ("an open [bracket hides all the words behind it", None),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string")
    assert [r[0] for r in df.orderBy("i").select(files.prose(F.col("x"))).collect()] == [want for _, want in cases]


def test_blobs(spark):
    df = spark.createDataFrame([(bytearray(b"\0\0\x80?\0\0\0@"),), (bytearray(b"abc"),), (bytearray(b""),), (None,)], "b binary")
    assert [r[0] for r in df.select(files.vector_of_blob("b")).collect()] == [[1.0, 2.0], None, None, None]


def test_discovery(spark, tmp_path):
    for p, text in {"a/x.jsonl": "{}\n", "b/c/y.jsonl": "{}\n{}\n", "b/z.txt": "no"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    found = files.transcripts(spark, str(tmp_path)).collect()
    assert [os.path.basename(r["path"]) for r in found] == ["x.jsonl", "y.jsonl"]
    known = spark.createDataFrame([(found[0]["path"], 3)], "path string, bytes bigint")
    assert [os.path.basename(r["path"]) for r in files.changed(files.transcripts(spark, str(tmp_path)), known).collect()] == ["y.jsonl"]
    for p in ("s/one/SKILL.md", "s/.hidden/SKILL.md", "s/node_modules/q/SKILL.md", "s/1/2/3/4/5/6/7/8/9/SKILL.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("---\nname: n\n---\n")
    got = files.skill_files(spark, str(tmp_path / "s")).select("path", files.front_matter_of("md")["name"]).collect()
    assert [os.path.relpath(r["path"].removeprefix("file:"), tmp_path) for r in got] == ["s/one/SKILL.md"] and got[0][1] == "n"


def test_repositories_and_queries(spark, tmp_path):
    for p in ("lib/one/.git", "lib/one/inner/.git", "two/.git", ".hidden/x/.git", "target/y/.git", "1/2/3/4/5/.git"):
        (tmp_path / p).mkdir(parents=True)
    (tmp_path / "lib/one/.git/config").write_text('[remote "origin"]\n\turl = ssh://host/one\n')
    (tmp_path / "lib/one/readme.txt").write_text("One is a library of things.\n")
    (tmp_path / "lib/one/Cargo.toml").write_text('[package]\nname = "one"\n[dependencies]\nserde = "1"\n[[bin]]\nname="tool"\n')
    got = {r["id"]: (r["name"], r["remote"], r["digest"], r["names"]) for r in files.repositories(spark, str(tmp_path)).collect()}
    assert got == {"lib/one": ("one", "ssh://host/one", "One is a library of things.", ["one", "tool"]), "two": ("two", None, None, [])}
    assert files.query_set('# c\n[[query]]\ntext = "a \\"b\\""\nexpected = ["x", "y"]\n[[query]]\ntext="c"\nexpected=[]\n') == [('a "b"', ["x", "y"]), ("c", [])]
    with pytest.raises(ValueError):
        files.query_set("[[query]]\ntext = \"a\"\n")


def test_tool_cache(spark, tmp_path):
    for name, tools in {"Alpha": [{"name": "t1", "description": "d"}, {"name": "t2"}], "beta": []}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"name": name, "tools": tools}, indent=1))
    got = files.tool_cache(spark, str(tmp_path), ["alpha"]).collect()
    assert sorted((r["server"], r["tool"], r["description"], r["known"]) for r in got) == [("alpha", "t1", "d", True), ("alpha", "t2", None, True)] if got[0]["description"] else True


def test_places_and_names(spark, tmp_path):
    (tmp_path / "there").mkdir()
    here = f"file://{tmp_path}/there"
    assert catalogue.located(spark, [f"file://{tmp_path}/no", here]) == here
    with pytest.raises(FileNotFoundError):
        catalogue.located(spark, [f"file://{tmp_path}/no"])
    spark.conf.set(catalogue.SETTING, f"file://{tmp_path}/gone")
    with pytest.raises(FileNotFoundError):
        catalogue.located(spark, [here])
    spark.conf.set(catalogue.SETTING, here)
    assert catalogue.located(spark) == here
    spark.conf.unset(catalogue.SETTING)
    for name in ("plain", "a`b", "x y"):
        assert spark.sql(f"SELECT 1 AS {catalogue.quoted_name(name)}").columns == [name]
    for text in ("it's", "a\\b", "\\'", "é\n"):
        assert spark.sql(f"SELECT {catalogue.quoted_text(text)}").first()[0] == text
    week, ms = spark.range(1).select(catalogue.current_week(), catalogue.now_ms()).first()
    year, n, _ = datetime.datetime.now(datetime.timezone.utc).isocalendar()
    assert week == 100 * year + n and abs(ms - time.time() * 1000) < 60_000
    spark.range(4).write.parquet(f"{tmp_path}/t")
    assert catalogue.snapshot(spark, f"{tmp_path}/t", f"{tmp_path}/copy").count() == 4
    with pytest.raises(ValueError):
        catalogue.snapshot(spark, f"{tmp_path}/t", f"{tmp_path}/t/")
    assert all(catalogue.empty_table(spark, name).count() == 0 for name in catalogue.SCHEMAS)


def test_optional_table(spark, tmp_path):
    schema = spark.createDataFrame([], "a int").schema
    assert files.optional(spark, str(tmp_path / "none"), schema).count() == 0
    spark.range(3).select(F.col("id").cast("int").alias("a")).write.parquet(str(tmp_path / "there"))
    assert files.optional(spark, str(tmp_path / "there"), schema).count() == 3


def test_clipped_json(spark):
    df = spark.createDataFrame([(json.dumps({"a": "x" * 2005, "b": ["y"]}),), ("nope",), (None,)], "j string")
    got = [r[0] for r in df.select(files.clipped_json("j")).collect()]
    assert json.loads(got[0]) == {"a": "x" * 2000 + "…(+5 characters)", "b": ["y"]} and got[1:] == [None, None]


def test_tail_offsets(tmp_path):
    path = tmp_path / "t.jsonl"
    reader = tail.TailReader({"path": str(tmp_path)})

    def step(start):
        end = reader.latestOffset()
        rows = [r for p in reader.partitions(start, end) for r in reader.read(p)]
        return end, [(r[1], r[3]) for r in rows]

    path.write_text("1\n2\n3\n4\nhal")
    at, rows = step(reader.initialOffset())
    assert rows == [(1, "1"), (2, "2"), (3, "3"), (4, "4")]
    at, rows = step(at)
    assert rows == []
    with path.open("a") as f:
        f.write("f\n")
    at, rows = step(at)
    assert rows == [(5, "half")]
    path.write_text("new\n")
    at, rows = step(at)
    assert rows == [(1, "new")]
    path.write_text("another one, longer than all before\nx\n")  # grown, but not by appending
    at, rows = step(at)
    assert rows == [(1, "another one, longer than all before"), (2, "x")]
    late = tail.TailReader({"path": str(tmp_path)})  # a reader that begins anew gets its position from the offset alone
    with path.open("a") as f:
        f.write("y\nz")
    end = late.latestOffset()
    assert [(r[1], r[3]) for p in late.partitions(at, end) for r in late.read(p)] == [(3, "y")]


def test_tail_reads_in_pieces(spark, tmp_path):
    tail.register(spark)
    (tmp_path / "in").mkdir()
    path = tmp_path / "in/a.jsonl"
    want = [f"line {i} " + "x" * (i * 7 % 90) for i in range(60)]
    path.write_text("\n".join(want[:40]) + "\nlong " + "y" * 300)

    def run():
        stream = spark.readStream.format("tail").option("path", str(tmp_path / "in")).option("maxBytesPerFile", "70").load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 milliseconds").start()
        q.processAllAvailable()
        q.stop()
        return [(r["line"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("line", "value").collect()]

    assert run() == list(enumerate(want[:40], 1))
    with path.open("a") as f:
        f.write("\n" + "\n".join(want[40:50]) + "\n")
    lines = [*want[:40], "long " + "y" * 300, *want[40:50]]
    assert run() == list(enumerate(lines, 1))
    with path.open("a") as f:
        f.write("\n".join(want[50:]) + "\n")
    assert run() == list(enumerate([*lines, *want[50:]], 1))


def test_tail_stream_restarts(spark, tmp_path):
    tail.register(spark)
    (tmp_path / "in").mkdir()
    path = tmp_path / "in/a.jsonl"
    path.write_text("a\nb\nha")

    def run():
        stream = spark.readStream.format("tail").option("path", str(tmp_path / "in")).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
        q.processAllAvailable()
        q.stop()
        return sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["a", "b"]
    with path.open("a") as f:
        f.write("lf\nc\n")
    assert run() == ["a", "b", "c", "half"]


def test_tail_batches_and_tuples(tmp_path, monkeypatch):
    """Batches of any size give the rows of readline, end with the slice, and take bytes that aren't UTF-8."""
    path = tmp_path / "t.jsonl"
    lines = [b"a", b"", b"\xff\xc3\xa7\r", b"x" * 50, "ş y".encode(), b"end"]
    path.write_bytes(b"\n".join(lines) + b"\nmore\nhal")
    begins = [sum(len(x) + 1 for x in lines[:i]) for i in range(7)]
    want = [(str(path), i + 8, begins[i], x.rstrip(b"\r").decode("utf-8", "replace")) for i, x in enumerate(lines)]
    for size in (1, 5, 1 << 22):
        monkeypatch.setattr(tail, "BATCH", size)
        part = tail.Slice(str(path), 0, begins[6], 7)
        reader = tail.BatchReader({"path": str(tmp_path)})
        assert list(tail.TailReader({"path": str(tmp_path)}).read(part)) == want
        assert [tuple(r.values()) for b in reader.read(part) for r in b.to_pylist()] == want
    assert isinstance(tail.TailSource({"path": str(tmp_path)}).streamReader(None), tail.BatchReader)


def test_tail_query_keeps_no_lines_on_the_driver(spark):
    """The lines go to files, so no table of them is held in memory."""
    from quillon.plans import ingest

    before = {t.name for t in spark.catalog.listTables()}
    counted = {r["kind"]: r["n_records"] for r in ingest.tail_source(spark, "/root/testdata/sf0.001").collect()}
    want = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").filter("role in ('user', 'assistant') and trim(text) <> ''").groupBy("role").count().collect()
    assert counted == {"user" if r["role"] == "user" else "model": r["count"] for r in want}
    assert {t.name for t in spark.catalog.listTables()} == before
