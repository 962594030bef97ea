"""Byte ranges, streams, estimates and settings that reach the reader."""

import bz2
import gzip
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from strandline.sources import dialects, ranges, settings
from strandline.workspace import materialise

RNG = random.Random(11)


def lines_of(text):
    parts = re.split("\r\n|\r|\n", text)
    return parts if parts[-1] else parts[:-1]


@pytest.mark.parametrize("codec", ["utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be"])
def test_ranges_give_every_line_once(codec):
    for _ in range(400):
        # U+0A00 and U+0D0A hold the bytes of line ends, the last character is two 16-bit units
        text = "".join(RNG.choice("\r\n\r\nab਀ഊĀ😀") for _ in range(RNG.randrange(30)))
        mark = RNG.choice([b"", "﻿".encode(codec)])
        data = mark + text.encode(codec)
        read = lambda at, n: data[at:at + n]
        name, begin = ranges.unit_codec(data[:4], codec)
        assert (name, begin) == (codec, len(mark)) or text.startswith("﻿")
        size, step = 4 * RNG.randrange(1, 9), RNG.randrange(4, 13)
        got = [line for start in range(0, max(1, len(data)), size) for line in ranges.range_lines(read, codec, begin, start, start + size, step)]
        assert got == lines_of(text)


@pytest.mark.parametrize("end", [None, "|", "#~#", "~~"])
def test_streams_are_cut_like_whole_texts(end):
    for _ in range(300):
        text = "".join(RNG.choice("\r\n|#~ab") for _ in range(RNG.randrange(25)))
        cuts = sorted(RNG.choices(range(len(text) + 1), k=3))
        pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        want = lines_of(text) if end is None else text.split(end)
        assert list(ranges._cut(iter(pieces), end)) == (want if end is None or want[-1] else want[:-1])


def test_wide_lines_by_many_tasks(spark, tmp_path):
    text = "".join(f"{i};ä😀{'x' * (i % 70)}\r\n" for i in range(3000))
    (tmp_path / "a.txt").write_bytes(text.encode("utf-16"))
    (tmp_path / "empty.txt").write_bytes(b"")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", F.col("length").alias("size"), F.lit("utf-16").alias("wide"))
    got = ranges.wide_lines(files, 4096).orderBy("block", "at").collect()
    assert [r["line"] for r in got] == lines_of(text) and len({r["block"] for r in got}) > 20


def test_row_estimate_reads_little(spark, tmp_path):
    lines = ["x" * RNG.randrange(5, 120) for _ in range(200_000)]
    (tmp_path / "large.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "small.csv").write_text("a\nb\nc")
    (tmp_path / "none.csv").write_text("")
    files = spark.createDataFrame([(f"file:{tmp_path}/{n}.csv",) for n in ("large", "small", "none")], "path string")
    got = {os.path.basename(r["path"]): r for r in ranges.estimate_lines(files, 16, 4096).collect()}
    assert (got["small.csv"]["lines"], got["small.csv"]["error"]) == (3, 0) and got["none.csv"]["lines"] == 0
    large = got["large.csv"]
    assert large["bytes_read"] < 0.01 * large["size"] and 0 < large["error"] < 20_000
    assert abs(large["lines"] - 200_000) <= 2 * large["error"]
    missing = spark.createDataFrame([(f"file:{tmp_path}/gone.csv",)], "path string")
    assert ranges.estimate_lines(missing).first()["lines"] is None


def read(spark, *pairs):
    rows = settings.read_with_settings(spark, [(f"file:{p}", s) for p, s in pairs]).collect()
    return sorted((os.path.basename(r["path"]), r["cells"], r["row_kind"], r["header"]) for r in rows)


def test_settings_reach_the_reader(spark, tmp_path):
    put = lambda name, data: (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode()) and tmp_path / name
    a = put("a.dat", "made by \"x\nnot a row\nid~note\n1~'it''s ~ \"so\"'\n2~'two\nlines'\n3~\n")
    b = put("b.dat", "k^v\x1e1^a\nb\x1e2^ccc^d\x1e")
    c = put("c.dat", gzip.compress("n;name\n1;é\n2;ü\n".encode("cp1252")))
    d = put("d.dat", zlib.compress(b"p,q\n5,6\n"))
    e = put("e.dat", bz2.compress("r|s#~#7|8#~#9|10".encode("utf-16-le")))
    f = put("f.dat", "x\ty\n1\tä\n".encode("utf-16-be"))
    got = read(spark, (a, {"firstRow": "3", "fieldDelimiter": "~", "quoteCharacter": "'"}),
               (b, {"rowTerminator": "0x1E", "fieldDelimiter": "^"}), (c, {"compression": "GZIP", "codepage": "1252"}),
               (d, {"compression": "DEFLATE"}), (e, {"compression": "BZIP2", "codepage": "1200", "rowTerminator": "#~#"}),
               (f, {"codepage": "1201"}))
    assert got == [("a.dat", ["1", "it's ~ \"so\""], "ok", ["id", "note"]), ("a.dat", ["2", "two\nlines"], "ok", ["id", "note"]),
                   ("a.dat", ["3", ""], "ok", ["id", "note"]), ("b.dat", ["1", "a\nb"], "ok", ["k", "v"]),
                   ("b.dat", ["2", "ccc", "d"], "long", ["k", "v"]), ("c.dat", ["1", "é"], "ok", ["n", "name"]),
                   ("c.dat", ["2", "ü"], "ok", ["n", "name"]), ("d.dat", ["5", "6"], "ok", ["p", "q"]),
                   ("e.dat", ["7", "8"], "ok", ["r", "s"]), ("e.dat", ["9", "10"], "ok", ["r", "s"]), ("f.dat", ["1", "ä"], "ok", ["x", "y"])]


def test_settings_leave_the_rest_to_detection(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title\n" + "id;t\n" + "".join(f"{i};w{i}\n" for i in range(500)))
    (tmp_path / "b.csv").write_text("title\n" + "id|t\n" + "".join(f'{i}|"w|{i}"\n' for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = settings.read_with_settings(spark, [(f"file:{tmp_path}", {"firstRow": "2"})]).collect()
        late = settings.read_with_settings(spark, [(f"file:{tmp_path}", {"firstRow": "400"})]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {(os.path.basename(r["path"]), r["delimiter"], r["delimiter_source"], *r["header"]) for r in rows} == {
        ("a.csv", ";", "detected", "id", "t"), ("b.csv", "|", "detected", "id", "t")}
    assert sorted(r["cells"][1] for r in rows) == sorted([f"w{i}" for i in range(500)] + [f"w|{i}" for i in range(500)])
    assert sorted(int(r["cells"][0]) for r in late) == sorted(2 * list(range(397, 500)))     # no header there: all are rows
    for bad in ({"fieldDelimiter": ""}, {"codepage": "437"}, {"compression": "SNAPPY"}, {"nothing": "1"}, {"format": "json"}):
        with pytest.raises(ValueError):
            settings.read_with_settings(spark, [(f"file:{tmp_path}", bad)])


def test_lines_of_ranges_are_never_broadcast(spark, tmp_path):
    text = "".join(f'{i},"a\nb{i}"\r\n' for i in range(3000))
    (tmp_path / "a.csv").write_bytes(text.encode("utf-16-le"))
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", F.col("length").alias("size"), F.lit("utf-16-le").alias("wide"))
    lines = ranges.wide_lines(files, 4096)
    assert lines.rdd.getNumPartitions() > 4                         # one task before
    facts = materialise(dialects.line_facts(lines), "test-facts")
    rows = dialects.records(lines, facts, dialects.file_facts(facts))
    assert sorted(r["line"] for r in rows.collect()) == sorted(f'{i},"a\nb{i}"' for i in range(3000))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildLeft" not in plan  # lines are on the left


def test_text_ranges_cut_between_characters():
    for _ in range(200):
        data = "".join(RNG.choice("aé€😀\n") for _ in range(RNG.randrange(40))).encode() + RNG.choice([b"", b"\xff\x80\x80"])
        size = RNG.randrange(4, 12)
        parts = [ranges.text_range(lambda at, n: data[at:at + n], start, start + size, len(data)) for start in range(0, max(1, len(data)), size)]
        assert b"".join(parts) == data and all(p.decode("utf-8", "replace").count("�") <= 4 for p in parts)
