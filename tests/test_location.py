"""Profiles of a whole location: dialects by consensus, records over blocks, cells, errors as rows."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from strandline.plans import location
from strandline.sources import dialects

RNG = random.Random(4)


def put(folder, name, data):
    p = folder / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(p)


def profile(spark, root, **kw):
    return {(os.path.basename(r["unit"]), r["name"]): r for r in location.profile_location(spark, f"file:{root}", **kw).collect()}


@pytest.fixture
def small_blocks(spark):
    """Splits of some dozen bytes, so that records cross them."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "61b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_whole_location(spark, tmp_path):
    late = "id,word\n" + "".join(f"{i},plain\n" for i in range(20_000)) + "20000,ééééééé\n"
    put(tmp_path, "late.csv", late)
    put(tmp_path, "latin.csv", late.replace("ééééééé", "déjà vu").encode("cp1252"))
    put(tmp_path, "tabs.tsv", "a\tb\n1\tx,y\n2\tz,w\n")
    put(tmp_path, "wide.csv", "n;name\n1;Zoë\n2;two words\n".encode("utf-16"))
    put(tmp_path, "quoted.csv", 'k,note\n1,"a ""b"", c"\n2,"first\nsecond line"\n3,plain\n')
    put(tmp_path, "inches.csv", 'k|note\n1|5" disk\n2|3" x 4"\n3|none\n')
    put(tmp_path, "bare.csv", "1,2.50\n3,4.25\n")
    put(tmp_path, "empty.csv", "")
    put(tmp_path, "rows.jsonl", '{"a": 1, "b": "xy"}\n{"a": 2}\n')
    spark.range(5).selectExpr("id", "cast(id as string) as s").coalesce(1).write.parquet(f"{tmp_path}/p")
    put(tmp_path, "broken.parquet", b"PAR1 nothing")
    got = profile(spark, tmp_path)
    one = lambda f, c: (got[f, c]["detected_type"], got[f, c]["observed_max_length"], got[f, c]["rows"])
    assert one("late.csv", "word") == ("object", 7, 20_001) and got["late.csv", "word"]["encoding"] == "utf-8"
    assert one("latin.csv", "word") == ("object", 7, 20_001) and got["latin.csv", "word"]["encoding"] == "cp1252"
    assert one("tabs.tsv", "a") == ("int32", None, 2) and one("tabs.tsv", "b") == ("object", 3, 2)
    assert one("wide.csv", "name") == ("object", 9, 2) and got["wide.csv", "n"]["delimiter"] == ";"
    assert one("quoted.csv", "note") == ("object", 17, 3) and one("quoted.csv", "k") == ("int32", None, 3)
    assert one("inches.csv", "note") == ("object", 7, 3) and got["inches.csv", "k"]["delimiter"] == "|"
    assert one("bare.csv", "column_2") == ("decimal(3,2)", None, 2)
    assert one("rows.jsonl", "b") == ("str", 2, None)
    assert got["broken.parquet", None]["error"] and not any(u == "empty.csv" for u, _ in got)
    assert sorted(r["detected_type"] for (u, n), r in got.items() if u.startswith("part-")) == ["int64", "string"]


def test_delimiter_is_a_consensus_of_all_lines(spark, tmp_path):
    good = "".join(f"{i},{i * 2},12:30:0{i % 10},x\n" for i in range(300))
    put(tmp_path, "late.csv", "a,b,t,c\n" + good + "1,2\n3,4,12:30:00,y,too many\n" * 5)
    r = profile(spark, tmp_path)
    assert r["late.csv", "t"]["delimiter"] == "," and r["late.csv", "t"]["rows"] == 305
    assert r["late.csv", "c"]["missing"] == 5                       # short rows; long ones are no evidence


def test_same_table_in_many_files(spark, tmp_path):
    for k in range(4):
        put(tmp_path, f"t/part{k}.csv", f"id,v\n{k},{10 ** k}\n")
    put(tmp_path, "t/other.csv", "id;v\n9;8\n")
    rows = [r for r in location.profile_location(spark, f"file:{tmp_path}", by="folder").collect() if r["name"] == "v"]
    assert sorted((r["delimiter"], r["rows"], r["detected_type"]) for r in rows) == [(",", 4, "int32"), (";", 1, "int32")]
    with pytest.raises(ValueError):
        location.profile_location(spark, str(tmp_path), by="host")


def test_files_that_cannot_be_read_are_rows(spark, tmp_path):
    path = put(tmp_path, "gone.csv", "a,b\n1,2\n")
    files = spark.createDataFrame([(f"file:{path}",), (f"file:{tmp_path}/missing.csv",)], "path string")
    found = {os.path.basename(r["path"]): r for r in dialects.first_records(files).collect()}
    assert bytes(found["gone.csv"]["record"]) == b"a,b" and found["gone.csv"]["error"] is None
    assert found["missing.csv"]["record"] is None and "missing" in found["missing.csv"]["error"]


def test_records_cross_blocks(spark, tmp_path, small_blocks):
    rows = [[str(i), "".join(RNG.choice(['"', ",", "\n", "x", " y", "é", ""]) for _ in range(RNG.randint(0, 60))), "end"] for i in range(80)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["id", "text", "last"], *rows])
    put(tmp_path, "a.csv", out.getvalue())
    put(tmp_path, "b.csv", "id,text,last\n" + "".join(f"{i},plain {i},end\n" for i in range(50)))
    files = spark.createDataFrame([(f"file:{tmp_path}/{n}.csv",) for n in "ab"], "path string")
    lines = dialects.raw_lines(spark, [str(tmp_path)])
    assert lines.select("block").distinct().count() > 20
    facts = dialects.line_facts(lines)
    found = dialects.dialects(lines, dialects.first_records(files), facts)
    assert {(r["delimiter"], r["quoted"]) for r in found.collect() if r["path"].endswith("a.csv")} == {(",", True)}
    got = dialects.file_cells(lines, facts, found).collect()
    expected = [r for r in rows] + [[str(i), f"plain {i}", "end"] for i in range(50)]
    assert sorted(r["cells"] for r in got) == sorted(expected) and {r["row_kind"] for r in got} == {"ok"}


@pytest.mark.parametrize("record, quoted, expected", [
    ('a,b,,', True, ["a", "b", "", ""]), ('"a,b",c', True, ["a,b", "c"]), ('"a ""q"", b",""', True, ['a "q", b', ""]),
    ('5" x,b', False, ['5" x', "b"]), ('"', True, ['"']), ("", True, [""]), ('"x\ny",z', True, ["x\ny", "z"])])
def test_cells(spark, record, quoted, expected):
    d = spark.createDataFrame([(record, ",", quoted)], "r string, d string, q boolean")
    assert d.select(dialects.cells(F.col("r"), F.col("d"), F.col("q"))).first()[0] == expected


def test_json_files_of_one_folder(spark, tmp_path):
    (tmp_path / "t").mkdir()
    put(tmp_path, "t/a.json", '{"id":1,"v":"x"}\n{"id":2}\n')
    put(tmp_path, "t/b.json", '{"id":1.5,"w":null,"v":"long"}\n{"late":{"x":1},"id":3}\n')
    put(tmp_path, "t/bad.json", '[1]\n{"id":"no"}\n')
    by = lambda by: [(r["name"], r["pos"], r["detected_type"], r["observed_max_length"]) for r in location.profile_location(
        spark, f"file:{tmp_path}", by=by).orderBy("unit", "pos").collect()]
    assert by("folder") == [("id", 0, "decimal(2,1)", None), ("v", 1, "str", 4), ("w", 2, "str", None), ("late", 3, "dict", None)]
    assert [r[:3] for r in by("file")] == [("id", 0, "int32"), ("v", 1, "str"), ("id", 0, "decimal(2,1)"), ("w", 1, "str"), ("v", 2, "str"),
                                           ("late", 3, "dict")]
