import json
import os

import pytest
from pyspark.sql import functions as F

from strandline.plans import lake
from strandline.sources import columnar, delimited, delta, detect, iceberg, inventory, jsondocs


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())
    return str(path)


def log_line(**kw):
    return json.dumps(kw)


@pytest.fixture
def delta_folder(spark, tmp_path):
    root = str(tmp_path / "sales")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).select("id", F.lit("x").alias("v")).coalesce(1).write.parquet(f"{root}/p={i}")
    files = sorted(str(p.relative_to(root)) for p in (tmp_path / "sales").rglob("*.parquet"))
    schema = {"type": "struct", "fields": [
        {"name": "id", "type": "long", "nullable": False, "metadata": {}},
        {"name": "v", "type": "string", "nullable": True, "metadata": {}},
        {"name": "p", "type": "integer", "nullable": True, "metadata": {}}]}
    add = lambda f: log_line(add={"path": f, "size": 1, "partitionValues": {"p": f[2]}, "stats": '{"numRecords":10}'})
    meta = log_line(metaData={"id": "1", "schemaString": json.dumps(schema), "partitionColumns": ["p"], "configuration": {}})
    put(f"{root}/_delta_log/{0:020d}.json", "\n".join([meta, *map(add, files)]))
    put(f"{root}/_delta_log/{1:020d}.json", log_line(remove={"path": files[0]}) + "\n\n")
    put(f"{root}/_delta_log/{2:020d}.json", log_line(remove={"path": files[1]}) + "\n" + add(files[1]))
    put(f"{root}/_delta_log/extra.json", "not a commit")
    return root


def test_delta_replay(spark, delta_folder):
    a = delta.delta_actions(spark, delta_folder)
    assert delta.delta_version(a).first()[0] == 2
    assert {r["path"][2] for r in delta.delta_active_files(a).collect()} == {"1", "2"}
    assert tuple(delta.delta_row_count(a).first()) == (2, 20)
    assert delta.delta_row_count(a, F.lit(True)).first()["row_count"] is None
    rows = delta.delta_read(spark, delta_folder)
    assert rows.columns == ["id", "v", "p"] and rows.count() == 20
    assert {r[0] for r in rows.select("p").distinct().collect()} == {1, 2}
    assert delta.delta_version(delta.delta_actions(spark, delta_folder, max_commits=1)).first()[0] == 2
    found = delta.delta_or_parquet(spark, delta_folder)
    assert (found["schema_inference"], found["columns"][0]) == (
        "delta_log", {"pos": 0, "name": "id", "type": "int64", "nullable": False})


def test_delta_counts_become_unknown(spark, delta_folder):
    put(f"{delta_folder}/_delta_log/{3:020d}.json", "{broken")
    assert delta.delta_row_count(delta.delta_actions(spark, delta_folder)).first()["row_count"] is None


def test_pretty_printed_log_falls_back_to_a_data_file(spark, tmp_path):
    root = str(tmp_path / "t")
    spark.range(3).coalesce(1).write.parquet(root + "/b")
    put(f"{root}/_delta_log/{0:020d}.json", json.dumps({"metaData": {"schemaString": "x"}}, indent=2))
    found = delta.delta_or_parquet(spark, root)
    assert (found["schema_inference"], found["columns"][0]["type"]) == ("underlying_parquet_file", "int64")


def test_checkpoint_files_are_live(spark, delta_folder, tmp_path):
    files = sorted(str(p.relative_to(delta_folder)) for p in (tmp_path / "sales").rglob("*.parquet"))
    adds = spark.createDataFrame([((files[2], {"p": "2"}),)], "add struct<path: string, partitionValues: map<string,string>>")
    adds.coalesce(1).write.parquet(str(tmp_path / "cp"))
    part = next((tmp_path / "cp").glob("*.parquet"))
    put(f"{delta_folder}/_delta_log/{2:020d}.checkpoint.parquet", part.read_bytes())
    keep = {0: 3}      # commits before the checkpoint lose the third file's add
    lines = open(f"{delta_folder}/_delta_log/{0:020d}.json").read().split("\n")
    put(f"{delta_folder}/_delta_log/{0:020d}.json", "\n".join(lines[:keep[0]]))
    assert delta.delta_read(spark, delta_folder).count() == 20


def test_iceberg_choice_and_counts(spark, tmp_path):
    root = str(tmp_path / "ice")
    base = {"format-version": 2, "current-snapshot-id": 2, "current-schema-id": 1, "default-spec-id": 3,
            "schemas": [{"schema-id": 0, "fields": []}, {"schema-id": 1, "fields": [
                {"id": 1, "name": "id", "required": True, "type": "long"},
                {"id": 2, "name": "at", "required": False, "type": "timestamptz"},
                {"id": 3, "name": "tags", "required": False, "type": {"type": "list", "element": "string"}}]}],
            "partition-specs": [{"spec-id": 3, "fields": [{"name": "id_bucket", "transform": "bucket[4]", "source-id": 1}]}]}
    put(f"{root}/metadata/v9.metadata.json", json.dumps({**base, "snapshots": [{"snapshot-id": 2, "summary": {"total-records": "1"}}]}))
    put(f"{root}/metadata/v10.metadata.json", json.dumps({**base, "snapshots": [{"snapshot-id": 2, "summary": {"total-records": "42"}}]}))
    put(f"{root}/metadata/version-hint.text", "9")
    inv = inventory.inventory(spark, root)
    r = iceberg.iceberg_current(spark, inv).first()
    assert (r["version"], r["row_count"]) == (10, 42)
    docs = iceberg.iceberg_docs(spark, iceberg.iceberg_latest(inv))
    assert [tuple(x)[2:] for x in iceberg.iceberg_schema(docs).orderBy("pos").collect()] == [
        ("id", "int64", False), ("at", "timestamp[us, tz=UTC]", True), ("tags", "list", True)]
    assert iceberg.iceberg_partition_spec(docs).first()["name"] == "id_bucket"
    count = lambda d: spark.createDataFrame([(json.dumps(d),)], "doc string").select(
        iceberg.iceberg_row_count(F.col("doc"))).first()[0]
    assert count({"current-snapshot-id": None}) == 0 and count({}) is None


ENCODINGS = [
    ("plain,text\n1,2\n".encode(), "ascii", "1252"), ("é,ß\n".encode(), "utf-8", "65001"),
    (b"\xef\xbb\xbfa,b", "utf-8-sig", "65001"), ("é,b".encode("utf-16"), "utf-16", "1200"),
    (b"\xfe\xff" + "ab".encode("utf-16-be"), "utf-16-be", "1201"), ("abcdef".encode("utf-16-le"), "utf-16-le", "1200"),
    ("abcdef".encode("utf-16-be"), "utf-16-be", "1201"), ("ab".encode("utf-32"), "utf-32", "ACP"),
    ("日本語のテキスト、これは本です。\n".encode("cp932") * 3, "cp932", "932"),
    ("Привет, это русский текст\n".encode("cp1251") * 3, "cp1251", "1251"),
    ("déjà vu, café à la carte, naïve façade\n".encode("cp1252") * 3, "cp1252", "1252"),
]


@pytest.mark.parametrize("raw, encoding, page", ENCODINGS)
def test_encodings(spark, raw, encoding, page):
    df = spark.createDataFrame([(bytearray(raw),)], "head binary")
    r = detect.detect_encoding(df).first()
    assert (r["encoding"], r["codepage"]) == (encoding, page)


def test_cut_character_is_no_error(spark):
    raw = ("a" * 10 + "é").encode()[:-1]
    df = spark.createDataFrame([(bytearray(raw), True), (bytearray(raw), False)], "head binary, cut boolean")
    got = [r[0] for r in df.select(detect.utf8_class(F.col("head"), F.col("cut"))).collect()]
    assert got == ["utf-8", None]


@pytest.mark.parametrize("sample, delimiter, header", [
    ("a,b\n1,2\n3,4\n", ",", ["a", "b"]), ("a;b;c\n1;2,5;3\n", ";", ["a", "b", "c"]), ("1|2\n3|4\n", "|", ["column_1", "column_2"]),
    ('a,"b\nc"\n1,2\n', ",", ["a", "b\nc"]), ("x\ty\n1\t2\n", "\t", ["x", "y"]), ("a,a\n1,2\n", ",", ["column_1", "column_2"]),
])
def test_dialects(spark, sample, delimiter, header):
    df = spark.createDataFrame([(sample, "f.csv")], "sample string, path string")
    r = detect.detect_dialect(df).first()
    assert (r["delimiter"], r["header"]) == (delimiter, header)


def test_header_names(spark):
    df = spark.createDataFrame([(["a", "", "a", "b", "a"],)], "c array<string>")
    assert df.select(detect.normalise_header(F.col("c"))).first()[0] == ["a", "Unnamed: 1", "a.1", "b", "a.2"]


def test_ragged_rows_and_counts(spark, tmp_path):
    p = put(str(tmp_path / "r.csv"), 'a,b,c\n1,2,3\n\n4,5\n6,7,8,9\n1,2,\n"x, y",2,"q"\n')
    d = delimited.Dialect(["a", "b", "c"])
    kept, dropped = delimited.split_ragged(delimited.read_delimited(spark, p, d, ragged=True), d)
    assert [tuple(r)[1:] for r in kept.collect()] == [
        ("1", "2", "3"), ("4", "5", None), ("1", "2", None), ("x, y", "2", "q")]
    assert [r[delimited.RAW] for r in dropped.collect()] == ["6,7,8,9"]
    assert delimited.logical_rows(spark, p, d).first()["row_count"] == 6


def test_quoted_breaks(spark, tmp_path):
    p = put(str(tmp_path / "q.csv"), 'a,b\n1,"x\n\ny"\n\n2,z\n')
    assert delimited.line_stats(delimited.read_lines(spark, p)).first()["quoted_breaks"] is True
    d = delimited.Dialect(["a", "b"], multiline=True)
    assert delimited.read_delimited(spark, p, d).count() == 2
    assert delimited.logical_rows(spark, p, d).first()["row_count"] == 3


@pytest.mark.parametrize("encoding", ["cp932", "utf-16-le", "utf-16", "cp1251", "gbk", "euc-jp"])
def test_reading_other_charsets(spark, tmp_path, encoding):
    word = {"cp1251": "слово", "gbk": "中文"}.get(encoding, "日本語")
    p = put(str(tmp_path / "e.csv"), f"id,name\n1,{word}\n".encode(encoding))
    rows = delimited.read_delimited(spark, p, delimited.Dialect(["id", "name"], encoding=encoding)).collect()
    assert [tuple(r)[1:] for r in rows] == [("1", word)]


def test_ndjson_rules(spark, tmp_path):
    put(str(tmp_path / "j/a.ndjson"), '{"a":1}\n\nbad\n{"a":2}\n')
    put(str(tmp_path / "j/b.json"), '{"a":1}\nbad\n')
    put(str(tmp_path / "j/c.json"), '{"a":1}')
    put(str(tmp_path / "j/d.jsonl"), '{"a":1}\n[1]\n')
    put(str(tmp_path / "j/e.json"), '{"a":1}\n{"a":1} x\n')
    d = jsondocs.ndjson_decision(jsondocs.read_ndjson(spark, str(tmp_path / "j")))
    got = {os.path.basename(r["path"]): (r["is_ndjson"], r["json_format"], r["row_count"], r["warning"]) for r in d.collect()}
    assert got == {"a.ndjson": (True, "ndjson", 2, "Skipped 1 invalid NDJSON line(s)."), "b.json": (False, None, None, None),
                   "c.json": (True, "object", 1, None), "d.jsonl": (False, None, None, None), "e.json": (False, None, None, None)}


def test_json_documents(spark, tmp_path):
    put(str(tmp_path / "d/a.json"), '[\n {"a": 1},\n {"a": 2, "b": [1]}\n]')
    put(str(tmp_path / "d/b.json"), '{\n "a": 3}')
    d = jsondocs.read_json_doc(spark, str(tmp_path / "d"))
    assert sorted(r[0] for r in d.select(F.variant_get("doc", "$.a", "int")).collect()) == [1, 2, 3]
    s = jsondocs.read_json_doc(spark, str(tmp_path / "d"), "a string, b string")
    assert sorted((r["a"], r["b"]) for r in s.collect()) == [("1", None), ("2", "[1]"), ("3", None)]


def test_row_ids_follow_the_file(spark, tmp_path):
    p = put(str(tmp_path / "n.ndjson"), "".join(f'{{"a":{i}}}\n' for i in range(2000)))
    rows = jsondocs.frame_documents(spark, p).orderBy("row_id").select(F.get_json_object("doc", "$.a").cast("int")).collect()
    assert [r[0] for r in rows] == list(range(2000))


def test_footers_and_unreadable_types(spark, tmp_path):
    import numpy as np
    import pyarrow as pa
    import pyarrow.orc as orc
    import pyarrow.parquet as pq
    t = pa.table({"h": pa.array(np.array([1, 2], dtype="float16")), "ts": pa.array([1, 2], pa.timestamp("ns")),
                  "d": pa.array([None, None], pa.decimal128(18, 4)), "u": pa.array([1, 2**64 - 1], pa.uint64()),
                  "l": pa.array([[1], None], pa.list_(pa.int32()))})
    p = str(tmp_path / "c/all.parquet")
    os.makedirs(os.path.dirname(p))
    pq.write_table(t, p, row_group_size=1, compression="zstd")
    put(str(tmp_path / "c/bad.parquet"), b"PAR1 not really")
    f = columnar.parquet_footers(inventory.inventory(spark, str(tmp_path / "c")))
    got = {os.path.basename(r["path"]): r for r in f.collect()}
    good = got["all.parquet"]
    assert (good["num_rows"], good["num_row_groups"], good["compression"], good["error"]) == (2, 2, "ZSTD", None)
    assert [(c["name"], c["type"], c["physical"]) for c in good["columns"]][:4] == [
        ("h", "halffloat", "FIXED_LEN_BYTE_ARRAY"), ("ts", "timestamp[ns]", "INT64"),
        ("d", "decimal128(18, 4)", "FIXED_LEN_BYTE_ARRAY"), ("u", "uint64", "INT64")]
    assert got["bad.parquet"]["error"] and got["bad.parquet"]["num_rows"] is None
    rows, left_out = columnar.read_parquet_tolerant(spark, f.filter("error is null"), [p])
    assert left_out == ["h"] and "u" in rows.columns
    o = str(tmp_path / "o/x.orc")
    os.makedirs(os.path.dirname(o))
    orc.write_table(pa.table({"a": [1, 2, 3]}), o, compression="snappy")
    r = columnar.orc_footers(inventory.inventory(spark, str(tmp_path / "o"))).first()
    assert (r["num_rows"], r["compression"], r["columns"][0]["type"]) == (3, "SNAPPY", "int64")


def test_lake_units_and_profiles(spark, delta_folder, tmp_path):
    root = str(tmp_path)
    put(f"{root}/in/a.csv", "id,name\n1,x\n2,y\n")
    put(f"{root}/in/b.csv", "id,name\n3000000000,zz\n")
    put(f"{root}/other/c.csv", "k;v\n1.5;2\n2.25;3\n")
    put(f"{root}/in/sub/e.ndjson", '{"a":1}\n{"a":2.50}\n')
    put(f"{root}/in/odd.bin", "a|b\n1|2\n")
    put(f"{root}/in/noext", '{"x": 1}')
    units = {os.path.relpath(r["path"].replace("file:", ""), root): r for r in lake.detect_units(spark, root).collect()}
    assert units["sales"]["file_type"] == "delta" and units["sales"]["members"] > 3
    assert (units["in/odd.bin"]["file_type"], units["in/noext"]["file_type"]) == ("csv", "json")
    assert not any(k.startswith("sales/") for k in units)
    all_units = lake.detect_units(spark, root)
    p = {(os.path.basename(r["path"]), r["name"]): r["detected_type"] for r in lake.profile_csvs(spark, all_units).collect()}
    assert p == {("a.csv", "id"): "int32", ("a.csv", "name"): "object", ("b.csv", "id"): "int64", ("b.csv", "name"): "object",
                 ("c.csv", "k"): "decimal(3,2)", ("c.csv", "v"): "int32", ("odd.bin", "a"): "int32", ("odd.bin", "b"): "int32"}
    j = {(os.path.basename(r["path"]), r["name"]): r["detected_type"] for r in lake.profile_json(spark, all_units).collect()}
    assert j == {("e.ndjson", "a"): "decimal(3,2)", ("noext", "x"): "int32"}


def test_missing_root(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        inventory.inventory(spark, str(tmp_path / "nowhere"))


def test_heads_report_errors_as_rows(spark, tmp_path):
    p = put(str(tmp_path / "h/a.txt"), "x" * 100)
    inv = spark.createDataFrame([("file:" + p,), ("file:/nowhere/b.txt",)], "path string")
    got = {os.path.basename(r["path"]): r for r in inventory.heads(inv, 10).collect()}
    assert (bytes(got["a.txt"]["head"]), got["a.txt"]["size"], got["a.txt"]["truncated"]) == (b"x" * 10, 100, True)
    assert got["b.txt"]["error"]


def test_nothing_is_cut_off_by_default(spark, tmp_path):
    deep = str(tmp_path / "lake" / "/".join("abcdefghi"))
    put(f"{deep}/_delta_log/{0:020d}.json", "{}")
    put(f"{deep}/.hidden/x.csv", "a\n")
    put(f"{deep}/part.parquet", "x")
    root = str(tmp_path / "lake")
    files = lambda **o: {r["path"].rsplit("/", 1)[-1] for r in inventory.inventory(spark, root, **o).collect()}
    assert files() == {f"{0:020d}.json", "part.parquet"}
    assert files(hidden=True) == {f"{0:020d}.json", "part.parquet", "x.csv"}
    inv = inventory.inventory(spark, root)
    assert [r["file_type"] for r in inventory.collapse_tables(inv).collect()] == ["delta"]
    many = spark.range(6000).select(F.concat(F.lit("k/"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("path"), F.col("id").alias("size"))
    assert inventory.object_listing(many).count() == inventory.prune(many, "k").count() == 6000
    assert inventory.list_level(many, "k/").count() == 6000
    assert inventory.object_listing(many, 7).count() == inventory.prune(many, "k", max_files=7).count() == 7


def test_long_json_line_is_an_object(spark):
    long = spark.range(1).select(F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), 17 << 20), F.lit('"}')).alias("doc"))
    from strandline.sources import jsondocs
    assert long.select(jsondocs.doc_family(F.col("doc"))).first()[0] == "object"
    assert long.select(jsondocs.doc_family(F.col("doc"), 1000)).first()[0] == "invalid"


def test_delta_plus_signs_windows_and_vectors(spark, tmp_path):
    root = str(tmp_path / "t")
    spark.range(4).coalesce(1).write.parquet(str(tmp_path / "d"))
    data = next((tmp_path / "d").glob("*.parquet")).read_bytes()
    schema = {"type": "struct", "fields": [{"name": "id", "type": "long", "nullable": True, "metadata": {}}]}
    meta = log_line(metaData={"id": "1", "schemaString": json.dumps(schema), "partitionColumns": [], "configuration": {}})
    for v in range(6):
        put(f"{root}/a+b {v}.parquet", data)
        add = log_line(add={"path": f"a+b%20{v}.parquet", "size": 1, "partitionValues": {}, "stats": '{"numRecords":4}'})
        put(f"{root}/_delta_log/{v:020d}.json", add + ("\n" + meta if v == 0 else ""))
    a = delta.delta_actions(spark, root)
    assert tuple(delta.delta_row_count(a).first()) == (6, 24) and delta.delta_read(spark, root).count() == 24
    assert delta.delta_row_count(a, max_commits=3).first()["row_count"] is None
    assert delta.delta_active_files(delta.delta_actions(spark, root, max_commits=3)).count() == 3
    put(f"{root}/_delta_log/{6:020d}.json", log_line(add={"path": "a+b%200.parquet", "size": 1, "partitionValues": {},
        "stats": '{"numRecords":4}', "deletionVector": {"storageType": "u"}}))
    assert delta.delta_row_count(delta.delta_actions(spark, root)).first()["row_count"] is None
    with pytest.raises(NotImplementedError):
        delta.delta_read(spark, root)


def test_wide_parquet_keeps_all_readable_columns(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    p = str(tmp_path / "w.parquet")
    fields = {f"c{i}": pa.array([i]) for i in range(1500)}
    pq.write_table(pa.table(fields | {"t": pa.array([1], pa.time32("s"))}), p)
    f = columnar.parquet_footers(inventory.inventory(spark, p))
    rows, left_out = columnar.read_parquet_tolerant(spark, f, [p])
    assert len(rows.columns) == 1500 and left_out == ["t"]


@pytest.mark.parametrize("text,codec", [
    ("Le café très élégant où l'été a créé une forêt", "cp1252"), ("Größe und Übermaß für die Straße", "cp1252"),
    ("ÉÉ", "cp1252"), ("Привет, это русский текст", "cp1251"), ("これは日本語の文章です。", "cp932"), ("これは日本語の文章です。", "euc-jp"),
    ("这是一个中文句子，用来测试编码。", "gbk"), ("這是一個中文句子，用來測試編碼。", "big5")])
def test_legacy_charset(spark, text, codec):
    df = spark.createDataFrame([(bytearray(text.encode(codec)),)], "head binary")
    assert df.select(detect.legacy_charset(F.col("head")).alias("g")).first()["g"]["encoding"] == codec


def test_files_find_their_outermost_table_folder(spark):
    """Nested folders, folders at several depths, a file named like a folder, prefixes that end inside a name."""
    paths = (["a/t/_delta_log/0.json", "a/t/x.parquet", "a/t/sub/metadata/v1.metadata.json", "a/t/sub/y.parquet", "a/t2/x.parquet",
              "a/t.csv", "b/c/d/ice/metadata/v1.metadata.json", "b/c/d/ice/data/z.parquet", "b/c/d/ice2", "a/both/_delta_log/1.json",
              "a/both/metadata/v1.metadata.json", "b/c/d/x/ice", "loose"] + [f"a/t/p={i % 3}/{i}.parquet" for i in range(300)])
    inv = spark.createDataFrame([(p, 1, None) for p in paths], "path string, size long, mtime timestamp")
    roots = inventory.table_roots(inv)
    assert {tuple(r) for r in roots.collect()} == {("a/t", "delta"), ("a/t/sub", "iceberg"), ("b/c/d/ice", "iceberg"), ("a/both", "delta")}
    owned = inventory.assign_roots(inv, roots)
    tops = {"a/t": "delta", "b/c/d/ice": "iceberg", "a/both": "delta"}
    for r in owned.collect():
        expected = next(((t, k) for t, k in tops.items() if r["path"].startswith(t + "/")), (None, None))
        assert (r["root"], r["kind"]) == expected, r["path"]
    assert owned.count() == len(paths)
    plan = owned._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    units = {r["path"]: (r["file_type"], r["members"]) for r in inventory.collapse_tables(inv).collect()}
    assert units["a/t"] == ("delta", 304) and units["a/t.csv"] == ("csv", 1) and units["loose"] == (None, 1) and "a/t/sub" not in units
    none = inventory.assign_roots(inv.filter("path = 'loose'"), inventory.table_roots(inv.filter("path = 'loose'")))
    assert [tuple(r) for r in none.collect()] == [("loose", 1, None, None, None)]


def test_blobs_of_large_files_come_in_parts(spark, tmp_path):
    import gzip
    text = "é€😀\n" * 500
    (tmp_path / "large.txt").write_text("﻿" + text, encoding="utf-8")
    (tmp_path / "small.txt").write_text("x\r\ny")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "packed.txt.gz").write_bytes(gzip.compress(b"abc\n"))
    got = {}
    for r in jsondocs.read_blob(spark, str(tmp_path), size=64).orderBy("path", "part").collect():
        got.setdefault(os.path.basename(r["path"]), []).append(r["content"])
    assert {k: "".join(v) for k, v in got.items()} == {"large.txt": text, "small.txt": "x\r\ny", "packed.txt.gz": "abc\n"}      # listings pass over empty files
    assert len(got["large.txt"]) > 50 and max(len(p.encode()) for p in got["large.txt"]) <= 67


def test_whole_files_do_not_depend_on_the_size_of_their_parts(spark, tmp_path):
    """One law for files of any size, plain and compressed, in any encoding, also where a cut meets broken bytes."""
    import bz2
    import gzip
    import zlib
    text = "aé€😀\r\n" * 50
    broken = b"ok\xc3A\xe2\x82B\xf0\x9f\x98\x80\x80\x80\x80\x80\xff" * 40
    files = {"utf-8": {"a.txt": b"\xef\xbb\xbf" + text.encode(), "b.txt": broken, "c.txt.gz": gzip.compress(text.encode()),
                       "d.txt.bz2": bz2.compress(text.encode()), "e.deflate": zlib.compress(text.encode())},
             "utf-16": {"a.txt": text.encode("utf-16"), "b.txt": b"\xfe\xff" + text.encode("utf-16-be"),
                        "c.txt.gz": gzip.compress(text.encode("utf-16")), "d.txt": text.encode("utf-16-le")},
             "shift_jis": {"a.txt": ("表ソ①\n" * 40).encode("cp932")}, "cp1252": {"a.txt": ("é€" * 99).encode("cp1252")}}
    want = {"utf-8": dict.fromkeys("acde", text) | {"b": broken.decode("utf-8", "replace")}, "utf-16": dict.fromkeys("abcd", text),
            "shift_jis": {"a": "表ソ①\n" * 40}, "cp1252": {"a": "é€" * 99}}
    for encoding, found in files.items():
        folder = tmp_path / encoding
        folder.mkdir()
        for name, data in found.items():
            (folder / name).write_bytes(data)
        for size in (32, 1 << 20):
            got, most, chars = {}, 0, {}
            for r in jsondocs.read_blob(spark, str(folder), encoding, size).selectExpr("*", "length(content) n").orderBy("path", "part").collect():
                key = os.path.basename(r["path"])[0]
                got[key] = got.get(key, "") + r["content"]
                chars[key] = chars.get(key, 0) + r["n"]
                most = max(most, r["n"])
            assert got == want[encoding], (encoding, size)
            assert chars == {k: len(v) for k, v in got.items()} and most <= size + 3
    for kind in ("lz4", "snappy"):                  # only the text reader opens these
        spark.createDataFrame([(text.replace("\r\n", "|"),)], "value string").coalesce(1).write.text(str(tmp_path / kind), compression=kind)
        rows = jsondocs.read_blob(spark, str(tmp_path / kind), size=32).orderBy("part").collect()
        assert "".join(r["content"] for r in rows) == text.replace("\r\n", "|") + "\n" and [r["part"] for r in rows] == list(range(len(rows)))
        assert len(rows) == -(-(len(text) - 50 + 1) // 32)
