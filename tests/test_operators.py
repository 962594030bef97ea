import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import html, text, urls
from strandline.operators import jsonops, load, preview, setops, validate
from strandline.operators.validate import Assertion
from strandline.sources import detect


def one(spark, fn, *values, schema=None):
    df = spark.createDataFrame([values], schema or ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(fn(*[F.col(c) for c in df.columns]).alias("r")).first()["r"]


@pytest.mark.parametrize("raw, clean", [
    ("AccountKey=abc123;x", "AccountKey=[redacted];x"), ("Authorization: bearer abc.def", "Authorization: Bearer [redacted]"),
    ("x eyJhbGciOiJI.eyJzdWIiOiIx.sig y", "x [redacted] y"), ("https://h/p?sv=1&sig=zzz&x=1", "https://h/p?sv=1&sig=[redacted]&x=1"),
    (None, ""), ("nothing", "nothing"),
])
def test_redact(spark, raw, clean):
    assert one(spark, text.redact, raw) == clean


def test_redact_url_and_mask(spark):
    assert one(spark, text.redact_url, "https://h/p?a=1&SIG=zz") == "https://h/p?[redacted]"
    assert one(spark, text.redact_url, "https://h/p?a=1") == "https://h/p?a=1"
    assert one(spark, text.mask_tail, "secretabcd") == "****abcd"
    assert one(spark, text.mask_tail, "abc") == "***" and one(spark, text.mask_tail, None) == ""


def test_full_redaction(spark):
    fn = lambda c: text.redact_full(c, ["prodhost", "prod", "test"], ["open.blob.core.windows.net"])
    raw = "PRODHOST prod test open.blob.core.windows.net acct.blob.core.windows.net 10.0.0.7 /home/me/x Password='a''b' UID=me"
    assert one(spark, fn, raw) == ("[redacted] [redacted] test open.blob.core.windows.net [storage-endpoint] [ip] [path] "
                                   "Password='[redacted]' UID=[redacted]")


def test_findings(spark):
    raw = ("SECRET = '<SAS_token>'\nPWD=hunter22;\nsig=abcdefghijkl\nPASSWORD = 'real one'\nSECRET = 'x''y'\n"
           "Password=   \n" + "A" * 70)
    df = spark.createDataFrame([(1, raw)], "k int, t string")
    got = sorted((r["line"], r["kind"], r["excerpt"]) for r in text.secret_findings(df, "k", "t").collect())
    assert got == [(2, "connection_password", "PWD=<12 chars>"), (3, "sas_signature", "sig=<16 chars>"),
                   (4, "inline_password", "PASSWORD =<21 chars>"), (5, "inline_secret", "SECRET =<15 chars>"),
                   (7, "storage_account_key", "A" * 12 + "=<70 chars>")]


@pytest.mark.parametrize("value, flag", [
    ("plain name", False), ("see https://x", True), ("www.x.com", True), ("a%253Db password%253Dx", True), ("100% +5", False),
    ("ghp_abcdefghijklmnop", True), ("Server=h;Db=x", True), ("eyJab.cd.ef", True),
])
def test_sensitive(spark, value, flag):
    assert one(spark, text.sensitive_flag, value) is flag


def test_names(spark):
    assert one(spark, text.clean_name, "1 a-b") == "col_1_a_b" and one(spark, text.clean_name, "") == "column_1"
    assert one(spark, text.escape_name, "a`b\nGO\n\u2028c") == "a``b GO c"
    assert one(spark, text.table_name, "/x/.hidden/my file.v1.csv") == "my_file_v1"
    assert one(spark, text.safe_file_name, "https://h/a%20b..%2Fc d.csv") == "c_d.csv"
    assert one(spark, text.safe_file_name, "..") == "dataset"
    assert one(spark, text.data_extension, "https://h/x.CSV?y=1") == ".csv" and one(spark, text.data_extension, "https://h/?a=.csv") is None


@pytest.mark.parametrize("url, kind", [
    ("", "local"), ("C:\\data\\x.csv", "local"), ("/data/x.csv", "local"), ("s3://b/k", "s3"), ("s3://b/", "other"),
    ("https://a.blob.core.windows.net/c/x", "azure"), ("https://a.blob.core.windows.net.evil.com/c/x", "other"),
    ("https://u@a.blob.core.windows.net/c", "other"), ("wasbs://c@a.blob.core.windows.net/x", "azure"),
    ("abs://c@a.dfs.core.windows.net/x", "other"), ("abfss://w@onelake.dfs.fabric.microsoft.com/i/Files/x", "onelake"),
    ("gs://b/k", "other"), ("azure://c/p", "azure"), ("https://eu-onelake.dfs.fabric.microsoft.com/w/i", "onelake"),
])
def test_url_kind(spark, url, kind):
    assert one(spark, urls.url_kind, url) == kind


def test_url_parts(spark):
    fn = lambda u: urls.url_parts(u, F.lit("d/f.csv"))
    assert tuple(one(spark, fn, "abs://c@a.blob.core.windows.net/p/q.csv")) == ("a.blob.core.windows.net", "c", "p/q.csv")
    assert tuple(one(spark, fn, "https://a.dfs.core.windows.net/c/")) == ("a.dfs.core.windows.net", "c", "f.csv")
    assert tuple(one(spark, fn, "/local/x.csv"))[1:] == ("<container>", "<path>/f.csv")


@pytest.mark.parametrize("href, absolute", [
    ("/a", "https://h.org/a"), ("b/c", "https://h.org/x/b/c"), ("../z", "https://h.org/z"), ("?q=1", "https://h.org/x/y?q=1"),
    ("#top", "https://h.org/x/y?k=1"), ("//o.org/p", "https://o.org/p"), ("mailto:a@b", "mailto:a@b"), ("https://o/p#f", "https://o/p"),
    ("./a/./b/..", "https://h.org/x/a/"), ("a?u=1/../2", "https://h.org/x/a?u=1/../2"),
])
def test_links(spark, href, absolute):
    df = spark.createDataFrame([(1, "https://h.org/x/y?k=1#f", f"<p><A class=x HREF='{href}'> <b>L</b>\n 1 &amp; 2</a>")],
                               "page_id int, url string, html string")
    assert tuple(html.page_links(df).first()) == (1, 0, absolute, "L 1 & 2")


def test_candidates_and_page_kind(spark):
    page = ("<title>Data &amp; more | Site</title><code>https://a1b.blob.core.windows.net/c/x.parquet. "
            "abfss://c@acct.dfs.core.windows.net/*.csv https://example.org/no https://example.org/d.csv</code>"
            "<pre>https://a1b.blob.core.windows.net/c/x.parquet</pre>")
    df = spark.createDataFrame([(1, "https://s/p", page), (2, "https://s/x.csv", ""), (3, "https://s/c", "<a href='/1'>1</a>"),
                                (4, "https://s/e", "nothing")], "page_id int, url string, html string")
    got = sorted((r["url"], r["kind"], r["extension"], r["wildcard"]) for r in html.storage_candidates(df).collect())
    assert got == [("abfss://c@acct.dfs.core.windows.net/*.csv", "virtualise", ".csv", True),
                   ("https://a1b.blob.core.windows.net/c/x.parquet", "download", ".parquet", False),
                   ("https://example.org/d.csv", "download", ".csv", False)]
    assert {r["page_id"]: r["kind"] for r in html.page_kind(df).collect()} == {1: "dataset", 2: "data", 3: "catalog", 4: "rejected"}
    assert html.page_titles(df).filter("page_id = 1").first()["title"] == "Data & more"


@pytest.mark.parametrize("doc, ok", [
    ('{"a":1}', 1), ("[1]", 1), ('{"a":1} x', 0), ('{"a":1}]', 0), ('{"a":1}}', 0), ('{"a":1},{"b":2}', 0), ('{"a":1}{"b":2}', 0),
    ("12", 0), ("", 0), (None, 0), ('{"a":[1,2],"b":"]"}', 1), ('[1]]', 0), ('{"a":1},"b":[2]', 0), (' {"a" : [ ] } ', 1),
])
def test_json_validity(spark, doc, ok):
    assert one(spark, jsonops.is_json, doc) == ok


def test_json_edits_and_paths(spark):
    assert one(spark, lambda c: jsonops.json_set(c, "a", F.lit(5)), '{"a":1,"b":"x"}') == '{"b":"x","a":5}'
    assert one(spark, lambda c: jsonops.json_path_exists(c, "n"), '{"n":null}') is True
    assert jsonops.json_path("a b\"c") == '$."a b\\"c"' and jsonops.json_path("a_1") == "$.a_1"
    assert one(spark, lambda c: jsonops.json_value(c, jsonops.spark_path("a b")), '{"a b":"v"}') == "v"
    assert one(spark, lambda c: jsonops.json_query(c, "$.a"), '{"a":[1,{"b":2}]}') == '[1,{"b":2}]'


def test_large_group_is_split_without_loss(spark):
    hot = spark.range(3000).select(F.lit("hot").alias("g"), F.concat(F.lit('{"i":'), (F.col("id") % 7).cast("string"), F.lit("}")).alias("l"))
    cold = spark.createDataFrame([("cold", '{"i":1}'), ("cold", " "), ("cold", '{"i":2}\r')], "g string, l string")
    parts = jsonops.lines_to_array(hot.unionByName(cold), "g", "l", max_bytes=4096).collect()
    assert max(len(p["document"]) for p in parts) < 3 * 4096
    import json
    items = [(p["g"], x["i"]) for p in parts for x in json.loads(p["document"])]
    assert sum(g == "hot" for g, _ in items) == 3000 == sum(p["n_lines"] for p in parts if p["g"] == "hot")
    assert sorted(i for g, i in items if g == "cold") == [1, 2]
    assert sum(1 for g, i in items if g == "hot" and i == 3) == sum(1 for k in range(3000) if k % 7 == 3)


def test_root_export_is_json(spark):
    import json
    df = spark.createDataFrame([(2, None), (1, "x")], "id int, v string")
    frags = jsonops.rows_to_json_root(df, "rows", "id").orderBy("seq", "key").collect()
    assert json.loads("".join(f["fragment"] for f in frags)) == {"rows": [{"id": 1, "v": "x"}, {"id": 2}]}


def test_typed_projection_is_refused(spark):
    df = spark.createDataFrame([('{"a":1}',)], "doc string")
    assert jsonops.shred_profiled(df, "doc", [{"name": "a", "spark_type": "INT", "safe": True}]).first()["a"] == 1
    with pytest.raises(ValueError):
        jsonops.shred_profiled(df, "doc", [{"name": "a", "spark_type": "INT", "safe": False}])


def test_exact_rows(spark):
    exp = spark.range(1, 101).select("id", F.format_string("fixture_%03d", "id").alias("label"), (F.col("id") * 7).alias("amount"))
    assert tuple(validate.exact_rows_diff(exp.repartition(3), exp).first()) == (100, 100, 0, 0, True)
    bad = exp.withColumn("amount", F.when(F.col("id") == 5, 0).otherwise(F.col("amount"))).union(exp.limit(1))
    assert tuple(validate.exact_rows_diff(bad, exp).first()) == (100, 101, 1, 2, False)
    assert validate.table_checksum(exp).first() == validate.table_checksum(exp.repartition(7)).first()
    split = lambda *r: validate.table_checksum(spark.createDataFrame([r], "a string, b string")).first()
    assert split("a|vb", "c") != split("a", "b|vc") and split(None, "") != split("", None)


def test_assertions_on_an_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    got = {r["kind"]: (r["actual"], r["ok"], r["evaluated"]) for r in validate.check(df, [
        Assertion("row_count", 0), Assertion("values_not_all_null"), Assertion("value_equals", "x", "b")]).collect()}
    assert got == {"row_count": ("0", True, True), "values_not_all_null": (None, True, False), "value_equals": (None, False, True)}


def test_stage_and_reject(spark, tmp_path):
    schema = T.StructType([T.StructField("i", T.IntegerType(), False), T.StructField("d", T.DecimalType(5, 2)), T.StructField("t", T.DateType())])
    df = spark.createDataFrame([("1", "1.50", "2024-02-29"), ("x", "1", "2024-01-01"), ("NA", "1", None), ("2", "1.234", "2023-02-29"),
                                ("3", "NULL", "")], "i string, d string, t string")
    good, bad = load.stage_then_type(df, schema)
    assert [r["i"] for r in good.orderBy("i").collect()] == [1, 3]
    assert sorted(tuple(r["bad_columns"]) for r in bad.collect()) == [("d", "t"), ("i",), ("i",)]
    table = "rejects_" + tmp_path.name.replace("-", "_")
    with pytest.raises(load.LoadRejected):
        load.load(df, table, schema, quarantine=str(tmp_path / "bin"))
    assert not spark.catalog.tableExists(table) and spark.read.json(str(tmp_path / "bin")).count() == 3
    assert load.load(df, table, schema, max_errors=3).first()[0] == 2
    with pytest.raises(load.LoadRejected):
        load.load(df, table, schema, max_errors=3, rerun_truncate=True)
    spark.sql(f"DROP TABLE {table}")


def test_distinct_first_and_definitions(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("B", 1, None), ("b", 0, "z")], "k string, o int, v string")
    assert sorted((r["k"], r["v"] or "") for r in setops.distinct_first(df, "k", "o").collect()) == [("B", ""), ("a", "x"), ("b", "z")]
    assert sorted(r["v"] for r in setops.first_definition(df, "k", "o").collect()) == ["x", "z"]


def test_collations(spark):
    df = spark.createDataFrame([("résumé", "RESUME"), ("Straße", "straße"), ("i", "I")], "l string, r string")
    eq = lambda n: [r[0] for r in df.select(preview.equal_under(F.col("l"), F.col("r"), n)).collect()]
    assert eq("ci_ai") == [True, True, True] and eq("ci_as") == [False, True, True]
    assert eq("binary") == [False, False, False] and eq("turkish_ci")[2] is False


def test_overrides_are_checked(spark):
    df = spark.createDataFrame([(",",)], "delimiter string")
    r = detect.with_overrides(df, {"fieldDelimiter": "|"}, {"fieldDelimiter": "delimiter"}).first()
    assert (r["delimiter"], r["delimiter_source"]) == ("|", "override")
    for bad in ({"fieldDelimiter": "||"}, {"codepage": "70000"}, {"firstRow": "0"}, {"other": "x"}):
        with pytest.raises(ValueError):
            detect.with_overrides(df, bad, {})


def test_normalise(spark):
    v = lambda value, t: one(spark, lambda c: validate.normalise(c, t, 32, 512), value, schema=T.StructType([T.StructField("c0", t)]))
    assert v(bytearray(b"ABCD"), T.BinaryType()) == "0x41424344"
    assert v(bytearray(b"A" * 40), T.BinaryType()).startswith("0x" + "41" * 32 + "... [40 bytes, sha256 ")
    assert v(float("inf"), T.DoubleType()) == "inf" and v(float("nan"), T.DoubleType()) == "nan"


def test_stream_equals_batch(spark, tmp_path, rows):
    from strandline.operators import infer
    from strandline.streaming import incremental
    src = str(tmp_path / "in")
    df = spark.range(400).select(F.col("id").cast("string").alias("a"), F.when(F.col("id") > 350, "x").otherwise("1.5").alias("b"))
    df.repartition(5).write.option("header", True).csv(src)
    store, ck = str(tmp_path / "store"), str(tmp_path / "ck")
    for _ in range(2):          # the second start finds nothing new
        incremental.profile_stream(spark, src, ["a", "b"], store, ck, files_per_trigger=1).awaitTermination()
    cols = ["pos", "name", "detected_type", "observed_max_length", "rows"]
    assert sorted(rows(incremental.stored_profile(spark, store).select(cols))) == sorted(rows(infer.infer_columns(df).select(cols)))


def test_stored_profile_after_many_batches_and_rewritten_files(spark, tmp_path, rows):
    """Every step equals a scan of the files; the number of folders stays bounded; changed files replace their evidence."""
    from strandline.operators import infer
    from strandline.streaming import incremental
    src, store, ck = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "ck")
    src.mkdir()
    names = ["path", "b"]                       # a column may be called like anything
    cols = ["pos", "name", "detected_type", "observed_max_length", "missing", "rows"]

    def put(name, lines):
        (src / name).write_text("path,b\n" + "".join(f"{x},{y}\n" for x, y in lines))

    def same():
        whole = spark.read.schema("path string, b string").option("header", True).csv(str(src))
        assert sorted(rows(incremental.stored_profile(spark, store).select(cols))) == sorted(rows(infer.infer_columns(whole).select(cols)))

    for i in range(14):
        put(f"f{i:02d}.csv", [(k, "x" * (i + 1)) for k in range(5)])
    incremental.profile_stream(spark, str(src), names, store, ck, files_per_trigger=1, compact_after=3).awaitTermination()
    same()
    assert len(incremental.steps(spark, store)) <= 8 and incremental.steps(spark, store)[-1][0] == 14
    assert incremental.refresh(spark, str(src), names, store) == 0
    put("f03.csv", [("1.5", "y" * 40), ("NA", "")])             # rewritten
    put("f04.csv", [])                                          # rewritten, no rows left
    put("new [1] a.csv", [("7", "z")])                          # added beside the stream
    (src / "f05.csv").unlink()
    assert incremental.refresh(spark, str(src), names, store, compact_after=100) == 4
    same()
    assert incremental.refresh(spark, str(src), names, store, compact_after=100) == 0
    newest = incremental.steps(spark, store)[-1][0]
    before = {r["name"]: r["rows"] for r in incremental.stored_profile(spark, store, as_of=14).collect()}
    assert newest > 14 and before["b"] == 70
    with pytest.raises(ValueError):
        incremental.stored_profile(spark, store, as_of=1)
    incremental.compact(spark, store, 1)
    same()
    assert incremental.refresh(spark, str(src), names, store) == 0
    with pytest.raises(FileNotFoundError):
        incremental.stored_profile(spark, str(tmp_path / "nothing"))


def test_a_statement_that_must_fail_with_a_number(spark):
    from strandline.operators.validate import Assertion, check
    wanted = [Assertion("error_number", 105), Assertion("no_error")]
    ok = lambda **kw: [(r["actual"], r["ok"]) for r in check(None, wanted, spark=spark, **kw).collect()]
    assert ok(error_number=105) == [("105", True), ("105", False)]
    assert ok(error_number=7) == [("7", False), ("7", False)]
    assert ok() == [(None, False), (None, True)]
    assert ok(error="gone") == [(None, False), ("gone", False)]


def test_links_only_from_real_anchors(spark):
    from strandline.functions import html
    page = ('<a data-href="/no" href="/yes">a</a><!-- <a href="/old">b</a> --><script>"<a href=\'/js\'>c</a>"</script>'
            "<a data-href=/none>d</a>")
    df = spark.createDataFrame([(1, "https://h.example/", page)], "page_id long, url string, html string")
    assert [r["url"] for r in html.page_links(df).collect()] == ["https://h.example/yes"]


def test_exact_json_numbers(spark):
    from strandline.operators import jsonops
    docs = [(1, None), (2, '{"a":1.2.3}'), (3, '{"a":1e-7,"b":"1.50","c":[1.2300,"x"],"d":null}'), (4, '{"a":1.5} 2'),
            (5, '{"\\u0001k":"\\u00011","z":1.0}'), (6, "[1.20]")]
    df = spark.createDataFrame(docs, "id long, doc string")
    got = {(r["id"], r["key"]): (r["value"], r["type"]) for r in jsonops.json_entries(df, "doc", ["id"]).collect()}
    assert got == {(3, "a"): ("1e-7", 2), (3, "b"): ("1.50", 1),
                   (3, "c"): ('[1.2300,"x"]', 4), (3, "d"): (None, 0),
                   (5, "\u0001k"): ("\u00011", 1), (5, "z"): ("1.0", 2), (6, "0"): ("1.20", 2)}


def test_whole_documents_only(spark):
    from strandline.functions import jsontext
    end = jsontext.END
    cases = {'{"a":1}': True, "1": True, "null": True, ' [1, {"b":"]"}] ': True, "1,2": False, "1]": False, "1],[2": False, "": False, "1}": False,
             f'"{end}"': True, f'1,"{end}"': False, f'1,"{end}"],[2': False, f'{{"a":"{end}"}}': True, "1.2.3": False, '{"a":1.50}': True}
    d = spark.createDataFrame([(k,) for k in cases], "doc string")
    for parse in (jsontext.parse_document, jsontext.parse_exact):
        assert {r[0]: r[1] for r in d.select("doc", parse(F.col("doc")).isNotNull()).collect()} == cases


def test_narrow_rows_are_dealt_out(spark, tmp_path):
    from strandline import workspace
    from strandline.catalog import QUERIES
    spark.range(4000).selectExpr("id AS o_orderkey", "id AS o_custkey", "CAST(id AS DOUBLE) / 4 AS o_totalprice").coalesce(1) \
        .write.parquet(f"{tmp_path}/orders.parquet")
    d = spark.read.parquet(f"{tmp_path}/orders.parquet")
    assert workspace.deal_out(d).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert workspace.deal_out(d, 4096).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    q = QUERIES["js_exact_numbers"](spark, str(tmp_path))
    assert "RoundRobinPartitioning" in q._jdf.queryExecution().executedPlan().toString()
    assert q.count() == 8 * 4000
