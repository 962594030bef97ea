import pytest
from pyspark.sql import functions as F

from strandline.functions import tokens as tk
from strandline.functions import types as ty
from strandline.operators import infer, jsonprofile


def infer_one(spark, values, **kw):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return infer.infer_columns(df, **kw).first()


@pytest.mark.parametrize("values, expected", [
    (["2147483647"], "int32"), (["-2147483648"], "int32"), (["2147483648"], "int64"), (["-2147483649"], "int64"),
    (["9223372036854775807"], "int64"), (["9223372036854775808"], "decimal(19,0)"),
    (["12345678901234.5678"], "decimal(18,4)"), (["9" * 39], "decimal(39,0)"),
    (["1.2300e2"], "object"), (["1e-4"], "object"), ([" 7 ", "+5"], "int32"),
    (["0000000000000000000000000012"], "int32"), (["True", "false"], "bool"), (["True", "1"], "object"),
    (["NA", "", None, "nan"], "object"), (["١٢"], "object"), (["1" * 257], "object"), (["1", "2.50"], "decimal(3,2)"),
    ([".5", "-10."], "decimal(3,1)"), (["\u00a012\u2003"], "int32"), (["\x0012"], "object"), ([" NA"], "object"),
])
def test_column_types(spark, values, expected):
    assert infer_one(spark, values)["detected_type"] == expected


def test_late_text_wins_and_sets_the_width(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("v")).union(
        spark.createDataFrame([("x" * 5000,)], "v string"))
    r = infer.infer_columns(df).first()
    assert (r["detected_type"], r["rows"], r["observed_max_length"], r["target_type"]) == (
        "object", 1001, 5000, "NVARCHAR(MAX)")


def test_width_headroom_and_surrogates(spark):
    assert infer_one(spark, ["a" * 240])["max_length"] == 300
    assert infer_one(spark, ["a😀"])["observed_max_length"] == 3


def test_sampled_evidence_is_never_narrower(spark):
    r = infer_one(spark, ["1", "2"], full=False)
    assert (r["detected_type"], r["target_type"], r["schema_inference"]) == ("int32", "NVARCHAR(MAX)", "sampled")


def test_profile_does_not_depend_on_partitioning(spark, rows):
    df = spark.range(500).select((F.col("id") * 7 % 13).cast("string").alias("a"),
                                 F.when(F.col("id") % 50 == 0, "NA").otherwise(F.concat(F.lit("t"), "id")).alias("b"))
    one, many = infer.infer_columns(df.coalesce(1)), infer.infer_columns(df.repartition(17))
    assert sorted(rows(one)) == sorted(rows(many))


@pytest.mark.parametrize("token, shape", [
    ("1e3", (False, True, 4, 0, 4)), ("1e-4", (False, True, 0, 4, 4)), ("0.00", (False, False, 0, 2, 2)),
    ("-00120", (True, False, 3, 0, 3)), ("1e99999", (False, True, 1001, 0, 1001)), ("12.", (False, False, 2, 0, 2)),
])
def test_numeric_token(spark, token, shape):
    r = spark.createDataFrame([(token,)], "t string").select(tk.numeric_token(F.col("t")).alias("n")).first()["n"]
    assert tuple(r) == shape


def test_exact_samples(spark):
    cases = {"0.1": True, "1e5": False, "9007199254740991": True, "9007199254740992": False, "abc": False,
             "9007199254740993.0": False, "1.00000000000000000001": False, "123456789012.125": True,
             "0.30000000000000004": True, "0.12345678901234567": None, "1" * 39: False, "2.50": True}
    got = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in cases], "t string").select(
        "t", tk.exact_sample(F.col("t"))).collect()}
    for k, want in cases.items():
        if want is None:
            from decimal import Decimal
            want = Decimal(repr(float(k))) == Decimal(k)
        assert got[k] == want, k


@pytest.mark.parametrize("name, n, target, spark_name", [
    ("int8", None, "SMALLINT", "TINYINT"), ("uint64", None, "DECIMAL(20,0)", "DECIMAL(20,0)"),
    ("large_string", 240, "NVARCHAR(250)", "VARCHAR(250)"), ("string", 5000, "NVARCHAR(MAX)", "STRING"),
    ("decimal(39,0)", None, "NVARCHAR(MAX)", "STRING"), ("decimal(5,-2)", None, "DECIMAL(7,0)", "DECIMAL(7,0)"),
    ("struct<id: int64>", None, "NVARCHAR(MAX)", "STRING"), ("timestamp[ms]", None, "DATETIME2(3)", "TIMESTAMP_NTZ"),
    ("timestamp[us, tz=UTC]", None, "DATETIMEOFFSET(6)", "TIMESTAMP"), ("weird<int64>", None, "NVARCHAR(MAX)", "STRING"),
    ("date32[day]", None, "DATE", "DATE"), ("time32[ms]", None, "TIME(3)", "STRING"),
])
def test_type_mapping(spark, name, n, target, spark_name):
    df = spark.createDataFrame([(name, n)], "t string, n int")
    r = df.select(ty.map_type(F.col("t"), F.col("n")).alias("m")).first()["m"]
    assert tuple(r) == (target, spark_name)


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_id long, doc string")


def profile(spark, texts, **kw):
    return {r["name"]: r for r in jsonprofile.json_profile(docs(spark, texts), **kw).collect()}


def test_json_numbers_keep_their_text(spark):
    p = profile(spark, ['{"a": 1.2300, "b": -7, "c": 1e-7, "s": "1.50 e5", "n": null}',
                        '{"a": 10, "b": 9223372036854775808, "d": {"x": 1.0}, "l": [1.10]}'])
    assert {k: (r["detected_type"], r["nesting"]) for k, r in p.items()} == {
        "a": ("decimal(6,4)", "scalar"), "b": ("decimal(19,0)", "scalar"), "c": ("str", "scalar"),
        "s": ("str", "scalar"), "n": ("str", "scalar"), "d": ("dict", "object"), "l": ("list", "array")}
    assert [r["name"] for r in sorted(p.values(), key=lambda r: r["pos"])] == ["a", "b", "c", "s", "n", "d", "l"]


def test_json_strings_with_the_mark_survive(spark):
    d = docs(spark, [r'{"a": "\u00011.5", "b": 1.50, "c": {"k": "\u0001", "v": 2.50}}'])
    got = {r["key"]: (r["family"], r["token"]) for r in jsonprofile.json_fields(d).collect()}
    assert got["a"] == (jsonprofile.STRING, "\x011.5")
    assert got["b"] == (jsonprofile.NUMERIC, "1.50")
    assert got["c"] == (jsonprofile.OBJECT, r'{"k":"\u0001","v":2.50}')


def test_mixed_families_are_not_safe(spark):
    texts = [f'{{"a": {i}}}' for i in range(200)] + ['{"a": "x"}']
    assert (profile(spark, texts)["a"]["detected_type"], profile(spark, texts)["a"]["safe"]) == ("str", False)


def test_key_cap(spark):
    texts = [f'{{"k{i:05d}": 1}}' for i in range(4098)]
    whole = profile(spark, texts)                    # no limit unless one is asked for
    assert len(whole) == 4098 and {r["schema_inference"] for r in whole.values()} == {"full"}
    p = profile(spark, texts, max_keys=4096)
    assert len(p) == 4096 and not any(r["safe"] for r in p.values())
    assert {r["schema_inference"] for r in p.values()} == {"sampled"} and "k04096" not in p


def test_long_number_is_rejected(spark):
    ok, bad = profile(spark, ['{"a": ' + "1" * 256 + "}"])["a"], profile(spark, ['{"a": ' + "1" * 257 + "}"])["a"]
    assert (ok["detected_type"], ok["safe"]) == ("decimal(256,0)", True)
    assert (bad["detected_type"], bad["safe"]) == ("str", False)


def test_repeated_key_keeps_the_last_value(spark):
    assert profile(spark, ['{"a": "x", "a": true}'])["a"]["detected_type"] == "bool"


def test_array_and_lines_give_the_same_profile(spark, rows):
    from strandline.operators.jsonops import lines_to_array
    d = docs(spark, ['{"a": 1, "b": "x"}', '{"a": 2.50, "c": [1]}'])
    arr = lines_to_array(d.withColumn("g", F.lit(1)), "g", "doc")
    items = arr.select(F.explode(F.from_json("document", "array<string>")).alias("doc")).select(
        F.monotonically_increasing_id().alias("row_id"), "doc")
    a, b = jsonprofile.json_profile(d), jsonprofile.json_profile(items)
    names = lambda p: {r["name"] for r in p.collect()}
    assert names(a) == names(b) == {"a", "b", "c"}


def test_token_evidence_against_plain_python(spark):
    """Class, digits and scale of single tokens; the few inferred names map like any type name."""
    import re
    tokens = ["5", "-5", "+7", "12.34", "12.", "00.50", ".5", "0", "-0", "000", ".", "-.", "+.", "1e5", "1E-3", "1e", "--1", "+-1",
              "1_0", "0x1F", "-", "abc", "1,5", "9" * 25, "-" + "0" * 40 + "5", "NaN", "1d", "1/2", "1.2.3", "12 34", " 8 ", " 8",
              "5\x01", "2147483647", "2147483648", "-2147483648", "-2147483649", "9223372036854775807", "9223372036854775808", "~x", "\x7f"]
    cells = spark.createDataFrame([(t,) for t in tokens], "token string").withColumn("pos", F.monotonically_increasing_id())
    got = {r["token"]: r for r in infer.merge_tokens(cells.withColumn("k", F.col("token")), ["k"]).withColumnRenamed("k", "token").collect()}
    for token in tokens:
        t, r = token.strip("  "), got[token]
        numeric = re.fullmatch(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?", t)
        assert bool(r["mask"] & (infer.INT32 | infer.INT64 | infer.DECIMAL | infer.EXPONENT)) == bool(numeric), token
        if numeric and "e" not in t.lower():
            whole, _, frac = t.lstrip("+-").partition(".")
            assert (r["int_digits"], r["scale"]) == (len(whole.lstrip("0")), len(frac)), token
            kind = infer.DECIMAL if "." in t or not -2**63 <= int(t) < 2**63 else infer.INT32 if -2**31 <= int(t) < 2**31 else infer.INT64
            assert r["mask"] == kind, token
    names = spark.createDataFrame([(n, w) for n in ("bool", "int32", "int64", "object", "decimal(5,2)", "decimal(38,38)", "decimal(39,0)")
                                   for w in (None, 0, 3, 200, 201, 3999, 4000, 4001)], "n string, w long")
    target, stored = ty.inferred_types(F.col("n"), F.col("w"))
    rows = names.select(target.alias("a"), stored.alias("b"), ty.map_type(F.col("n"), F.col("w")).alias("m")).collect()
    assert all((r["a"], r["b"]) == tuple(r["m"]) for r in rows)
