"""Queries over loads, table creation and validation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_name, table_name
from ..operators import infer, jsonprofile, load, setops, validate
from ..operators.validate import Assertion
from ..sources import inventory
from ..streaming import incremental
from ..workspace import shared_dir, staged
from .inference import DIRTY_SQL, NUM, TEXT, dirty, infer_sql, text_sql, text_table, OUT
from .registry import order_docs, query, table
from .scanning import csv_copy

NA_SQL = "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"


def _name(stem: str) -> str:
    return f"{stem}_{uuid.uuid4().hex[:10]}"


ORDER_SCHEMA = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.IntegerType()),
    T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DecimalType(12, 2)),
    T.StructField("o_orderpriority", T.StringType())])


@query("ld_create_table", "SELECT 'o_orderkey' AS name, 'bigint' AS type FROM (SELECT count(*) FROM orders) UNION ALL SELECT 'o_totalprice', 'decimal(12,2)' FROM (SELECT count(*) FROM orders)")
def _create(spark, sf):
    cols = infer.infer_columns(text_table(spark, sf, "orders")).filter("name in ('o_orderkey', 'o_totalprice')")
    t = _name("created")
    typed = [(r["name"], "BIGINT" if r["name"] == "o_orderkey" else "DECIMAL(12,2)", True)
             for r in cols.orderBy("pos").collect()]                  # one row per column
    load.create_table(spark, t, typed)
    load.create_table(spark, t, typed)                                # running it again changes nothing
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in spark.table(t).schema], "name string, type string")


@query("ld_bulk_load", "SELECT count(*) AS loaded_rows FROM orders")
def _load(spark, sf):
    from ..sources import delimited
    d = delimited.Dialect([c for c, _ in TEXT["orders"]])
    rows = delimited.read_delimited(spark, csv_copy(spark, sf, "orders"), d).drop("path")
    return load.load(rows, _name("loaded"), ORDER_SCHEMA)


@query("ld_ctas_stage", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _stage(spark, sf):
    return load.stage(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), _name("orders")).groupBy(
        "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("ld_insert_select", "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1")
def _insert(spark, sf):
    t = _name("suppliers")
    load.create_table(spark, t, [("s_suppkey", "BIGINT", True), ("s_name", "STRING", True), ("s_nationkey", "INT", True)])
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return load.insert_from_file(s, t).groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))


BAD_SQL = f"t NOT IN {NA_SQL} AND NOT (regexp_matches(trim(t), '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$') AND abs(TRY_CAST(trim(t) AS DECIMAL(38,4))) < 10000000000 AND length(rtrim(regexp_extract(trim(t), '[.]([0-9]*)$', 1), '0')) <= 2)"


@query("ld_stage_then_type", f"""SELECT o_orderkey, CASE WHEN t NOT IN {NA_SQL} THEN CAST(trim(t) AS DECIMAL(12,2)) END AS t, 'good' AS state FROM ({DIRTY_SQL}) WHERE NOT ({BAD_SQL})
  UNION ALL SELECT o_orderkey, NULL, 'bad' FROM ({DIRTY_SQL}) WHERE {BAD_SQL}""")
def _typed(spark, sf):
    schema = T.StructType([T.StructField("t", T.DecimalType(12, 2))])
    rows = load.convert_rows(dirty(spark, sf), schema, keep=["o_orderkey"])
    return rows.select("o_orderkey", F.col("typed.t").alias("t"),
                       F.when(F.size("bad_columns") > 0, F.lit("bad")).otherwise("good").alias("state"))


@query("ld_reject_limit", f"""SELECT 'rejected' AS outcome, count(*) AS bad_rows FROM ({DIRTY_SQL}) WHERE {BAD_SQL}""")
def _reject(spark, sf):
    schema = T.StructType([T.StructField("t", T.DecimalType(12, 2))])
    bin_ = f"{shared_dir(spark)}/{_name('quarantine')}"
    rows = dirty(spark, sf).select("t")
    try:
        load.load(rows, _name("rejected"), schema, max_errors=0, quarantine=bin_)
        outcome = "loaded"
    except load.LoadRejected:
        outcome = "rejected"
    return spark.read.schema("t string, bad_columns array<string>").json(bin_).agg(
        F.lit(outcome).alias("outcome"), F.count(F.lit(1)).alias("bad_rows"))


@query("ld_missing_is_null", f"SELECT t IN {NA_SQL} AS missing, count(*) AS n, count(*) FILTER (WHERE TRY_CAST(trim(t) AS DECIMAL(12,2)) = 0) AS defaulted FROM ({DIRTY_SQL}) WHERE NOT ({BAD_SQL}) GROUP BY 1")
def _missing(spark, sf):
    schema = T.StructType([T.StructField("t", T.DecimalType(12, 2))])
    good, _ = load.stage_then_type(dirty(spark, sf), schema)
    return good.groupBy(F.col("t").isNull().alias("missing")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("t") == 0).alias("defaulted"))


@query("ld_external_table", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _external(spark, sf):
    opts = load.format_options({"file_type": "csv", "delimiter": ",", "encoding": "utf-8", "has_header": True})
    schema = T.StructType([T.StructField(c, T.StringType()) for c, _ in TEXT["orders"]])
    t = load.external_table(spark, _name("ext_orders"), csv_copy(spark, sf, "orders"), "csv", schema, opts)
    return t.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("ld_external_refusal", """SELECT p_partkey AS name, CASE p_size % 3 WHEN 0 THEN 'nested' ELSE 'unbounded' END AS reason FROM part WHERE p_size % 3 <> 1""")
def _refusal(spark, sf):
    m = F.col("p_size") % 3
    cols = table(spark, sf, "part").select(
        F.col("p_partkey").alias("name"), F.when(m == 0, F.lit("list<element: int64>")).when(m == 1, F.lit("int64")).otherwise("string").alias("type"),
        F.lit("BYTE_ARRAY").alias("physical"), F.when(m == 2, F.lit(5000)).alias("max_length"))
    return load.external_refusal(cols).select("name", "reason")


@query("ld_format_options", "SELECT count(*) AS n, CAST(sum(length(c_name)) AS BIGINT) AS chars FROM customer")
def _options(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    path = staged(spark, (sf, "customer", "pipe16"), lambda p: c.write.option("header", True).option("sep", "|").option(
        "encoding", "UTF-16LE").csv(p))
    opts = load.format_options({"file_type": "csv", "delimiter": "|", "encoding": "utf-16-le", "has_header": True})
    return spark.read.options(**opts).schema("k string, name string").csv(path).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("name")).alias("chars"))


@query("ld_rerun_safe", "SELECT 2 * count(*) AS appended, count(*) AS replaced FROM nation")
def _rerun(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string"), "n_name")
    schema = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType())])
    spark.sql("CREATE DATABASE IF NOT EXISTS strandline_runs")
    t, own = _name("nation"), "strandline_runs." + _name("nation")
    for _ in range(2):
        twice = load.load(n, t, schema)
        once = load.load(n, own, schema, rerun_truncate=True)
    return twice.select(F.col("loaded_rows").alias("appended")).withColumn("replaced", once.scalar())


@query("ld_names", """SELECT s_suppkey, regexp_replace('my ' || s_name, '[^A-Za-z0-9_]', '_', 'g') AS name, 'ext_col_' || s_suppkey || '_v1' AS ext, 'stg_a_b' AS stg FROM supplier""")
def _names(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey").cast("string")
    return s.select("s_suppkey", table_name(F.concat(F.lit("d\\e/my "), "s_name", F.lit(".csv"))).alias("name"),
                    table_name(F.concat(F.lit("/x/"), k, F.lit(".v1.parquet")), "ext_").alias("ext"),
                    table_name(F.concat(F.lit("/x/a-b."), k), "stg_").alias("stg"))


@query("ld_shared_once", """SELECT p_type, min(p_partkey) AS p_partkey FROM part GROUP BY 1""")
def _shared(spark, sf):
    p = table(spark, sf, "part").select(F.when(F.col("p_size") % 2 == 0, F.lower("p_type")).otherwise(F.col("p_type")).alias("obj"), "p_partkey")
    return setops.first_definition(p, "obj", "p_partkey").select(F.upper("obj").alias("p_type"), "p_partkey")


@query("ld_table_ddl", """SELECT l_orderkey AS path, 'CREATE TABLE IF NOT EXISTS `t` (' || string_agg('`c' || l_linenumber || '_' || i || '` BIGINT' || CASE WHEN l_linenumber = 1 THEN ' NOT NULL' ELSE '' END, ', ' ORDER BY l_linenumber, i) || ') USING parquet' AS ddl
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem) GROUP BY 1""")
def _ddl(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    li = table(spark, sf, "lineitem").withColumn("i", F.row_number().over(w))
    cols = li.select(F.col("l_orderkey").alias("path"), F.lit("t").alias("table_name"), F.struct("l_linenumber", "i").alias("pos"),
                     F.concat(F.lit("c"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("i").cast("string")).alias("name"),
                     F.lit("BIGINT").alias("spark_type"), (F.col("l_linenumber") != 1).alias("nullable"))
    return load.table_ddl(cols)


@query("ld_convert_parquet", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _convert(spark, sf):
    src = spark.read.option("header", True).schema(", ".join(f"{c} string" for c, _ in TEXT["orders"])).csv(csv_copy(spark, sf, "orders"))
    path = f"{shared_dir(spark)}/{_name('converted')}"
    load.convert_to_parquet(src, path, ["o_orderstatus"])
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("ld_export_json", infer_sql(text_sql("customer"), [c for c, _ in TEXT["customer"]]))
def _export(spark, sf):
    prof = infer.infer_columns(text_table(spark, sf, "customer")).select(*OUT)
    path = f"{shared_dir(spark)}/{_name('profile')}"
    load.export_json(prof, path)
    return spark.read.schema(prof.schema).json(path)


# --- validation -------------------------------------------------------------------

@query("val_row_count", "SELECT count(*) AS loaded_rows FROM lineitem")
def _count(spark, sf):
    return validate.row_count_check(table(spark, sf, "lineitem"))


@query("val_nulls", """SELECT count(*) FILTER (WHERE l_returnflag = 'N') AS l_returnflag_nulls, count(*) FILTER (WHERE l_linenumber = 3) AS l_linenumber_nulls,
  CAST(0 AS BIGINT) AS l_orderkey_nulls FROM lineitem""")
def _nulls(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", F.expr("nullif(l_returnflag, 'N')").alias("l_returnflag"),
                                             F.expr("nullif(l_linenumber, 3)").alias("l_linenumber"))
    return validate.null_distribution(li)


@query("val_exact_rows", """WITH e AS (SELECT l_partkey AS a, l_linenumber AS b, count(*) AS n FROM lineitem GROUP BY 1, 2),
  c AS (SELECT l_partkey AS a, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_linenumber END AS b, count(*) AS n FROM lineitem GROUP BY 1, 2),
  j AS (SELECT coalesce(e.n, 0) AS e, coalesce(c.n, 0) AS c FROM e FULL JOIN c ON e.a = c.a AND e.b = c.b)
  SELECT CAST(sum(e) AS BIGINT) AS expected_rows, CAST(sum(c) AS BIGINT) AS actual_rows, CAST(sum(greatest(e - c, 0)) AS BIGINT) AS missing_rows,
  CAST(sum(greatest(c - e, 0)) AS BIGINT) AS extra_rows, sum(abs(e - c)) = 0 AS exact FROM j""")
def _exact(spark, sf):
    li = table(spark, sf, "lineitem")
    exp = li.select(F.col("l_partkey").alias("a"), F.col("l_linenumber").alias("b"))
    act = li.select(F.col("l_partkey").alias("a"), F.when(F.col("l_returnflag") == "R", 0).otherwise(F.col("l_linenumber")).alias("b"))
    return validate.exact_rows_diff(act, exp)


@query("val_checksum", """WITH c AS (SELECT CAST(o_orderkey AS VARCHAR) AS a, o_orderstatus AS b, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) END AS c FROM orders),
  d AS (SELECT md5(length(a) || ':' || a || '|' || length(b) || ':' || b || '|' || coalesce(length(c) || ':' || c, 'n')) AS d FROM c)
  SELECT count(*) AS rows, CAST(sum(CAST(CAST('0x' || substr(d, 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) || '/' || CAST(sum(CAST(CAST('0x' || substr(d, 17, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS checksum FROM d""")
def _checksum(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("c"))
    return validate.table_checksum(o)


@query("val_assertions", """SELECT 'row_count' AS kind, '15000' AS expected, CAST(count(*) AS VARCHAR) AS actual, count(*) = 15000 AS ok, true AS evaluated, '' AS detail FROM orders
  UNION ALL SELECT 'column_count', '3', '3', true, true, '' UNION ALL SELECT 'value_equals', 'F', arg_min(o_orderstatus, o_orderkey), arg_min(o_orderstatus, o_orderkey) = 'F', true, 'first status' FROM orders
  UNION ALL SELECT 'values_not_all_null', '>0', '3', true, true, '' UNION ALL SELECT 'no_error', NULL, NULL, true, true, ''
  UNION ALL SELECT 'catalog_present', 'True', NULL, true, false, 'unreadable'""")
def _assert(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return validate.check(o, [Assertion("row_count", 15000), Assertion("column_count", 3),
                              Assertion("value_equals", "F", "o_orderstatus", "first status"),
                              Assertion("values_not_all_null"), Assertion("no_error"),
                              Assertion("catalog_present", True)], order="o_orderkey")


@query("val_catalog_present", "SELECT count(*) AS n, true AS present, false AS other FROM region")
def _present(spark, sf):
    t = _name("region")
    load.stage(table(spark, sf, "region"), t)
    return spark.table("stg_" + t).agg(F.count(F.lit(1)).alias("n")).withColumns({
        "present": F.lit(validate.table_present(spark, "stg_" + t)), "other": F.lit(validate.table_present(spark, t))})


@query("val_manifest", """SELECT coalesce(d.doc_id, m.k) AS path, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN m.k IS NULL THEN 'extra'
  WHEN d.text = m.t THEN 'same' ELSE 'different' END AS status FROM documents d FULL JOIN (
  SELECT l.doc_id + 3 AS k, CASE WHEN l.quality = 1 THEN x.text ELSE upper(x.text) END AS t FROM labels l JOIN documents x ON x.doc_id = l.doc_id + 3
  UNION ALL SELECT -1 - doc_id, 'gone' FROM labels WHERE toxic = 1) m ON m.k = d.doc_id""")
def _manifest(spark, sf):
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    kept = docs.join(labels.select((F.col("doc_id") + 3).alias("doc_id"), "quality"), "doc_id").select(
        "doc_id", F.when(F.col("quality") == 1, F.col("text")).otherwise(F.upper("text")).alias("text"))
    gone = labels.filter("toxic = 1").select((-1 - F.col("doc_id")).alias("doc_id"), F.lit("gone").alias("text"))
    manifest = validate.content_digests(kept.unionByName(gone), "doc_id", "text")
    return validate.manifest_diff(validate.content_digests(docs, "doc_id", "text"), manifest)


@query("val_manifest_files", """WITH f AS (SELECT doc_id // 100 AS block, string_agg(doc_id || ':' || n_chars, chr(10) ORDER BY doc_id) || chr(10) AS body FROM documents GROUP BY 1),
  m AS (SELECT block, CASE WHEN block % 3 = 0 THEN body || 'x' ELSE body END AS body FROM f WHERE block % 4 <> 0 UNION ALL SELECT -1, 'gone')
  SELECT coalesce(f.block, m.block) AS block, octet_length(encode(f.body)) AS bytes, sha256(f.body) AS sha256,
    CASE WHEN f.block IS NULL THEN 'missing' WHEN m.block IS NULL THEN 'extra' WHEN f.body = m.body THEN 'same' ELSE 'different' END AS status
  FROM f FULL JOIN m ON f.block = m.block""")
def _manifest_files(spark, sf):
    """Digests of real files, read on executors, against a manifest that lacks, changes and invents some."""
    def write(path):
        lines = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 100).alias("block"), "doc_id", F.concat_ws(
            ":", F.col("doc_id").cast("string"), F.col("n_chars").cast("string")).alias("value"))
        lines.repartition("block").sortWithinPartitions("block", "doc_id").select("block", "value").write.partitionBy("block").text(path)
    files = inventory.inventory(spark, staged(spark, (sf, "documents", "blocks"), write))
    block = F.regexp_extract("path", "/block=([^/]+)/", 1).cast("long")
    found = validate.file_digests(files).select(block.alias("path"), "bytes", "sha256")
    body = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "n_chars"))), lambda x: F.concat_ws(
        ":", x["doc_id"].cast("string"), x["n_chars"].cast("string"))), "\n"), F.lit("\n"))
    whole = table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 100).alias("path")).agg(body.alias("body")).filter("path % 4 <> 0")
    known = whole.select("path", F.when(F.col("path") % 3 == 0, F.concat("body", F.lit("x"))).otherwise(F.col("body")).alias("body"))
    known = known.unionByName(spark.createDataFrame([(-1, "gone")], "path long, body string")).select(
        "path", F.octet_length("body").cast("long").alias("bytes"), F.sha2("body", 256).alias("sha256"))
    status = validate.manifest_diff(found, known)
    return status.join(found, "path", "left").select(F.col("path").alias("block"), "bytes", "sha256", "status")


@query("val_error_number", """SELECT o_orderstatus, kind, expected, actual, ok FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), (VALUES
  ('error_number', '8152', '8152', true), ('error_number', '4861', '8152', false), ('no_error', NULL, '8152', false)) v(kind, expected, actual, ok)
  UNION ALL SELECT o_orderstatus, 'row_count', '7000', CAST(count(*) AS VARCHAR), count(*) = 7000 FROM orders GROUP BY 1""")
def _error_number(spark, sf):
    """A load that must fail with one number, reported next to the rows of each status."""
    o = table(spark, sf, "orders")
    wanted = [Assertion("error_number", 8152), Assertion("error_number", 4861), Assertion("no_error"), Assertion("row_count", 7000)]
    parts = [validate.check(o.filter(F.col("o_orderstatus") == s), wanted, error_number=8152).select(
        F.lit(s).alias("o_orderstatus"), "kind", "expected", "actual", "ok")
        for s in sorted(r[0] for r in o.select("o_orderstatus").distinct().collect())]          # three statuses
    return setops.union_all(parts)


@query("val_summary", """SELECT event_type AS verdict, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'ACCEPTED', count(*) FROM events WHERE event_type <> 'error' AND event_type <> 'view'
  UNION ALL SELECT 'DEFECTS', count(*) FROM events WHERE event_type = 'error'""")
def _verdicts(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("verdict"), (F.col("event_type") != "error").alias("accepted"))
    return validate.verdict_summary(e, harness_only=("view",))


@query("val_shape_agree", "SELECT count(*) FILTER (WHERE o_orderkey IS NULL) AS differences FROM orders")
def _agree(spark, sf):
    d = order_docs(spark, sf)
    arrays = d.select("row_id", F.concat(F.lit("["), "doc", F.lit("]")).alias("doc"))
    unwrapped = arrays.select("row_id", F.explode(F.from_json("doc", "array<string>")).alias("doc"))
    a, b = jsonprofile.json_profile(d), jsonprofile.json_profile(unwrapped)
    return jsonprofile.profiles_agree(a, b).agg(F.count(F.lit(1)).alias("differences"))


@query("val_declared_shape", """SELECT 'c_custkey' AS name, 'type' AS problem FROM (SELECT count(*) FROM customer) UNION ALL SELECT 'c_name', 'longer than declared' FROM (SELECT max(length(c_name)) AS w FROM customer) WHERE w > 5
  UNION ALL SELECT 'c_acctbal', 'undeclared column' UNION ALL SELECT 'c_phone', 'missing column'""")
def _declared(spark, sf):
    cols = infer.infer_columns(text_table(spark, sf, "customer")).select("name", F.col("detected_type").alias("type"), F.col("observed_max_length").alias("max_length"))
    declared = spark.createDataFrame([("c_custkey", "int64", None), ("c_name", "object", 5), ("c_nationkey", "int32", None),
                                      ("c_mktsegment", "object", 100), ("c_phone", "object", 20)], "name string, type string, max_length int")
    return validate.shape_diff(cols, declared).select("name", "problem")


@query("val_normalise", """SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS price, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS day,
  '0x' || upper(hex(o_orderstatus)) AS bin, CASE WHEN o_custkey % 2 = 0 THEN 'nan' ELSE 'inf' END AS f FROM orders""")
def _normal(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(12,2)").alias("price"), F.col("o_orderdate").alias("day"),
        F.col("o_orderstatus").cast("binary").alias("bin"),
        F.when(F.col("o_custkey") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf"))).alias("f"))
    return validate.normalise_rows(o)


@query("val_fail_per_file", "SELECT count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) AS files FROM events")
def _fails(spark, sf):
    e = table(spark, sf, "events").select(F.when(F.col("event_type") == "error", F.col("props")).alias("error"))
    return validate.failure_count(e)


# --- incremental ------------------------------------------------------------------

@query("st_incremental_profile", infer_sql(text_sql("orders"), [c for c, _ in TEXT["orders"]]))
def _incremental(spark, sf):
    names = [c for c, _ in TEXT["orders"]]
    base = f"{shared_dir(spark)}/{_name('stream')}"
    q = incremental.profile_stream(spark, csv_copy(spark, sf, "orders"), names, base + "/store", base + "/checkpoint", files_per_trigger=2)
    q.awaitTermination()
    return incremental.stored_profile(spark, base + "/store").select(*OUT)
