"""Queries over JSON columns and JSON shape inference."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import jsonops, jsonprofile
from ..sources import jsonarrays, jsondocs
from ..workspace import deal_out, staged
from .registry import ORDER_DOC_SQL, order_docs, query, table

# what the shape rules give for the derived documents, computed from the base columns
KEYS_SQL = f"""
WITH d AS (SELECT *, CAST(o_totalprice AS DECIMAL(12,2)) AS total FROM orders),
m AS (SELECT max(length(CAST(CAST(abs(total) AS BIGINT) AS VARCHAR))) AS hi, max(floor(abs(total))) AS top FROM d)
SELECT name, detected_type, nesting, observed_max_length, safe FROM (
  SELECT 'id' AS name, 'int32' AS detected_type, 'scalar' AS nesting, CAST(NULL AS BIGINT) AS observed_max_length, true AS safe
  UNION ALL SELECT 'total', 'decimal(' || (length(CAST(CAST(top AS BIGINT) AS VARCHAR)) + 2) || ',2)', 'scalar', NULL, true FROM m
  UNION ALL SELECT 'status', 'str', 'scalar', max(length(o_orderstatus)), true FROM d
  UNION ALL SELECT 'flag', 'bool', 'scalar', NULL, true
  UNION ALL SELECT 'mixed', 'str', 'scalar', NULL, false
  UNION ALL SELECT 'tags', 'list', 'array', NULL, true
  UNION ALL SELECT 'note', 'str', 'scalar', NULL, true
  UNION ALL SELECT 'extra', 'dict', 'object', NULL, true)"""


@query("inf_json_families", KEYS_SQL)
def _families(spark, sf):
    p = jsonprofile.json_profile(order_docs(spark, sf))
    return p.select("name", "detected_type", "nesting", "observed_max_length", "safe")


@query("json_key_profile", """SELECT 'k' AS name, 'int32' AS detected_type, 'scalar' AS nesting, count(*) AS seen
  FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def _props(spark, sf):
    docs = table(spark, sf, "events").select(F.col("event_id").alias("row_id"), F.col("props").alias("doc"))
    ev = jsonprofile.key_evidence(jsonprofile.json_fields(docs))
    done = jsonprofile.finish_keys(jsonprofile.cap_keys(ev))
    return done.select("name", "detected_type", "nesting").join(
        ev.select(F.col("key").alias("name"), "seen"), "name")


@query("inf_json_nesting", """WITH d AS (SELECT lang, doc_id % 5 AS k, CASE doc_id % 5 WHEN 0 THEN 'object' WHEN 1 THEN 'array'
    WHEN 2 THEN CASE WHEN n_chars % 2 = 0 THEN 'object' ELSE 'array' END WHEN 3 THEN CASE WHEN n_chars % 2 = 0 THEN 'array' END ELSE 'scalar' END AS f FROM documents)
  SELECT lang, 'k' || k AS name, CASE WHEN min(f) = max(f) THEN min(f) ELSE 'scalar' END AS nesting FROM d GROUP BY lang, k""")
def _nesting(spark, sf):
    """A key is an object or an array only if all its values are; nulls do not count, a mixture is scalar."""
    k, even = F.col("doc_id") % 5, F.col("n_chars") % 2 == 0
    value = (F.when(k == 0, F.lit('{"a":[1]}')).when(k == 1, F.lit('[{"a":1}]'))
             .when(k == 2, F.when(even, F.lit("{}")).otherwise(F.lit("[]")))
             .when(k == 3, F.when(even, F.lit("[null]")).otherwise(F.lit("null"))).otherwise(F.lit('"[1]"')))
    d = table(spark, sf, "documents").select("lang", F.col("doc_id").alias("row_id"), F.concat(
        F.lit('{"k'), k.cast("string"), F.lit('":'), value, F.lit("}")).alias("doc"))
    return jsonprofile.json_profile(d, ["lang"]).select("lang", "name", "nesting")


@query("inf_json_rejected", """SELECT o_orderstatus, bool_or(length(r) > 256) AS rejected_numeric FROM (
  SELECT o_orderstatus, repeat('1', CAST(CASE WHEN o_orderstatus = 'F' THEN 200 + o_custkey % 100 ELSE 1 + o_custkey % 30 END AS BIGINT)) AS r FROM orders) GROUP BY 1""")
def _rejected(spark, sf):
    n = F.when(F.col("o_orderstatus") == "F", 200 + F.col("o_custkey") % 100).otherwise(1 + F.col("o_custkey") % 30)
    d = table(spark, sf, "orders").select(
        "o_orderstatus", F.col("o_orderkey").alias("row_id"),
        F.concat(F.lit('{"n":'), F.repeat(F.lit("1"), n.cast("int")), F.lit("}")).alias("doc"))
    ev = jsonprofile.key_evidence(jsonprofile.json_fields(d, ["o_orderstatus"]), ["o_orderstatus"])
    return jsonprofile.rejected_numeric(ev, ["o_orderstatus"])


@query("inf_json_exact_token", """SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) || '00' AS a,
  CAST(o_custkey AS VARCHAR) || 'e-7' AS b, 'n 1.50' AS c FROM orders""")
def _exact(spark, sf):
    o = table(spark, sf, "orders")
    doc = F.concat(F.lit('{"a":'), F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.lit('00, "b" : '),
                   F.col("o_custkey").cast("string"), F.lit('e-7,"c":"n 1.50"}'))
    f = jsonprofile.json_fields(o.select("o_orderkey", F.col("o_orderkey").alias("row_id"), doc.alias("doc")), ["o_orderkey"])
    # the three keys of a document are known, so its tokens are laid out by conditional aggregates
    pick = lambda k: F.max(F.when(F.col("key") == k, F.col("token"))).alias(k)
    return f.groupBy("o_orderkey").agg(pick("a"), pick("b"), pick("c"))


@query("inf_json_safe", """SELECT o_orderstatus, true AS typed_projection_safe FROM orders GROUP BY 1""")
def _safe(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").join(
        order_docs(spark, sf), "o_orderkey")
    return jsonprofile.typed_projection_safe(jsonprofile.json_profile(d, ["o_orderstatus"]), ["o_orderstatus"])


@query("inf_json_key_cap", """SELECT 'u' || user_id AS name, CAST(row_number() OVER (ORDER BY first_seen) - 1 AS INTEGER) AS pos, CASE WHEN (SELECT count(DISTINCT user_id) FROM events) > 40 THEN 'sampled' ELSE 'full' END AS schema_inference
  FROM (SELECT user_id, min(event_id) AS first_seen FROM events GROUP BY 1) ORDER BY first_seen LIMIT 40""")
def _cap(spark, sf):
    d = table(spark, sf, "events").select(F.col("event_id").alias("row_id"), F.concat(
        F.lit('{"u'), F.col("user_id").cast("string"), F.lit('":1}')).alias("doc"))
    return jsonprofile.json_profile(d, max_keys=40).select("name", "pos", "schema_inference")


@query("inf_json_first", f"""SELECT 'id' AS name, CAST(arg_min(o_orderkey, o_orderkey) AS VARCHAR) AS first_value FROM orders
  UNION ALL SELECT 'total', CAST(arg_min(CAST(o_totalprice AS DECIMAL(12,2)), o_orderkey) AS VARCHAR) FROM orders
  UNION ALL SELECT 'status', arg_min(o_orderstatus, o_orderkey) FROM orders
  UNION ALL SELECT 'flag', arg_min(CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END, o_orderkey) FROM orders
  UNION ALL SELECT 'mixed', arg_min(CASE WHEN o_orderstatus = 'F' THEN 'n' ELSE '1' END, o_orderkey) FROM orders
  UNION ALL SELECT 'tags', '["a","b"]' FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'F' LIMIT 1)
  UNION ALL SELECT 'extra', arg_min('{{"x":' || o_custkey || '}}', o_orderkey) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')""")
def _first(spark, sf):
    d = order_docs(spark, sf)
    p = jsonprofile.json_profile(d)
    f = jsonprofile.json_first_values(d, p)
    return f.select("name", "first_value")


@query("inf_key_order", f"""SELECT name, CAST(row_number() OVER (ORDER BY first_row, p) - 1 AS INTEGER) AS pos FROM (
  SELECT name, min(o_orderkey) AS first_row, min(p) AS p FROM (
   SELECT o_orderkey, unnest(CASE o_orderstatus WHEN 'F' THEN ['id','total','status','flag','mixed','tags'] WHEN 'O' THEN ['id','total','status','flag','mixed','note']
     ELSE ['id','total','status','flag','mixed','extra'] END) AS name, unnest([0,1,2,3,4,5]) AS p FROM orders) GROUP BY 1)""")
def _order(spark, sf):
    return jsonprofile.json_profile(order_docs(spark, sf)).select("name", "pos")


@query("inf_shape", """SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'object' ELSE 'array' END AS json_format,
  CASE WHEN conv_id % 3 = 0 THEN 1 ELSE count(*) END AS row_count FROM conversations GROUP BY conv_id""")
def _shape(spark, sf):
    d = turn_arrays(spark, sf)
    doc = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit('{"t":'), F.col("document"), F.lit("}"))).otherwise(F.col("document"))
    return jsondocs.json_shape(d.select("conv_id", doc.alias("doc"))).select("conv_id", "json_format", "row_count")


def turn_arrays(spark, sf):
    c = table(spark, sf, "conversations")
    line = F.concat(F.lit('{"turn":'), F.col("turn").cast("string"), F.lit(',"n":'), F.length("text").cast("string"), F.lit("}"))
    return jsonops.lines_to_array(c.select("conv_id", line.alias("line")), "conv_id", "line")


LINE_LEN = "length('{\"turn\":' || turn || ',\"n\":' || length(text) || '}')"


@query("js_ndjson_wrap", f"""SELECT conv_id, 0 AS part, 1 AS parts, count(*) AS n_lines, CAST(sum({LINE_LEN}) + count(*) + 1 AS BIGINT) AS size
  FROM conversations GROUP BY conv_id""")
def _wrap(spark, sf):
    d = turn_arrays(spark, sf)
    return d.select("conv_id", "part", "parts", "n_lines", F.length("document").cast("long").alias("size"))


@query("scan_json_prefix", f"""SELECT conv_id, CASE WHEN len > 60 THEN NULL ELSE n END AS row_count, len > 60 AS analysis_truncated,
  CAST(CASE WHEN len > 60 THEN least(n - 1, 2) ELSE n END AS BIGINT) AS items FROM (
  SELECT conv_id, count(*) AS n, sum({LINE_LEN}) + count(*) + 1 AS len FROM conversations GROUP BY 1)""")
def _prefix(spark, sf):
    d = turn_arrays(spark, sf).select("conv_id", F.col("document").alias("doc"))
    p = jsondocs.read_json_prefix(d, max_doc_bytes=60, sample_rows=2)
    return p.select("conv_id", "row_count", "analysis_truncated", F.size("items").cast("long").alias("items"))


# --- column operators --------------------------------------------------------------

@query("js_shred_typed", f"""SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(12,2)) AS total, o_orderstatus AS status,
  CASE o_orderstatus WHEN 'F' THEN '["a","b"]' END AS tags,
  CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN '{{"x":' || o_custkey || '}}' END AS extra FROM orders""")
def _shred(spark, sf):
    return jsonops.shred(order_docs(spark, sf), "doc",
                         "id bigint, total decimal(12,2), status string, tags string, extra string")


_ENTRY = " UNION ALL ".join([
    "SELECT o_orderkey, 'id' AS key, CAST(o_orderkey AS VARCHAR) AS value, 2 AS type FROM orders",
    "SELECT o_orderkey, 'status', o_orderstatus, 1 FROM orders",
    "SELECT o_orderkey, 'flag', CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END, 3 FROM orders",
    "SELECT o_orderkey, 'mixed', CASE WHEN o_orderstatus = 'F' THEN 'n' ELSE '1' END, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END FROM orders",
    "SELECT o_orderkey, 'tags', '[\"a\",\"b\"]', 4 FROM orders WHERE o_orderstatus = 'F'",
    "SELECT o_orderkey, 'note', NULL, 0 FROM orders WHERE o_orderstatus = 'O'",
    "SELECT o_orderkey, 'extra', '{\"x\":' || o_custkey || '}', 5 FROM orders WHERE o_orderstatus NOT IN ('F', 'O')"])


@query("js_schemaless", _ENTRY + " UNION ALL SELECT o_orderkey, 'total', CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR), 2 FROM orders")
def _entries(spark, sf):
    return jsonops.json_entries(order_docs(spark, sf), "doc", ["o_orderkey"])


@query("js_exact_numbers", """WITH o AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS c, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS t FROM orders)
  SELECT o_orderkey, 'tiny' AS key, c || 'e-7' AS value, 2 AS type FROM o UNION ALL SELECT o_orderkey, 'long', t || '00', 2 FROM o
  UNION ALL SELECT o_orderkey, 'text', '1.50', 1 FROM o UNION ALL SELECT o_orderkey, 'nest', '{"y":[' || c || '.50,"1.50"]}', 5 FROM o
  UNION ALL SELECT o_orderkey, 'y.0', c || '.50', NULL FROM o UNION ALL SELECT o_orderkey, 'y.1', '1.50', NULL FROM o
  UNION ALL SELECT o_orderkey, '$.tiny', c || 'e-7', NULL FROM o UNION ALL SELECT o_orderkey, '$.nest.y', '[' || c || '.50,"1.50"]', NULL FROM o""")
def _exact_entries(spark, sf):
    c, t = F.col("o_custkey").cast("string"), F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    doc = F.concat(F.lit('{"tiny":'), c, F.lit('e-7,"long":'), t, F.lit('00,"text":"1.50","nest":{"y":['), c, F.lit('.50,"1.50"]}}'))
    d = deal_out(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")).select("o_orderkey", doc.alias("doc"))
    inner = jsonops.json_expand(d, "doc", ["o_orderkey"], "$.nest").select(
        "o_orderkey", F.concat_ws(".", "parent_key", "child_key").alias("key"), F.col("child_value").alias("value"))
    paths = d.select("o_orderkey", F.inline(F.array(
        F.struct(F.lit("$.tiny").alias("key"), jsonops.json_value(F.col("doc"), "$.tiny").alias("value")),
        F.struct(F.lit("$.nest.y").alias("key"), jsonops.json_query(F.col("doc"), "$.nest.y").alias("value")))))
    return jsonops.json_entries(d, "doc", ["o_orderkey"]).unionByName(
        inner.unionByName(paths).withColumn("type", F.lit(None).cast("int")))


@query("jn_lateral", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def _lateral(spark, sf):
    e = jsonops.apply_json(table(spark, sf, "events"), "props", ["event_id"])
    return e.select("event_id", "key", "value")


@query("js_nested_expand", """SELECT o_orderkey, 'tags' AS parent_key, CAST(i AS VARCHAR) AS child_key, ['a','b'][i + 1] AS child_value
  FROM orders, (SELECT unnest([0, 1]) AS i) WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey, 'extra', 'x', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')""")
def _expand(spark, sf):
    return jsonops.json_expand(order_docs(spark, sf), "doc", ["o_orderkey"])


@query("js_is_valid", """SELECT event_id, CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'view' THEN 0 ELSE 1 END AS is_valid_json,
  CASE WHEN event_type IN ('error', 'view') THEN 'Invalid' ELSE 'Valid' END AS status FROM events""")
def _valid(spark, sf):
    t = F.col("event_type")
    doc = F.when(t == "error", F.concat("props", F.lit("]"))).when(t == "view", F.lit("12")).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", jsonops.json_valid(doc).alias("v")).select("event_id", "v.*")


@query("js_path_exists", "SELECT o_orderkey, o_orderstatus = 'O' AS has_note, false AS has_other FROM orders")
def _exists(spark, sf):
    return order_docs(spark, sf).select("o_orderkey", jsonops.json_path_exists(F.col("doc"), "note").alias("has_note"),
                                        jsonops.json_path_exists(F.col("doc"), "x").alias("has_other"))


@query("js_modify", """SELECT event_id, '{"k":' || user_id || '}' AS changed, '{"k":' || json_extract_string(props, '$.k') || ',"new":"' || event_type || '"}' AS added,
  '{}' AS removed FROM events""")
def _modify(spark, sf):
    p = F.col("props")
    return table(spark, sf, "events").select(
        "event_id", jsonops.json_set(p, "k", F.col("user_id")).alias("changed"),
        jsonops.json_set(p, "new", F.col("event_type")).alias("added"),
        jsonops.json_set(p, "k", F.lit(None).cast("string")).alias("removed"))


@query("js_value", "SELECT o_orderkey, o_orderstatus AS status, CAST(NULL AS VARCHAR) AS tags FROM orders")
def _value(spark, sf):
    return order_docs(spark, sf).select("o_orderkey", jsonops.json_value(F.col("doc"), "$.status").alias("status"),
                                        jsonops.json_value(F.col("doc"), "$.tags").alias("tags"))


@query("js_query", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '["a","b"]' END AS tags, CAST(NULL AS VARCHAR) AS status FROM orders""")
def _jquery(spark, sf):
    return order_docs(spark, sf).select("o_orderkey", jsonops.json_query(F.col("doc"), "$.tags").alias("tags"),
                                        jsonops.json_query(F.col("doc"), "$.status").alias("status"))


@query("js_path_quote", """SELECT s_suppkey, json_extract_string('{"a b":"' || s_name || '","c":1}', '$."a b"') AS quoted, '1' AS plain FROM supplier""")
def _quote(spark, sf):
    doc = F.concat(F.lit('{"a b":"'), F.col("s_name"), F.lit('","c":1}'))
    return table(spark, sf, "supplier").select(
        "s_suppkey", jsonops.json_value(doc, jsonops.spark_path("a b")).alias("quoted"),
        jsonops.json_value(doc, jsonops.spark_path("c")).alias("plain"))


@query("js_export_rows", """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || CASE WHEN n_name = 'NATION_3' THEN '' ELSE ',"n_name":"' || n_name || '"' END || ',"n_regionkey":' || n_regionkey || '}' AS json FROM nation""")
def _export(spark, sf):
    n = table(spark, sf, "nation").withColumn("n_name", F.expr("nullif(n_name, 'NATION_3')"))
    return jsonops.rows_to_json(n, keep=["n_nationkey"])


@query("js_export_nulls", """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":' || CASE WHEN n_name = 'NATION_3' THEN 'null' ELSE '"' || n_name || '"' END || ',"n_regionkey":' || n_regionkey || '}' AS json FROM nation""")
def _export_nulls(spark, sf):
    n = table(spark, sf, "nation").withColumn("n_name", F.expr("nullif(n_name, 'NATION_3')"))
    return jsonops.rows_to_json(n, include_nulls=True, keep=["n_nationkey"])


@query("js_export_root", """SELECT 0 AS seq, NULL AS key, '{"nation":[' AS fragment UNION ALL SELECT 2, NULL, ']}'
  UNION ALL SELECT 1, c_custkey, CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer) THEN '' ELSE ',' END || '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}' FROM customer""")
def _root(spark, sf):
    return jsonops.rows_to_json_root(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "nation", "c_custkey")


@query("js_export_single", """SELECT '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}' AS json FROM supplier ORDER BY s_suppkey LIMIT 1""")
def _single(spark, sf):
    return jsonops.first_row_json(table(spark, sf, "supplier").select("s_suppkey", "s_name"), "s_suppkey")


@query("js_object_subset", """SELECT '{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","p_brand":"' || p_brand || '","p_type":"' || p_type || '","p_size":' || p_size || '}' AS json FROM part""")
def _subset(spark, sf):
    return jsonops.rows_to_json(table(spark, sf, "part"), cols=table(spark, sf, "part").columns[:5])


@query("js_insert_scalars", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders")
def _scalars(spark, sf):
    import uuid
    docs = jsonops.shred(order_docs(spark, sf), "doc", T.StructType([
        T.StructField("id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("tags", T.StringType())]))
    cols = [{"name": "id"}, {"name": "status"}, {"name": "tags", "nesting": "array"}]
    return jsonops.insert_scalars(docs, cols, f"scalars_{uuid.uuid4().hex[:8]}")


@query("q_preview_json", f"""SELECT o_orderkey, json_extract_string(doc, '$.id') AS id, json_extract_string(doc, '$.status') AS status FROM ({ORDER_DOC_SQL}) ORDER BY o_orderkey LIMIT 50""")
def _preview_json(spark, sf):
    return jsonops.preview_json(order_docs(spark, sf).select("o_orderkey", "doc"), 50, "o_orderkey").select("o_orderkey", "id", "status")


def array_copy(spark, sf) -> str:
    """All order documents as one array in one file."""
    def write(path):
        d = order_docs(spark, sf).select("o_orderkey", "doc")
        last = d.agg(F.max("o_orderkey")).first()[0]
        comma = F.when(F.col("o_orderkey") == last, F.col("doc")).otherwise(F.concat("doc", F.lit(",")))
        rows = d.select(F.col("o_orderkey").alias("k"), comma.alias("value")) \
            .unionAll(spark.createDataFrame([(-1, "["), (last + 1, "]")], "k long, value string"))
        rows.coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    return staged(spark, (sf, "orders", "array"), write)


@query("scan_json_array", f"""SELECT json_extract_string(doc, '$.status') AS status, count(*) AS n, CAST(sum(length(doc)) AS BIGINT) AS chars,
  CAST(sum(CAST(json_extract_string(doc, '$.id') AS BIGINT)) AS BIGINT) AS ids FROM ({ORDER_DOC_SQL}) GROUP BY 1""")
def _array(spark, sf):
    """Elements of one large array, cut by many tasks."""
    d = jsonarrays.array_elements(spark, [array_copy(spark, sf)])
    return d.groupBy(F.get_json_object("doc", "$.status").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("doc")).cast("long").alias("chars"),
        F.sum(F.get_json_object("doc", "$.id").cast("long")).alias("ids"))
