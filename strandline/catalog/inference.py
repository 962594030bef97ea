"""Queries over the inference operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..functions import types as ty
from ..functions.lookups import FALSE_TOKENS, MISSING_TOKENS, TRUE_TOKENS
from ..operators import infer, preview
from ..sources import delimited
from .registry import query, spread_table, table

NA = ", ".join("'" + x + "'" for x in MISSING_TOKENS)
BOOLS = ", ".join("'" + x + "'" for x in TRUE_TOKENS + FALSE_TOKENS)
NUM = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
U16 = "(length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"
BUCKET = ("CASE WHEN {0} > 4000 THEN NULL WHEN {0} <= 200 THEN 255 "
          "ELSE least((({0}) // 50 + 1) * 50, 4000) END")

# Text forms of the table columns: (name, Spark type to pass through, SQL expression).
TEXT = {
    "orders": [("o_orderkey", "string"), ("o_custkey", "string"), ("o_orderstatus", "string"),
               ("o_totalprice", "decimal(18,2)"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "string"), ("l_partkey", "string"), ("l_suppkey", "string"),
                 ("l_linenumber", "string"), ("l_quantity", "decimal(18,2)"),
                 ("l_extendedprice", "decimal(18,2)"), ("l_discount", "decimal(18,2)"),
                 ("l_tax", "decimal(18,2)"), ("l_returnflag", "string"), ("l_linestatus", "string")],
    "part": [("p_partkey", "string"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "string"), ("p_retailprice", "decimal(18,2)")],
    "customer": [("c_custkey", "string"), ("c_name", "string"), ("c_nationkey", "string"),
                 ("c_acctbal", "decimal(18,2)"), ("c_mktsegment", "string")],
    "documents": [("doc_id", "string"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "string")],
}


def text_table(spark, sf, name):
    return spread_table(spark, sf, name, *[c for c, _ in TEXT[name]]).select(
        *[F.col(c).cast(t).cast("string").alias(c) for c, t in TEXT[name]])


def text_sql(name: str) -> str:
    cols = ", ".join(f"CAST(CAST({c} AS {'VARCHAR' if t == 'string' else t.upper()}) AS VARCHAR) AS {c}"
                     for c, t in TEXT[name])
    return f"SELECT {cols} FROM {name}"


def infer_sql(source: str, columns, extra: str = "", by: str = "") -> str:
    """SQL that infers each column of ``source`` (a SELECT of text columns)."""
    g = f"{by}, " if by else ""
    parts = []
    for i, c in enumerate(columns):
        parts.append(f"""
SELECT {g}{i} AS pos, '{c}' AS name, count(*) AS n,
  count(*) FILTER (WHERE t IS NULL OR t IN ({NA})) AS missing,
  bool_and(t IN ({BOOLS})) FILTER (WHERE ok) AS bools,
  bool_and(regexp_matches(trim(t), '{NUM}') AND length(trim(t)) <= 256) FILTER (WHERE ok) AS nums,
  bool_or(regexp_matches(t, '[eE]')) FILTER (WHERE ok) AS exps,
  bool_and(NOT contains(t, '.')) FILTER (WHERE ok) AS whole,
  max(length(ltrim(ltrim(split_part(trim(t), '.', 1), '+-'), '0'))) FILTER (WHERE ok) AS id,
  max(length(split_part(trim(t), '.', 2))) FILTER (WHERE ok) AS sc,
  min(TRY_CAST(trim(t) AS HUGEINT)) FILTER (WHERE ok) AS lo,
  max(TRY_CAST(trim(t) AS HUGEINT)) FILTER (WHERE ok) AS hi,
  max({U16.format('t')}) FILTER (WHERE ok) AS w
FROM (SELECT *, t IS NOT NULL AND t NOT IN ({NA}) AS ok FROM (SELECT {g}{c} AS t FROM src)) {f'GROUP BY {by}' if by else ''}""")
    return f"""
WITH src AS ({source}), ev AS ({' UNION ALL '.join(parts)}),
ty AS (SELECT *, CASE WHEN bools THEN 'bool'
   WHEN nums AND NOT exps AND whole AND id <= 19 AND lo >= -2147483648 AND hi <= 2147483647 THEN 'int32'
   WHEN nums AND NOT exps AND whole AND id <= 19 AND lo >= -9223372036854775808 AND hi <= 9223372036854775807 THEN 'int64'
   WHEN nums AND NOT exps THEN 'decimal(' || greatest(1, id + sc) || ',' || sc || ')'
   ELSE 'object' END AS detected_type FROM ev),
wd AS (SELECT *, CASE WHEN detected_type = 'object' THEN CAST(w AS BIGINT) END AS observed_max_length FROM ty)
SELECT {g}CAST(pos AS INTEGER) AS pos, name, detected_type, observed_max_length,
  CAST(ceil(observed_max_length * 1.25) AS BIGINT) AS max_length,
  CAST(missing AS BIGINT) AS missing, CAST(n AS BIGINT) AS rows{extra} FROM wd"""


OUT = ["pos", "name", "detected_type", "observed_max_length", "max_length", "missing", "rows"]
TARGET = """, CASE WHEN detected_type = 'bool' THEN 'NVARCHAR(5)' WHEN detected_type = 'int32' THEN 'INT'
  WHEN detected_type = 'int64' THEN 'BIGINT' WHEN detected_type LIKE 'decimal%' THEN upper(detected_type)
  WHEN ceil(observed_max_length * 1.25) > 4000 THEN 'NVARCHAR(MAX)'
  WHEN ceil(observed_max_length * 1.25) <= 200 THEN 'NVARCHAR(255)'
  ELSE 'NVARCHAR(' || CAST(least((CAST(ceil(observed_max_length * 1.25) AS BIGINT) // 50 + 1) * 50, 4000) AS VARCHAR) || ')' END AS target_type"""

for _t in ("orders", "lineitem", "part", "customer", "documents"):
    def _make(name):
        cols = [c for c, _ in TEXT[name]]

        @query(f"infer_{name}_types", infer_sql(text_sql(name), cols, TARGET))
        def _q(spark, sf):
            return infer.infer_columns(text_table(spark, sf, name)).select(*OUT, "target_type")
    _make(_t)


@query("inf_delimited_column", infer_sql(
    "SELECT lang, CAST(doc_id AS VARCHAR) AS doc_id, text, CAST(n_chars AS VARCHAR) AS n_chars FROM documents",
    ["doc_id", "text", "n_chars"], by="lang"))
def _inf_grouped(spark, sf):
    d = table(spark, sf, "documents").select(
        "lang", F.col("doc_id").cast("string"), "text", F.col("n_chars").cast("string"))
    return infer.infer_columns(d, ["doc_id", "text", "n_chars"], by=["lang"]).select("lang", *OUT)


# tokens with missing marks, booleans, exponents and long digits, derived from orders
DIRTY_SQL = """SELECT o_orderkey, CASE o_orderkey % 9
  WHEN 0 THEN 'NA' WHEN 1 THEN 'true' WHEN 2 THEN CAST(o_orderkey AS VARCHAR) || 'e2'
  WHEN 3 THEN ' ' || CAST(o_custkey AS VARCHAR) || ' ' WHEN 4 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
  WHEN 5 THEN '92233720368547758' || CAST(o_custkey AS VARCHAR) WHEN 6 THEN o_orderpriority
  WHEN 7 THEN '' ELSE '-.' || CAST(o_custkey AS VARCHAR) END AS t FROM orders"""


def dirty(spark, sf):
    o = table(spark, sf, "orders")
    k, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    m = F.col("o_orderkey") % 9
    return o.select("o_orderkey", (
        F.when(m == 0, F.lit("NA")).when(m == 1, F.lit("true")).when(m == 2, F.concat(k, F.lit("e2")))
        .when(m == 3, F.concat(F.lit(" "), cust, F.lit(" ")))
        .when(m == 4, F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
        .when(m == 5, F.concat(F.lit("92233720368547758"), cust)).when(m == 6, F.col("o_orderpriority"))
        .when(m == 7, F.lit("")).otherwise(F.concat(F.lit("-."), cust))).alias("t"))


@query("inf_missing", f"SELECT t IN ({NA}) AS missing, count(*) AS n FROM ({DIRTY_SQL}) GROUP BY 1")
def _missing(spark, sf):
    return dirty(spark, sf).groupBy(tk.is_missing(F.col("t")).alias("missing")).agg(F.count(F.lit(1)).alias("n"))


@query("inf_bool_token", f"""SELECT CASE WHEN t IN ('True','TRUE','true') THEN true WHEN t IN ('False','FALSE','false')
  THEN false END AS b, count(*) AS n FROM ({DIRTY_SQL}) GROUP BY 1""")
def _bool(spark, sf):
    return dirty(spark, sf).groupBy(tk.bool_token(F.col("t")).alias("b")).agg(F.count(F.lit(1)).alias("n"))


NUMERIC_SQL = f"""
WITH p AS (SELECT o_orderkey, trim(t) AS t FROM ({DIRTY_SQL}) WHERE regexp_matches(trim(t), '{NUM}')),
q AS (SELECT *, regexp_matches(t, '[eE]') AS has_exp,
  coalesce(TRY_CAST(regexp_extract(t, '[eE]([+-]?[0-9]+)$', 1) AS BIGINT), 0) AS ex,
  split_part(ltrim(regexp_extract(t, '^([^eE]*)', 1), '+-'), '.', 1) AS whole,
  split_part(ltrim(regexp_extract(t, '^([^eE]*)', 1), '+-'), '.', 2) AS frac FROM p),
r AS (SELECT *, length(whole) + ex AS point, whole || frac AS digits FROM q),
s AS (SELECT *, CASE WHEN ltrim(digits, '0') = '' THEN 0
  ELSE greatest(point - (length(digits) - length(ltrim(digits, '0'))), 0) END AS id,
  greatest(length(digits) - point, 0) AS sc FROM r)
SELECT o_orderkey, NOT contains(t, '.') AND NOT has_exp AS int_syntax, has_exp, CAST(id AS INTEGER) AS int_digits,
  CAST(sc AS INTEGER) AS scale, CAST(greatest(1, id + sc) AS INTEGER) AS "precision" FROM s"""


@query("inf_numeric_token", NUMERIC_SQL)
def _numeric(spark, sf):
    d = dirty(spark, sf).select("o_orderkey", tk.numeric_token(F.col("t")).alias("n"))
    return d.filter("n is not null").select("o_orderkey", "n.*")


@query("inf_numeric_agg", infer_sql(
    f"SELECT k, CASE WHEN k IN (3, 4, 5, 8) THEN t END AS t FROM (SELECT o_orderkey % 9 AS k, t FROM ({DIRTY_SQL}))",
    ["t"], by="k"))
def _numeric_agg(spark, sf):
    d = dirty(spark, sf).withColumn("k", F.col("o_orderkey") % 9)
    d = d.select("k", F.when(F.col("k").isin(3, 4, 5, 8), F.col("t")).alias("t"))
    return infer.infer_columns(d, ["t"], by=["k"]).select("k", *OUT)


@query("inf_utf16_len", f"""SELECT lang, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum({U16.format('text')}) AS BIGINT) AS units,
  CAST(max({U16.format('text')}) AS BIGINT) AS widest FROM documents GROUP BY lang""")
def _utf16(spark, sf):
    n = tk.utf16_len(F.col("text"))
    return table(spark, sf, "documents").groupBy("lang").agg(
        F.sum(F.length("text")).alias("chars"), F.sum(n).alias("units"), F.max(n).cast("long").alias("widest"))


@query("inf_width_headroom", "SELECT doc_id, CAST(ceil(n_chars * 1.25) AS BIGINT) AS sized FROM documents")
def _headroom(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tk.sized(F.col("n_chars")).alias("sized"))


@query("inf_text_bucket", f"SELECT doc_id, CAST({BUCKET.format('n_chars')} AS INTEGER) AS bucket FROM documents")
def _bucket(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tk.text_width_bucket(F.col("n_chars")).alias("bucket"))


@query("inf_nullable_conservative", "SELECT name, true AS nullable, 'full' AS schema_inference FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS name, max({c}) FROM customer" for c, _ in TEXT["customer"]) + ")")
def _nullable(spark, sf):
    return infer.infer_columns(text_table(spark, sf, "customer")).select("name", "nullable", "schema_inference")


@query("inf_sample_rows", """SELECT lang, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn
  FROM documents) WHERE rn <= 3""")
def _samples(spark, sf):
    d = table(spark, sf, "documents").select("lang", "doc_id", "source")
    return delimited.sample_rows(d, "doc_id", 3, "lang")


@query("inf_exact_sample", f"""SELECT o_orderkey, coalesce(regexp_matches(trim(t), '{NUM}') AND NOT regexp_matches(t, '[eE]')
  AND (contains(t, '.') OR abs(TRY_CAST(trim(t) AS HUGEINT)) <= 9007199254740991), false) AS exact FROM ({DIRTY_SQL})""")
def _exact(spark, sf):
    return dirty(spark, sf).select("o_orderkey", tk.exact_sample(F.col("t")).alias("exact"))


@query("inf_widen_incomplete", """SELECT p_partkey, CASE WHEN p_size > 40 THEN 'BIGINT' WHEN p_type = 'ECONOMY' THEN 'NVARCHAR(MAX)'
  WHEN p_size % 2 = 0 THEN 'INT' ELSE 'NVARCHAR(255)' END AS effective FROM part""")
def _widen(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", infer.effective_type(
        F.when(F.col("p_size") % 2 == 0, F.lit("int32")).otherwise("object"),
        F.when(F.col("p_type") == "ECONOMY", F.lit("sampled")).otherwise("full"),
        F.when(F.col("p_size") > 40, F.lit("bigint")), F.col("p_size")).alias("effective"))


TYPE_NAMES = ["int8", "uint64", "float", "bool", "large_string", "timestamp[us]", "timestamp[ns, tz=UTC]",
              "time64[us]", "decimal128(12, 3)", "decimal(40,2)", "struct<a: int64>", "date32[day]",
              "fixed_size_binary[16]", "decimal(5,-2)", "object"]
TYPE_TARGETS = ["SMALLINT", "DECIMAL(20,0)", "FLOAT", "BIT", "NVARCHAR(255)", "DATETIME2(6)", "DATETIMEOFFSET(7)",
                "TIME(6)", "DECIMAL(12,3)", "NVARCHAR(MAX)", "NVARCHAR(MAX)", "DATE",
                "VARBINARY(MAX)", "DECIMAL(7,0)", "NVARCHAR(255)"]
TYPE_SPARK = ["TINYINT", "DECIMAL(20,0)", "DOUBLE", "BOOLEAN", "VARCHAR(255)", "TIMESTAMP_NTZ", "TIMESTAMP",
              "STRING", "DECIMAL(12,3)", "STRING", "STRING", "DATE", "BINARY", "DECIMAL(7,0)", "VARCHAR(255)"]


def _list(xs):
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]"


@query("inf_map_type", f"""SELECT {_list(TYPE_NAMES)}[p_size % 15 + 1] AS name, {_list(TYPE_TARGETS)}[p_size % 15 + 1] AS target_type,
  {_list(TYPE_SPARK)}[p_size % 15 + 1] AS spark_type, count(*) AS n FROM part GROUP BY 1, 2, 3""")
def _map(spark, sf):
    name = F.element_at(F.array(*[F.lit(x) for x in TYPE_NAMES]), (F.col("p_size") % 15 + 1))
    p = table(spark, sf, "part").select(name.alias("name"), F.col("p_size"))
    m = p.select("name", ty.map_type(F.col("name"), F.col("p_size")).alias("m"))
    return m.groupBy("name", "m.target_type", "m.spark_type").agg(F.count(F.lit(1)).alias("n"))


DELTA_NAMES = ["long", "decimal(12,2)", "timestamp", "timestamp_ntz", "boolean", "weird"]
DELTA_OUT = ["int64", "decimal(12,2)", "timestamp[us, tz=UTC]", "timestamp[us]", "bool", "str"]
ICE_NAMES = ["long", "decimal(9, 2)", "timestamptz", "uuid", "fixed[16]", '{"type":"list","element":"int"}']
ICE_OUT = ["int64", "decimal(9,2)", "timestamp[us, tz=UTC]", "str", "binary", "list"]


@query("inf_delta_type", f"""SELECT p_partkey, {_list(DELTA_OUT)}[p_size % 6 + 1] AS delta,
  {_list(ICE_OUT)}[p_size % 6 + 1] AS iceberg FROM part""")
def _catalog(spark, sf):
    i = F.col("p_size") % 6 + 1
    d = F.element_at(F.array(*[F.lit(x) for x in DELTA_NAMES]), i)
    c = F.element_at(F.array(*[F.lit(x) for x in ICE_NAMES]), i)
    return table(spark, sf, "part").select("p_partkey", ty.delta_type(d).alias("delta"), ty.iceberg_type(c).alias("iceberg"))


ICE_MORE = ["int", "FLOAT", " double ", "boolean", "string", "date", "time", "timestamp", "timestamp_ns", "timestamptz_ns", "binary",
            "decimal(38, 0)", "decimal", "unknown", '{"type":"struct","fields":[]}', '{"type":"map","key":"string","value":"int"}']
ICE_MORE_OUT = ["int32", "float32", "float64", "bool", "str", "date", "time64[us]", "timestamp[us]", "timestamp[ns]", "timestamp[ns, tz=UTC]", "binary",
                "decimal(38,0)", "decimal128", "str", "dict", "dict"]


@query("inf_iceberg_type", f"""SELECT o_orderstatus, {_list(ICE_MORE_OUT)}[o_custkey % 16 + 1] AS detected, count(*) AS n FROM orders GROUP BY 1, 2""")
def _iceberg_names(spark, sf):
    raw = F.element_at(F.array(*[F.lit(x) for x in ICE_MORE]), (F.col("o_custkey") % 16 + 1).cast("int"))
    named = table(spark, sf, "orders").select("o_orderstatus", ty.iceberg_type(raw).alias("detected"))
    return named.groupBy("o_orderstatus", "detected").agg(F.count(F.lit(1)).alias("n"))


@query("inf_override", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'INT' WHEN p_size % 3 = 1 THEN 'DECIMAL(10,2)'
  ELSE 'NVARCHAR(MAX)' END AS t FROM part""")
def _override(spark, sf):
    m = F.col("p_size") % 3
    o = F.when(m == 1, F.lit("decimal(10,2)")).when(m == 2, F.concat(F.lit("int; drop "), F.col("p_name")))
    return table(spark, sf, "part").select("p_partkey", ty.with_type_overrides(F.lit("INT"), o).alias("t"))


@query("inf_column_limit", """SELECT source, count(*) AS column_count, count(*) <= 45 AS typed_table_allowed
  FROM documents GROUP BY source""")
def _limit(spark, sf):
    d = table(spark, sf, "documents").select("source", F.col("doc_id").alias("name"))
    return infer.check_column_limit(d, ["source"], 45)


@query("inf_unique_names", """SELECT p_brand, lower(p_type) AS folded_name, count(*) AS copies FROM part
  GROUP BY 1, 2 HAVING count(*) > 1""")
def _unique(spark, sf):
    return infer.duplicate_names(table(spark, sf, "part"), ["p_brand"], "p_type")


@query("inf_external_bounds", """SELECT p_partkey, ['BIGINT', 'DATETIME2(6)', 'NVARCHAR(4000)', 'VARBINARY(8000)',
  'INT', 'NVARCHAR(255)'][p_size % 6 + 1] AS t FROM part""")
def _bounds(spark, sf):
    i = F.col("p_size") % 6 + 1
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), i)
    return table(spark, sf, "part").select("p_partkey", ty.bounded_type(
        pick("timestamp[ns]", "timestamp[us, tz=UTC]", "string", "binary", "int32", "string"),
        pick("INT64", "INT64", "BYTE_ARRAY", "BYTE_ARRAY", "INT32", "BYTE_ARRAY"),
        F.when(i == 6, F.col("p_size"))).alias("t"))


@query("inf_watchouts", """SELECT lang, source, w.code AS code, w.subject AS subject FROM (SELECT lang, source, unnest([
  CASE WHEN max(n_chars) > 4000 THEN {'code': 'long_text', 'subject': 'text'} END, {'code': 'nullable_number', 'subject': 'n'},
  CASE WHEN count(*) > 30 THEN {'code': 'rows_estimated', 'subject': NULL} END,
  CASE WHEN min(n_chars) < 70 THEN {'code': 'unsure_encoding', 'subject': CAST(min(n_chars) AS VARCHAR)} END]) AS w
  FROM documents GROUP BY 1, 2) WHERE w IS NOT NULL""")
def _watch(spark, sf):
    d = table(spark, sf, "documents").groupBy("lang", "source").agg(
        F.min("n_chars").alias("encoding_confidence"), F.max("n_chars").alias("m"), F.count(F.lit(1)).alias("c"))
    col = lambda n, t, m: F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(True).alias("nullable"),
                                   F.lit("scalar").alias("nesting"), m.alias("max_length"))
    prof = d.select("lang", "source", F.lit("utf-8").alias("encoding"), "encoding_confidence",
                    (F.col("c") > 30).alias("row_count_estimated"), F.lit("csv").alias("file_type"),
                    F.array(col("text", "object", F.col("m")), col("n", "int32", F.lit(None).cast("long"))).alias("columns"))
    return prof.select("lang", "source", F.inline(infer.watchouts(prof)))


@query("inf_folder_consensus", """
WITH f AS (SELECT source, count(*) AS n, count(DISTINCT lang) AS dl, min(lang) AS ml,
  count(DISTINCT CASE WHEN n_chars > 20 THEN 'long' ELSE 'short' END) AS ds, min(CASE WHEN n_chars > 20 THEN 'long' ELSE 'short' END) AS ms
  FROM documents GROUP BY source),
tl AS (SELECT source, max(c) AS top FROM (SELECT source, lang, count(*) AS c FROM documents GROUP BY 1, 2) GROUP BY 1),
ts AS (SELECT source, max(c) AS top FROM (SELECT source, n_chars > 20, count(*) AS c FROM documents GROUP BY 1, 2) GROUP BY 1)
SELECT source, n AS file_count, CASE WHEN dl > 1 THEN 'Mixed' ELSE ml END AS lang,
  CASE WHEN ds > 1 THEN 'Mixed' ELSE ms END AS span, greatest(n - tl.top, n - ts.top) AS outlier_count
FROM f JOIN tl USING (source) JOIN ts USING (source) WHERE n >= 2""")
def _consensus(spark, sf):
    d = table(spark, sf, "documents").select(
        "source", "lang", F.when(F.col("n_chars") > 20, F.lit("long")).otherwise("short").alias("span"))
    return infer.folder_consensus(d, "source", ["lang", "span"])


@query("inf_summary", "SELECT lang AS file_type, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS total_size FROM documents GROUP BY lang")
def _summary(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("file_type"), F.col("n_chars").alias("file_size"))
    return infer.summary(d)


# --- projections and previews ------------------------------------------------------

@query("q_typed_read_top", """SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice, o_orderstatus
  FROM orders ORDER BY o_orderkey LIMIT 100""")
def _typed_top(spark, sf):
    t = text_table(spark, sf, "orders").withColumn("k", F.col("o_orderkey").cast("long"))
    return preview.typed_read(t, [("o_orderkey", "bigint"), ("o_totalprice", "decimal(12,2)"), ("o_orderstatus", "string")],
                              100, "k")


@query("q_read_all_top", "SELECT * FROM supplier ORDER BY s_suppkey LIMIT 100")
def _read_top(spark, sf):
    return preview.read_top(table(spark, sf, "supplier"), 100, "s_suppkey")


@query("q_preview", """SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders) AS total_rows,
  (SELECT count(*) FROM orders) > 250 AS truncated FROM orders ORDER BY o_orderkey LIMIT 250""")
def _preview(spark, sf):
    return preview.preview(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 250, "o_orderkey")


@query("q_preview_cell", f"""SELECT o_orderkey, CASE WHEN t IN ({NA}) THEN NULL
  WHEN regexp_matches(trim(t), '{NUM}') AND NOT regexp_matches(t, '[eE]')
   AND (contains(t, '.') OR abs(TRY_CAST(trim(t) AS HUGEINT)) <= 9007199254740991) THEN 'number' ELSE 'text' END AS kind,
  CASE WHEN t IN ({NA}) THEN NULL WHEN regexp_matches(trim(t), '{NUM}') AND NOT regexp_matches(t, '[eE]')
   AND (contains(t, '.') OR abs(TRY_CAST(trim(t) AS HUGEINT)) <= 9007199254740991) THEN trim(t) ELSE t END AS "text" FROM ({DIRTY_SQL})""")
def _cell(spark, sf):
    d = dirty(spark, sf).select("o_orderkey", preview.preview_cell(F.col("t"), F.lit("decimal(20,2)")).alias("c"))
    return d.select("o_orderkey", "c.kind", "c.text")


@query("q_provisional", """SELECT CAST(least(count(*), 100) AS BIGINT) AS n, CAST(least(count(*), 100) AS BIGINT) AS row_count_lower_bound,
  CASE WHEN count(*) > 100 THEN 'rows' END AS stopped_by FROM customer""")
def _provisional(spark, sf):
    p = preview.provisional(table(spark, sf, "customer"))
    return p.groupBy("row_count_lower_bound", "stopped_by").agg(F.count(F.lit(1)).alias("n"))


@query("q_list_filter", """SELECT doc_id AS file_name, lang AS file_type, source AS folder FROM documents
  WHERE contains(lower(source || chr(10) || doc_id || chr(10) || lang), 'c7')""")
def _filter(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("file_name"), F.col("lang").alias("file_type"),
                                             F.col("source").alias("folder"))
    return preview.filter_files(d, " C7 ")


@query("q_project_names", "SELECT s_suppkey, s_nationkey FROM supplier")
def _project(spark, sf):
    return preview.project_names(table(spark, sf, "supplier"), ["s_nationkey", "s_suppkey"])


@query("q_sample3", "SELECT p_partkey, p_name, p_brand FROM part ORDER BY p_partkey LIMIT 10")
def _sample3(spark, sf):
    return preview.sample_first_columns(table(spark, sf, "part"), 10, 3, "p_partkey")


@query("q_header_filter", "SELECT * FROM nation WHERE n_name <> 'NATION_3'")
def _header(spark, sf):
    return preview.drop_header_rows(table(spark, sf, "nation"), "n_name", "NATION_3")


@query("q_count_cap", """SELECT source, least(count(*), 40) AS expected FROM documents GROUP BY source""")
def _cap(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return d.select("source", preview.capped_expectation(F.col("n"), 40).alias("expected"))


@query("q_collation_compare", """SELECT p_partkey, lower(p_brand) = lower(upper(p_brand)) AS ci, p_brand = upper(p_brand) AS bin FROM part""")
def _coll(spark, sf):
    b = F.col("p_brand")
    return table(spark, sf, "part").select(
        "p_partkey", preview.equal_under(b, F.upper(b), "ci_as").alias("ci"),
        preview.equal_under(b, F.upper(b), "binary").alias("bin"))


@query("q_collation_group", "SELECT min(v) AS v, count(*) AS n FROM (SELECT CASE WHEN p_size % 2 = 0 THEN upper(p_type) ELSE lower(p_type) END AS v FROM part) GROUP BY lower(v)")
def _coll_group(spark, sf):
    p = table(spark, sf, "part")
    v = F.when(F.col("p_size") % 2 == 0, F.upper("p_type")).otherwise(F.lower("p_type"))
    return preview.count_under(p.select(v.alias("v")), "v", "ci_as")


@query("q_collation_sort", "SELECT s_suppkey, s_name FROM supplier")
def _coll_sort(spark, sf):
    return preview.sort_under(table(spark, sf, "supplier").select("s_suppkey", "s_name"), "s_name", "cs_as")


@query("q_byte_length", f"SELECT doc_id, CAST(2 * {U16.format('text')} AS BIGINT) AS bytes FROM documents")
def _bytes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tk.byte_length(F.col("text")).alias("bytes"))
