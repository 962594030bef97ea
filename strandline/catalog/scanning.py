"""Queries over listings, files, detection and table formats.

Files are written by Spark from the given tables into the shared folder and read
back by the operators, so the work grows with the tables.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.lookups import DELIMITER_NAMES, EXTENSION_FORMATS, MAX_LISTING, with_lookup
from ..operators import infer, setops
from ..sources import columnar, delimited, delta, detect, iceberg, inventory, jsondocs
from ..workspace import staged
from .inference import TEXT, infer_sql, text_sql, text_table, OUT
from .registry import LISTING_SQL, listing, query, spread_table, table

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
EXT_CASE = ("CASE lower(regexp_extract(path, '[.]([^.]+)$', 1)) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in EXTENSION_FORMATS.items()) + " END")


# --- listings ---------------------------------------------------------------------

@query("scan_inventory", " UNION ALL ".join(f"SELECT '{t}.parquet' AS file_name, 'parquet' AS file_type, true AS has_bytes" for t in TABLES))
def _inventory(spark, sf):
    inv = inventory.detect_ext(inventory.inventory(spark, sf))
    top = F.regexp_extract("path", r"/([^/]+\.parquet)(?:/|$)", 1)      # a table may be one file or a folder of files
    return inv.select(top.alias("file_name"), "file_type", "size").filter("file_name <> ''").groupBy(
        "file_name", "file_type").agg((F.sum("size") > 0).alias("has_bytes"))


@query("scan_object_store", """SELECT path, replace(path, '#', '%23') AS url, size, (SELECT count(*) FROM customer) > 5000 AS truncated
  FROM (SELECT 'crm/' || c_mktsegment || '/' || c_name || '.csv' AS path, c_custkey AS size FROM customer) ORDER BY path LIMIT 5000""")
def _objects(spark, sf):
    c = table(spark, sf, "customer").select(
        F.concat(F.lit("crm/"), "c_mktsegment", F.lit("/"), "c_name", F.lit(".csv")).alias("path"), F.col("c_custkey").alias("size"))
    return inventory.object_listing(c, MAX_LISTING)


@query("scan_object_store_all", """SELECT path, replace(path, '#', '%23') AS url, size, false AS truncated
  FROM (SELECT 'crm/' || c_mktsegment || '/' || c_name || '.csv' AS path, c_custkey AS size FROM customer)""")
def _all_objects(spark, sf):
    c = table(spark, sf, "customer").select(
        F.concat(F.lit("crm/"), "c_mktsegment", F.lit("/"), "c_name", F.lit(".csv")).alias("path"), F.col("c_custkey").alias("size"))
    return inventory.object_listing(c)


@query("scan_list_level", f"""SELECT name, is_folder, CAST(sum(size) AS BIGINT) AS size, bool_or(NOT is_folder) AS supported,
  CASE WHEN bool_or(starts_with(rest2, '_delta_log/')) THEN 'delta' WHEN bool_or(regexp_matches(rest2, '^metadata/[^/]*[.]metadata[.]json$')) THEN 'iceberg' END AS table_type
  FROM (SELECT split_part(substr(path, 11), '/', 1) AS name, contains(substr(path, 11), '/') AS is_folder, size,
    regexp_replace(substr(path, 11), '^[^/]*/?', '') AS rest2 FROM ({LISTING_SQL}) WHERE starts_with(path, 'lake/src1/')) GROUP BY 1, 2 ORDER BY 1 LIMIT 100""")
def _level(spark, sf):
    return inventory.list_level(listing(spark, sf), "lake/src1/", page=100)


@query("scan_prune", f"""WITH l AS (SELECT * FROM ({LISTING_SQL}) WHERE NOT contains(path, '/.cache/'))
  SELECT path, size, (SELECT count(*) FROM l) > 500 AS truncated FROM l ORDER BY path LIMIT 500""")
def _prune(spark, sf):
    return inventory.prune(listing(spark, sf).select("path", "size"), "lake", max_depth=6, max_files=500, max_dirs=2000)


@query("scan_prune_all", f"""SELECT path, size, false AS truncated FROM ({LISTING_SQL}) WHERE NOT contains(path, '/.cache/')""")
def _prune_all(spark, sf):
    return inventory.prune(listing(spark, sf).select("path", "size"), "lake")


ROOTS_CTE = f"""WITH l AS ({LISTING_SQL}),
d AS (SELECT DISTINCT regexp_extract(path, '^(.*)/_delta_log/', 1) AS root FROM l WHERE contains(path, '/_delta_log/')),
i AS (SELECT DISTINCT regexp_extract(path, '^(.*)/metadata/', 1) AS root FROM l WHERE path LIKE '%/metadata/%.metadata.json'),
r AS (SELECT root, 'delta' AS kind FROM d UNION ALL SELECT root, 'iceberg' FROM i WHERE root NOT IN (SELECT root FROM d)),
o AS (SELECT l.*, r.root, r.kind FROM l LEFT JOIN r ON starts_with(l.path, r.root || '/'))"""


@query("scan_table_roots", ROOTS_CTE + f""" SELECT coalesce(root, path) AS path, max(coalesce(kind, {EXT_CASE})) AS file_type,
  CAST(sum(size) AS BIGINT) AS size, count(*) AS members FROM o GROUP BY 1""")
def _roots(spark, sf):
    return inventory.collapse_tables(listing(spark, sf)).select("path", "file_type", "size", "members")


@query("jn_anti_members", ROOTS_CTE + " SELECT path, size FROM o WHERE root IS NULL")
def _anti(spark, sf):
    inv = listing(spark, sf)
    return inventory.without_members(inv, inventory.table_roots(inv)).select("path", "size")


@query("folder_size", ROOTS_CTE + " SELECT root, CAST(sum(size) AS BIGINT) AS bytes FROM o WHERE root IS NOT NULL GROUP BY 1")
def _folder(spark, sf):
    inv = listing(spark, sf)
    return inventory.folder_size(inv, inventory.table_roots(inv))


@query("scan_by_extension", f"SELECT path, {EXT_CASE} AS file_type FROM ({LISTING_SQL})")
def _by_ext(spark, sf):
    return inventory.detect_ext(listing(spark, sf)).select("path", "file_type")


@query("jn_lookup", f"SELECT path, coalesce({EXT_CASE}, 'unknown') AS kind FROM (SELECT *, lower(regexp_extract(path, '[.]([^.]+)$', 1)) AS ext FROM ({LISTING_SQL}))")
def _lookup(spark, sf):
    inv = listing(spark, sf).withColumn("ext", inventory.extension(F.col("path")))
    return with_lookup(inv, EXTENSION_FORMATS, "ext", "kind", "unknown").select("path", "kind")


@query("scan_sql_source_filter", f"SELECT path, {EXT_CASE} AS file_type FROM ({LISTING_SQL}) WHERE {EXT_CASE} IS NOT NULL AND {EXT_CASE} <> 'excel'")
def _sources(spark, sf):
    return inventory.only_sources(listing(spark, sf)).select("path", "file_type")


@query("scan_first_supported", f"SELECT path, size FROM ({LISTING_SQL}) WHERE {EXT_CASE} IS NOT NULL AND size > 0 AND size <= 2000 ORDER BY path LIMIT 1")
def _first(spark, sf):
    return inventory.first_supported(listing(spark, sf), "path", 2000).select("path", "size")


@query("prof_refresh", f"""SELECT path, CASE WHEN lang = 'en' AND quality_ok THEN 'kept' ELSE 'fresh' END AS state FROM (
  SELECT l.path, d.lang, d.doc_id IN (SELECT doc_id FROM labels) AS quality_ok FROM ({LISTING_SQL}) l JOIN documents d USING (doc_id))""")
def _refresh(spark, sf):
    inv = listing(spark, sf)
    labelled = table(spark, sf, "labels").select("doc_id").distinct()
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    prof = inv.join(labelled, "doc_id").join(docs, "doc_id").select(
        "path", "size", "mtime", F.when(F.col("lang") != "en", F.lit("failed")).alias("error"),
        F.lit(False).alias("is_table"), F.lit(False).alias("provisional"), F.lit("kept").alias("state"))
    fresh = lambda units: units.select("path", "size", "mtime", F.lit("fresh").alias("state"))
    return inventory.refresh(prof, inv, fresh).select("path", "state")


@query("prof_changed_guard", f"""SELECT path, 'file_changed' AS error FROM ({LISTING_SQL}) l JOIN labels b USING (doc_id) WHERE b.toxic = 1""")
def _guard(spark, sf):
    before = listing(spark, sf)
    toxic = table(spark, sf, "labels").filter("toxic = 1").select("doc_id", F.lit(1).alias("grown"))
    after = before.join(toxic, "doc_id", "left").withColumn("size", F.col("size") + F.coalesce("grown", F.lit(0)))
    return inventory.changed_files(before, after)


# --- detection --------------------------------------------------------------------

@query("scan_by_content", """SELECT kind, count(*) AS n FROM (
  SELECT CASE event_type WHEN 'click' THEN 'parquet' WHEN 'view' THEN 'orc' ELSE 'json' END AS kind FROM events
  UNION ALL SELECT 'csv' FROM customer UNION ALL SELECT 'text' FROM supplier) GROUP BY 1""")
def _content(spark, sf):
    t = F.col("event_type")
    e = table(spark, sf, "events").select(F.encode(
        F.when(t == "click", F.concat(F.lit("PAR1"), "props")).when(t == "view", F.concat(F.lit("ORC"), "props"))
        .otherwise(F.concat(F.lit(" \n"), "props")), "UTF-8").alias("head"))
    row = F.concat_ws(";", "c_name", "c_mktsegment")
    c = table(spark, sf, "customer").select(F.encode(F.concat(F.lit("a;b\n\n"), row, F.lit("\n"), row), "UTF-8").alias("head"))
    s = table(spark, sf, "supplier").select(F.encode(F.concat("s_name", F.lit("\nplain, text\n")), "UTF-8").alias("head"))
    heads = e.unionByName(c).unionByName(s)
    return heads.select(detect.detect_magic(F.col("head")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("enc_bom", """SELECT doc_id, ['utf-32', 'utf-32', 'utf-8-sig', 'utf-16', 'utf-16-be', NULL][n_chars % 6 + 1] AS encoding FROM documents""")
def _bom(spark, sf):
    marks = F.expr("array('FFFE0000','0000FEFF','EFBBBF','FFFE','FEFF','')")
    mark = F.unhex(F.element_at(marks, (F.col("n_chars") % 6 + 1).cast("int")))
    head = F.concat(mark, F.encode("text", "UTF-8"))
    return table(spark, sf, "documents").select("doc_id", detect.bom(head).alias("encoding"))


@query("enc_utf16_nobom", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'utf-16-le' WHEN p_size % 3 = 1 THEN 'utf-16-be' END AS encoding FROM part""")
def _utf16(spark, sf):
    m = F.col("p_size") % 3
    head = (F.when(m == 0, F.encode("p_name", "UTF-16LE")).when(m == 1, F.encode("p_name", "UTF-16BE"))
            .otherwise(F.encode("p_name", "UTF-8")))
    return table(spark, sf, "part").select("p_partkey", detect.bomless_utf16(head).alias("encoding"))


@query("enc_ascii_utf8", "SELECT doc_id, CASE WHEN strlen(text) = length(text) THEN 'ascii' ELSE 'utf-8' END AS encoding FROM documents")
def _ascii(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", detect.utf8_class(F.encode("text", "UTF-8"), F.lit(False)).alias("encoding"))


@query("enc_legacy", """SELECT lang, CASE WHEN strlen(text) = length(text) THEN 'ascii' ELSE 'cp1252' END AS encoding,
  '1252' AS codepage, count(*) AS n FROM documents GROUP BY 1, 2""")
def _legacy(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.encode("text", "windows-1252").alias("head"))
    e = detect.detect_encoding(d)
    return e.groupBy("lang", "encoding", "codepage").agg(F.count(F.lit(1)).alias("n"))


@query("enc_codepage", """SELECT p_partkey, ['65001', '1252', '1200', '1201', '932', '20932', '936', '950', '1251', 'ACP'][p_size % 10 + 1] AS codepage FROM part""")
def _codepage(spark, sf):
    names = F.expr("array('UTF-8 ', 'ascii', 'utf-16', 'utf-16-be', 'cp932', 'euc-jp', 'gb2312', 'big5', 'cp1251', 'koi8-r')")
    return table(spark, sf, "part").select("p_partkey", detect.codepage(
        F.element_at(names, F.col("p_size") % 10 + 1)).alias("codepage"))


@query("dlm_sniff", """SELECT c_custkey, [',', chr(9), ';', '|', ':'][c_nationkey % 5 + 1] AS delimiter, c_nationkey % 2 = 0 AS has_header,
  CASE WHEN c_nationkey % 2 = 0 THEN ['id', 'name', 'segment'] ELSE ['column_1', 'column_2', 'column_3'] END AS header FROM customer""")
def _sniff(spark, sf):
    d = F.element_at(F.expr("array(',', '\\t', ';', '|', ':')"), F.col("c_nationkey") % 5 + 1)
    row = F.concat_ws("\u0000", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), "c_name", F.lit(',;"')), "c_mktsegment")
    head = F.when(F.col("c_nationkey") % 2 == 0, F.lit("id\u0000name\u0000segment\n")).otherwise(F.lit(""))
    sample = F.concat(head, row, F.lit("\n"), row, F.lit("\n"), row)
    s = table(spark, sf, "customer").select("c_custkey", F.replace(sample, F.lit("\u0000"), d).alias("sample"), F.lit("x.csv").alias("path"))
    return detect.detect_dialect(s).select("c_custkey", "delimiter", "has_header", "header")


@query("dlm_header", """SELECT p_partkey, p_size % 4 = 0 AS has_header FROM part""")
def _header(spark, sf):
    cells = F.array(F.lit("id"), F.concat("p_brand", F.lit("_c")), F.element_at(
        F.array(F.lit("note"), F.lit(" ID"), F.lit("1.5"), F.lit("")), F.col("p_size") % 4 + 1))
    return table(spark, sf, "part").select("p_partkey", detect.guess_header(cells).alias("has_header"))


@query("dlm_header_names", """
WITH w AS (SELECT item_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS c FROM (SELECT item_id, string_split(text, ' ') AS a FROM benchmark)),
n AS (SELECT item_id, pos, CASE WHEN trim(c) = '' THEN 'Unnamed: ' || pos ELSE c END AS c FROM w)
SELECT item_id, CAST(pos AS INTEGER) AS pos, CASE WHEN k = 1 THEN c ELSE c || '.' || (k - 1) END AS name FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, c ORDER BY pos) AS k FROM n)""")
def _names(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", detect.normalise_header(F.split("text", " ")).alias("h"))
    return b.select("item_id", F.posexplode("h").alias("pos", "name"))


@query("dlm_overrides", f"""SELECT ',' AS delimiter, 'override' AS delimiter_source, [{', '.join("'" + v + "'" for v in list(DELIMITER_NAMES.values())[:4])}][c_nationkey % 4 + 1] AS detected_name,
  CASE c_nationkey % 2 WHEN 0 THEN 'utf-8' ELSE 'cp932' END AS encoding, 'detected' AS encoding_source, count(*) AS n FROM customer GROUP BY 3, 4""")
def _overrides(spark, sf):
    d = F.element_at(F.expr("array(',', '\\t', '|', ';')"), F.col("c_nationkey") % 4 + 1)
    c = table(spark, sf, "customer").select(d.alias("delimiter"), F.when(
        F.col("c_nationkey") % 2 == 0, F.lit("utf-8")).otherwise("cp932").alias("encoding"))
    named = with_lookup(c, DELIMITER_NAMES, "delimiter", "detected_name")
    o = detect.with_overrides(named, {"fieldDelimiter": ","}, {"fieldDelimiter": "delimiter", "codepage": "encoding"})
    return o.groupBy("delimiter", "delimiter_source", "detected_name", "encoding", "encoding_source").agg(F.count(F.lit(1)).alias("n"))


@query("dlm_scan_mode", "SELECT doc_id, CASE WHEN n_chars <= 500 THEN 'full' ELSE 'sampled' END AS mode FROM documents")
def _mode(spark, sf):
    return table(spark, sf, "documents").select("doc_id", delimited.scan_mode(F.col("n_chars"), 500).alias("mode"))


# --- delimited and text files ----------------------------------------------------

def csv_copy(spark, sf, name):
    return staged(spark, (sf, name, "csv"), lambda p: text_table(spark, sf, name).write.option("header", True).option("escape", '"').csv(p))


@query("scan_delimited", """SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total,
  CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY 1""")
def _delimited(spark, sf):
    d = delimited.Dialect([c for c, _ in TEXT["customer"]])
    rows = delimited.read_delimited(spark, csv_copy(spark, sf, "customer"), d)
    return rows.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("decimal(28,2)").alias("total"),
        F.sum(F.col("c_custkey").cast("long")).alias("keys"))


for _t in ("lineitem", "orders"):
    def _make(name):
        @query(f"csv_profile_{name}", infer_sql(text_sql(name), [c for c, _ in TEXT[name]]))
        def _q(spark, sf):
            d = delimited.Dialect([c for c, _ in TEXT[name]])
            return delimited.profile_delimited(spark, csv_copy(spark, sf, name), d).select(*OUT)
    _make(_t)


@query("enc_decode_read", """SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(doc_id) AS BIGINT) AS keys FROM documents GROUP BY 1""")
def _decode(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string"), "lang", "text")
    path = staged(spark, (sf, "documents", "utf16"), lambda p: docs.write.option("header", True).option(
        "escape", '"').option("quoteAll", True).option("encoding", "UTF-16LE").csv(p))
    rows = delimited.read_delimited(spark, path, delimited.Dialect(["doc_id", "lang", "text"], encoding="utf-16-le"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"),
                                    F.sum(F.col("doc_id").cast("long")).alias("keys"))


@query("dlm_ragged", """SELECT CASE turn % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'long' ELSE 'short' END AS row_kind, count(*) AS n,
  CAST(sum(conv_id) AS BIGINT) AS keys FROM conversations GROUP BY 1""")
def _ragged(spark, sf):
    c = table(spark, sf, "conversations")
    m = F.col("turn") % 3
    base = F.concat_ws(",", F.col("conv_id").cast("string"), F.concat(F.lit('"a,'), "role", F.lit('"')))
    line = F.when(m == 0, F.concat(base, F.lit(",x"))).when(m == 1, F.concat(base, F.lit(',x,"y, ""z"""'))).otherwise(base)
    path = staged(spark, (sf, "conversations", "ragged"), lambda p: c.select(line.alias("value")).write.text(p))
    d = delimited.Dialect(["conv_id", "role", "note"], has_header=False)
    marked = delimited.mark_ragged(delimited.read_delimited(spark, path, d, ragged=True), d)
    return marked.groupBy("row_kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("conv_id").cast("long")).alias("keys"))


def text_copy(spark, sf):
    d = table(spark, sf, "documents").select(F.col("text").alias("value"))
    return staged(spark, (sf, "documents", "text"), lambda p: d.write.text(p))


LINES = "length(text) - length(replace(text, chr(10), '')) + 1"


@query("scan_text", f"SELECT CAST(sum({LINES}) AS BIGINT) AS lines, CAST((SELECT count(*) FROM (SELECT unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS l FROM documents) WHERE l = '') AS BIGINT) AS blank_lines FROM (SELECT replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents)")
def _text(spark, sf):
    s = delimited.line_stats(delimited.read_lines(spark, text_copy(spark, sf)))
    return s.agg(F.sum("lines").alias("lines"), F.sum("blank_lines").alias("blank_lines"))


@query("dlm_logical_rows", f"SELECT CAST(sum({LINES}) AS BIGINT) AS row_count FROM (SELECT replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents)")
def _logical(spark, sf):
    r = delimited.logical_rows(spark, text_copy(spark, sf), delimited.Dialect(["line"], has_header=False))
    return r.agg(F.sum("row_count").alias("row_count"))


@query("scan_whole_file", "SELECT CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents")
def _blob(spark, sf):
    return jsondocs.read_blob(spark, text_copy(spark, sf)).agg(F.sum(F.length("content")).alias("chars"))


@query("dlm_row_estimate", "SELECT count(*) AS row_count FROM orders")
def _estimate(spark, sf):
    o = table(spark, sf, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 20, "0").alias("value"))
    path = staged(spark, (sf, "orders", "fixed"), lambda p: o.write.text(p))
    inv = inventory.inventory(spark, path)
    e = delimited.estimate_rows(inv, delimited.Dialect(["line"], has_header=False))
    return e.agg(F.sum("row_count").alias("row_count"))


# --- JSON files -------------------------------------------------------------------

@query("scan_ndjson", """SELECT true AS is_ndjson, count(*) AS row_count, CAST(0 AS BIGINT) AS invalid_lines FROM events""")
def _ndjson(spark, sf):
    e = table(spark, sf, "events").select(F.col("props").alias("value"))
    path = staged(spark, (sf, "events", "ndjson"), lambda p: e.write.text(p))
    d = jsondocs.ndjson_decision(jsondocs.read_ndjson(spark, path))
    return d.agg(F.bool_and("is_ndjson").alias("is_ndjson"), F.sum("row_count").alias("row_count"),
                 F.sum("invalid_lines").alias("invalid_lines"))


@query("js_line_frame", "SELECT count(*) AS docs, CAST(sum(length(props)) AS BIGINT) AS chars FROM events")
def _frame(spark, sf):
    e = table(spark, sf, "events").select(F.col("props").alias("value"))
    path = staged(spark, (sf, "events", "ndjson"), lambda p: e.write.text(p))
    return jsondocs.frame_documents(spark, path).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.length("doc")).alias("chars"))


@query("scan_json_document", "SELECT c_nationkey, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY 1")
def _documents(spark, sf):
    from ..operators import jsonops
    c = table(spark, sf, "customer").select("c_nationkey", F.to_json(F.struct("c_custkey", "c_nationkey", "c_name")).alias("line"))
    arrays = jsonops.lines_to_array(c, "c_nationkey", "line").select(
        F.concat_ws("-", "c_nationkey", "part").alias("unit"), F.col("document").alias("value"))
    path = staged(spark, (sf, "customer", "arrays"), lambda p: arrays.write.partitionBy("unit").text(p))
    d = jsondocs.read_json_doc(spark, path)
    get = lambda p, t: F.variant_get("doc", p, t)
    return d.select(get("$.c_nationkey", "int").alias("c_nationkey"), get("$.c_custkey", "long").alias("k")).groupBy(
        "c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("keys"))


# --- parquet and ORC --------------------------------------------------------------

@query("scan_parquet", """SELECT l_returnflag, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem GROUP BY 1""")
def _parquet(spark, sf):
    li = columnar.read_parquet(spark, f"{sf}/lineitem.parquet")
    return li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


def _counts_sql(extra: str) -> str:
    return " UNION ALL ".join(f"SELECT '{t}.parquet' AS file_name, (SELECT count(*) FROM {t}) AS num_rows{extra}" for t in TABLES)


def _file(path="path"):
    return F.regexp_extract(path, r"/([^/]+\.parquet)(?:/|$)", 1)


@query("scan_parquet_footer", _counts_sql(", false AS failed"))
def _footer(spark, sf):
    inv = inventory.only_sources(inventory.inventory(spark, sf))
    f = columnar.parquet_footers(inv).select(_file().alias("file_name"), "num_rows", F.col("error").isNotNull().alias("failed"))
    return f.groupBy("file_name").agg(F.sum("num_rows").alias("num_rows"), F.bool_or("failed").alias("failed"))


@query("parquet_row_groups", _counts_sql(", true AS groups_agree"))
def _groups(spark, sf):
    inv = inventory.only_sources(inventory.inventory(spark, sf))
    g = columnar.row_group_stats(columnar.parquet_footers(inv))
    return g.groupBy(_file().alias("file_name")).agg(
        F.sum("group_rows").alias("num_rows"), F.bool_and(F.col("group_rows") == F.col("num_rows")).alias("groups_agree"))


def orc_copy(spark, sf):
    o = table(spark, sf, "orders")
    return staged(spark, (sf, "orders", "orc"), lambda p: o.write.option("compression", "zlib").orc(p))


@query("scan_orc", "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def _orc(spark, sf):
    return columnar.read_orc(spark, orc_copy(spark, sf)).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys"))


@query("scan_orc_recognise", "SELECT 'ZLIB' AS compression, count(*) AS num_rows, CAST(6 AS BIGINT) AS columns FROM orders")
def _orc_footer(spark, sf):
    f = columnar.orc_footers(inventory.only_sources(inventory.inventory(spark, orc_copy(spark, sf))))
    return f.groupBy("compression").agg(F.sum("num_rows").alias("num_rows"), F.max(F.size("columns")).cast("long").alias("columns"))


def hive_copy(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return staged(spark, (sf, "lineitem", "hive"), lambda p: li.write.partitionBy("l_returnflag").parquet(p))


@query("scan_hive_partitions", "SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY 1")
def _hive(spark, sf):
    p = columnar.read_partitioned(spark, hive_copy(spark, sf))
    return p.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


@query("scan_hudi_folder", "SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem")
def _hudi(spark, sf):
    return columnar.read_hudi_files(spark, hive_copy(spark, sf)).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@query("scan_wildcard", "SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem")
def _glob(spark, sf):
    return columnar.read_glob(spark, hive_copy(spark, sf), "l_returnflag=*/*.parquet").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


# --- Delta ------------------------------------------------------------------------

META = '{"type":"struct","fields":[{"name":"id","type":"long","nullable":false,"metadata":{}},{"name":"v","type":"decimal(9,2)","nullable":true,"metadata":{}},{"name":"xs","type":{"type":"array","elementType":"string","containsNull":true},"nullable":true,"metadata":{}}]}'


def event_log(spark, sf):
    """Events as an action log: errors remove the user's file, sign-ups set
    metadata, all other events add it."""
    e = spread_table(spark, sf, "events", "event_id", "user_id", "event_type", "props")
    path = F.concat(F.lit("part-"), F.col("user_id").cast("string"), F.lit(".parquet"))
    k = F.get_json_object("props", "$.k").cast("long")
    add = F.to_json(F.struct(F.struct(path.alias("path"), k.alias("size"), F.create_map(F.lit("t"), F.col("event_type")).alias("partitionValues"),
                                      F.to_json(F.struct(k.alias("numRecords"))).alias("stats")).alias("add")))
    rem = F.to_json(F.struct(F.struct(path.alias("path")).alias("remove")))
    meta = F.to_json(F.struct(F.struct(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("name"),
                                       F.lit(META).alias("schemaString"), F.array(F.lit("t")).alias("partitionColumns")).alias("metaData")))
    t = F.col("event_type")
    line = F.when(t == "error", rem).when(t == "signup", meta).otherwise(add)
    lines = e.select("event_id", F.lit(0).alias("n"), line.alias("text"))
    return delta.actions_from_lines(lines, "event_id", "n", "text")


_LAST = """SELECT user_id, arg_max(event_type, event_id) AS t, arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), event_id) AS k
  FROM events WHERE event_type <> 'signup' GROUP BY 1"""


@query("scan_delta_log", """SELECT event_type IN ('click', 'view', 'purchase') AS is_add, event_type = 'error' AS is_remove, event_type = 'signup' AS is_meta,
  false AS bad, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def _log(spark, sf):
    a = event_log(spark, sf)
    has = lambda c: F.col(f"action.{c}").isNotNull()
    return a.groupBy(has("add").alias("is_add"), has("remove").alias("is_remove"), has("metaData").alias("is_meta"), "bad").agg(
        F.count(F.lit(1)).alias("n"))


@query("delta_version", "SELECT max(event_id) AS version FROM events")
def _version(spark, sf):
    return delta.delta_version(event_log(spark, sf))


@query("delta_metadata", "SELECT 't' || arg_max(user_id, event_id) AS name, 't' AS part FROM events WHERE event_type = 'signup'")
def _meta(spark, sf):
    return delta.delta_metadata(event_log(spark, sf)).select("name", F.col("partitionColumns")[0].alias("part"))


@query("delta_schema", """SELECT name, CAST(pos AS INTEGER) AS pos, type, nullable FROM (SELECT max(event_id) FROM events WHERE event_type = 'signup'),
  (VALUES ('id', 0, 'int64', false), ('v', 1, 'decimal(9,2)', true), ('xs', 2, 'list', true)) AS t(name, pos, type, nullable)""")
def _schema(spark, sf):
    return delta.schema_columns(delta.delta_metadata(event_log(spark, sf)))


@query("delta_active_files", f"SELECT 'part-' || user_id || '.parquet' AS path, t, k AS num_records FROM ({_LAST}) WHERE t <> 'error'")
def _active(spark, sf):
    a = delta.delta_active_files(event_log(spark, sf))
    return a.select("path", F.col("partition_values")["t"].alias("t"), F.get_json_object("stats", "$.numRecords").cast("long").alias("num_records"))


@query("jn_anti_removed", """WITH r AS (SELECT user_id, max(event_id) AS gone FROM events WHERE event_type = 'error' GROUP BY 1)
  SELECT 'part-' || e.user_id || '.parquet' AS path, event_id AS version FROM events e LEFT JOIN r USING (user_id)
  WHERE event_type NOT IN ('error', 'signup') AND (gone IS NULL OR event_id > gone)""")
def _removed(spark, sf):
    a = event_log(spark, sf)
    adds = a.filter("action.add is not null").select(F.col("action.add.path").alias("path"), "version")
    rems = a.filter("action.remove is not null").select(F.col("action.remove.path").alias("path"), "version")
    return delta.without_removed(adds, rems)


@query("delta_row_count", f"""SELECT CAST(count(*) FILTER (WHERE t <> 'error') AS BIGINT) AS live_files,
  CAST(sum(k) FILTER (WHERE t <> 'error') AS BIGINT) AS row_count FROM ({_LAST})""")
def _rows(spark, sf):
    return delta.delta_row_count(event_log(spark, sf))


@query("scan_delta_fallback", f"SELECT path, size FROM ({LISTING_SQL}) WHERE starts_with(path, 'lake/src1/') AND ends_with(path, '.parquet') ORDER BY path LIMIT 1")
def _fallback(spark, sf):
    return delta.first_data_file(listing(spark, sf), "lake/src1")


def write_small(spark, path: str, text: str) -> None:
    """One small metadata file through the cluster's own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def delta_copy(spark, sf):
    """Orders as a Delta-style folder: one commit adds every file, the next one
    removes the files of status P."""
    def write(path):
        table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
        files = inventory.inventory(spark, path).select(F.regexp_extract("path", r"(o_orderstatus=.*)$", 1).alias("p"), "size")
        rows = files.filter("p <> ''").collect()                       # one entry per file, as any commit has
        fields = [("o_orderkey", "long"), ("o_custkey", "long"), ("o_orderstatus", "string")]
        schema = {"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in fields]}
        first = [{"metaData": {"id": "x", "schemaString": json.dumps(schema), "partitionColumns": ["o_orderstatus"], "configuration": {}}}]
        first += [{"add": {"path": r["p"], "size": r["size"], "partitionValues": {"o_orderstatus": r["p"][14:15]}, "dataChange": True}} for r in rows]
        second = [{"remove": {"path": r["p"]}} for r in rows if r["p"].startswith("o_orderstatus=P")]
        for v, actions in enumerate((first, second)):
            write_small(spark, f"{path}/_delta_log/{v:020d}.json", "\n".join(json.dumps(a) for a in actions))
    return staged(spark, (sf, "orders", "delta"), write)


@query("scan_delta_rows", "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def _delta_rows(spark, sf):
    return delta.delta_read(spark, delta_copy(spark, sf)).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


# --- Iceberg ----------------------------------------------------------------------

def metadata_docs(spark, sf):
    """One metadata document per part, in the three shapes tables use."""
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.expr("""concat('{"current-snapshot-id":', CASE WHEN p_size % 5 = 0 THEN 'null' ELSE string(p_partkey) END,
      ',"snapshots":[{"snapshot-id":', p_partkey + p_size % 4, ',"summary":{"total-records":"', p_size, '"}}],"current-schema-id":', p_size % 3,
      ',"schemas":[{"schema-id":0,"fields":[{"id":1,"name":"a","required":true,"type":"long"}]},',
      '{"schema-id":1,"fields":[{"id":1,"name":"b","required":false,"type":"decimal(', p_size % 9 + 1, ', 0)"},{"id":2,"name":"l","required":false,"type":{"type":"list","element":"int"}}]}],',
      '"default-spec-id":', p_size % 2, ',"partition-specs":[{"spec-id":1,"fields":[{"name":"bucket_', p_partkey, '","transform":"bucket[4]","source-id":1,"field-id":1000}]}]}')""").alias("doc"))


@query("iceberg_row_count", """SELECT p_partkey, CAST(CASE WHEN p_size % 5 = 0 THEN 0 WHEN p_size % 4 = 0 THEN p_size END AS BIGINT) AS row_count FROM part""")
def _ice_rows(spark, sf):
    return metadata_docs(spark, sf).select("p_partkey", iceberg.iceberg_row_count(F.col("doc")).alias("row_count"))


@query("iceberg_schema", """SELECT p_partkey, 0 AS pos, 'a' AS name, 'int64' AS type, false AS nullable FROM part WHERE p_size % 3 = 0
  UNION ALL SELECT p_partkey, 0, 'b', 'decimal(' || (p_size % 9 + 1) || ',0)', true FROM part WHERE p_size % 3 <> 0
  UNION ALL SELECT p_partkey, 1, 'l', 'list', true FROM part WHERE p_size % 3 <> 0""")
def _ice_schema(spark, sf):
    return iceberg.iceberg_schema(metadata_docs(spark, sf), "p_partkey")


@query("iceberg_spec", """SELECT p_partkey, 0 AS pos, 'bucket_' || p_partkey AS name, 'bucket[4]' AS transform, 1 AS source_id FROM part WHERE p_size % 2 = 1""")
def _ice_spec(spark, sf):
    return iceberg.iceberg_partition_spec(metadata_docs(spark, sf), "p_partkey")


def metadata_listing(spark, sf):
    o = table(spark, sf, "orders")
    name = F.expr("""CASE o_orderkey % 3 WHEN 0 THEN concat('v', o_orderkey % 50, '.metadata.json')
      WHEN 1 THEN concat(lpad(o_orderkey % 50, 5, '0'), '-abc.metadata.json') ELSE 'current.metadata.json' END""")
    return o.select(F.concat(F.lit("t"), F.col("o_custkey").cast("string"), F.lit("/metadata/"), name).alias("path"),
                    F.lit(1).alias("size"), F.col("o_orderdate").alias("mtime"))


_ICE_LIST = """SELECT 't' || o_custkey AS root, o_orderdate AS mtime, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderkey % 50 END AS version,
  't' || o_custkey || '/metadata/' || CASE o_orderkey % 3 WHEN 0 THEN 'v' || (o_orderkey % 50) || '.metadata.json'
   WHEN 1 THEN lpad(CAST(o_orderkey % 50 AS VARCHAR), 5, '0') || '-abc.metadata.json' ELSE 'current.metadata.json' END AS file FROM orders"""


@query("iceberg_latest", f"""SELECT root, file, version FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY coalesce(version, -1) DESC, mtime DESC, file DESC) AS rn
  FROM ({_ICE_LIST})) WHERE rn = 1""")
def _ice_latest(spark, sf):
    return iceberg.iceberg_latest(metadata_listing(spark, sf))


@query("iceberg_version", f"SELECT root, version FROM ({_ICE_LIST})")
def _ice_version(spark, sf):
    m = metadata_listing(spark, sf)
    return m.select(F.substring_index("path", "/", 1).alias("root"), iceberg.iceberg_version(F.col("path")).alias("version"))


def iceberg_copy(spark, sf):
    """Suppliers as an Iceberg-style folder with two metadata files."""
    def write(path):
        s = table(spark, sf, "supplier")
        s.write.parquet(path + "/data")
        n = s.count()
        for name, total in (("v9", 1), ("v10", n)):
            write_small(spark, f"{path}/metadata/{name}.metadata.json", json.dumps({
                "format-version": 2, "current-snapshot-id": 7, "current-schema-id": 0, "default-spec-id": 0,
                "snapshots": [{"snapshot-id": 7, "summary": {"total-records": str(total)}}],
                "schemas": [{"schema-id": 0, "fields": [{"id": 1, "name": "s_suppkey", "required": True, "type": "long"}]}],
                "partition-specs": [{"spec-id": 0, "fields": []}]}))
    return staged(spark, (sf, "supplier", "iceberg"), write)


@query("scan_iceberg_metadata", "SELECT CAST(10 AS BIGINT) AS version, count(*) AS row_count, '2' AS format_version FROM supplier")
def _ice_current(spark, sf):
    c = iceberg.iceberg_current(spark, inventory.inventory(spark, iceberg_copy(spark, sf)))
    return c.select("version", "row_count", "format_version")


@query("scan_iceberg_rows")
def _ice_rows_preview(spark, sf):
    path = iceberg_copy(spark, sf)
    return iceberg.iceberg_preview(spark, inventory.inventory(spark, path), path).select("s_suppkey", "s_name")


# --- set operations ---------------------------------------------------------------

@query("st_union_keys", """SELECT s_suppkey AS k, s_name AS name, NULL AS p_brand FROM supplier UNION ALL SELECT p_partkey, p_name, p_brand FROM part""")
def _union(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    b = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), "p_brand")
    return setops.union_all([a, b])


@query("st_except", """WITH a AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
  SELECT coalesce(a.k, b.k) AS k, CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'missing' ELSE 'extra' END AS side,
  abs(coalesce(a.n, 0) - coalesce(b.n, 0)) AS copies FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def _except(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"))
    return setops.multiset_diff(a, table(spark, sf, "orders").select(F.col("o_custkey").alias("k")))


@query("jn_manifest", """SELECT coalesce(d, l) AS path, CASE WHEN d IS NULL THEN 'missing' WHEN l IS NULL THEN 'extra' ELSE 'same' END AS status
  FROM (SELECT doc_id AS d FROM documents) FULL JOIN (SELECT doc_id * 2 AS l FROM labels) ON d = l""")
def _align(spark, sf):
    return setops.align(table(spark, sf, "documents").select(F.col("doc_id").alias("path")),
                        table(spark, sf, "labels").select((F.col("doc_id") * 2).alias("path")))
