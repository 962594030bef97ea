"""Queries over text, URL and HTML columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html, text, urls
from ..functions.text import FULL_REDACT_RULES, REDACT_RULES, SECRET_SHAPES
from ..operators import setops
from .registry import query, spread_table, table


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold_sql(expr: str, rules) -> str:
    for pattern, replacement in rules:
        expr = f"regexp_replace({expr}, {_lit(pattern)}, {_lit(replacement.replace('$1', chr(92) + '1'))}, 'g')"
    return expr


@query("tx_redact", f"SELECT doc_id, {fold_sql('text', REDACT_RULES)} AS redacted FROM documents")
def _redact(spark, sf):
    return spread_table(spark, sf, "documents", "doc_id", "text").select("doc_id", text.redact(F.col("text")).alias("redacted"))


@query("tx_redact_full", f"SELECT doc_id, {fold_sql('text', FULL_REDACT_RULES)} AS redacted FROM documents")
def _redact_full(spark, sf):
    return spread_table(spark, sf, "documents", "doc_id", "text").select("doc_id", text.redact_full(F.col("text")).alias("redacted"))


@query("tx_redact_url", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN split_part(url, '?', 1) || '?[redacted]' ELSE u END AS u FROM (
  SELECT page_id, url, CASE WHEN page_id % 3 = 1 THEN split_part(url, '#', 1) || '?a=1&b=2' ELSE url END AS u FROM pages)""")
def _redact_url(spark, sf):
    p = table(spark, sf, "pages")
    m = F.col("page_id") % 3
    u = (F.when(m == 0, F.concat(F.substring_index("url", "?", 1), F.lit("?Sv=1&SIG=abc")))
         .when(m == 1, F.concat(F.substring_index("url", "#", 1), F.lit("?a=1&b=2"))).otherwise(F.col("url")))
    return p.select("page_id", text.redact_url(u).alias("u"))


@query("tx_mask_tail", """SELECT c_custkey, '****' || right(c_name, 4) AS masked, repeat('*', least(length(c_mktsegment), 20)) AS full_mask FROM customer""")
def _mask(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", text.mask_tail(F.col("c_name")).alias("masked"),
                    text.mask_tail(F.col("c_mktsegment"), 20).alias("full_mask"))


_SHAPE_SQL = " UNION ALL ".join(
    f"SELECT doc_id, line, '{k}' AS kind, regexp_extract(probe, {_lit(p)}, 0) AS found FROM probes"
    for k, p in SECRET_SHAPES)


@query("tx_secret_findings", f"""
WITH lines AS (SELECT doc_id, generate_subscripts(a, 1) AS line, unnest(a) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
probes AS (SELECT doc_id, line, regexp_replace(raw, '<[^<>\n]{{1,80}}>', '<>', 'g') AS probe FROM lines),
hits AS ({_SHAPE_SQL})
SELECT doc_id, CAST(line AS INTEGER) AS line, kind, split_part(substr(found, 1, 12), '=', 1) || '=<' || length(found) || ' chars>' AS excerpt
FROM hits WHERE found <> ''""")
def _findings(spark, sf):
    return text.secret_findings(spread_table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")


@query("tx_sensitive_flag", f"""SELECT doc_id, {' OR '.join(f"regexp_matches(text, {_lit(p)})" for p in text.SENSITIVE_SHAPES)} AS sensitive FROM documents""")
def _sensitive(spark, sf):
    return spread_table(spark, sf, "documents", "doc_id", "text").select("doc_id", text.sensitive_flag(F.col("text")).alias("sensitive"))


@query("tx_clean_name", """SELECT s_suppkey, regexp_replace(s_name, '[^A-Za-z0-9_]', '_', 'g') AS clean,
  'col_' || s_suppkey || '_x' AS digit, replace(s_name, '#', '##') AS escaped FROM supplier""")
def _clean(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey", text.clean_name(F.col("s_name")).alias("clean"),
                    text.clean_name(F.concat(F.col("s_suppkey").cast("string"), F.lit("-x"))).alias("digit"),
                    text.escape_name(F.col("s_name"), "#").alias("escaped"))


@query("tx_escape", """SELECT doc_id, length(e) AS n, md5(e) AS digest FROM (SELECT doc_id, replace(regexp_replace(coalesce(text, '') || chr(9) || chr(10) || '`e`',
  '[\\x00-\\x1F\\x7F\\x{85}\\x{2028}\\x{2029}]+', ' ', 'g'), 'e', 'ee') AS e FROM documents)""")
def _escape(spark, sf):
    """Whole texts as names: runs of control characters become one blank, the quoting letter is doubled."""
    d = spread_table(spark, sf, "documents", "doc_id", "text")
    e = d.select("doc_id", text.escape_name(F.concat(F.coalesce("text", F.lit("")), F.lit("\t\n`e`")), "e").alias("e"))
    return e.select("doc_id", F.length("e").cast("long").alias("n"), F.md5("e").alias("digest"))


@query("tx_safe_file_name", """SELECT page_id, CASE WHEN n = '' THEN 'dataset' ELSE substr(n, 1, 120) END AS safe FROM (
  SELECT page_id, trim(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), '._') AS n FROM pages)""")
def _safe(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.safe_file_name(F.col("url")).alias("safe"))


@query("tx_data_extension", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN '.parquet' WHEN 1 THEN '.csv' WHEN 2 THEN NULL ELSE '.json' END AS ext FROM pages""")
def _ext(spark, sf):
    base = F.regexp_replace("url", r"[?#].*$", "")
    e = F.element_at(F.array(F.lit("/d.PARQUET?x=1"), F.lit("/d.csv#f"), F.lit("/d.exe?n=a.csv"), F.lit("/d.json")),
                     (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", text.data_extension(F.concat(base, e)).alias("ext"))


# storage URLs of every kind derived from orders
URL_CASES = [
    ("local", "'data/' || o_orderkey || '.csv'"),
    ("s3", "'s3://bucket' || o_custkey || '/k/' || o_orderkey || '.parquet'"),
    ("other", "'s3://bucket' || o_custkey"),
    ("azure", "'https://acct' || o_custkey || '.blob.core.windows.net/c/p/' || o_orderkey || '.csv'"),
    ("other", "'https://acct.blob.core.windows.net.evil' || o_custkey || '.com/c/p.csv'"),
    ("azure", "'abfss://cont@acct' || o_custkey || '.dfs.core.windows.net/p/' || o_orderkey || '.csv'"),
    ("onelake", "'https://onelake.dfs.fabric.microsoft.com/ws/item' || o_custkey || '/Files/a/' || o_orderkey || '.csv'"),
    ("other", "'https://user@acct' || o_custkey || '.blob.core.windows.net/c/p.csv'"),
    ("azure", "'azure://cont' || o_custkey || '/p/' || o_orderkey || '.csv'"),
    ("other", "'ftp://host/' || o_orderkey || '.csv'"),
]
URL_SQL = "CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN {e}" for i, (_, e) in enumerate(URL_CASES)) + " END"


def order_urls(spark, sf):
    o = spread_table(spark, sf, "orders", "o_orderkey", "o_custkey").withColumn("r", F.col("o_orderkey") % 10)
    chain = F
    for i, (_, e) in enumerate(URL_CASES):
        chain = chain.when(F.col("r") == i, F.expr(e))
    return o.select("o_orderkey", chain.alias("url"))


@query("url_kind", f"""SELECT o_orderkey, {URL_SQL} AS url, CASE o_orderkey % 10 {' '.join(f"WHEN {i} THEN '{k}'" for i, (k, _) in enumerate(URL_CASES))} END AS kind FROM orders""")
def _kind(spark, sf):
    return order_urls(spark, sf).select("o_orderkey", "url", urls.url_kind(F.col("url")).alias("kind"))


_PLACE = "'<storage_account>.dfs.core.windows.net', '<container>', '<path>/f.csv'"
_PARTS = [
    _PLACE, "'s3.amazonaws.com', 'bucket' || o_custkey, 'k/' || o_orderkey || '.parquet'",
    "'s3.amazonaws.com', 'bucket' || o_custkey, 'f.csv'",
    "'acct' || o_custkey || '.blob.core.windows.net', 'c', 'p/' || o_orderkey || '.csv'", _PLACE,
    "'acct' || o_custkey || '.dfs.core.windows.net', 'cont', 'p/' || o_orderkey || '.csv'",
    "'onelake.dfs.fabric.microsoft.com', 'ws/item' || o_custkey || '/Files', 'a/' || o_orderkey || '.csv'",
    "'user@acct' || o_custkey || '.blob.core.windows.net', 'c', 'p.csv'",
    "'<storage_account>.dfs.core.windows.net', 'cont' || o_custkey, 'p/' || o_orderkey || '.csv'", _PLACE]


@query("url_parts", " UNION ALL ".join(
    f"SELECT o_orderkey, x.a AS account_host, x.b AS container, x.c AS relative_path FROM (SELECT o_orderkey, "
    f"struct_pack(a := {p.split(', ')[0]}, b := {p.split(', ')[1]}, c := {p.split(', ')[2]}) AS x FROM orders WHERE o_orderkey % 10 = {i})"
    for i, p in enumerate(_PARTS)))
def _parts(spark, sf):
    u = order_urls(spark, sf).select("o_orderkey", urls.url_parts(F.col("url"), F.lit("d/f.csv")).alias("p"))
    return u.select("o_orderkey", "p.*")


@query("url_join", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'https://h/' || source || '/' || doc_id || '.csv'
  WHEN 1 THEN 'https://h/' || source || '/' || doc_id || '.csv' WHEN 2 THEN 'https://h/' || source || '.csv' ELSE NULL END AS u FROM documents""")
def _join(spark, sf):
    m = F.col("doc_id") % 4
    h = F.concat(F.lit("https://h/"), F.col("source"))
    base = F.when(m == 0, F.concat(h, F.lit("/"))).when(m == 1, h).when(m == 2, F.concat(h, F.lit(".csv")))
    name = F.concat(F.lit("a\\b/"), F.col("doc_id").cast("string"), F.lit(".csv"))
    return table(spark, sf, "documents").select("doc_id", urls.url_join(base, name).alias("u"))


@query("url_listable_prefix", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || '/' WHEN 1 THEN '' ELSE source || '/' || lang END AS p FROM documents""")
def _prefix(spark, sf):
    m = F.col("doc_id") % 3
    p = (F.when(m == 0, F.concat("source", F.lit("/x*"), "lang")).when(m == 1, F.concat("source", F.lit("[a]/b")))
         .otherwise(F.concat("source", F.lit("/"), "lang")))
    return table(spark, sf, "documents").select("doc_id", urls.listable_prefix(p).alias("p"))


@query("url_validate", r"""SELECT s_suppkey, regexp_matches('acct' || s_suppkey, '^[a-z0-9]{3,24}$') AS account, false AS bad_account,
  s_nationkey % 2 = 0 AS container, s_nationkey % 3 <> 0 AS blob FROM supplier""")
def _valid(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey").cast("string")
    cont = F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("cont-"), k)).otherwise(F.concat(F.lit("cont--"), k))
    blob = F.when(F.col("s_nationkey") % 3 == 0, F.concat(F.lit("a/../"), k)).otherwise(F.concat(F.lit("a/"), k))
    return s.select("s_suppkey", urls.valid_account(F.concat(F.lit("acct"), k)).alias("account"),
                    urls.valid_account(F.col("s_name")).alias("bad_account"),
                    urls.valid_container(cont).alias("container"), urls.valid_blob(blob).alias("blob"))


# --- HTML ----------------------------------------------------------------------------

_UNESC = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '&quot;?', chr(34), 'g'), '&middot;?', chr(183), 'g'),"
          " '&copy;?', chr(169), 'g'), '&amp;?', '&', 'g')")
_COLL = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query("html_title", f"""SELECT page_id, trim(split_part({_COLL.format(_UNESC.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))}, '|', 1)) AS title FROM pages""")
def _title(spark, sf):
    return html.page_titles(table(spark, sf, "pages"))


_NO_TITLE = "(?is)<title[^>]*>.*?</title>"


@query("html_title_or_segment", f"""SELECT page_id, CASE WHEN page_id % 3 = 0 OR t = '' THEN regexp_extract(rtrim(regexp_replace(url, '[?#].*$', ''), '/'), '([^/]*)$', 1)
  ELSE t END AS title FROM (SELECT page_id, url, trim(split_part({_COLL.format(_UNESC.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))}, '|', 1)) AS t FROM pages)""")
def _title_or_segment(spark, sf):
    """Every third page loses its title and is called by its address."""
    pages = spread_table(spark, sf, "pages", "page_id", "url", "html")
    untitled = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", _NO_TITLE, "")).otherwise(F.col("html"))
    return html.page_titles(pages.withColumn("html", untitled), url="url")


_LINKS = f"""
WITH a AS (SELECT page_id, url AS base, generate_subscripts(h, 1) - 1 AS pos, unnest(h) AS href, unnest(l) AS label FROM (
  SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*"([^"]*)"[^>]*>(.*?)</a\\s*>', 1) AS h,
    regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*"([^"]*)"[^>]*>(.*?)</a\\s*>', 2) AS l FROM pages)),
b AS (SELECT page_id, base, pos, split_part({_UNESC.format('href')}, '#', 1) AS ref,
  {_COLL.format(_UNESC.format("regexp_replace(label, '<[^>]*>', '', 'g')"))} AS label FROM a WHERE href <> ''),
c AS (SELECT page_id, pos, label, CASE WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN ref
  WHEN starts_with(ref, '/') THEN regexp_extract(base, '^(https?://[^/?#]*)', 1) || ref
  WHEN ref = '' THEN split_part(base, '#', 1)
  WHEN starts_with(ref, '?') THEN regexp_extract(base, '^([^?#]*)', 1) || ref
  ELSE regexp_extract(base, '^(https?://[^?#]*/)', 1) || ref END AS url FROM b)
"""


@query("html_links", _LINKS + "SELECT page_id, url, CAST(min(pos) AS INTEGER) AS pos, arg_min(label, pos) AS label FROM c GROUP BY 1, 2")
def _links(spark, sf):
    return html.page_links(spread_table(spark, sf, "pages", "page_id", "url", "html"))


@query("st_distinct_first", _LINKS + "SELECT url, min(page_id) AS page_id FROM c GROUP BY 1")
def _first_links(spark, sf):
    links = html.page_links(spread_table(spark, sf, "pages", "page_id", "url", "html")).select("url", "page_id", "pos")
    return setops.distinct_first(links, "url", ["page_id", "pos"]).select("url", "page_id")


# pages with code blocks derived from orders
CODE_SQL = """SELECT o_custkey AS page_id, o_orderkey AS k, '<p>x</p><pre class="c"><b>' || CASE o_orderkey % 5
  WHEN 0 THEN 'https://data' || o_custkey || '.blob.core.windows.net/c/' || o_orderkey || '.parquet.'
  WHEN 1 THEN 'abfss://c@data' || o_custkey || '.dfs.core.windows.net/p/*.csv'
  WHEN 2 THEN 'https://data1.blob.core.windows.net/c/folder?x=1' WHEN 3 THEN 'https://example.org/nothing'
  ELSE 'wasbs://c@data1.blob.core.windows.net/a.json,' END || '</b></pre>' AS html FROM orders"""
CAND_SQL = f"""
WITH h AS ({CODE_SQL}),
u AS (SELECT k AS page_id, rtrim(regexp_extract(html, '<b>([^<]*)</b>', 1), '.,;:') AS url, k % 5 AS m FROM h)
SELECT page_id, 0 AS pos, url, split_part(url, '://', 1) AS scheme,
  CASE m WHEN 0 THEN 'download' WHEN 2 THEN 'folder' ELSE 'virtualise' END AS kind,
  CASE m WHEN 0 THEN '.parquet' WHEN 1 THEN '.csv' WHEN 4 THEN '.json' END AS extension,
  m IN (1, 2) AS wildcard FROM u WHERE m <> 3"""


def code_pages(spark, sf):
    o = spread_table(spark, sf, "orders", "o_orderkey", "o_custkey")
    url = F.expr("""CASE o_orderkey % 5
      WHEN 0 THEN 'https://data' || o_custkey || '.blob.core.windows.net/c/' || o_orderkey || '.parquet.'
      WHEN 1 THEN 'abfss://c@data' || o_custkey || '.dfs.core.windows.net/p/*.csv'
      WHEN 2 THEN 'https://data1.blob.core.windows.net/c/folder?x=1' WHEN 3 THEN 'https://example.org/nothing'
      ELSE 'wasbs://c@data1.blob.core.windows.net/a.json,' END""")
    return o.select(F.col("o_orderkey").alias("page_id"),
                    F.concat(F.lit('<p>x</p><pre class="c"><b>'), url, F.lit("</b></pre>")).alias("html"),
                    F.concat(F.lit("https://site/"), F.col("o_orderkey").cast("string"),
                             F.when(F.col("o_custkey") % 7 == 0, F.lit(".csv")).otherwise("")).alias("url"))


@query("html_candidates", CAND_SQL)
def _cands(spark, sf):
    return html.storage_candidates(code_pages(spark, sf))


@query("html_page_kind", """SELECT o_orderkey AS page_id, CAST(0 AS BIGINT) AS links, CAST(CASE WHEN o_orderkey % 5 = 3 THEN 0 ELSE 1 END AS BIGINT) AS candidates,
  CASE WHEN o_custkey % 7 = 0 THEN 'data' WHEN o_orderkey % 5 = 3 THEN 'rejected' ELSE 'dataset' END AS kind FROM orders""")
def _page_kind(spark, sf):
    return html.page_kind(code_pages(spark, sf))


@query("html_page_kind_pages", """SELECT page_id, CAST(len(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*"([^"]*)"[^>]*>(.*?)</a\\s*>', 1)) AS BIGINT) AS links,
  CAST(0 AS BIGINT) AS candidates, CASE WHEN len(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*"([^"]*)"[^>]*>(.*?)</a\\s*>', 1)) > 0
  THEN 'catalog' ELSE 'rejected' END AS kind FROM pages""")
def _page_kind2(spark, sf):
    return html.page_kind(table(spark, sf, "pages"))
