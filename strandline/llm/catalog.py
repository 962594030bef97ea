"""Registered queries of the text operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import configure
from .common import source_table, word_count, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base findings of every document, and weak credential parts that complete one another."""
    from .secrets import scan_secrets, spans_text
    found = scan_secrets(source_table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.array_sort(F.concat("base", "linked"))).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"))


@query("op3_mix_sources")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document, so that each source meets its target of words."""
    from .mixing import mix
    docs = source_table(spark, sf_dir, "documents")
    mixed = mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                            F.xxhash64("text").alias("text_hash")),
                F.col("source"), F.col("size"), [F.col("doc_id"), F.col("text_hash")])
    return mixed.select("row.doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target",
                        (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "rate")


@query("op8_shard_shuffle")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards of equal row counts, in random order."""
    from .sharding import shuffle_into_shards
    text = F.coalesce("text", F.lit(""))
    docs = source_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64("text").alias("text_hash"))
    placed = shuffle_into_shards(docs, 8, [F.col("doc_id"), F.col("text_hash")], stored=True)
    return placed.select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and the likelihood-ratio verdict of every document.

    Trusted are the documents with label quality 1.
    """
    from .qualityrules import quality_rules
    docs = source_table(spark, sf_dir, "documents")
    trusted = source_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules(docs, trusted)


@query("op1_quality_votes")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by votes of its labelled neighbours."""
    from .classifier import classify, held_out
    docs = source_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, source_table(spark, sf_dir, "labels"))
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted")


CONTAMINATION_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, ws, least(len(ws), 13) AS k FROM (SELECT item_id, regexp_extract_all(translate(text,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
      FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS g
      FROM (SELECT item_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT k FROM windows),
spots AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g FROM
      (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, sizes)),
hits AS (SELECT DISTINCT s.doc_id, s.i, s.k, m.item_id FROM spots s JOIN windows m USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY 1),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)"""


@query("op5_benchmark_scan", CONTAMINATION_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    from .decontaminate import find_contamination
    found = find_contamination(source_table(spark, sf_dir, "documents").select("doc_id", "text"),
                               source_table(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op6_simhash_components")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    from .simhash import near_duplicates
    out = near_duplicates(source_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


REPEATS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
firsts AS (SELECT md5(g) AS g, min(doc_id) AS first_id FROM windows GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT x.doc_id, unnest(range(x.i, x.i + 50)) AS j
      FROM windows x JOIN firsts f ON md5(x.g) = f.g AND f.first_id < x.doc_id) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN js IS NULL THEN ws
    ELSE list_filter(ws, lambda x, k: NOT list_contains(js, k)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)"""


@query("op4_repeat_removal", REPEATS_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a document of smaller id has in a window of 50."""
    from .repeats import remove_repeats
    return remove_repeats(source_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


@query("op7_main_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the paths its host agrees on."""
    from .maintext import extract
    out = extract(source_table(spark, sf_dir, "pages"))
    return out.select("row.page_id", "row.url", F.col("main_text").alias("text"),
                      F.length("main_text").cast("long").alias("n_chars"))


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram tokens of every document, with the pieces of a public vocabulary file."""
    from .tokencounts import VOCABULARY, read_pieces, token_counts, zipf_scores
    return token_counts(source_table(spark, sf_dir, "documents"), zipf_scores(read_pieces(VOCABULARY)))


RUNS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
      FROM documents),
h AS (SELECT *, len(ws) AS n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
      string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 256, 256, 256, 256, 256, 256, 256, 256]))),
      lambda x, y: CASE WHEN y < 256 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END),
      CAST(4294967295 AS BIGINT)) AS h FROM d),
plan AS (SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p, h % 10 = 0 AS planted FROM h WHERE n > 0),
w AS (SELECT r, i, CASE WHEN planted AND i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END AS word
      FROM (SELECT *, unnest(range(n)) AS i FROM plan)),
equal AS (SELECT x.r, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.r = y.r AND x.word = y.word AND x.i < y.i),
island AS (SELECT r, q, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k, i FROM equal),
stretch AS (SELECT r, q, min(i) AS s, count(*) + q AS m FROM island GROUP BY r, q, k
      HAVING count(*) + q >= greatest(12, 2 * q)),
runs AS (SELECT r, s, m, min(q) AS q FROM stretch GROUP BY r, s, m),
best AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
      min_by({'s': s, 'm': m, 'q': q}, {'m': -m, 's': s, 'q': q}) AS top FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + m)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM w ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(top.s AS BIGINT) AS start, CAST(top.m AS BIGINT) AS length,
  CAST(top.q AS BIGINT) AS period, CAST(1000 * top.m // top.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""


NEGATIVES_SQL = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
      CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
    AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, with a seventh of the labels moved on."""
    from .negatives import mine
    i, label = F.col("vec_id"), F.col("label")
    rows = source_table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.when(i % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
    return mine(rows, lambda v: v % 50 == 0)


MATCHES_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT *, len(x) // 2 AS n FROM d),
starts AS (SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS k FROM (SELECT r, x, unnest(range(n - 199)) AS i FROM n WHERE n >= 200)),
hit AS (SELECT r, i FROM starts JOIN (SELECT k FROM starts GROUP BY k HAVING count(*) > 1) USING (k)),
island AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i,
      CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM hit)),
span AS (SELECT r, min(i) AS s, max(i) + 200 AS e FROM island GROUP BY r, g),
gap AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS before FROM span),
cut AS (SELECT r, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS last,
      string_agg(substr(x, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS x FROM gap JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n_removed IS NULL THEN n.x ELSE cut.x || substr(n.x, 2 * last + 1) END)) AS kept_sha256
FROM n LEFT JOIN cut USING (r)"""


@query("op12_byte_matches", MATCHES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a string of 200 has in common with any other place."""
    from .suffixes import remove_matches
    return remove_matches(source_table(spark, sf_dir, "documents")).drop("kept")


@query("op13_periodic_runs", RUNS_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, some of which the ids plant, and what stays of its words."""
    from .runs import find_runs, longest_run, plant_runs, runs_text
    docs = source_table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", words(F.col("text")).alias("words"))
    text = F.array_join(plant_runs(F.col("doc_id"), F.col("words")), " ")
    found = find_runs(docs.select("doc_id", text.alias("text"))).withColumn("top", longest_run(F.col("runs")))
    return found.select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(runs_text(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over documents."""
    from corpus_pipeline import run
    return run(spark, sf_dir)
