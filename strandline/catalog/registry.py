"""Registration of queries and shared derived relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def add(fn):
        from ..workspace import configure

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Chosen columns, dealt out over all cores when the table is small."""
    from ..workspace import spread_small
    return spread_small(table(spark, sf_dir, name).select(*cols))


# A lake listing derived from documents: loose files, a table folder with a log,
# its data files, an Iceberg-style folder and a hidden folder per source.
LISTING_SQL = """
SELECT doc_id, CASE
    WHEN n_chars % 11 = 0 THEN 'lake/' || source || '/.cache/' || doc_id || '.tmp'
    WHEN lang = 'de' THEN 'lake/' || source || '/tbl/_delta_log/' || doc_id || '.json'
    WHEN lang = 'fr' THEN 'lake/' || source || '/tbl/data/' || doc_id || '.parquet'
    WHEN lang = 'es' THEN 'lake/' || source || '/ice/metadata/v' || doc_id || '.metadata.json'
    ELSE 'lake/' || source || '/' || lang || '/' || doc_id || '.' ||
      CASE n_chars % 7 WHEN 0 THEN 'csv' WHEN 1 THEN 'JSON' WHEN 2 THEN 'parquet' WHEN 3 THEN 'bin'
        WHEN 4 THEN 'txt' WHEN 5 THEN 'xlsx' ELSE 'ndjson' END END AS path,
  n_chars AS size FROM documents"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing as an inventory relation (``mtime`` from the document id)."""
    docs = table(spark, sf_dir, "documents")
    ext = F.element_at(F.expr("array('csv','JSON','parquet','bin','txt','xlsx','ndjson')"),
                       (F.col("n_chars") % 7 + 1).cast("int"))
    at = lambda *p: F.concat(F.lit("lake/"), F.col("source"), *p)
    n = F.col("doc_id").cast("string")
    path = (F.when(F.col("n_chars") % 11 == 0, at(F.lit("/.cache/"), n, F.lit(".tmp")))
            .when(F.col("lang") == "de", at(F.lit("/tbl/_delta_log/"), n, F.lit(".json")))
            .when(F.col("lang") == "fr", at(F.lit("/tbl/data/"), n, F.lit(".parquet")))
            .when(F.col("lang") == "es", at(F.lit("/ice/metadata/v"), n, F.lit(".metadata.json")))
            .otherwise(at(F.lit("/"), F.col("lang"), F.lit("/"), n, F.lit("."), ext)))
    return docs.select("doc_id", path.alias("path"), F.col("n_chars").alias("size"),
                       F.timestamp_seconds("doc_id").alias("mtime"))


# Documents of mixed shape derived from orders.
ORDER_DOC_SQL = """
SELECT o_orderkey, '{"id":' || o_orderkey || ',"total":' || CAST(o_totalprice AS DECIMAL(12,2)) ||
  ',"status":"' || o_orderstatus || '","flag":' || CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END ||
  ',"mixed":' || CASE WHEN o_orderstatus = 'F' THEN '"n"' ELSE '1' END ||
  CASE o_orderstatus WHEN 'F' THEN ',"tags":["a","b"]' WHEN 'O' THEN ',"note":null'
    ELSE ',"extra":{"x":' || o_custkey || '}' END || '}' AS doc FROM orders"""


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    s = F.col("o_orderstatus")
    text = lambda c: F.col(c).cast("string")
    doc = F.concat(
        F.lit('{"id":'), text("o_orderkey"), F.lit(',"total":'),
        F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.lit(',"status":"'), s,
        F.lit('","flag":'), F.when(F.col("o_custkey") % 2 == 0, F.lit("true")).otherwise("false"),
        F.lit(',"mixed":'), F.when(s == "F", F.lit('"n"')).otherwise("1"),
        F.when(s == "F", F.lit(',"tags":["a","b"]')).when(s == "O", F.lit(',"note":null'))
        .otherwise(F.concat(F.lit(',"extra":{"x":'), text("o_custkey"), F.lit("}"))), F.lit("}"))
    return o.select(F.col("o_orderkey"), F.col("o_orderkey").alias("row_id"), doc.alias("doc"))
