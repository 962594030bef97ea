"""Corpus pipeline: documents become sharded training data in five stages.

Every stage takes (spark, docs, sf_dir), works on all rows of the stage before and
returns a DataFrame; ``run`` writes each one as Parquet in the shared folder and
reads it again, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.classifier import classify
from strandline.llm.common import source_table, word_count
from strandline.llm.decontaminate import find_contamination
from strandline.llm.mixing import mix
from strandline.llm.sharding import shuffle_into_shards
from strandline.llm.similar import one_of_similar
from strandline.workspace import configure, materialise

SHARDS = 8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour votes accept."""
    return classify(docs, source_table(spark, sf_dir, "labels")).where("predicted = 1").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each chain of texts whose five-word shingle sets are similar to 0.8 or more, that of the smallest id.

    Near fingerprints (SimHash, pivot distance tables) are compared first, the prefix filter finds what they miss.
    """
    return one_of_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without too many words of benchmark items; what stays is unchanged."""
    found = find_contamination(docs, source_table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice."""
    mixed = mix(docs, F.col("source"), word_count(F.col("text")), [F.col("doc_id"), F.xxhash64("text")])
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("n")).select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in random order in shards of equal size: the columns of documents, ``shard`` and ``slot``."""
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    placed = shuffle_into_shards(docs.select(*[F.col(f"`{c}`") for c in names]), SHARDS,
                                 [F.col("doc_id"), F.xxhash64("text")], stored=True)
    return placed.select("row.*", "shard", "slot")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixing),
          ("sharding", sharding)]

# The votes, the fingerprints and the random order have no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = source_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
