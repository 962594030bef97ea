"""The registered text queries and the pipeline on the smallest tables."""

import os

import oracle_check
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_registered():
    names = oracle_check.entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_whole_tables(spark):
    for name, table, key in (("op1_quality_votes", "documents", "doc_id"), ("op3_mix_sources", "documents", "doc_id"),
                             ("op7_main_text", "pages", "page_id"), ("op8_shard_shuffle", "documents", "doc_id")):
        ids = sorted(r[0] for r in catalog.QUERIES[name](spark, SF).select(key).collect())
        assert ids == sorted(pd.read_parquet(f"{SF}/{table}.parquet")[key])


def one_of_similar_texts(rows):
    """Smallest ids of the chains of texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more."""
    from test_text_operators import WORD, plain_components
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def shingles(text):
        w = WORD.findall((text or "").translate(lower))
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    sets = {r[0]: shingles(r[1]) for r in rows}
    every = list(set(sets.values()))
    number = {s: k for k, s in enumerate(every)}
    part = plain_components(range(len(every)), lambda a, b: 5 * len(every[a] & every[b]) >= 4 * len(every[a] | every[b]))
    least = {}
    for i, s in sorted(sets.items()):
        least.setdefault(part[number[s]], i)
    return sorted(least.values())


def test_pipeline_stage_by_stage(spark):
    """Each stage is judged on what the one before kept, with plain Python."""
    docs = corpus_pipeline.source_table(spark, SF, "documents")
    columns = docs.columns
    from test_text_operators import plain_contamination
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), f"test-{name}")
        after = docs.collect()
        ids = sorted(r["doc_id"] for r in after)
        if name != "sharding":
            assert docs.columns == columns
            assert {tuple(r) for r in after} <= set(before)
        if name == "quality":
            labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id")["quality"]
            known = [i for i, *_ in before if i in labels]
            assert sum((i in set(ids)) == bool(labels[i]) for i in known) >= 0.97 * len(known)
        elif name == "near_dedup":
            assert ids == one_of_similar_texts(before)
        elif name == "decontaminate":
            items = pd.read_parquet(f"{SF}/benchmark.parquet").itertuples(index=False, name=None)
            assert ids == sorted(r[0] for r in plain_contamination(before, list(items)) if not r[4])
        elif name == "mixing":
            assert max(ids.count(i) for i in set(ids)) <= 2
        else:
            assert ids == sorted(r[0] for r in before)
            sizes = docs.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"),
                                              F.countDistinct("slot").alias("d")).collect()
            assert all(r["n"] == r["m"] + 1 == r["d"] for r in sizes)
            assert max(r["n"] for r in sizes) - min(r["n"] for r in sizes) <= 1
