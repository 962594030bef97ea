"""Set operations that occur in the checks: distinct-first, union, multiset difference."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_first(df: DataFrame, key: Sequence[str] | str, order: Sequence[str] | str) -> DataFrame:
    """First row per key in the given order, as a map-side aggregate: a key held
    by a third of the rows shrinks to one row per task before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*orders)).alias("r"))
    return first.select(*[F.col(c) if c in keys else F.col("r")[c].alias(c) for c in df.columns])


def first_definition(objects: DataFrame, name: str, order: str) -> DataFrame:
    """Shared objects once: the first definition wins, names compared without case."""
    folded = objects.withColumn("_k", F.upper(name))
    return distinct_first(folded, "_k", order).drop("_k")


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def multiset_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows whose number of copies differs, ``copies`` > 0 for rows of
    ``a`` that ``b`` lacks.

    One grouping of both sides together: each side is shuffled once and copies
    of the same row are added up before they move.
    """
    both = a.withColumn("_n", F.lit(1)).union(b.select(*a.columns).withColumn("_n", F.lit(-1)))
    return (both.groupBy(*[F.col(f"`{c}`") for c in a.columns]).agg(F.sum("_n").alias("copies"))
            .filter("copies <> 0"))


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    d = multiset_counts(a, b)
    return d.withColumn("side", F.when(F.col("copies") > 0, F.lit("missing")).otherwise(F.lit("extra"))
                        ).withColumn("copies", F.abs("copies"))


def align(tree: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Both-sided difference of two keyed relations."""
    a = tree.select(key).distinct().withColumn("in_tree", F.lit(True))
    b = manifest.select(key).distinct().withColumn("in_manifest", F.lit(True))
    return a.join(b, key, "full_outer").select(
        key, F.when(F.col("in_tree").isNull(), F.lit("missing"))
        .when(F.col("in_manifest").isNull(), F.lit("extra")).otherwise(F.lit("same")).alias("status"))
