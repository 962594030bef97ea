"""JSON shape inference: one pass over documents, evidence merged per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..functions.jsontext import exact_text, is_tagged, tag_numbers
from ..functions.lookups import MAX_NUMERIC_TOKEN
from ..workspace import spread_small
from . import infer

# Families as bits of the per-key evidence mask.
BOOLEAN, NUMERIC, STRING, OBJECT, ARRAY = (1 << i for i in range(5))


def json_fields(docs: DataFrame, by: Sequence[str] = (), doc: str = "doc", row_id: str = "row_id") -> DataFrame:
    """One row per top-level entry of every object:
    ``(by..., row_id, pos, key, family, token)``.

    ``token`` is the exact text of a number, the value of a string and the JSON
    text of anything else; a null value has family 0.
    """
    parsed = spread_small(docs.select(*by, row_id, doc)).select(*by, row_id, F.json_object_keys(doc).alias("names"),
                         F.try_parse_json(tag_numbers(F.col(doc))).alias("v"))
    # a variant keeps its keys sorted; the position is the one in the text
    entries = parsed.lateralJoin(_explode_variant()).select(
        *by, row_id, (F.array_position("names", F.col("key")) - 1).cast("int").alias("pos"), "key", "value")
    with_type = entries.select("*", F.schema_of_variant("value").alias("t"),
                               F.col("value").try_cast("string").alias("text"))
    t, text = F.col("t"), F.col("text")
    family = (F.when(t == "VOID", F.lit(0)).when(t == "BOOLEAN", F.lit(BOOLEAN))
              .when((t == "STRING") & is_tagged(text), F.lit(NUMERIC))
              .when(t == "STRING", F.lit(STRING)).when(t.startswith("OBJECT"), F.lit(OBJECT))
              .when(t.startswith("ARRAY"), F.lit(ARRAY)).otherwise(F.lit(NUMERIC)))
    return with_type.select(*by, row_id, "pos", "key", family.alias("family"), exact_text(t, text).alias("token"))


def _explode_variant():
    from pyspark.sql import SparkSession
    return SparkSession.active().tvf.variant_explode(F.col("v").outer())


def key_evidence(fields: DataFrame, by: Sequence[str] = (), row_id: str = "row_id") -> DataFrame:
    """Merged evidence per key; everything is a fixed-width number, so the
    aggregate is hashed and combined map-side."""
    bits = infer.with_token_bits(
        fields, {"x": F.when(F.col("family") == NUMERIC, F.col("token"))},
        keep=[*by, row_id, "pos", "key", "family", "token"])
    f = infer.token_features("x")
    numeric = F.col("family") == NUMERIC
    return bits.groupBy(*by, "key").agg(
        F.bit_or("family").alias("families"),
        F.bit_or(F.col("x_b")).alias("mask"), F.max(f["int_digits"]).alias("int_digits"),
        F.max(f["scale"]).alias("scale"),
        F.bool_or(numeric & (F.octet_length("token") > MAX_NUMERIC_TOKEN)).alias("rejected"),
        F.max(F.when(F.col("family") == STRING, tk.utf16_len(F.col("token")))).alias("width"),
        F.min(F.col(row_id)).alias("first_row"), F.min_by("pos", F.col(row_id)).alias("first_pos"),
        F.min(F.when(F.col("family") != 0, F.col(row_id))).alias("first_value_row"),
        F.count(F.lit(1)).alias("seen"))


def merge_files(evidence: DataFrame, place: Column) -> DataFrame:
    """Evidence of files (``path``) merged by ``place``, which becomes the path; keys of files with smaller names come first."""
    first = F.min(F.struct("path", "first_row", "first_pos"))
    value = F.when(F.col("first_value_row").isNotNull(), F.struct("path", "first_value_row"))
    merged = evidence.withColumn("place", place).groupBy("place", "key").agg(
        F.bit_or("families").alias("families"), F.bit_or("mask").alias("mask"), F.max("int_digits").alias("int_digits"),
        F.max("scale").alias("scale"), F.bool_or("rejected").alias("rejected"), F.max("width").alias("width"),
        first.alias("first_row"), F.min(value)["first_value_row"].alias("first_value_row"), F.sum("seen").alias("seen"))
    return merged.withColumn("first_pos", F.col("first_row.first_pos")).withColumnRenamed("place", "path")


def cap_keys(evidence: DataFrame, by: Sequence[str] = (), max_keys: int | None = None) -> DataFrame:
    """Keys in order of appearance, with their position; with ``max_keys`` the first so many, and that
    there were more is reported through ``keys_truncated``.

    One key beyond the limit is kept for that flag, so the documents are read
    once.  Ranking is limited inside every task before rows are moved: a source
    with a key per row never lands in one task.
    """
    order = ["first_row", "first_pos", "key"]
    if max_keys is None:
        w = Window.partitionBy(*[F.col(b) for b in by]).orderBy(*order)
        return evidence.withColumn("pos", F.row_number().over(w) - 1).withColumn("keys_truncated", F.lit(False))
    if by:
        group = [F.col(b) for b in by]
        w = Window.partitionBy(*group).orderBy(*order)
        kept = evidence.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= max_keys + 1)
        everything = Window.partitionBy(*group)
    else:
        top = evidence.orderBy(*order).limit(max_keys + 1)          # bounded from here on
        kept = top.withColumn("pos", F.row_number().over(Window.orderBy(*order)))
        everything = Window.partitionBy()
    flagged = kept.withColumn("keys_truncated", F.max("pos").over(everything) > max_keys)
    return flagged.filter(F.col("pos") <= max_keys).withColumn("pos", F.col("pos") - 1)


def finish_keys(capped: DataFrame, by: Sequence[str] = (), sampled: bool = False) -> DataFrame:
    """Type, nesting, widths and safety per key."""
    fam = F.col("families")
    single = fam.isin(BOOLEAN, NUMERIC, STRING, OBJECT, ARRAY)
    number = infer.numeric_type(F.col("mask"), F.col("int_digits"), F.col("scale"))
    dtype = (F.when(fam == OBJECT, F.lit("dict")).when(fam == ARRAY, F.lit("list"))
             .when(fam == BOOLEAN, F.lit("bool"))
             .when((fam == NUMERIC) & ~F.col("rejected"), F.coalesce(number, F.lit("str")))
             .otherwise(F.lit("str")))
    partial = F.lit(sampled) | F.col("keys_truncated")
    observed = F.when(fam == STRING, F.col("width"))
    return capped.select(
        *by, F.col("pos").cast("int").alias("pos"), F.col("key").alias("name"), dtype.alias("detected_type"),
        F.when(fam == OBJECT, F.lit("object")).when(fam == ARRAY, F.lit("array"))
        .otherwise(F.lit("scalar")).alias("nesting"),
        fam.alias("families"), observed.cast("long").alias("observed_max_length"),
        F.when(~partial, tk.sized(observed)).alias("max_length"),
        (~partial & (single | (fam == 0)) & ~((fam == NUMERIC) & F.col("rejected"))).alias("safe"),
        F.when(partial, F.lit("sampled")).otherwise(F.lit("full")).alias("schema_inference"),
        F.col("first_value_row"), F.lit(True).alias("nullable"))


def json_profile(docs: DataFrame, by: Sequence[str] = (), doc: str = "doc", row_id: str = "row_id",
                 max_keys: int | None = None, sampled: bool = False) -> DataFrame:
    fields = json_fields(docs, by, doc, row_id)
    return finish_keys(cap_keys(key_evidence(fields, by, row_id), by, max_keys), by, sampled)


def typed_projection_safe(profile: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return profile.groupBy(*by).agg(F.bool_and("safe").alias("typed_projection_safe"))


def json_first_values(docs: DataFrame, profile: DataFrame, doc: str = "doc", row_id: str = "row_id") -> DataFrame:
    """First non-null value of every key.

    The rows that hold one are known from the profile: at most one per kept key
    and therefore few enough to broadcast; only those documents are taken apart.
    """
    wanted = profile.select(F.col("name").alias("key"), F.col("first_value_row").alias(row_id))
    rows = docs.join(F.broadcast(wanted.select(row_id).distinct()), row_id, "left_semi")
    fields = json_fields(rows, (), doc, row_id)
    return fields.join(F.broadcast(wanted), [row_id, "key"]).select(
        F.col("key").alias("name"), "family", F.col("token").alias("first_value"))


def rejected_numeric(profile_evidence: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return profile_evidence.groupBy(*by).agg(F.bool_or("rejected").alias("rejected_numeric"))


def profiles_agree(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differences between two profiles of the same data (empty = they agree)."""
    cols = ["name", "detected_type", "nesting", "observed_max_length"]
    from .setops import multiset_diff
    return multiset_diff(a.select(*cols), b.select(*cols))
