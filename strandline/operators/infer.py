"""Type inference: mergeable evidence per column, then one type per column.

Every token is reduced to a few numbers (a class bit, digit counts, a width) and
those are merged with ``bit_or`` and ``max``, so the whole table is aggregated
map-side and only one small row per column and partition is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..functions.lookups import text_array
from ..functions.types import inferred_types, map_type, target_type, with_type_overrides

# What a token can be, as bits of the per-column evidence mask.
BOOL, INT32, INT64, DECIMAL, EXPONENT, TEXT = (1 << i for i in range(6))


def _fits(digits: Column, negative: Column, low: str, high: str) -> Column:
    """Digit string (no sign, no leading zeros) within ``-low .. high``.

    Compared as text: a cast that fails raises inside the JVM and costs far more
    than the comparison, and on text columns nearly every cast would fail.
    """
    n = F.octet_length(digits)
    limit = F.when(negative, F.lit(low)).otherwise(F.lit(high))
    return (n < len(high)) | ((n == len(high)) & (digits <= limit))


_BUILT: dict[tuple, Column] = {}


def built(key: tuple, make) -> Column:
    """A large expression over fixed column names, built once per application."""
    from pyspark import SparkContext
    full = (SparkContext._active_spark_context.applicationId, *key)
    if full not in _BUILT:
        _BUILT[full] = make()
    return _BUILT[full]


def token_bit(n: str) -> Column:
    """Class bit of the token prepared by ``with_token_bits``; 0 = missing.

    No missing or boolean token is numeric, so numbers need only the one test.
    """
    c, t, digits = F.col(f"{n}_c"), F.col(f"{n}_t"), F.col(f"{n}_d")
    negative = t.startswith("-")
    exponent = t.contains("e") | t.contains("E")
    return (F.when(digits.isNotNull(),
                   F.when(exponent, F.lit(EXPONENT)).when(F.col(f"{n}_p") > 0, F.lit(DECIMAL))
                   .when(_fits(digits, negative, "2147483648", "2147483647"), F.lit(INT32))
                   .when(_fits(digits, negative, "9223372036854775808", "9223372036854775807"), F.lit(INT64))
                   .otherwise(F.lit(DECIMAL)))
            .when(tk.is_missing(c), F.lit(0))
            .when(tk.is_bool_token(c), F.lit(BOOL))
            .otherwise(F.lit(TEXT)))


def with_token_bits(df: DataFrame, cells: dict[str, Column], keep: Sequence[str] = ()) -> DataFrame:
    """For every cell ``<n>_c`` raw, ``<n>_t`` trimmed, ``<n>_d`` the number without sign and leading
    zeros (null unless numeric), ``<n>_p`` the place of the point in it and ``<n>_b`` class bit.

    Stacked projections on purpose: each value is computed once per token
    and only referenced afterwards, where one nested expression would repeat it.
    """
    steps = [("t", lambda n: tk.strip_blanks(F.col(f"{n}_c"))), ("d", lambda n: tk.significant(F.col(f"{n}_t"))),
             ("p", lambda n: F.instr(F.col(f"{n}_d"), ".")), ("b", token_bit)]
    out = df.select(*keep, *[v.alias(f"{n}_c") for n, v in cells.items()])
    for suffix, make in steps:
        out = out.select("*", *[built(("token", suffix, n), lambda n=n: make(n)).alias(f"{n}_{suffix}") for n in cells])
    return out


def token_features(n: str) -> dict[str, Column]:
    """The numbers one token contributes to its column's evidence."""
    c, digits, point, bit = F.col(f"{n}_c"), F.col(f"{n}_d"), F.col(f"{n}_p"), F.col(f"{n}_b")
    numeric = bit.bitwiseAND(F.lit(INT32 | INT64 | DECIMAL)) != 0
    length = F.octet_length(digits)
    return {
        "mask": bit,
        "int_digits": F.when(numeric, F.when(point > 0, point - 1).otherwise(length)),
        "scale": F.when(numeric, F.when(point > 0, length - point).otherwise(F.lit(0))),
        "width": F.when(bit != 0, tk.utf16_len(c)),
        "missing": F.when(bit == 0, F.lit(1)).otherwise(F.lit(0)),
    }


def merge_evidence(parts: dict[str, Column]) -> dict[str, Column]:
    """Aggregates that merge token features (or partial evidence) of one column."""
    return {
        "mask": F.bit_or(parts["mask"]),
        "int_digits": F.max(parts["int_digits"]),
        "scale": F.max(parts["scale"]),
        "width": F.max(parts["width"]),
        "missing": F.sum(parts["missing"]),
        "rows": F.sum(parts["rows"]) if "rows" in parts else F.count(F.lit(1)),
    }


def numeric_type(mask: Column, int_digits: Column, scale: Column) -> Column:
    """Narrowest exact numeric type, or null when some value has an exponent
    (those stay text) or is not numeric at all."""
    inside = lambda bits: mask.bitwiseAND(F.lit(63 ^ bits)) == 0
    s = F.coalesce(scale, F.lit(0))
    p = F.greatest(F.lit(1), F.coalesce(int_digits, F.lit(0)) + s)
    return (F.when(mask == 0, F.lit(None))
            .when(inside(INT32), F.lit("int32"))
            .when(inside(INT32 | INT64), F.lit("int64"))
            .when(inside(INT32 | INT64 | DECIMAL), F.format_string("decimal(%d,%d)", p, s)))


def delimited_type(mask: Column, int_digits: Column, scale: Column) -> Column:
    """Column type from merged evidence; text wins whenever anything disagrees."""
    return F.coalesce(F.when(mask == BOOL, F.lit("bool")),
                      numeric_type(mask, int_digits, scale), F.lit("object"))


def column_evidence(df: DataFrame, columns: Sequence[str] | None = None,
                    by: Sequence[str] = ()) -> DataFrame:
    """Merged evidence ``(by..., pos, name, mask, int_digits, scale, width, missing, rows)``.

    The table is melted to ``(by..., pos, token)`` rows and aggregated map-side by
    position: one short loop that the JIT compiles well, where a set of aggregates
    per column grows into generated methods too large to be compiled.
    """
    names = list(columns or [n for n in df.columns if n not in by])
    return merge_tokens(melt(_spread(df.select(*[F.col(f"`{c}`") for c in [*by, *names]])), names, by), by).withColumn(
        "name", F.element_at(text_array(names), F.col("pos") + 1))


def _spread(df: DataFrame) -> DataFrame:
    from ..workspace import spread_small
    return spread_small(df)


def melt(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per cell: ``(by..., pos, token)``."""
    cells = F.array(*[F.col(f"`{n}`").cast("string") for n in names])
    return df.select(*[F.col(f"`{b}`") for b in by], F.posexplode(cells).alias("pos", "token"))


def merge_tokens(tokens: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    bits = with_token_bits(tokens, {"x": F.col("token")}, keep=[*by, "pos"])
    parts = ("mask", "int_digits", "scale", "width", "missing", "rows")
    return bits.groupBy(*by, "pos").agg(*[
        built(("merged", k), lambda k=k: merge_evidence(token_features("x"))[k]).alias(k) for k in parts])


def mapped_type() -> Column:
    """``map_type`` of the evidence columns, any type name."""
    return built(("mapped",), lambda: map_type(F.col("detected_type"), F.col("max_length")))


def finish_columns(evidence: DataFrame, full: bool = True, has_header: bool = True,
                   delimited: bool = True) -> DataFrame:
    """Typed columns from merged evidence.

    ``full=False`` marks sampled evidence: the detected type is still reported
    but the effective type is text, because unread rows could disagree.
    """
    detected = built(("detected",), lambda: delimited_type(F.col("mask"), F.col("int_digits"), F.col("scale")))
    observed = F.when(F.col("detected_type") == "object", F.col("width")).cast("long")
    max_len = F.when(F.lit(full), tk.sized(F.col("observed_max_length")))
    target, stored = (built(("inferred", i), lambda i=i: inferred_types(F.col("detected_type"), F.col("max_length"))[i])
                      for i in range(2))
    out = (evidence.withColumn("detected_type", detected)
           .withColumn("observed_max_length", observed)
           .withColumn("max_length", max_len))
    keep = [c for c in evidence.columns if c not in
            {"mask", "int_digits", "scale", "width", "missing", "rows"}]
    if not full:                            # unread rows could disagree
        target, stored = F.lit("NVARCHAR(MAX)"), F.lit("STRING")
    elif delimited:
        target = F.when(F.col("detected_type") == "bool", F.lit("NVARCHAR(5)")).otherwise(target)
    return out.select(
        *keep, "detected_type", "observed_max_length", "max_length",
        target.alias("target_type"), stored.alias("spark_type"),
        F.col("missing").cast("long").alias("missing"), F.col("rows").cast("long").alias("rows"),
        F.lit(True).alias("nullable"),          # inferred columns are never promised non-null
        F.lit("full" if full else "sampled").alias("schema_inference"),
    )


def infer_columns(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (),
                  full: bool = True, delimited: bool = True) -> DataFrame:
    """Exact type, width and missing count of every column of a text table."""
    return finish_columns(column_evidence(df, columns, by), full, delimited=delimited)


# --- column-level rules over a (path, pos, name, type, ...) relation -------------

def effective_type(detected: Column, inference: Column, override: Column, max_len: Column) -> Column:
    """Override first; sampled evidence widens to text; otherwise the mapped type."""
    base = F.when(inference == "sampled", F.lit("NVARCHAR(MAX)")).otherwise(
        target_type(detected, max_len))
    return with_type_overrides(base, override)


def check_column_limit(columns: DataFrame, by: Sequence[str] = ("path",),
                       max_columns: int | None = None) -> DataFrame:
    """Column counts; with a target's ``max_columns`` (1024 is usual) whether a typed table may hold them."""
    return columns.groupBy(*by).agg(F.count(F.lit(1)).alias("column_count")).withColumn(
        "typed_table_allowed", F.lit(True) if max_columns is None else F.col("column_count") <= max_columns)


def duplicate_names(columns: DataFrame, by: Sequence[str] = ("path",), name: str = "name") -> DataFrame:
    """Names that collide when case is ignored (empty result = schema is usable)."""
    return (columns.groupBy(*by, F.lower(name).alias("folded_name"))
            .agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"))


def watchouts(prof: DataFrame) -> Column:
    """``array<struct(code, subject)>``: what a reader of the profile should look at, sorted by code.

    A warning about columns is there once for every such column.
    """
    numeric = F.lit("int|float|double|decimal|numeric|real")
    note = lambda code, subject: F.struct(F.lit(code).alias("code"), subject.cast("string").alias("subject"))
    per_column = lambda code, test: F.transform(
        F.filter("columns", lambda c: F.coalesce(test(c), F.lit(False))), lambda c: note(code, c["name"]))
    whole = lambda code, test, subject: F.when(test, F.array(note(code, subject))).otherwise(
        F.array().cast("array<struct<code:string,subject:string>>"))
    return F.array_sort(F.concat(
        per_column("long_text", lambda c: c["max_length"] > 4000),
        per_column("nullable_number", lambda c: c["nullable"] & F.rlike(F.lower(c["type"]), numeric)),
        F.when(F.col("file_type") == "json", per_column("nested", lambda c: c["nesting"].isin("object", "array")))
        .otherwise(F.array().cast("array<struct<code:string,subject:string>>")),
        whole("rows_estimated", F.col("row_count_estimated"), F.lit(None)),
        whole("unsure_encoding", (F.col("encoding") != "binary") & (F.col("encoding_confidence") < 70),
              F.col("encoding_confidence"))))


def folder_consensus(files: DataFrame, folder: str, traits: Sequence[str]) -> DataFrame:
    """Modal value of every trait per folder, 'Mixed' when files disagree.

    The pair counts are merged map-side first, so a folder holding most of the
    files costs no more than any other.
    """
    pairs = files.select(folder, F.posexplode(F.array(*[F.col(t).cast("string") for t in traits]))
                         .alias("t", "v"))
    counts = pairs.groupBy(folder, "t", "v").agg(F.count(F.lit(1)).alias("n"))
    per_trait = counts.groupBy(folder, "t").agg(
        F.sum("n").alias("files"), F.count(F.lit(1)).alias("values"),
        F.max("n").alias("top"), F.min("v").alias("v"))
    wide = [F.max(F.when(F.col("t") == i, F.when(F.col("values") > 1, F.lit("Mixed"))
                         .otherwise(F.col("v")))).alias(t) for i, t in enumerate(traits)]
    return (per_trait.groupBy(folder).agg(
        F.max("files").cast("long").alias("file_count"), *wide,
        F.max(F.col("files") - F.col("top")).cast("long").alias("outlier_count"))
        .filter("file_count >= 2"))


def summary(files: DataFrame, type_col: str = "file_type", size_col: str = "file_size") -> DataFrame:
    return files.groupBy(type_col).agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.col(size_col).cast("long")).alias("total_size"))
