"""Bounded looks at data and small projections over any table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as tk


def clamp_rows(n: int | None) -> int:
    return max(1, int(n or 100))


def typed_read(df: DataFrame, columns: Sequence[tuple[str, str]], n: int = 100,
               order: str | None = None) -> DataFrame:
    """Text columns cast to their detected types, first ``n`` rows."""
    rows = df if order is None else df.orderBy(order)
    typed = [F.col(f"`{c}`").try_cast(t).alias(c) for c, t in columns]
    return rows.limit(clamp_rows(n)).select(*typed)


def read_top(df: DataFrame, n: int = 100, order: str | None = None) -> DataFrame:
    return (df if order is None else df.orderBy(order)).limit(clamp_rows(n))


def preview(df: DataFrame, n: int | None = 100, order: str | None = None,
            truncated: bool = False) -> DataFrame:
    """First rows with ``total_rows`` and ``truncated`` on each."""
    n = clamp_rows(n)
    total = df.agg(F.count(F.lit(1))).scalar()
    return read_top(df, n, order).withColumn("total_rows", total.cast("long")).withColumn(
        "truncated", F.lit(truncated) | (total > n))


def preview_cell(token: Column, dtype: Column) -> Column:
    """``struct(kind, text)`` of a cell: missing is null, booleans and exact numbers
    are shown as such, everything else keeps its text untouched."""
    return tk.bind(tk.strip_blanks(token), lambda t: _cell(token, t, dtype))


def _cell(token: Column, t: Column, dtype: Column) -> Column:
    numeric = dtype.rlike(r"^(int|decimal)") & tk.is_numeric_token(t)
    return (F.when(tk.is_missing(token), F.lit(None))
            .when((dtype == "bool") & tk.is_bool_token(token),
                  F.struct(F.lit("bool").alias("kind"), F.lower(token).alias("text")))
            .when(numeric & tk.exact_sample(t), F.struct(F.lit("number").alias("kind"), t.alias("text")))
            .otherwise(F.struct(F.lit("text").alias("kind"), token.alias("text"))))


def provisional(df: DataFrame, rows: int = 100, max_chars: int = 65536, max_columns: int = 256) -> DataFrame:
    """Bounded first look: few rows and columns, long cells marked, count unknown.

    ``stopped_by`` names the bound that ended it; the full profile follows.
    """
    cols = df.columns[:max_columns]
    top = df.select([F.col(f"`{c}`").cast("string").alias(c) for c in cols]).limit(rows + 1)
    seen = top.agg(F.count(F.lit(1))).scalar()
    too_long = [F.coalesce(F.length(f"`{c}`") > max_chars, F.lit(False)) for c in cols]
    long_any = too_long[0]
    for c in too_long[1:]:
        long_any = long_any | c
    reason = (F.when(F.lit(len(df.columns) > max_columns), F.lit("columns"))
              .when(seen > rows, F.lit("rows")).when(long_any, F.lit("characters")))
    return top.limit(rows).withColumns({
        "stage": F.lit("provisional"), "row_count": F.lit(None).cast("long"),
        "row_count_lower_bound": F.least(seen, F.lit(rows)).cast("long"), "stopped_by": reason})


def filter_files(prof: DataFrame, query: str, name: str = "file_name", kind: str = "file_type",
                 folder: str = "folder") -> DataFrame:
    """Case-insensitive substring on name, type or folder, sorted within folders."""
    hay = F.lower(F.concat_ws("\n", folder, name, kind))
    return prof.filter(hay.contains(query.strip().lower())).orderBy(folder, name)


def quote(name: str, qualifier: str | None = None) -> str:
    q = "`" + name.replace("`", "``") + "`"
    return q if qualifier is None else f"{qualifier}.{q}"


def project_names(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns in schema order; everything when the schema is unknown."""
    return df.select("*") if not columns else df.select(*[quote(c) for c in df.columns if c in set(columns)])


def sample_first_columns(df: DataFrame, n: int = 10, k: int = 3, order: str | None = None) -> DataFrame:
    rows = df if order is None else df.orderBy(order)
    return rows.select(*[F.col(quote(c)) for c in df.columns[:k]]).limit(n)


def drop_header_rows(df: DataFrame, column: str, header: str) -> DataFrame:
    """Rows whose first column repeats the header text are dropped (nulls stay out too)."""
    return df.filter(F.col(quote(column)) != F.lit(header))


def capped_expectation(expected: Column, n: int) -> Column:
    return F.least(expected, F.lit(n))


# --- collations -------------------------------------------------------------------
# Spark's names for the comparison rules; kana type and width are always told apart
# only under the binary and UNICODE rules.
COLLATIONS = {
    "binary": "UTF8_BINARY", "ci_ai": "UNICODE_CI_AI", "ci_as": "UNICODE_CI",
    "cs_as": "UNICODE", "cs_ai": "UNICODE_AI", "turkish_ci": "tr_CI",
}


def collation(name: str) -> str:
    return COLLATIONS.get(name.lower(), name)


def equal_under(left: Column, right: Column, name: str) -> Column:
    return F.collate(left, collation(name)) == F.collate(right, collation(name))


def sort_under(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.orderBy(F.collate(F.col(column), collation(name)), F.col(column))


def count_under(df: DataFrame, column: str, name: str, out: str = "n") -> DataFrame:
    """Groups under a collation; the group is shown by its binary-smallest member.

    Rows are counted per exact value first, so the collation keys are built for
    distinct values only.
    """
    exact = df.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return (exact.groupBy(F.collate("v", collation(name)).alias("k"))
            .agg(F.min("v").alias(column), F.sum("n").cast("long").alias(out)).drop("k"))
