"""Type names: detected name -> Spark type / target type, catalogs, overrides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lookups import (
    DECIMAL_PATTERN, DELTA_TYPES, ICEBERG_TYPES, MAX_DECIMAL_PRECISION, SIZED_TEXT_TYPES,
    SPARK_TYPES, STRUCTURAL_PATTERN, TARGET_TYPES, TIME_PATTERN, TIMESTAMP_PATTERN, UNIT_DIGITS,
    lookup_column, text_array,
)
from .tokens import text_width_bucket

# Explicit column types a caller may ask for.
OVERRIDE_PATTERN = r"^[A-Za-z][A-Za-z0-9_]*( *\( *([0-9]+|MAX|max) *(, *[0-9]+ *)?\))?$"


def is_structural(name: Column) -> Column:
    return F.lower(F.trim(name)).rlike(STRUCTURAL_PATTERN)


def _decimal(name: Column, prefix: str, text: str) -> Column:
    """DECIMAL for ``decimal(p,s)`` names, ``text`` when it cannot hold, else null."""
    p = F.regexp_extract(name, DECIMAL_PATTERN, 1).try_cast("int")
    s = F.coalesce(F.regexp_extract(name, DECIMAL_PATTERN, 2).try_cast("int"), F.lit(0))
    p_fold = p - F.least(s, F.lit(0))          # a negative scale widens the integer part
    s_fold = F.greatest(s, F.lit(0))
    bad = (p_fold < 1) | (p_fold > MAX_DECIMAL_PRECISION) | (s_fold > p_fold)
    return F.when(
        name.rlike(DECIMAL_PATTERN),
        F.when(p.isNull() | bad, F.lit(text)).otherwise(
            F.format_string(prefix + "(%d,%d)", p_fold, s_fold)),
    )


def _longest_inside(name: Column, table: dict[str, str]) -> Column:
    """Table value of the longest key contained in the name."""
    keys = sorted(table, key=lambda k: (-len(k), k))
    inside = F.filter(text_array(keys), lambda k: name.contains(k))
    return F.try_element_at(inside, F.lit(1))


def _resolved_name(name: Column, table: dict[str, str]) -> Column:
    exact = F.when(F.array_contains(text_array(table), name), name)
    guess = F.when(~name.contains("<") & ~name.contains("{"), _longest_inside(name, table))
    return F.coalesce(exact, guess)


def target_type(name: Column, max_len: Column | None = None) -> Column:
    """Relational target type of a detected type name."""
    n = F.lower(F.trim(name))
    key = _resolved_name(n, TARGET_TYPES)
    digits = lookup_column(UNIT_DIGITS, F.regexp_extract(n, TIMESTAMP_PATTERN, 1))
    zone = F.regexp_extract(n, TIMESTAMP_PATTERN, 2)
    time_digits = lookup_column(UNIT_DIGITS, F.regexp_extract(n, TIME_PATTERN, 1))
    plain = F.coalesce(lookup_column(TARGET_TYPES, key), F.lit("NVARCHAR(MAX)"))
    if max_len is not None:
        width = text_width_bucket(max_len)
        sized_text = F.when(width.isNull(), F.lit("NVARCHAR(MAX)")).otherwise(
            F.format_string("NVARCHAR(%d)", width))
        plain = F.when(key.isin(SIZED_TEXT_TYPES) & max_len.isNotNull(), sized_text).otherwise(plain)
    return (F.when(is_structural(n), F.lit("NVARCHAR(MAX)"))
            .when(n.rlike(DECIMAL_PATTERN), _decimal(n, "DECIMAL", "NVARCHAR(MAX)"))
            .when(n.rlike(TIMESTAMP_PATTERN),
                  F.when(zone != "", F.concat(F.lit("DATETIMEOFFSET("), digits, F.lit(")")))
                  .otherwise(F.concat(F.lit("DATETIME2("), digits, F.lit(")"))))
            .when(n.rlike(TIME_PATTERN), F.concat(F.lit("TIME("), time_digits, F.lit(")")))
            .otherwise(plain))


def spark_type(name: Column, max_len: Column | None = None) -> Column:
    """Spark SQL type of a detected type name (text is VARCHAR when sized)."""
    n = F.lower(F.trim(name))
    key = _resolved_name(n, SPARK_TYPES)
    zone = F.regexp_extract(n, TIMESTAMP_PATTERN, 2)
    plain = F.coalesce(lookup_column(SPARK_TYPES, key), F.lit("STRING"))
    if max_len is not None:
        width = text_width_bucket(max_len)
        plain = F.when(key.isin(SIZED_TEXT_TYPES) & max_len.isNotNull() & width.isNotNull(),
                       F.format_string("VARCHAR(%d)", width)).otherwise(plain)
    return (F.when(is_structural(n), F.lit("STRING"))
            .when(n.rlike(DECIMAL_PATTERN), _decimal(n, "DECIMAL", "STRING"))
            .when(n.rlike(TIMESTAMP_PATTERN),
                  F.when(zone != "", F.lit("TIMESTAMP")).otherwise(F.lit("TIMESTAMP_NTZ")))
            .when(n.rlike(TIME_PATTERN), F.lit("STRING"))
            .otherwise(plain))


def map_type(name: Column, max_len: Column | None = None) -> Column:
    return F.struct(target_type(name, max_len).alias("target_type"),
                    spark_type(name, max_len).alias("spark_type"))


def inferred_types(name: Column, max_len: Column) -> tuple[Column, Column]:
    """``map_type`` for the few names that inference from text gives: bool, int32, int64, decimal, object."""
    few = ("bool", "int32", "int64")
    width = text_width_bucket(max_len)
    unsized = max_len.isNull() | width.isNull()

    def mapped(table: dict[str, str], prefix: str, text: str) -> Column:
        return (F.when(name == "object", F.when(unsized, F.lit(text)).otherwise(F.format_string(prefix + "(%d)", width)))
                .when(name.isin(*few), lookup_column({k: table[k] for k in few}, name))
                .otherwise(_decimal(name, "DECIMAL", text)))

    return mapped(TARGET_TYPES, "NVARCHAR", "NVARCHAR(MAX)"), mapped(SPARK_TYPES, "VARCHAR", "STRING")


def iceberg_type(raw: Column) -> Column:
    """Detected type name of an Iceberg type (nested types by their kind)."""
    n = F.lower(F.trim(raw))
    kind = F.when(n.startswith("{"), F.lower(F.get_json_object(raw, "$.type"))).otherwise(n)
    base = F.regexp_extract(kind, r"^([^\[(]*)", 1)
    p = r"^decimal(?:128|256)?\s*\(\s*(\d+)\s*,\s*(-?\d+)\s*\)$"
    return (F.when(kind.rlike(p), F.format_string(
                "decimal(%s,%s)", F.regexp_extract(kind, p, 1), F.regexp_extract(kind, p, 2)))
            .when(base.isin("decimal", "decimal128", "decimal256"), F.lit("decimal128"))
            .otherwise(lookup_column(ICEBERG_TYPES, base, F.lit("str"))))


def delta_type(raw: Column) -> Column:
    """Detected type name of a primitive Delta type name."""
    n = F.lower(F.trim(raw))
    p = r"^decimal\s*\(\s*(\d+)\s*,\s*(-?\d+)\s*\)$"
    return F.when(n.rlike(p), F.format_string(
        "decimal(%s,%s)", F.regexp_extract(n, p, 1), F.regexp_extract(n, p, 2))
    ).otherwise(lookup_column(DELTA_TYPES, n, F.lit("str")))


def delta_type_name(raw) -> str:
    """Detected type name of a parsed Delta type, nested types rendered in full.

    Works on one schema (driver-side metadata), never on data rows.
    """
    if isinstance(raw, dict):
        kind = str(raw.get("type", "string")).lower()
        if kind == "array":
            return f"list<element: {delta_type_name(raw.get('elementType'))}>"
        if kind == "map":
            return f"map<{delta_type_name(raw.get('keyType'))}, {delta_type_name(raw.get('valueType'))}>"
        if kind == "struct":
            inner = (f"{f.get('name', '')}: {delta_type_name(f.get('type'))}"
                     for f in raw.get("fields") or [])
            return f"struct<{', '.join(inner)}>"
        return delta_type_name(kind)
    name = "".join(str(raw if raw is not None else "string").lower().split())
    if name.startswith("decimal("):
        return name
    return DELTA_TYPES.get(name, "str")


def with_type_overrides(type_col: Column, override: Column) -> Column:
    """Caller's explicit type when it is well formed, text when it is not."""
    return (F.when(override.isNull(), type_col)
            .when(override.rlike(OVERRIDE_PATTERN), F.upper(override))
            .otherwise(F.lit("NVARCHAR(MAX)")))


def bounded_type(name: Column, physical: Column, max_len: Column) -> Column:
    """Type for an external table over columnar files: no unbounded columns.

    Nanosecond INT64 timestamps are plain integers there; zoned INT64 timestamps
    lose the zone but keep the unit; unbounded text and binary get the widest
    bounded type unless the data is known to be wider.
    """
    n = F.lower(F.trim(name))
    int64 = F.upper(physical) == "INT64"
    nanos = n.rlike(r"^timestamp\[ns(?:,\s*tz=[^\]]+)?\]$")
    zoned = r"^timestamp\[(s|ms|us),\s*tz=[^\]]+\]$"
    naive = F.concat(F.lit("timestamp["), F.regexp_extract(n, zoned, 1), F.lit("]"))
    full = target_type(name, max_len)
    wide = F.coalesce(max_len > 4000, F.lit(False))
    return (F.when(F.coalesce(int64 & nanos, F.lit(False)), F.lit("BIGINT"))
            .when(F.coalesce(int64 & n.rlike(zoned), F.lit(False)), target_type(naive))
            .when(~wide & (full == "NVARCHAR(MAX)"), F.lit("NVARCHAR(4000)"))
            .when(~wide & (full == "VARBINARY(MAX)"), F.lit("VARBINARY(8000)"))
            .otherwise(full))


def is_unbounded(target: Column) -> Column:
    return F.upper(target).rlike(r"^((N?VARCHAR|VARBINARY)\s*\(\s*MAX\s*\)|N?TEXT|IMAGE|XML)$")
