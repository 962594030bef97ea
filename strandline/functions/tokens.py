"""Column expressions over single text tokens: missing, boolean, numeric, width.

All are built from Catalyst expressions; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lookups import (
    FALSE_TOKENS, MAX_DECIMAL_PRECISION, MAX_NUMERIC_TOKEN, MISSING_TOKENS, SAFE_INTEGER,
    TRUE_TOKENS,
)

# Numeric token syntax (ASCII digits only) and the blanks around it.
NUMERIC_PATTERN = r"^[+-]?(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)?$"
BLANKS = (" \t\n\u000b\f\r\u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004"
          "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip_blanks(c: Column) -> Column:
    """Trim white space of every kind from both ends.

    Most tokens carry none, so the trim runs only for those that start or end
    with something that is not visible ASCII.
    """
    visible = lambda x: (x >= "!") & (x < "\x7f")
    return F.when(visible(c) & visible(F.substring(c, -1, 1)), c).otherwise(F.btrim(c, F.lit(BLANKS)))


def is_missing(c: Column) -> Column:
    return c.isNull() | c.isin(MISSING_TOKENS)


def is_bool_token(c: Column) -> Column:
    return c.isin(TRUE_TOKENS + FALSE_TOKENS)


def bool_token(c: Column) -> Column:
    return F.when(c.isin(TRUE_TOKENS), F.lit(True)).when(c.isin(FALSE_TOKENS), F.lit(False))


def is_numeric_token(trimmed: Column) -> Column:
    return (F.octet_length(trimmed) <= MAX_NUMERIC_TOKEN) & trimmed.rlike(NUMERIC_PATTERN)


def significant(trimmed: Column) -> Column:
    """The number without its sign and leading zeros, null when the token is not numeric.

    Most text starts with a letter, which one comparison of the first byte tells.
    """
    could_be = (trimmed >= "+") & (trimmed < ":")
    return F.when(could_be & is_numeric_token(trimmed), F.ltrim(trimmed, F.lit("+-0")))


def utf16_len(c: Column) -> Column:
    """UTF-16 code units.  ASCII text, the usual case, needs no re-encoding."""
    plain = F.octet_length(c) == F.length(c)
    return F.when(plain, F.length(c)).otherwise(
        (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int"))


def byte_length(c: Column, charset: str = "UTF-16LE") -> Column:
    return F.octet_length(F.encode(c, charset)).cast("long")


def sized(n: Column) -> Column:
    """Observed width plus a quarter of headroom; 0 for nothing observed."""
    return F.when(n <= 0, F.lit(0)).otherwise(F.ceil(n * F.lit(1.25))).cast("long")


def text_width_bucket(n: Column) -> Column:
    """Declared width for an observed width; null stands for unbounded."""
    stepped = (F.floor(n / 50) + 1) * 50
    return (F.when(n > 4000, F.lit(None))
            .when(n <= 200, F.lit(255))
            .otherwise(F.least(stepped, F.lit(4000)))).cast("int")


def _unsigned_parts(t: Column) -> tuple[Column, Column]:
    """Integer and fraction digits of an exponent-free mantissa."""
    mantissa = F.ltrim(t, F.lit("+-"))
    whole = F.substring_index(mantissa, ".", 1)
    frac = F.when(mantissa.contains("."), F.substring_index(mantissa, ".", -1)).otherwise("")
    return whole, frac


def numeric_token(c: Column) -> Column:
    """Struct of the token's exact shape, or null when it is not numeric.

    ``int_digits`` and ``scale`` are what a decimal needs to hold the value
    without loss, so ``precision = int_digits + scale``.
    """
    return bind(strip_blanks(c), lambda t: F.when(is_numeric_token(t), bind(_token_parts(t), _token_shape)))


def _token_parts(t: Column) -> Column:
    exp_text = F.regexp_extract(t, r"[eE]([+-]?[0-9]+)$", 1)
    exp_digits = F.ltrim(F.ltrim(exp_text, F.lit("+-")), F.lit("0"))
    exp_abs = (F.when(exp_digits == "", F.lit(0))
               .when(F.length(exp_digits) > 3, F.lit(1000))
               .otherwise(exp_digits.try_cast("int")))
    whole, frac = _unsigned_parts(F.regexp_extract(t, r"^([^eE]*)", 1))
    return F.struct(whole.alias("whole"), F.concat(whole, frac).alias("digits"),
                    F.when(exp_text.startswith("-"), -exp_abs).otherwise(exp_abs).alias("exponent"),
                    (exp_text != "").alias("has_exp"), t.contains(".").alias("has_point"))


def _token_shape(p: Column) -> Column:
    digits = p["digits"]
    point = F.length(p["whole"]) + p["exponent"]
    significant = F.ltrim(digits, F.lit("0"))
    first_nonzero = F.length(digits) - F.length(significant)
    int_digits = F.when(significant == "", F.lit(0)).otherwise(F.greatest(point - first_nonzero, F.lit(0)))
    scale = F.greatest(F.length(digits) - point, F.lit(0))
    return F.struct(
        (~p["has_point"] & ~p["has_exp"]).alias("int_syntax"),
        p["has_exp"].alias("has_exp"),
        int_digits.cast("int").alias("int_digits"),
        scale.cast("int").alias("scale"),
        F.greatest(F.lit(1), int_digits + scale).cast("int").alias("precision"),
    )


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def exact_sample(c: Column) -> Column:
    """True when a double shows the token's value exactly, so it may be
    published as a number; otherwise the text itself must be kept.

    Up to 15 significant digits always survive and more than 17 never do; only
    what lies between is read back and compared.
    """
    return bind(strip_blanks(c), _exact_trimmed)


def _exact_trimmed(t: Column) -> Column:
    whole, frac = _unsigned_parts(t)
    lead = F.ltrim(whole, F.lit("0"))
    digits = F.rtrim(F.ltrim(F.concat(whole, frac), F.lit("0")), F.lit("0"))
    is_whole = F.rtrim(frac, F.lit("0")) == ""
    n = F.length(lead)
    safe_whole = (n < 16) | ((n == 16) & (lead <= str(SAFE_INTEGER)))
    round_trip = F.when((n <= 20) & (F.length(frac) <= 18),
                        t.try_cast("decimal(38,18)")
                        == t.try_cast("double").try_cast("string").try_cast("decimal(38,18)"))
    survives = (F.length(digits) <= 15) | ((F.length(digits) <= 17) & F.coalesce(round_trip, F.lit(False)))
    shown = F.when(is_whole, safe_whole & (~t.contains(".") | survives)).otherwise(survives)
    plain = is_numeric_token(t) & ~t.contains("e") & ~t.contains("E")
    return F.coalesce(F.when(plain, (n + F.length(frac) <= MAX_DECIMAL_PRECISION) & shown), F.lit(False))
