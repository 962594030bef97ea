"""Secret scan with linking of multipart credentials.

Base findings are three patterns.  Beside them, weaker parts of credentials are
found: identifiers, secrets and endpoints.  Alone they prove nothing and are not
reported.  The text is covered by overlapping scopes; parts are joined with the
scopes that hold them, and a weak part is reported when one of its
scopes also holds a part of another role, one of them a secret whose value looks
like one (``SHAPE``): prose such as "pass: through" or a name next to an address
completes nothing.  A weak secret made of plain letters is missed for that.  Only DataFrame functions are used.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import materialise

# The base patterns.
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"          # the maximal runs of 24 or more

# Weak parts: (kind, role, pattern, group that must have the least length, least length)
IDENTIFIER, SECRET, ENDPOINT = 1, 2, 4
WEAK = [
    ("weak_id", IDENTIFIER,
     r"""\b(?i:access_?key(?:_?id)?|client_?id|account(?:_?id)?|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?"""
     r"""([A-Za-z0-9._@-]+)""", 1, 4),
    ("weak_secret", SECRET,
     r"""\b(?i:pwd|pass|pass_?phrase|private_?key|access_?secret|credential)["']?\x20*[:=]\x20*["']?"""
     r"""([^\s"',;]+)""", 1, 6),
    ("weak_blob", SECRET, r"[A-Za-z0-9+/]{32,}={0,2}", 0, 32),
    ("endpoint", ENDPOINT,
     r"""\b(?i:https?|s3a?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]+""", 0, 8),
]
BASE = [("assign", SECRET, ASSIGN, 1, 6), ("access", IDENTIFIER, ACCESS, 0, 20), ("hex", SECRET, HEX, 0, 24)]
KINDS = [k[0] for k in BASE + WEAK]
ROLES = [k[1] for k in BASE + WEAK]

#: What the measured group of a match must also contain.
SHAPE = (r"[A-Za-z]", r"[0-9!#$%^&*+=~]")
ALSO = {"weak_secret": SHAPE, "weak_blob": (r"[0-9]", r"[A-Z]", r"[a-z]")}

#: Scopes are this long and begin at every half of it (code points).
SCOPE = 512


def running_sums(lengths: Column) -> Column:
    """Sums of the elements before each one, in pieces of 256 so that long arrays stay cheap to build."""
    k = 256
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(lengths) - 1) / k), F.lit(0)).cast("int")),
                         lambda i: F.slice(lengths, i * k + 1, k))
    plus = lambda a, x: a + x
    sums = F.transform(pieces, lambda c: F.aggregate(c, F.lit(0).cast("long"), plus))

    def inner(c: Column, i: Column) -> Column:
        start = F.aggregate(F.slice(sums, 1, i), F.lit(0).cast("long"), plus)
        run = F.aggregate(c, F.array(start), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return F.slice(run, 1, F.size(c))
    return F.flatten(F.transform(pieces, inner))


SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def pattern_spans(t: Column, number: int, pattern: str, group: int, least: int, also=()) -> Column:
    """Non-overlapping matches from the left whose ``group`` has at least ``least`` characters
    and contains every pattern in ``also``.

    Places follow from the lengths of the matches and of the text between them.
    """
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    lens = F.transform(found, lambda m: F.length(m).cast("long"))
    values = found if not group else F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
    checked = F.transform(values, lambda m: F.length(m).cast("long"))
    if also:
        checked = F.transform(values, lambda m: F.when(
            functools.reduce(lambda a, b: a & b, [m.rlike(p) for p in also]), F.length(m).cast("long")).otherwise(0))
    gaps = F.transform(F.split(t, pattern, -1), lambda m: F.length(m).cast("long"))

    def place(p: Column) -> Column:
        starts = running_sums(F.transform(p["lens"], lambda n, i: n + F.get(p["gaps"], i)))
        spans = F.transform(p["lens"], lambda n, i: F.struct(
            (F.get(starts, i) + F.get(p["gaps"], i)).alias("start"), F.lit(number).alias("kind"),
            (F.get(starts, i) + F.get(p["gaps"], i) + n).alias("end"), F.get(p["checked"], i).alias("size")))
        kept = F.filter(spans, lambda s: s["size"] >= least)
        return F.transform(kept, lambda s: F.struct(s["start"], s["kind"], s["end"])).cast(SPAN)
    parts = F.array(F.struct(lens.alias("lens"), checked.alias("checked"), gaps.alias("gaps")))
    return F.when(t.rlike(pattern), F.get(F.transform(parts, place), F.lit(0))).otherwise(F.array().cast(SPAN))


def spans_text(spans: Column, kinds: list[str] = KINDS) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_parts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``weak`` spans (start, kind, end; sorted), the key of its text, and
    ``proof``: the base spans that may complete weak parts, that is without assignments of prose."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs
    for number, (kind, _, pattern, group, least) in enumerate(BASE + WEAK):
        out = out.withColumn(f"_{kind}", pattern_spans(t, number, pattern, group, least, ALSO.get(kind, ())))
    kind, _, pattern, group, least = BASE[0]
    out = out.withColumn("_shaped", F.when(F.size(f"_{kind}") > 0, pattern_spans(t, 0, pattern, group, least, SHAPE))
                         .otherwise(F.array().cast(SPAN)))
    base = F.concat(*[F.col(f"_{k[0]}") for k in BASE])
    proof = F.concat("_shaped", *[F.col(f"_{k[0]}") for k in BASE[1:]])
    weak = F.concat(*[F.col(f"_{k[0]}") for k in WEAK])
    return out.withColumn("base", F.array_sort(base)).withColumn("weak", F.array_sort(weak)) \
        .withColumn("proof", proof).withColumn("text_key", F.sha2(t, 256)).drop("_shaped", *[f"_{k}" for k in KINDS])


def link_parts(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``text_key, linked``: weak spans that share a scope with a part of another role, if one of the parts is a secret.

    Parts are joined with scopes by interval: each lies in the scopes of which it
    touches a half.  Per scope only the set of roles is kept, so a scope full of parts
    stays one row, and no pairs are listed.
    """
    parts = (found.where((F.size("weak") > 0) & (F.size("weak") + F.size("proof") > 1))
             .dropDuplicates(["text_key"])
             .select("text_key", F.explode(F.concat("proof", "weak")).alias("s")))
    role = F.get(F.array(*[F.lit(r) for r in ROLES]), F.col("s.kind"))
    half = scope // 2
    first, last = F.floor(F.col("s.start") / half), F.floor((F.col("s.end") - 1) / half)
    placed = parts.select("text_key", "s", role.alias("role"),
                          F.explode(F.sequence(first - 1, last)).alias("scope"))
    scopes = placed.groupBy("text_key", "scope").agg(F.bit_or("role").alias("roles"))
    return (placed.where(F.col("s.kind") >= len(BASE)).join(scopes, ["text_key", "scope"])
            .where((F.col("roles") != F.col("role")) & (F.col("roles").bitwiseAND(F.lit(SECRET)) != 0))
            .groupBy("text_key").agg(F.array_sort(F.collect_set("s")).alias("linked")))


def scan_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 scope: int = SCOPE) -> DataFrame:
    """Columns ``keep`` with ``base`` and ``linked`` spans of every document.

    A null text counts as empty and has none.  Repeated rows get the same spans; each distinct text is linked once.
    Places are code points, ends exclusive.
    """
    found = materialise(find_parts(docs.select(*keep, text), text).select(*keep, "text_key", "base", "weak", "proof"),
                        "secret-parts")
    linked = materialise(link_parts(found, scope), "secret-links")
    return found.join(linked, "text_key", "left").select(
        *keep, "base", F.coalesce("linked", F.array().cast(SPAN)).alias("linked"))
