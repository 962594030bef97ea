"""Mixing sources to token targets by entropy balancing.

Every document gets a rate between 0 and ``cap``; among all rates that give each
source its target, those nearest to 1 in relative entropy are exponentially
tilted: odds ``exp(lam * size / mean)``.  ``lam`` is the multiplier of the source's token
constraint and solves a convex dual, found by Newton steps that are sums over
all rows (kept per source and size, which is all the rates depend on).  Rates
become whole copies by comparing the fraction with a hash of the document; the
threshold is moved so that each source meets its target within about one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workspace import materialise
from .common import small, uniform

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BINS = 1 << 16
STEPS = 60
TOLERANCE = 1e-9


def source_key(source: Column) -> Column:
    """Joins and groups keep the null source apart from every name; it sorts last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``skey, source_size`` with the ``target`` of each source.

    Weights repeat over the sources in code point order.  Targets are level * weight, held at cap * size:
    the level at which all targets add up to ``share`` of all sizes is found from the sources in the order in
    which they reach the cap.  The windows run over one row per source.
    """
    order = Window.orderBy("skey")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = (sources.withColumn("weight", weight)
              .withColumn("ratio", cap * F.col("source_size") / F.col("weight")))
    by_ratio = Window.orderBy("ratio", "skey")
    up_to = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    held = F.coalesce(F.sum(cap * F.col("source_size")).over(up_to), F.lit(0))
    free = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0))
    level = (share * F.sum("source_size").over(whole) - held) / free
    # level if exactly the sources before this one are held; true for the first one that stays below its cap
    levels = ranked.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("ratio"))
    found = F.min(F.when(F.col("fits"), F.struct("ratio", "skey", "level"))).over(whole)["level"]
    return levels.withColumn("found", found).select(
        "skey", "source_size", F.least(F.col("source_size").cast("double") * cap,
                                       F.coalesce(F.col("found") * F.col("weight"),
                                                  F.col("source_size").cast("double") * cap)).alias("target"))


def _rate(cap: int) -> Column:
    tilt = F.col("lam") * F.col("size") / F.col("mean")
    return F.when(F.col("full"), F.lit(float(cap))).otherwise(F.lit(float(cap)) / (1 + (cap - 1) * F.exp(-tilt)))


def solve(hist: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """``skey, target, source_size, mean, full, lam`` from the histogram ``skey, size, n``.

    Newton steps on all sources at once, kept inside a bracket that shrinks: a step that leaves it is halved.
    """
    mean = hist.groupBy("skey").agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1)))
                                    .alias("mean"))
    state = targets.join(mean, "skey").select(
        "skey", "source_size", "target", F.greatest("mean", F.lit(1e-9)).alias("mean"),
        (F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"))
    state = materialise(state, "mix-start")
    for _ in range(STEPS):
        r, z = _rate(cap), F.col("size") / F.col("mean")
        sums = (hist.join(state, "skey").where(~F.col("full")).groupBy("skey")
                .agg(F.sum(F.col("n") * F.col("size") * r).alias("mass"),
                     F.sum(F.col("n") * F.col("size") * z * r * (1 - r / cap)).alias("slope")))
        step = state.join(sums, "skey", "left")
        gap = F.col("mass") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        step = step.select("skey", "source_size", "target", "mean", "full", "lam", "slope", gap.alias("gap"),
                           lo.alias("lo"), hi.alias("hi"))
        newton = F.col("lam") - F.col("gap") / F.greatest("slope", F.lit(1e-300))
        inside = (newton > F.col("lo")) & (newton < F.col("hi"))
        # a bracket that still has its first bound grows by doubling instead of halving the whole range
        wide = (F.col("hi") - F.col("lo")) > 1e5
        other = F.when(wide, F.when(F.col("gap") < 0, F.col("lam") * 2 + 1).otherwise(F.col("lam") * 2 - 1)) \
            .otherwise((F.col("lo") + F.col("hi")) / 2)
        done = F.col("gap").isNull() | (F.abs("gap") <= F.col("target") * TOLERANCE)
        state = materialise(step.select(
            "skey", "source_size", "target", "mean", "full",
            F.when(done, F.col("lam")).when(inside, newton).otherwise(other).alias("lam"),
            "lo", "hi", (~done).alias("open")), "mix-newton")
        if state.where("open").limit(1).count() == 0:
            break
        state = state.drop("open")
    return state.select("skey", "source_size", "target", "mean", "full", "lam")


def mix(docs: DataFrame, source: Column, size: Column, identity: list[Column], weights=WEIGHTS,
        share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The columns of ``docs`` in a struct ``row``, with ``size, source_size, target, rate, copies``.

    A null size counts as 0; documents of size 0 keep the copies their rate gives and take no words.  The null
    source is a source.  Equal rows get equal copies.  An empty table gives no rows.  All sums are
    over all rows; ``copies`` never exceeds ``cap``.
    """
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       source_key(source).alias("skey"), F.coalesce(size, F.lit(0)).cast("long").alias("size"),
                       uniform(*identity).alias("u"))
    hist = materialise(base.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    sums = hist.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = materialise(source_targets(sums, weights, share, cap), "mix-targets")
    state = solve(hist, targets, cap)
    rated = base.join(small(state), "skey").withColumn("rate", F.least(_rate(cap), F.lit(float(cap))))
    whole = F.floor("rate")
    at = F.floor((F.col("u") - (F.col("rate") - whole) + 1) * (BINS // 2)).cast("int")
    rated = rated.withColumn("whole", whole).withColumn("bin", at)
    # words that each threshold would add, per source: at most BINS rows a source
    by_bin = (rated.groupBy("skey", "bin")
              .agg(F.sum(F.when(F.col("whole") < cap, F.col("size")).otherwise(0)).alias("more"),
                   F.sum(F.col("whole") * F.col("size")).alias("sure")))
    w = Window.partitionBy("skey")
    run = (by_bin.withColumn("added", F.sum("more").over(w.orderBy("bin")))
           .withColumn("sure_all", F.sum("sure").over(w)))
    run = run.join(state.select("skey", "target"), "skey")
    off = F.abs(F.col("sure_all") + F.col("added") - F.col("target"))
    none = F.abs(F.col("sure_all") - F.col("target"))
    cut = (run.groupBy("skey").agg(F.min(F.struct(off.alias("off"), F.col("bin"))).alias("best"),
                                   F.first(none).alias("none"))
           .select("skey", F.when(F.col("none") <= F.col("best.off"), F.lit(-1))
                   .otherwise(F.col("best.bin")).alias("cut")))
    cut = materialise(cut, "mix-cuts")
    copies = F.least(F.col("whole") + (F.col("bin") <= F.col("cut")).cast("long"), F.lit(cap)).cast("int")
    return rated.join(small(cut), "skey").select("row", "size", "source_size", "target", "rate",
                                                 copies.alias("copies"))
