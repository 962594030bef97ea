"""Uniform shuffle into shards of exact size.

Rows are dealt to virtual partitions by a hash of their content.  The number of
rows that each partition sends to each shard is drawn from the hypergeometric
law, so that the shards have their exact sizes before a row has moved.  Inside a
partition a random order decides which rows make up each share; after the
exchange a second random order gives the place in the shard.  Only the matrix of
counts (partitions x shards) passes through the driver.  The number of virtual partitions
grows with the rows, so that a partition stays a task's worth of work.
"""

from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workspace import materialise
from .common import small

#: Least and most virtual partitions, and the rows one holds on average before their number doubles.
PARTITIONS, MOST_PARTITIONS = 1 << 8, 1 << 16
ROWS_PER_PARTITION = 1 << 20


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows, taken without replacement, are among the ``good`` ones.

    Inverts the distribution from its mode outwards, which takes a few standard
    deviations of steps and works for counts beyond 32 bits.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    logc = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p0 = math.exp(logc(good, mode) + logc(bad, draws - mode) - logc(total, draws))
    rest = rng.random() - p0
    up, down, p_up, p_down = mode, mode, p0, p0
    while rest > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            rest -= p_up
            if rest <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            rest -= p_down
            if rest <= 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:
            break
    return mode


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that partition ``p`` sends to shard ``s``: row sums are the counts, column sums the shard sizes."""
    rng, total = random.Random(seed), sum(counts)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in counts:
        pool, line = sum(left), []
        for s in range(shards):
            pool -= left[s]
            k = hypergeometric(rng, left[s], pool, n) if n else 0
            line.append(k)
            left[s] -= k
            n -= k
        matrix.append(line)
    return matrix


def partition_bits(total: int, rows: int = ROWS_PER_PARTITION) -> int:
    """Binary logarithm of the number of virtual partitions for ``total`` rows."""
    wanted = max(1, -(-total // rows))
    return min(MOST_PARTITIONS.bit_length() - 1, max(PARTITIONS.bit_length() - 1, (wanted - 1).bit_length()))


def _told_apart(rows: DataFrame, identity: list[Column], seed: int, stored: bool) -> DataFrame:
    """``row, h1, h2``: the columns in a struct, and two hashes by which rows are dealt out and ordered.

    Rows of one identity would stay together in every order, so each gets its place in the table into its hashes; those
    of an identity of its own do not depend on where they are stored.
    """
    hashes = [F.xxhash64(F.lit(seed + k), *identity).alias(f"h{k + 1}") for k in range(2)]
    repeated = materialise(rows.select(*hashes).groupBy("h1", "h2").count().where("count > 1")
                           .select("h1", "h2", F.lit(True).alias("again")), "shard-repeated")
    base = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *hashes)
    if repeated.limit(1).count() == 0:
        return base
    base = base.withColumn("nth", F.monotonically_increasing_id())
    base = (base if stored else materialise(base, "shard-rows")).join(small(repeated), ["h1", "h2"], "left")
    apart = lambda h: F.when(F.col("again"), F.xxhash64(F.col(h), F.col("nth"))).otherwise(F.col(h)).alias(h)
    return base.select("row", apart("h1"), apart("h2"))


def shuffle_into_shards(rows: DataFrame, shards: int, identity: list[Column], seed: int = 0,
                        rows_per_partition: int = ROWS_PER_PARTITION, stored: bool = False) -> DataFrame:
    """The columns of ``rows`` in a struct ``row``, with ``shard`` and ``slot``.

    ``identity`` are the columns that tell rows apart.  Rows that share one are numbered by their place in the table, so that
    copies are spread like any other rows; they are written once for that, unless ``stored`` says that ``rows`` are read from a
    table as it is.  Shard sizes differ by one at most, slots run from 0 without a
    gap.  Null columns take part like any value; an empty table stays empty.
    For rows of an identity of their own it alone decides, so that any partitioning of the input gives the
    same shards.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    dealt = _told_apart(rows, identity, seed, stored)
    # counted in the finest partitions, at most MOST_PARTITIONS rows; coarser ones are sums of these
    fine = dealt.groupBy(F.pmod("h1", F.lit(MOST_PARTITIONS)).cast("int").alias("p")).count().collect()
    bits = partition_bits(sum(n for _, n in fine), rows_per_partition)
    counts = [0] * (1 << bits)
    for p, n in fine:
        counts[p % len(counts)] += n
    matrix = communication_matrix(counts, shards, seed)
    # the last rank of each share, partition by partition: one folded constant
    ends = F.split(F.lit(",".join(str(e) for line in matrix for e in itertools.accumulate(line))), ",") \
        .cast("array<bigint>")
    local = Window.partitionBy("p").orderBy("h2", "h1")
    mine = F.slice(ends, F.col("p") * shards + 1, shards)
    placed = (dealt.withColumn("p", F.pmod("h1", F.lit(len(counts))).cast("int"))
              .withColumn("rank", F.row_number().over(local))
              .withColumn("shard", F.size(F.filter(mine, lambda e: e < F.col("rank"))).cast("int")))
    # the second order: cut into pieces by the high bits of a fresh hash, so that a shard is many tasks
    again = F.xxhash64(F.lit(seed + 2), F.col("h2"), F.col("h1"))
    placed = placed.select("row", "shard", "h1", again.alias("h3"),
                           F.shiftrightunsigned(again, 64 - bits).cast("int").alias("piece"))
    pieces = materialise(placed.groupBy("shard", "piece").count(), "shard-pieces")   # shards x partitions rows
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("shard", "piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("shard", "piece").orderBy("h3", "h1")
    return (placed.withColumn("at", F.row_number().over(inner))
            .join(F.broadcast(offsets), ["shard", "piece"])
            .select("row", "shard", (F.col("offset") + F.col("at") - 1).cast("long").alias("slot")))
