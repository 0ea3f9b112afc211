"""Exact interpolated percentiles without holding a group's values in one buffer."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window, functions as F

# Bins per doubling of |value|; about 65,000 bins span the whole double range.
BINS_PER_OCTAVE = 64


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, ps: dict[str, float]) -> DataFrame:
    """``keys`` plus one column per entry of ``ps``; null values are ignored.

    ``percentile`` gathers every distinct value of a group in one aggregation buffer.
    Here values are counted first (a plain aggregation keyed by group *and* value),
    the counts are folded into an order-preserving histogram of bounded size, and only
    the few bins that hold a wanted rank are looked at value by value.
    """
    keys = list(keys)
    freq = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    bin_of = F.floor(F.signum("_v") * F.log2(F.lit(1.0) + F.abs("_v")) * BINS_PER_OCTAVE)
    binned = freq.withColumn("_b", bin_of)

    in_order = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    hist = (
        binned.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
        .withColumn("_start", F.sum("_bn").over(in_order) - F.col("_bn"))
        .withColumn("_total", F.sum("_bn").over(whole))
    )

    def rank(p):
        return F.lit(float(p)) * (F.col("_total") - 1)

    def covers(r, start, n):
        return (r >= start) & (r < start + n)

    wanted = F.lit(False)
    for p in ps.values():
        for edge in (F.floor(rank(p)), F.ceil(rank(p))):
            wanted = wanted | covers(edge, F.col("_start"), F.col("_bn"))
    hit = hist.filter(wanted).select(*keys, "_b", "_start", "_total")

    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = binned.join(hit, [*keys, "_b"]).withColumn(
        "_from", F.col("_start") + F.sum("_n").over(inside) - F.col("_n"))
    aggs = [F.max("_total").alias("_total")]
    for name, p in ps.items():
        for side, edge in (("lo", F.floor(rank(p))), ("hi", F.ceil(rank(p)))):
            aggs.append(F.max(F.when(covers(edge, F.col("_from"), F.col("_n")), F.col("_v"))).alias(f"_{side}_{name}"))
    edges = ranked.groupBy(*keys).agg(*aggs)
    return edges.select(*keys, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (rank(p) - F.floor(rank(p)))).alias(n)
        for n, p in ps.items()
    ])
