"""Exact distribution figures that survive hot groups.

Rows are first counted per (group, value), which combines on the map side and
spreads a hot group over all its values. Order statistics are then located in
two steps: running totals over coarse value buckets name the few buckets that
hold the wanted ranks, and only those buckets are ordered value by value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_E_FOLD = 256


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, _v, _n``; null groups and null values are left out."""
    known = F.lit(True)
    for name in (*keys, value):
        known = known & F.col(name).isNotNull()
    return (
        df.filter(known)
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count("*").alias("_n"))
    )


def _bucket(v: Column) -> Column:
    """Coarse bucket that never decreases as ``v`` grows.

    Made non-nullable so that no null filter is inferred for one side of the
    join on it only; both sides then share one exchange of the counts.
    """
    bucket = (F.signum(v) * F.floor(F.log1p(F.abs(v)) * BUCKETS_PER_E_FOLD)).cast("long")
    return F.coalesce(bucket, F.lit(0))


def quantiles_from_counts(
    counts: DataFrame, keys: Sequence[str], probs: dict[str, float]
) -> DataFrame:
    """``keys, n_rows`` and one linearly interpolated quantile per entry of ``probs``."""
    bucketed = counts.withColumn("_b", _bucket(F.col("_v").cast("double")))
    by_bucket = bucketed.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.select(
        *keys,
        "_b",
        "_bn",
        F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_start"),
        F.sum("_bn").over(group).alias("n_rows"),
    )

    def position(p: float) -> Column:
        return (F.col("n_rows") - 1) * F.lit(float(p))

    def holds(rank: Column, start: Column, size: Column) -> Column:
        return (rank >= start) & (rank < start + size)

    wanted = F.lit(False)
    for p in probs.values():
        for rank in (F.floor(position(p)), F.ceil(position(p))):
            wanted = wanted | holds(rank, F.col("_start"), F.col("_bn"))
    hits = offsets.filter(wanted).drop("_bn")

    inside = (
        Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = bucketed.join(hits, [*keys, "_b"]).withColumn(
        "_first_rank", F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    )

    aggs = [F.first("n_rows").alias("n_rows")]
    for name, p in probs.items():
        for side, rank in (("lo", F.floor(position(p))), ("hi", F.ceil(position(p)))):
            at = F.when(holds(rank, F.col("_first_rank"), F.col("_n")), F.col("_v").cast("double"))
            aggs.append(F.max(at).alias(f"{name}_{side}"))
    edges = ranked.groupBy(*keys).agg(*aggs)
    out = [*keys, "n_rows"]
    for name, p in probs.items():
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out.append((lo + (hi - lo) * (position(p) - F.floor(position(p)))).alias(name))
    return edges.select(*out)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    return quantiles_from_counts(value_counts(df, keys, value), keys, probs)


def group_summary(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """``keys, n_rows, mean`` and quantiles from a single pass of counting over ``df``.

    The mean divides an exact whole-number sum when ``value`` is whole.
    """
    counts = value_counts(df, keys, value)
    means = counts.groupBy(*keys).agg(
        (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean")
    )
    return quantiles_from_counts(counts, keys, probs).join(means, list(keys))


def approximate_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], accuracy: int = 10000
) -> DataFrame:
    """One-shuffle sketch version for callers who accept a bounded rank error."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n_rows"),
            *[F.percentile_approx(value, p, accuracy).alias(n) for n, p in probs.items()],
        )
    )
