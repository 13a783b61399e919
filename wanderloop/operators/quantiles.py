"""Exact quantiles with linear interpolation, for groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wanderloop.config import group_rows
from wanderloop.operators.ordered import OrderedGroups, group_sizes

# Largest group handed to the built-in aggregate, which keeps every distinct
# value of a group in the memory of one task.
BUILT_IN_ROWS = 1_000_000


def join_on_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", null_safe: bool = False
) -> DataFrame:
    """Equi-join keeping the left copy of the keys.

    Plain equality lets Spark reuse a partitioning by the same keys; NULL keys
    match only with ``null_safe``, which costs that reuse.
    """
    if not null_safe:
        return left.join(right, list(keys), how)
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = term if cond is None else cond & term
    joined = left.join(renamed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def group_summary(
    df: DataFrame,
    keys: Sequence[str],
    aggs: Mapping[str, Column],
    quantiles: Mapping[str, tuple[str, float]],
    largest: int | None = None,
) -> DataFrame:
    """Plain aggregates and exact quantiles ``name -> (column, probability)``.

    Small groups take one aggregation with the built-in ``percentile``.
    Otherwise each quantile is found by rank, see ``quantiles_by_rank``.
    ``largest`` is the size of the largest group where it is known already.
    """
    keys = list(keys)
    plain = [expr.alias(name) for name, expr in aggs.items()]
    if largest is None:
        largest = group_sizes(df, keys).largest
    by_column: dict[str, dict[str, float]] = {}
    for name, (c, p) in quantiles.items():
        by_column.setdefault(c, {})[name] = float(p)
    if largest <= min(BUILT_IN_ROWS, group_rows(df.sparkSession)):
        # One aggregate per column: each keeps its own table of values.
        exact = [
            F.percentile(c, F.array(*[F.lit(p) for p in probs.values()])).alias(f"_q{i}")
            for i, (c, probs) in enumerate(by_column.items())
        ]
        got = df.groupBy(*keys).agg(*plain, *exact)
        picked = {
            name: F.get(f"_q{i}", F.lit(at))
            for i, probs in enumerate(by_column.values()) for at, name in enumerate(probs)
        }
        return got.select(*keys, *aggs, *[picked[name].alias(name) for name in quantiles])
    out = df.groupBy(*keys).agg(*plain, F.count(F.lit(1)).alias("_rows"))
    if not keys:
        raise ValueError("split quantiles need a key; use a constant column for the whole table")
    for c, probs in by_column.items():
        out = join_on_keys(out, quantiles_by_rank(df, keys, c, probs), keys, "left", null_safe=True)
    return out.select(*keys, *aggs, *quantiles)


def quantiles_by_rank(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Quantiles from counted values: no group meets in one task.

    Equal values are counted on the map side, counts are summed in value order
    slice by slice, and the two values around each wanted position are picked
    by a plain minimum.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_count")
    )
    upto = OrderedGroups(counts, keys, [value]).scan(sums={"_upto": "_count"})
    sizes = df.groupBy(*keys).agg(F.count(value).alias("_n"))
    joined = join_on_keys(upto, sizes, keys, null_safe=True)
    picks = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_n") - 1)
        for side, edge in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            above = F.when(F.col("_upto") > edge, F.col(value).cast("double"))
            picks.append(F.min(above).alias(f"_{side}_{name}"))
    picked = joined.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)
    out = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (at - F.floor(at)) * (hi - lo)).alias(name))
    return picked.select(*keys, *out)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], largest: int | None = None
) -> DataFrame:
    """Keys plus one column per named probability."""
    return group_summary(df, keys, {}, {name: (value, p) for name, p in probs.items()}, largest)


def median_and_mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys, ``center`` (median) and ``mad`` (median absolute deviation)."""
    largest = group_sizes(df, keys).largest
    center = exact_quantiles(df, keys, value, {"center": 0.5}, largest)
    spread = join_on_keys(df, center, keys, null_safe=True).withColumn("_dev", F.abs(F.col(value) - F.col("center")))
    return join_on_keys(center, exact_quantiles(spread, keys, "_dev", {"mad": 0.5}, largest), keys, null_safe=True)
