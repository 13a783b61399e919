"""Autocorrelation of step lengths and persistence of step directions.

Lagged pairs are formed by windows over blocks of positions. Each block also
receives the first ``max_lag`` rows of the next one, so every pair meets in one
block, a long series is spread over many tasks, and no row is joined per lag.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wanderloop.config import group_rows
from wanderloop.functions import vectors as V
from wanderloop.operators.ordered import settled
from wanderloop.operators.quantiles import join_on_keys
from wanderloop.operators.summaries import require_short
from wanderloop.operators.trajectory import steps_of

EPS = 1e-12


def with_leads(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, lags: Sequence[int]
) -> DataFrame:
    """Rows with an array ``later`` holding ``value`` at pos + lag for each lag."""
    reach = max(lags)
    block = max(group_rows(df.sparkSession), 4 * reach)
    own = F.floor(F.col(pos) / block)
    spans = F.when(
        (F.col(pos) % block < reach) & (own > 0), F.array(own, own - 1)
    ).otherwise(F.array(own))
    spread = df.withColumn("_own", own).withColumn("_block", F.explode(spans))
    ahead = Window.partitionBy(*keys, "_block").orderBy(pos)
    later = F.array(*[F.lead(value, lag).over(ahead) for lag in lags])
    return (
        spread.withColumn("later", later)
        .filter("_own = _block")
        .drop("_own", "_block")
    )


def _by_lag(sums: DataFrame, keys: Sequence[str], lags: Sequence[int], fields: Sequence[str]) -> DataFrame:
    rows = [
        F.struct(F.lit(int(lag)).alias("lag"), *[F.col(f"{f}_{lag}").alias(f) for f in fields])
        for lag in lags
    ]
    return sums.select(*keys, "n", F.explode(F.array(*rows)).alias("_r")).select(*keys, "n", "_r.*")


def magnitude_acf(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, max_lag: int
) -> DataFrame:
    """(keys, lag, acf_mag): unbiased autocorrelation, NULL for a constant series."""
    keys = list(keys)
    mean = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    flat = join_on_keys(df, mean, keys).select(
        *keys, pos, (F.col(value) - F.col("_mean")).alias("_x")
    )
    lags = list(range(1, max_lag + 1))
    paired = with_leads(flat, keys, pos, "_x", lags)
    x = F.col("_x")
    sums = paired.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(x * x).alias("dot_0"),
        *[F.sum(x * F.get("later", F.lit(i))).alias(f"dot_{lag}") for i, lag in enumerate(lags)],
    )
    power = F.col("_p") / F.col("n")
    # Lags beyond the series have no pairs: the sum over the padding is zero.
    value_at = F.coalesce(F.col("dot"), F.lit(0.0)) / (F.col("n") - F.col("lag")) / power
    acf = (
        F.when(F.col("lag") == 0, F.lit(1.0))
        .when((F.col("n") < 2) | (F.abs(power) < EPS), F.lit(None).cast("double"))
        .when(F.col("lag") < F.col("n"), value_at)
    )
    long = _by_lag(sums, keys, [0, *lags], ["dot"])
    whole = sums.select(*keys, F.col("dot_0").alias("_p"))
    return join_on_keys(long, whole, keys).select(*keys, "lag", acf.alias("acf_mag"))


def direction_acf(
    steps: DataFrame, keys: Sequence[str], pos: str, step: str, max_lag: int
) -> DataFrame:
    """(keys, lag, cos_sim): mean cosine of steps ``lag`` apart; 1 at lag 0."""
    keys = list(keys)
    lags = list(range(1, max_lag + 1))
    sized = steps.select(
        *keys, pos, F.struct(F.col(step).alias("v"), V.norm(F.col(step)).alias("m")).alias("_s")
    )
    paired = with_leads(sized, keys, pos, "_s", lags)
    aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
    for i, lag in enumerate(lags):
        other = F.get("later", F.lit(i))
        cosine = V.dot(F.col("_s.v"), other["v"]) / (F.col("_s.m") * other["m"] + EPS)
        aggs.append(F.avg(cosine).alias(f"cos_{lag}"))
    sums = paired.groupBy(*keys).agg(*aggs).withColumn("cos_0", F.lit(1.0))
    return _by_lag(sums, keys, [0, *lags], ["cos"]).select(
        *keys, "lag", F.col("cos").alias("cos_sim")
    )


def trajectory_acf(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], point: str, max_lag: int = 40
) -> DataFrame:
    """(keys, lag, acf_mag, cos_sim) of every trajectory."""
    steps = steps_of(df, keys, order, point)
    lengths = steps.select(*keys, "pos", V.norm(F.col("step")).alias("length"))
    mags = magnitude_acf(lengths, keys, "pos", "length", max_lag)
    turns = direction_acf(steps, keys, "pos", "step", max_lag)
    return join_on_keys(mags, turns, [*keys, "lag"])


def acf_of_products(
    products: DataFrame, keys: Sequence[str], pos: str = "pos", dots: str = "dots", max_lag: int = 40
) -> DataFrame:
    """``trajectory_acf`` from inner products of increments with later ones, summed over column chunks.

    The points are not needed: cosines are products over lengths, and lengths are roots of products.
    """
    keys = list(keys)
    lags = list(range(1, max_lag + 1))
    sized = products.select(*keys, pos, dots, F.sqrt(F.get(dots, F.lit(0))).alias("length"))
    paired = with_leads(sized, keys, pos, "length", lags)
    aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
    for i, lag in enumerate(lags):
        cosine = F.get(dots, F.lit(lag)) / (F.col("length") * F.get("later", F.lit(i)) + EPS)
        aggs.append(F.avg(cosine).alias(f"cos_{lag}"))
    turns = _by_lag(paired.groupBy(*keys).agg(*aggs).withColumn("cos_0", F.lit(1.0)), keys, [0, *lags], ["cos"])
    mags = magnitude_acf(sized.select(*keys, pos, "length"), keys, pos, "length", max_lag)
    return join_on_keys(mags, turns.select(*keys, "lag", F.col("cos").alias("cos_sim")), [*keys, "lag"])


def acf_statistics(acf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and sample deviation over seeds per lag, to four digits half-even."""
    aggs = []
    for c in ("acf_mag", "cos_sim"):
        aggs += [
            F.bround(F.avg(c), 4).alias(f"{c}_mean"),
            F.bround(F.stddev_samp(c), 4).alias(f"{c}_std"),
        ]
    return acf.groupBy(*keys, "lag").agg(*aggs)


def window_means(acf: DataFrame, keys: Sequence[str], lag: str = "lag", value: str = "cos_sim") -> DataFrame:
    """Mean over lags 1-10, 11-20 and 1-20."""
    spans = {"C1_10": (1, 10), "C11_20": (11, 20), "C1_20": (1, 20)}
    return acf.groupBy(*keys).agg(
        *[F.avg(F.when(F.col(lag).between(a, b), F.col(value))).alias(n) for n, (a, b) in spans.items()]
    )


def persistence_differences(windows: DataFrame, group: str) -> DataFrame:
    """Pairwise C1_20 differences of group means; the groups are a short label list."""
    means = settled(windows.groupBy(group).agg(F.avg("C1_20").alias("m")))
    require_short(means, [], 100)
    packed = means.agg(F.array_sort(F.collect_list(F.struct(group, "m"))).alias("g"))
    first = packed.select("g", F.posexplode("g").alias("i", "a"))
    later = F.slice("g", F.col("i") + 2, F.size("g"))
    return first.select("a", F.explode(later).alias("b")).select(
        F.col(f"a.{group}").alias(f"{group}_a"), F.col(f"b.{group}").alias(f"{group}_b"),
        (F.col("a.m") - F.col("b.m")).alias("diff"),
    )


def next_stage_suggested(windows: DataFrame, group: str, threshold: float = 0.10) -> DataFrame:
    """One row: does any group's mean C1_20 exceed the threshold in size?"""
    means = windows.groupBy(group).agg(F.avg("C1_20").alias("m"))
    return means.agg(F.coalesce(F.bool_or(F.abs("m") > threshold), F.lit(False)).alias("any_structure"))


__all__ = [
    "acf_of_products", "acf_statistics", "direction_acf", "magnitude_acf", "next_stage_suggested",
    "persistence_differences", "trajectory_acf", "window_means", "with_leads",
]
