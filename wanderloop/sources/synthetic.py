"""Known curves and clouds as (t, point) rows, for controls and tests.

Points are column expressions over a row range. Noise is hashed from the seed
and the row, so a curve does not depend on how its rows are partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wanderloop.operators.walk_nulls import TOKEN_SPAN, hash_number

TAU = 2.0 * math.pi


def hash_uniform(seed: int, *parts: Column) -> Column:
    """Uniform in (0, 1) from a hash of the seed and the parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return (hash_number(text) + 0.5) / TOKEN_SPAN


def hash_normal(seed: int, *parts: Column) -> Column:
    """Standard normal from two hashed uniforms."""
    radius = F.sqrt(-2.0 * F.log(hash_uniform(seed, *parts, F.lit("r"))))
    return radius * F.cos(TAU * hash_uniform(seed, *parts, F.lit("a")))


def curve(
    spark: SparkSession, n: int, shape: Callable[[Column], Sequence[Column]], noise: float, seed: int,
    closed: bool = False,
) -> DataFrame:
    """Rows t = 0..n-1 of ``shape`` over [0, 1] (end point left out when closed)."""
    t = F.col("t").cast("double") / (n if closed else max(n - 1, 1))
    coords = [
        c + noise * hash_normal(seed, F.col("t"), F.lit(j)) for j, c in enumerate(shape(t))
    ]
    return spark.range(n).select(F.col("id").cast("int").alias("t")).select("t", F.array(*coords).alias("point"))


def circle(spark: SparkSession, n: int, radius: float, noise: float, seed: int) -> DataFrame:
    shape = lambda t: [radius * F.cos(TAU * t), radius * F.sin(TAU * t), F.lit(0.0)]
    return curve(spark, n, shape, noise, seed, closed=True)


def helix(
    spark: SparkSession, n: int, turns: float, pitch: float, noise: float, seed: int, radius: float = 3.0
) -> DataFrame:
    def shape(t: Column) -> list[Column]:
        a = TAU * turns * t
        return [radius * F.cos(a), radius * F.sin(a), pitch * t]

    return curve(spark, n, shape, noise, seed)


def curvature_family(spark: SparkSession, n: int, lam: float, noise: float, seed: int) -> DataFrame:
    """From a straight rise (0) to one full turn (1)."""
    return helix(spark, n, lam, 5.0, noise, seed)


def drift(spark: SparkSession, n: int, noise: float, seed: int, length: float = 5.0, d: int = 3) -> DataFrame:
    axis = [hash_normal(seed, F.lit("axis"), F.lit(j)) for j in range(d)]
    size = F.sqrt(sum((a * a for a in axis[1:]), axis[0] * axis[0]))
    return curve(spark, n, lambda t: [length * t * a / size for a in axis], noise, seed)


def curved_drift(spark: SparkSession, n: int, noise: float, seed: int) -> DataFrame:
    return curve(spark, n, lambda t: [3.0 * t * t, 2.0 * t, F.lit(0.0)], noise, seed)


def overpass(spark: SparkSession, n: int, noise: float, seed: int, d: int = 50) -> DataFrame:
    """A plane curve that crosses itself, kept apart in the other coordinates."""
    cross = math.sqrt(3.0)

    def shape(unit: Column) -> list[Column]:
        t = 4.4 * unit - 2.2
        bump = 1000.0 * (F.exp(-200.0 * (t + cross) * (t + cross)) - F.exp(-200.0 * (t - cross) * (t - cross)))
        return [500.0 * (t * t * t - 3.0 * t), 500.0 * (t * t - 1.0), *[bump] * (d - 2)]

    return curve(spark, n, shape, noise, seed)


def embedded_circle(
    spark: SparkSession, n: int, cycles: int, radius: float, d: int, noise: float, seed: int
) -> DataFrame:
    def shape(t: Column) -> list[Column]:
        a = TAU * cycles * t
        return [radius * F.cos(a), radius * F.sin(a), *[F.lit(0.0)] * (d - 2)]

    return curve(spark, n, shape, noise, seed)


def random_steps(spark: SparkSession, n: int, d: int, seed: int) -> DataFrame:
    """Independent normal points; their running sum is a random walk."""
    return curve(spark, n, lambda t: [F.lit(0.0)] * d, 1.0, seed)


def swiss_roll(spark: SparkSession, n: int, noise: float, seed: int) -> DataFrame:
    """A rolled sheet, scaled to unit deviation by the caller if wanted."""
    row = F.col("t")

    def shape(_: Column) -> list[Column]:
        a = 1.5 * math.pi * (1.0 + 2.0 * hash_uniform(seed, row, F.lit("u")))
        return [a * F.cos(a), 10.0 * hash_uniform(seed, row, F.lit("h")), a * F.sin(a)]

    return curve(spark, n, shape, noise, seed)


def torus(spark: SparkSession, n: int, big: float, small: float, noise: float, seed: int) -> DataFrame:
    row = F.col("t")

    def shape(_: Column) -> list[Column]:
        u, v = TAU * hash_uniform(seed, row, F.lit("u")), TAU * hash_uniform(seed, row, F.lit("v"))
        ring = big + small * F.cos(v)
        return [ring * F.cos(u), ring * F.sin(u), small * F.sin(v)]

    return curve(spark, n, shape, noise, seed)


def figure_eight(spark: SparkSession, n: int, radius: float, noise: float, seed: int) -> DataFrame:
    """Two circles touching in one point."""
    row = F.col("t")

    def shape(_: Column) -> list[Column]:
        a = TAU * hash_uniform(seed, row, F.lit("u"))
        side = F.when(row % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
        return [side * radius * (1.0 - F.cos(a)), radius * F.sin(a), F.lit(0.0)]

    return curve(spark, n, shape, noise, seed)
