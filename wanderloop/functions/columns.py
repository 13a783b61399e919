"""Scalar column helpers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings read as true.
TRUE_WORDS = ("true", "1", "yes", "y", "formal", "primary")


def is_true_text(c: Column) -> Column:
    """Lenient truth of any value through its text; NULL is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def number_or_null(c: Column) -> Column:
    """Numeric reading of text; anything unreadable, and NaN, becomes NULL."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def wilson_bounds(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of k successes in n trials, clipped to [0, 1]."""
    k, n = k.cast("double"), n.cast("double")
    p = k / n
    scale = 1.0 + z * z / n
    mid = (p + z * z / (2.0 * n)) / scale
    half = F.lit(z) * F.sqrt(p * (1.0 - p) / n + z * z / (4.0 * n * n)) / scale
    low, high = F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)
    return F.when(n > 0, low), F.when(n > 0, high)


def select_existing(df: DataFrame, wanted: Sequence[str], keep_rest: bool = False) -> DataFrame:
    """The wanted columns that exist, in that order, then optionally the rest."""
    first = [c for c in wanted if c in df.columns]
    rest = [c for c in df.columns if c not in first] if keep_rest else []
    return df.select(*first, *rest)


def constant_columns(df: DataFrame, values: dict) -> DataFrame:
    """Echo run settings into every row."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def grid(df: DataFrame, axes: dict[str, Sequence]) -> DataFrame:
    """Every row against every combination of short literal lists."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def is_finite_number(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf))
