"""Rank correlations: known values and slow definitions."""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wanderloop.operators import ranks as R


def test_kendall_p_known_values():
    k = np.arange(7)
    assert math.isclose(R.kendall_p(k, k), 2 / 5040)
    once = k.copy()
    once[[2, 3]] = once[[3, 2]]
    assert math.isclose(R.kendall_p(k, once), 14 / 5040)
    tied = np.array([0, 1, 1, 1, 1, 1, 1.0])
    assert math.isclose(R.kendall_p(k, tied), 0.13361440253771614, rel_tol=1e-12)


@pytest.mark.parametrize("n", [3, 4, 5, 6])
def test_exact_kendall_p_equals_enumeration(n):
    def score(order):
        return sum(np.sign(order[j] - order[i]) for i in range(n) for j in range(i + 1, n))

    every = [abs(score(p)) for p in permutations(range(n))]
    rng = np.random.default_rng(n)
    for _ in range(5):
        y = rng.permutation(n)
        want = np.mean(np.array(every) >= abs(score(y)))
        assert math.isclose(R.kendall_p(np.arange(n), y), min(1.0, want), rel_tol=1e-9)


def test_student_tail_known_values():
    assert math.isclose(R.student_two_sided(0.0, 5), 1.0)
    assert math.isclose(R.student_two_sided(1.0, 1), 0.5, rel_tol=1e-12)
    assert math.isclose(R.student_two_sided(2.0, 2), 1 - 2 / math.sqrt(6), rel_tol=1e-12)
    assert math.isclose(R.spearman_p(0.9761904761904762, 8), 3.31439602620015e-05, rel_tol=1e-9)


def test_spearman_equals_pandas(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"x": rng.integers(0, 12, 300) * 1.0, "y": rng.normal(size=300).round(1)})
    pdf["y"] += pdf["x"] / 6
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pdf.to_numpy()], "x double, y double")
    df = df.unionByName(spark.createDataFrame([(None, 1.0), (2.0, None)], "x double, y double"))
    want = pdf["x"].rank().corr(pdf["y"].rank())
    for rows in ("1000", "16"):
        spark.conf.set("spark.wanderloop.groupRows", rows)
        row = R.spearman(df, "x", "y").first()
        spark.conf.unset("spark.wanderloop.groupRows")
        assert row["n"] == 300 and math.isclose(row["rho"], want, rel_tol=1e-12)


def test_tau_b_with_ties(spark):
    df = spark.createDataFrame(
        [("a", [1.0, 2.0, 3.0, 4.0], [1.0, 1.0, 3.0, 2.0]), ("flat", [1.0, 2.0], [5.0, 5.0])],
        "id string, x array<double>, y array<double>",
    )
    got = {
        r["id"]: r for r in df.select(
            "id", R.kendall_tau_b(F.col("x"), F.col("y")).alias("t"), R.kendall_p_column("x", "y").alias("p")
        ).collect()
    }
    # five untied pairs: four concordant, one discordant
    assert math.isclose(got["a"]["t"], 3 / math.sqrt(6 * 5))
    assert got["flat"]["t"] is None


def slow_tau(x, y):
    i, j = np.triu_indices(len(x), 1)
    sx, sy = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
    a, b = np.abs(sx).sum(), np.abs(sy).sum()
    return (sx * sy).sum() / math.sqrt(a * b) if a * b else None


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 300])
def test_weighted_inversions(n):
    rng = np.random.default_rng(n)
    rank, w = rng.permutation(n), rng.integers(1, 5, n)
    i, j = np.triu_indices(n, 1)
    want = int((w[i] * w[j])[rank[i] > rank[j]].sum())
    assert R.inversions(rank, w) == want
    assert R.inversions(rank, w.astype(np.int64) << 40) == want << 80


@pytest.mark.parametrize("rows", [10, 70, 100_000])
def test_tau_of_long_columns(spark, rows):
    rng = np.random.default_rng(5)
    groups = {
        "ties": (rng.integers(0, 9, 150), rng.integers(0, 7, 150)), None: (rng.normal(size=120), rng.normal(size=120)),
        "same y": (np.arange(40), np.zeros(40)), "one": ([1], [2]), "up": (np.arange(60), np.arange(60) ** 2), "hot": (np.repeat([1, 2], 90), rng.normal(size=180)),
    }
    data = [(k, float(a), float(b)) for k, (x, y) in groups.items() for a, b in zip(x, y)]
    data += [("ties", None, 1.0), ("ties", 2.0, float("nan")), ("empty", None, None)]
    df = spark.createDataFrame(data, "k string, x double, y double")
    got = {r["k"]: r for r in R.kendall(df, ["k"], "x", "y", rows).collect()}
    assert set(got) == set(groups)
    for k, (x, y) in groups.items():
        want = slow_tau(np.asarray(x, float), np.asarray(y, float))
        assert got[k]["n"] == len(x) and (got[k]["tau"] == want or abs(got[k]["tau"] - want) < 1e-12)


def test_tau_of_a_million_rows(spark):
    """Noise around a slope, against the slow form on a tenth of a percent of it."""
    df = spark.range(1_000_000).select(
        F.lit(1).alias("k"), F.rand(1).alias("x"), F.lit(0.0).alias("y")
    ).withColumn("y", F.col("x") + F.rand(2))
    all_of = R.kendall(df, ["k"], "x", "y", 200_000).first()
    few = np.array([tuple(r) for r in df.select("x", "y").filter("x * 1000 - floor(x * 1000) < 0.003").collect()])
    assert all_of["n"] == 1_000_000 and abs(all_of["tau"] - slow_tau(few[:, 0], few[:, 1])) < 0.03


def test_slices_of_long_columns_stay_small():
    """54 million pairs were cut into slices of two million, of which an executor holds four."""
    from wanderloop.config import DEFAULT_GROUP_ROWS
    from wanderloop.operators import ranks

    for pairs in (1, 9_000_000, 54_000_000):
        slices = ranks.slice_count(pairs, DEFAULT_GROUP_ROWS)
        assert pairs / slices <= 1 << 19
    assert ranks.slice_count(100, 16) == 13
