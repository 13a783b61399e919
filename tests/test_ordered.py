"""Ordered scans on split groups equal plain pandas, also with one hot key."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wanderloop.operators.ordered import OrderedGroups, hash_subsample, stride_kept, stride_subsample
from wanderloop.operators.quantiles import group_summary, median_and_mad
from wanderloop.operators.trajectory import segment_of


def hot_table(n: int = 600, seed: int = 0) -> pd.DataFrame:
    """A third of the rows under one key, one key with a single row, NULL keys."""
    rng = np.random.default_rng(seed)
    keys = np.where(rng.random(n) < 0.34, 0.0, rng.integers(1, 30, n).astype(float))
    keys[:3] = np.nan
    pdf = pd.DataFrame({"k": keys, "o": rng.permutation(n), "v": rng.normal(size=n).round(3)})
    pdf.loc[n] = [99.0, n, 1.0]
    return pdf


def frame(spark, pdf):
    rows = [
        (None if np.isnan(k) else int(k), int(o), float(v)) for k, o, v in pdf.itertuples(index=False)
    ]
    return spark.createDataFrame(rows, "k int, o int, v double")


@pytest.mark.parametrize("limit", [10_000, 16])
def test_scan_matches_pandas(spark, limit):
    pdf = hot_table()
    scan = OrderedGroups(frame(spark, pdf), ["k"], ["o"], limit=limit)
    assert scan.is_split == (limit == 16)
    got = scan.scan(position="pos", sums={"cum": "v"}, lags={"prev": "v"}).toPandas()
    assert len(got) == len(pdf)
    got = got.sort_values("o").reset_index(drop=True)
    want = pdf.sort_values("o").reset_index(drop=True)
    by = want.groupby("k", dropna=False)["v"]
    assert (got["pos"] == by.cumcount()).all()
    assert np.allclose(got["cum"], by.cumsum().where(want["k"].notna(), want[want["k"].isna()]["v"].cumsum()))
    assert np.allclose(got["prev"], by.shift(), equal_nan=True)


def test_scan_without_keys(spark, small_groups):
    pdf = hot_table()
    got = OrderedGroups(frame(spark, pdf), [], ["o"]).scan(position="pos", sums={"cum": "v"}).toPandas()
    got = got.sort_values("o")
    assert got["pos"].tolist() == list(range(len(pdf)))
    assert np.allclose(got["cum"], got["v"].cumsum())


def test_quantiles_split_equal_numpy(spark, small_groups):
    pdf = hot_table().dropna()
    pdf["v"] = pdf["v"].round(1)
    df = frame(spark, pdf)
    probs = {"q0": ("v", 0.0), "q37": ("v", 0.37), "q95": ("v", 0.95), "q1": ("v", 1.0)}
    got = group_summary(df, ["k"], {"n": F.count("v")}, probs).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        want = np.percentile(g["v"], [0, 37, 95, 100])
        assert np.allclose(got.loc[k, ["q0", "q37", "q95", "q1"]].astype(float), want)
        assert got.loc[k, "n"] == len(g)


def test_mad_split_equals_numpy(spark, small_groups):
    pdf = hot_table().dropna()
    got = median_and_mad(frame(spark, pdf), ["k"], "v").toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        med = np.median(g["v"])
        assert np.isclose(got.loc[k, "center"], med)
        assert np.isclose(got.loc[k, "mad"], np.median(np.abs(g["v"] - med)))


@pytest.mark.parametrize("n,cap", [(5, 10), (10, 10), (11, 10), (1000, 7), (1200, 600), (601, 600), (97, 2)])
def test_stride_positions_are_the_truncated_grid(spark, n, cap):
    got = spark.range(n).filter(stride_kept(F.col("id"), F.lit(n), cap)).toPandas()["id"].tolist()
    want = list(range(n)) if n <= cap else sorted(set(np.linspace(0, n - 1, cap, dtype=int).tolist()))
    assert sorted(got) == want


@pytest.mark.parametrize("n,cap", [(50, 20), (601, 600), (1000, 7), (12, 12)])
def test_segments_end_at_kept_checkpoints(spark, n, cap):
    kept = np.arange(n) if n <= cap else np.linspace(0, n - 1, cap, dtype=int)
    got = (
        spark.range(1, n).select("id", segment_of(F.col("id"), F.lit(n), cap).alias("s"))
        .toPandas().sort_values("id")["s"].to_numpy()
    )
    assert (got == np.searchsorted(kept, np.arange(1, n), side="left")).all()


def test_long_draws_equal_one_sort(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"))
    got = hash_subsample(df, ["k"], "o", 1500, 3).toPandas()
    from hashlib import md5
    for k in (0, 1):
        order = sorted(range(k, 5000, 2), key=lambda i: md5(f"3|{i}".encode()).hexdigest())
        part = got[got["k"] == k].sort_values("draw")
        assert part["o"].tolist() == order[:1500]


def test_subsamples(spark, small_groups):
    pdf = hot_table().dropna()
    df = frame(spark, pdf)
    strided = stride_subsample(df, ["k"], ["o"], 5).groupBy("k").count().toPandas().set_index("k")["count"]
    drawn = hash_subsample(df, ["k"], "o", 5, 1).groupBy("k").count().toPandas().set_index("k")["count"]
    for k, g in pdf.groupby("k"):
        assert strided[k] == drawn[k] == min(5, len(g))
