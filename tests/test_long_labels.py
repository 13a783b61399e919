"""Labels that are too long for a matrix in memory: the same rows as for short ones, nothing left out."""

from __future__ import annotations

import numpy as np
import pytest
from brute import h1_bars_by_matrix_reduction

from wanderloop.functions import topology as T
from wanderloop.plans import geometry
from wanderloop.plans.catalogue import QUERIES

SIZES = {0: 26, 1: 15, None: 22, 3: 1}


@pytest.fixture(scope="module")
def long_dir(spark, tmp_path_factory):
    """Labels around a limit of 20, one of them null, one of a single point, one with rows that come twice."""
    rng = np.random.default_rng(4)
    rows = []
    for label, n in SIZES.items():
        x = (rng.normal(size=(n, 64)) * ([1.0] * 3 + [0.02] * 61)).astype(np.float32)
        if label == 0:
            x[7] = x[6]
        rows += [(1000 * (label or 9) + i, label, p.tolist()) for i, p in enumerate(x)]
    path = tmp_path_factory.mktemp("long")
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def rows_of(df):
    plain = lambda v: float(f"{v:.6g}") if isinstance(v, float) else v
    return sorted((tuple(plain(v) for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["h1_max_lifetime", "h1_diagram", "top_h1_bar", "full_audit_geo", "block_robustness", "projection_max_test", "archetype_decisions", "loop_control"])
def test_queries_give_the_same_rows_for_long_labels(spark, long_dir, monkeypatch, name):
    def rows():
        df = QUERIES[name](spark, long_dir)
        if name == "loop_control":
            # Steps of a loop are of equal length, so rounding chooses among neighbours, and decides whether a null
            # that is the loop itself reaches it; and a short label that is null has no rows.
            df = df.filter("label IS NOT NULL").select(
                "label", "amp_frac", "block_size", "N_pts", "n_nulls_used", "geo_status", "euc_Lobs", "euc_null_med"
            )
        return rows_of(df)

    want = rows()
    monkeypatch.setattr(geometry, "MAX_POINTS", 20)
    got = rows()
    assert len(got) == len(want) > 2
    for a, b in zip(got, want):
        assert [v for v in a if not isinstance(v, float)] == [v for v in b if not isinstance(v, float)]
        assert [v for v in a if isinstance(v, float)] == pytest.approx([v for v in b if isinstance(v, float)], rel=1e-4, abs=1e-5)


@pytest.mark.parametrize("kind", ["cloud", "walk", "grid", "twice"])
def test_matrices_in_files_give_the_same_bars(monkeypatch, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 3))
    if kind == "walk":
        x = np.cumsum(x, axis=0)
    elif kind == "grid":
        x = np.round(x)
    elif kind == "twice":
        x = np.vstack([x, x])

    def results():
        d = T.point_distances(x)
        geo, k, _ = T.geodesic_distances(d, 3, 50)
        ends = [T.filtration_end(m, p) for m in (d, geo) for p in (None, 90.0)]
        bars = [sorted(map(tuple, np.round(np.stack(T.h1_bars(d, end), axis=1), 9).tolist())) for end in ends[:2]]
        assert (d == d.T).all() and (geo == geo.T).all()
        return bars, [*ends, k, *T.lifetime_pair(d, 3, 50), *T.lifetime_pair(d, 3, 50, 90.0)], geo

    bars, numbers, geo = results()
    monkeypatch.setattr(T, "HELD", 500)
    assert isinstance(T.matrix((30, 30)).base, np.memmap)
    filed = results()
    assert filed[0] == bars and filed[1] == pytest.approx(numbers, rel=1e-9) and np.allclose(filed[2], geo)


def test_bars_of_matrices_in_files_equal_the_matrix_reduction(monkeypatch):
    monkeypatch.setattr(T, "HELD", 50)
    x = np.random.default_rng(6).normal(size=(22, 2))
    d = T.point_distances(x)
    end = T.filtration_end(d, None)
    want = h1_bars_by_matrix_reduction(np.array(d), end)
    assert np.allclose(sorted(zip(*T.h1_bars(d, end))), want)


def test_ranks_of_numbers_in_parts(monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.exp(rng.normal(size=4001) * 9), np.zeros(50), np.full(700, 2.5)])
    parts = lambda: iter(np.array_split(x, 7))
    want = [np.median(x), *(np.percentile(x, p) for p in (0, 12.5, 95, 100))]
    monkeypatch.setattr(T, "HELD", 100)
    assert [T.median(parts, len(x)), *(T.percentile(parts, len(x), p) for p in (0, 12.5, 95, 100))] == pytest.approx(want, rel=1e-14)
