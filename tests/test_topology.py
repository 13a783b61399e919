"""H1 bars, graphs and distances against closed forms and slow definitions."""

from __future__ import annotations

import time
import tracemalloc

import numpy as np
import pytest
from brute import h1_bars_by_matrix_reduction

from wanderloop.functions import topology as T
from wanderloop.operators.principal import centred_gram, spectrum


def polygon(n: int) -> np.ndarray:
    a = np.arange(n) * 2 * np.pi / n
    return np.c_[np.cos(a), np.sin(a)]


def test_unit_square():
    d = T.point_distances(np.array([[0, 0], [1, 0], [1, 1], [0, 1.0]]))
    births, deaths = T.h1_bars(d, d.max())
    assert np.allclose(births, [1]) and np.allclose(deaths, [2**0.5])


@pytest.mark.parametrize("n", [6, 9, 20, 31])
def test_regular_polygon(n):
    d = T.point_distances(polygon(n))
    births, deaths = T.h1_bars(d, d.max())
    chord = lambda arcs: 2 * np.sin(np.pi * arcs / n)
    assert len(births) == 1
    assert np.isclose(births[0], chord(1)) and np.isclose(deaths[0], chord(-(-n // 3)))


def test_tree_metric_has_no_bars():
    d = np.abs(np.subtract.outer(np.arange(12.0), np.arange(12.0)))
    assert T.h1_bars(d, d.max())[0].size == 0
    assert T.max_h1_lifetime(d[:3, :3]) == 0.0


@pytest.mark.parametrize("seed", range(40))
def test_bars_equal_matrix_reduction(seed):
    rng = np.random.default_rng(seed)
    n, dim = int(rng.integers(4, 24)), int(rng.integers(1, 6))
    x = [
        rng.standard_normal((n, dim)), rng.standard_normal((n, dim)).cumsum(axis=0),
        rng.integers(0, 4, (n, dim)).astype(float), rng.standard_normal((n, dim)),
    ][seed % 4]
    d = T.point_distances(x)
    if seed % 4 == 3:
        d, _, _ = T.geodesic_distances(d, 3, 50)
    for pct in (None, 60.0):
        end = T.filtration_end(d, pct)
        if end == 0:
            continue
        want = h1_bars_by_matrix_reduction(d, end)
        for batch in (5, 512):
            got = sorted(zip(*T.h1_bars(d, end, batch)))
            assert len(got) == len(want)
            assert np.allclose(np.array(got).reshape(-1, 2), np.array(want).reshape(-1, 2))


def test_many_open_classes_use_more_than_one_word():
    rng = np.random.default_rng(5)
    d = T.point_distances(rng.standard_normal((80, 40)))
    end = T.filtration_end(d, 55.0)
    got = sorted(zip(*T.h1_bars(d, end, 100_000)))
    want = h1_bars_by_matrix_reduction(d, end)
    assert len(got) == len(want) > 64
    assert np.allclose(np.array(got), np.array(want))


def test_many_classes_stay_small_in_memory():
    """Rows of classes for each pair took 8 bytes a word of 64 open classes: gigabytes at 1,000 points."""
    d = T.point_distances(np.random.default_rng(6).standard_normal((500, 64)))
    tracemalloc.start()
    births, _ = T.h1_bars(d, d.max())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(births) > 900 and most < 40 << 20


def test_a_cloud_of_many_classes_takes_seconds():
    d = T.point_distances(np.random.default_rng(6).standard_normal((700, 64)))
    start = time.process_time()
    T.h1_bars(d, d.max())
    assert time.process_time() - start < 10


@pytest.mark.parametrize("seed", range(6))
def test_shortest_paths_of_sparse_and_dense_graphs(seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((130, 3 + seed))
    x = x.cumsum(axis=0) if seed % 2 else x
    w = T.grow_graph(T.point_distances(x), 3, 3)[0]
    want = w.copy()
    np.fill_diagonal(want, 0.0)
    for m in range(len(w)):
        want = np.minimum(want, want[:, m, None] + want[None, m])
    by_points = T.eliminated(w, len(w))
    for got in (T.shortest_paths(w), T.blocked_paths(w), by_points):
        assert np.allclose(got, want, rtol=1e-12) and (got == got.T).all()
    assert T.eliminated(w, 2) is None


def permuted_walk(n: int, dim: int, seed: int) -> np.ndarray:
    steps = np.random.default_rng(seed).standard_normal((n, dim))
    return (steps - steps.mean(axis=0)).cumsum(axis=0)


def test_edges_behind_the_last_bar_are_not_sorted(monkeypatch):
    d = T.point_distances(permuted_walk(500, 2, 3))
    made = []
    extend = T.Filtration.extend
    monkeypatch.setattr(T.Filtration, "extend", lambda self: (extend(self), made.append(len(self.length))))
    births, deaths = T.h1_bars(d, d.max())
    assert len(births) > 50 and np.isfinite(deaths).all() and made[-1] < 500 * 499 / 2 / 3
    # No batch, guess or part changes the bars.
    for batch in (64, 100_000):
        again = T.h1_bars(d, d.max(), batch, lambda i, j: np.zeros(len(i), dtype=np.int64))
        assert sorted(zip(*again)) == sorted(zip(births, deaths))


@pytest.mark.parametrize("kind", ["copies", "grid", "walk"])
def test_bars_of_ties_and_copies_over_more_than_a_word(kind):
    rng = np.random.default_rng(11)
    x = {
        "copies": np.repeat(rng.standard_normal((24, 3)), 3, axis=0), "grid": rng.integers(0, 6, (70, 2)).astype(float),
        "walk": permuted_walk(70, 2, 8),
    }[kind]
    d = T.point_distances(x)
    want = h1_bars_by_matrix_reduction(d, d.max())
    for batch in (7, 2048):
        assert np.allclose(np.array(sorted(zip(*T.h1_bars(d, d.max(), batch)))), np.array(want).reshape(-1, 2))


@pytest.mark.parametrize("pct", [None, 99.0, 95.0, 70.0, 30.0])
def test_percentiles_are_left_out_only_where_they_cut_nothing(pct):
    for seed in range(12):
        x = permuted_walk(40, 1 + seed % 4, seed) if seed % 3 else np.random.default_rng(seed).standard_normal((40, 3))
        d = T.point_distances(x)
        births, deaths = T.h1_bars(d, T.filtration_end(d, pct))
        want = (np.minimum(deaths, T.filtration_end(d, pct)) - births).max() if births.size else 0.0
        assert T.max_h1_lifetime(d, pct) == want


def test_graph_without_sorting_keeps_ties_in_order():
    for x in (np.random.default_rng(2).integers(0, 3, (60, 2)).astype(float), permuted_walk(60, 3, 1)):
        d = T.point_distances(x)
        for k in (1, 4, 12, 59):
            assert (T.nearest_graph(d, k) == T.knn_graph(d, T.neighbour_order(d), k)).all()


def test_censored_bar_counts_to_the_cut():
    d = T.point_distances(polygon(30))
    end = T.filtration_end(d, 40.0)
    births, deaths = T.h1_bars(d, end)
    assert np.isinf(deaths).all()
    assert np.isclose(T.max_h1_lifetime(d, 40.0), end - births[0])
    assert T.significant_bars(d, 40.0) == 1


def test_gram_distances_equal_direct_ones():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((30, 7)).cumsum(axis=0)
    steps = np.diff(x, axis=0)
    order = T.block_order(29, 4, rng)
    moved = np.vstack([x[:1], x[:1] + steps[order].cumsum(axis=0)])
    gram = steps @ steps.T
    assert np.allclose(T.distances_from_gram(gram), T.point_distances(x))
    assert np.allclose(T.distances_from_gram(gram, order), T.point_distances(moved))


@pytest.mark.parametrize("n,b", [(10, 1), (10, 3), (7, 7), (7, 20), (1, 5)])
def test_block_order_keeps_blocks(n, b):
    order = T.block_order(n, b, np.random.default_rng(3))
    assert sorted(order.tolist()) == list(range(n))
    starts = np.flatnonzero(order % b == 0)
    for s in starts:
        run = order[s : s + min(b, n - order[s])]
        assert (np.diff(run) == 1).all()
    want = np.random.default_rng(3).permutation(-(-n // b))
    assert (order[order % b == 0] // b == want).all()


def test_graph_growth_and_sentinel():
    far = np.r_[polygon(6), polygon(6) + 100]
    d = T.point_distances(far)
    _, k, first, parts = T.grow_graph(d, 2, 11)
    assert (k, first, parts) == (8, 2, 1)
    with pytest.raises(RuntimeError):
        T.geodesic_distances(d, 2, 4)
    geo, k, used = T.geodesic_distances(d, 2, 4, sentinel_fill=True, rescale=False)
    assert used and k == 4
    same = geo[:6, :6]
    assert np.allclose(geo[:6, 6:], 10 * np.median(np.r_[same.ravel(), geo[6:, 6:].ravel()]) + 1)


def test_shortest_paths_equal_triple_loop():
    rng = np.random.default_rng(2)
    d = T.point_distances(rng.standard_normal((14, 3)))
    w, *_ = T.grow_graph(d, 3, 13)
    want = w.copy()
    np.fill_diagonal(want, 0)
    for m in range(14):
        for i in range(14):
            for j in range(14):
                want[i, j] = min(want[i, j], want[i, m] + want[m, j])
    assert np.allclose(T.shortest_paths(w), want)


def test_neighbour_ties_go_to_the_lower_index():
    d = T.point_distances(np.array([[0.0], [1], [-1], [1], [0]]))
    assert T.neighbour_order(d)[0].tolist() == [4, 1, 2, 3]


def test_principal_components_from_the_gram():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((25, 6)).cumsum(axis=0)
    steps = np.diff(x, axis=0)
    c = x - x.mean(axis=0)
    assert np.allclose(centred_gram(steps @ steps.T), c @ c.T)
    values, _ = spectrum(steps @ steps.T)
    assert np.allclose(values[:6], np.linalg.svd(c, compute_uv=False) ** 2)
