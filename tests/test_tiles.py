"""Tiled distances, neighbours, growth and shortest paths against whole matrices."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tools.check_oracles import row_set
from wanderloop.functions import topology
from wanderloop.operators import principal, tiles
from wanderloop.operators.locality import LOCALITY, locality_row
from wanderloop.plans import geometry
from wanderloop.plans.catalogue import ORACLES, QUERIES


def clouds():
    """Keys and points: a plain cloud, far clusters, repeated points, a line, short paths, a null key."""
    rng = np.random.default_rng(3)
    return {
        "cloud": rng.normal(size=(70, 5)),
        "clusters": np.concatenate([rng.normal(size=(n, 5)) + 50 * i for i, n in enumerate((9, 21, 4))]),
        "repeats": np.repeat(rng.integers(0, 3, size=(12, 5)), 3, axis=0).astype(float),
        "line": np.outer(np.arange(33.0), np.ones(5)),
        None: rng.normal(size=(17, 5)),
        "three": rng.normal(size=(5, 5)),
    }


def points(spark):
    rows = [(k, i, p.tolist()) for k, x in clouds().items() for i, p in enumerate(x)] + [("one", 0, [0.0] * 5)]
    return spark.createDataFrame(rows, "k string, at long, point array<double>")


@pytest.fixture(scope="module")
def cut(spark):
    return tiles.tiled(points(spark), ["k"], ["at"], "point", tile=8, chunk_cols=2)


def direct(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))


def by_key(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["k"], []).append(r)
    return out


def test_profile_of_all_pairs(cut):
    got = by_key(tiles.distance_profile(cut))
    assert set(got) == set(clouds())
    for k, x in clouds().items():
        d, r = direct(x)[np.triu_indices(len(x), 1)], got[k][0]
        assert r["n_pairs"] == len(d)
        assert np.allclose([r["d_min"], r["d_mean"], r["d_median"], r["d_max"]], [d.min(), d.mean(), np.median(d), d.max()], rtol=1e-12, atol=0)


def test_digits_are_counted_once_for_all_quantiles(cut, monkeypatch):
    """Twelve ranks of two families ask for few different digits, not for twelve times as many."""
    asked = []
    over = tiles.over_squares

    def counted(t, fn, schema, info=None, own=None, **more):
        if own is not None:
            asked.append(max(len(r["own"]) // 4 for r in own.collect()))
        return over(t, fn, schema, info, own, **more)

    monkeypatch.setattr(tiles, "over_squares", counted)
    sizes = cut.paths.select("path", (F.col("n_points") * (F.col("n_points") - 1) / 2).cast("long").alias("n0")).withColumn("n1", F.col("n0"))
    found = cut.named(tiles.quantiles(cut, sizes.filter("n0 > 0"), (0.5, 0.5, 0.5), lambda s: [tiles.all_pairs(s)[0]] * 2, (0, 1)))
    assert asked[0] == 2 and max(asked) <= 4
    for k, rows in by_key(found).items():
        x = clouds()[k]
        want = np.median(direct(x)[np.triu_indices(len(x), 1)])
        assert len(rows) == 2 and all(np.allclose([r["q0"], r["q1"], r["q2"]], want, rtol=1e-12) for r in rows)


def test_points_in_single_precision_travel_as_such(spark):
    df = points(spark)
    short = tiles.tiled(df.withColumn("point", F.col("point").cast("array<float>")), ["k"], ["at"], "point", tile=8, chunk_cols=2)
    assert dict(short.tiles.dtypes)["block"] == "array<float>"
    got = by_key(tiles.distance_profile(short))
    for k, x in clouds().items():
        d = direct(x.astype(np.float32).astype(float))[np.triu_indices(len(x), 1)]
        assert np.allclose([got[k][0]["d_mean"], got[k][0]["d_median"]], [d.mean(), np.median(d)], rtol=1e-12, atol=0)


def test_sums_of_points(cut):
    got = by_key(cut.named(tiles.point_sums(cut)))
    for k, x in clouds().items():
        rows = sorted(got[k], key=lambda r: r["pos"])
        assert np.allclose([(r["total"], r["far"]) for r in rows], np.stack([direct(x).sum(axis=1), direct(x).max(axis=1)], axis=1))


def test_sums_of_products(cut):
    got = by_key(cut.named(tiles.product_sums(cut)))
    for k, x in clouds().items():
        g, off = x @ x.T, ~np.eye(len(x), dtype=bool)
        want = [np.trace(g), g.sum(), (g[off] ** 2).sum(), g[off].max()]
        assert np.allclose([got[k][0][c] for c in ("trace", "total", "off_square", "off_max")], want)


@pytest.mark.parametrize("k", [1, 3, 11, 500])
def test_edges_of_nearest_neighbours(cut, k):
    got = by_key(tiles.knn_edges(cut, k))
    for key, x in clouds().items():
        d = direct(x)
        w = topology.knn_graph(d, topology.neighbour_order(d), min(k, len(x) - 1))
        want = {(i, j): w[i, j] for i, j in zip(*np.triu_indices(len(x), 1)) if np.isfinite(w[i, j])}
        assert {(r["src"], r["dst"]) for r in got[key]} == set(want)
        assert all(abs(want[r["src"], r["dst"]] - r["w"]) < 1e-12 for r in got[key])


@pytest.mark.parametrize("k0,kmax", [(1, 0), (3, 4)])
def test_growth_and_locality(cut, k0, kmax):
    got = by_key(tiles.graph_locality(cut, k0, kmax))
    assert set(got) == set(clouds())
    for key, x in clouds().items():
        want = locality_row(direct(x), k0, kmax)
        for field, value in zip(LOCALITY, want):
            found = got[key][0][field.name]
            assert found == value or abs(found - value) < 1e-9, (key, field.name, found, value)


def test_ways_on_sparse_graphs_make_no_tiles(cut, monkeypatch):
    by_tiles = tiles.shortest_paths
    monkeypatch.setattr(tiles, "HELD", 0)
    want = by_key(tiles.geodesic_rows(cut, 2, 9))
    monkeypatch.undo()
    monkeypatch.setattr(tiles, "shortest_paths", lambda *_: pytest.fail("ways of a sparse graph in tiles"))
    got = by_key(tiles.geodesic_rows(cut, 2, 9))
    assert by_tiles is not tiles.shortest_paths and set(got) == set(want)
    for k in want:
        a, b = (sorted((r["t"], r["k_used"], r["mean_geodesic"], r["max_geodesic"]) for r in x[k]) for x in (got, want))
        assert [r[:2] for r in a] == [r[:2] for r in b]
        assert np.allclose(np.array(a, dtype=float), np.array(b, dtype=float), rtol=1e-12, equal_nan=True)


@pytest.mark.parametrize("walk", [True, False])
def test_ways_from_some_points(walk):
    x = np.random.default_rng(4).normal(size=(150, 3))
    w = topology.grow_graph(direct(x.cumsum(axis=0) if walk else x), 3, 50)[0]
    rows, others = np.nonzero(np.isfinite(w) & ~np.eye(len(w), dtype=bool))
    start = np.searchsorted(rows, np.arange(len(w) + 1))
    got = topology.ways_from(np.arange(20, 60), start, others, w[rows, others])
    assert np.allclose(got.T, topology.shortest_paths(w)[20:60], rtol=1e-12)


def test_shortest_paths(spark):
    cut = tiles.tiled(points(spark), ["k"], ["at"], "point", tile=24)
    got = by_key(tiles.geodesic_rows(cut, 2, 9))
    for key, x in clouds().items():
        d = direct(x)
        w, k, _, parts = topology.grow_graph(d, 2, 9)
        rows = sorted(got[key], key=lambda r: r["t"])
        assert len(rows) == len(x) and {r["k_used"] for r in rows} == {k}
        if parts > 1:
            assert {r["mean_geodesic"] for r in rows} == {None}
            continue
        geo = topology.shortest_paths(w)
        assert np.allclose([(r["mean_geodesic"], r["max_geodesic"]) for r in rows], np.stack([geo.sum(axis=1) / (len(x) - 1), geo.max(axis=1)], axis=1))


def test_a_long_path_equals_brute_force(spark):
    """2,500 points in tiles of the default size."""
    x = np.cumsum(np.random.default_rng(0).normal(size=(2500, 6)), axis=0)
    df = spark.createDataFrame([(0, i, p.tolist()) for i, p in enumerate(x)], "k int, at long, point array<double>")
    cut = tiles.tiled(df, ["k"], ["at"], "point")
    d = topology.point_distances(x)
    upper = d[np.triu_indices(len(x), 1)]
    r = tiles.distance_profile(cut).first()
    assert r["n_pairs"] == len(upper) and np.allclose([r["d_median"], r["d_mean"], r["d_max"]], [np.median(upper), upper.mean(), upper.max()])
    near = topology.neighbour_order(d)[:, :5]
    want = {(min(i, j), max(i, j)) for i in range(len(x)) for j in near[i].tolist()}
    assert {(e["src"], e["dst"]) for e in tiles.knn_edges(cut, 5).collect()} == want


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, at long, point array<double>")
    cut = tiles.tiled(df, ["k"], ["at"], "point", tile=8)
    assert tiles.distance_profile(cut).count() == 0 and tiles.graph_locality(cut).count() == 0
    assert tiles.geodesic_rows(cut, 2, 9).count() == 0 and tiles.knn_edges(cut, 3).count() == 0
    assert cut.named(tiles.point_sums(cut)).agg(F.count("pos")).first()[0] == 0


LONG = (
    "pairwise_distance_profile", "step_gram", "gram_distance_identity", "knn_sym_graph",
    "locality_overview", "geodesic_apsp",
)


@pytest.mark.parametrize("name", LONG)
def test_queries_give_the_same_rows_by_tiles(spark, sf_dir, monkeypatch, name):
    """Labels on both sides of the limit, against the SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    sizes = [r[0] for r in con.execute("SELECT count(*) FROM embeddings GROUP BY label ORDER BY 1").fetchall()]
    monkeypatch.setattr(geometry, "MAX_POINTS", sizes[len(sizes) // 2])
    monkeypatch.setattr(tiles.tiled, "__defaults__", (16, 24))
    df, cur = QUERIES[name](spark, sf_dir), con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert row_set(df.columns, [tuple(r) for r in df.collect()]) == row_set(names, cur.fetchall())


def test_long_labels_keep_a_row_where_a_matrix_is_needed(spark, sf_dir, monkeypatch):
    labels = {r[0] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label").distinct().collect()}
    monkeypatch.setattr(geometry, "MAX_POINTS", 19)
    for name in ("pca_profile", "h1_max_lifetime", "top_h1_bar"):
        assert {r["label"] for r in QUERIES[name](spark, sf_dir).select("label").collect()} == labels


def test_components_of_long_paths(spark, monkeypatch):
    """Reduced triangles against the spectrum of the whole matrix; several rounds of reduction."""
    monkeypatch.setattr(principal, "FAN", 2)
    rng = np.random.default_rng(8)
    paths = {"a": rng.normal(size=(900, 7)) * [9, 5, 3, 1, 0.5, 0.1, 0] + 100, None: rng.normal(size=(40, 3)), "short": rng.normal(size=(3, 7)), "flat": np.ones((5, 2))}
    rows = [(k, p.tolist()) for k, x in paths.items() for p in x] + [("wide", [0.0] * 2049)] * 2
    df = spark.createDataFrame(rows, "k string, point array<double>").repartition(9)
    got = by_key(principal.tall_profile(df, ["k"], "point", 6))
    for k, x in paths.items():
        s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
        most = min(len(x) - 1, 6)
        kept = np.pad(s, (0, 9))[:most]
        r = got[k][0]
        assert r["max_d"] == most
        if kept.sum() < 1e-12:
            continue
        cum = kept.cumsum() / kept.sum()
        assert np.allclose(r["cum"], cum) and (r["d_95"], r["d_99"]) == tuple(int(np.searchsorted(cum, q)) + 1 for q in (0.95, 0.99))
    assert got["wide"][0]["max_d"] is None
    assert principal.tall_profile(df.filter("false"), ["k"], "point").count() == 0


def test_profile_query_by_small_factors(spark, sf_dir, monkeypatch):
    want = {tuple(r) for r in QUERIES["pca_profile"](spark, sf_dir).collect()}
    monkeypatch.setattr(geometry, "MAX_POINTS", 5)
    assert {tuple(r) for r in QUERIES["pca_profile"](spark, sf_dir).collect()} == want


def dealt_copies(cut):
    """Tiles sent out per tile of ``cut`` by one pass over all squares."""
    def count(s):
        yield tiles.arrow(path=[s.path], i=[s.i], j=[s.j])

    squares = tiles.over_squares(cut, count, "path long, i long, j long")
    found = [tuple(r) for r in squares.collect()]
    n = cut.tiles.count()
    assert len(found) == len(set(found)) == cut.pairs
    return sum(-(-int(r["tiles"]) // cut.group) * int(r["tiles"]) for r in cut.tiles.groupBy("path").agg(F.count("tile").alias("tiles")).collect()) / n


def test_a_tile_goes_to_a_bounded_number_of_tasks(spark):
    """Four times as many points are dealt four times as often in all, not sixteen times; each square is met once."""
    def path(n):
        df = spark.range(n).select(F.lit(0).alias("k"), F.col("id").alias("at"), F.array(F.rand(1), F.rand(2)).alias("point"))
        return tiles.tiled(df, ["k"], ["at"], "point", tile=2)

    short, long = path(200), path(800)
    assert dealt_copies(long) <= 1.1 * dealt_copies(short)
    d = tiles.distance_profile(long).first()
    assert d["n_pairs"] == 800 * 799 // 2
