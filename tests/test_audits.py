"""Audits: Spark results against direct computation, and known answers."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_record import plain_record

from wanderloop.config import AuditConfig
from wanderloop.functions import topology as T
from wanderloop.operators import audits as A
from wanderloop.operators.calibration import calibrate, walk_draws
from wanderloop.operators.decisions import with_inference_role
from wanderloop.operators.controls import looped_grams, sparse_plane
from wanderloop.operators.locality import graph_locality, knn_edges
from wanderloop.operators.principal import pca_profile, pca_trajectories
from wanderloop.operators.projections import (
    pair_cut_lifetime, projection_audit, random_planes, without_main_axis, without_time_trend,
)
from wanderloop.operators.static_clouds import cloud_moments, static_cloud_audit
from wanderloop.operators.trajectory import kinematics, step_gram, to_chunks
from wanderloop.sources import synthetic


def paths(seed=0, sizes=(20, 26), d=5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {f"p{i}": rng.standard_normal((n, d)).cumsum(axis=0) for i, n in enumerate(sizes)}


def frame(spark, trajectories):
    rows = [
        (name, t, [float(v) for v in x])
        for name, path in trajectories.items() for t, x in enumerate(path)
    ]
    np.random.default_rng(0).shuffle(rows)
    return spark.createDataFrame([(r[0], int(r[1]), list(r[2])) for r in rows], "id string, t int, point array<double>")


def gram_of(path):
    steps = np.diff(path, axis=0)
    return steps @ steps.T


@pytest.mark.parametrize("chunk_cols", [2, 50])
def test_step_gram_adds_over_chunks(spark, chunk_cols):
    all_paths = paths()
    got = step_gram(frame(spark, all_paths), ["id"], ["t"], "point", 600, chunk_cols).collect()
    assert len(got) == len(all_paths)
    for row in got:
        assert np.allclose(row["gram"], gram_of(all_paths[row["id"]]).ravel())


def test_kinematics(spark):
    all_paths = paths() | {"still": np.ones((4, 5))}
    for row in kinematics(frame(spark, all_paths), ["id"], ["t"], "point").collect():
        x = all_paths[row["id"]]
        length = np.linalg.norm(np.diff(x, axis=0), axis=1).sum()
        net = np.linalg.norm(x[-1] - x[0])
        assert np.isclose(row["path_length"], length) and np.isclose(row["net_displacement"], net)
        assert np.isclose(row["kinematic_R"], length / max(net, 1e-8))


def seed_of(spark, key):
    return spark.createDataFrame([(key,)], "id string").select(A.key_seed(["id"])).first()[0]


def test_long_and_short_trajectories_get_a_status(spark):
    df = frame(spark, paths(sizes=(21, 12))).unionByName(
        spark.createDataFrame([("one", 0, [0.0] * 5), (None, 0, [0.0] * 5), (None, 1, [1.0] * 5)], frame(spark, paths(sizes=(3,))).schema)
    )
    cfg = AuditConfig(n_nulls=3, k0=3, max_points=20)
    rows = {r["id"]: r for r in A.ambient_audit(df, ["id"], ["t"], "point", cfg).collect()}
    assert rows["p0"]["geo_status"] == "too_long" and rows["p0"]["geo_pperm"] is None and rows["p0"]["N_pts"] == 21
    assert rows["one"]["geo_status"] == "too_short" and rows["p1"]["geo_status"] == "ok" and len(rows) == 4
    assert rows[None]["N_pts"] == 2
    with pytest.raises(ValueError):
        A.require_decisive(AuditConfig(n_nulls=19))
    assert A.require_decisive(AuditConfig(n_nulls=20)).n_nulls == 20


def test_trajectories_can_have_nulls_of_their_own(spark):
    x = paths(sizes=(14,))["p0"]
    cfg = AuditConfig(n_nulls=3, k0=3, seed_by_key=True)
    got = A.audit_lifetimes(frame(spark, {"a": x, "b": x}), ["id"], ["t"], "point", cfg).collect()
    gram = gram_of(x)
    for row in got:
        order = None
        if row["null_id"] >= 0:
            rng = np.random.default_rng([cfg.seed + 100, seed_of(spark, row["id"]), row["null_id"], 1])
            order = T.block_order(len(gram), 1, rng)
        want = T.lifetime_pair(T.distances_from_gram(gram, order), 3, 199)
        assert np.allclose([row["L_euc"], row["L_geo"]], want[:2])


def test_ambient_audit_equals_direct_loop(spark):
    all_paths = paths()
    cfg = AuditConfig(n_nulls=12, k0=3, block_sizes=(1, 4), nulls_per_task=5)
    got = A.ambient_audit(frame(spark, all_paths), ["id"], ["t"], "point", cfg).collect()
    assert len(got) == 4
    for row in got:
        gram, b = gram_of(all_paths[row["id"]]), row["block_size"]
        obs = T.lifetime_pair(T.distances_from_gram(gram), 3, 199)
        nulls = []
        for i in range(12):
            rng = np.random.default_rng([cfg.seed + 100, i, b])
            order = T.block_order(len(gram), b, rng)
            nulls.append(T.lifetime_pair(T.distances_from_gram(gram, order), 3, 199))
        nulls = np.array(nulls)
        for prefix, col in (("euc_", 0), ("geo_", 1)):
            for name, value in plain_record(obs[col], nulls[:, col]).items():
                assert row[prefix + name] == pytest.approx(value, rel=1e-9, abs=1e-9), name
        assert row["geo_k_used_obs"] == obs[2]
        assert row["geo_null_k_median"] == np.median(nulls[:, 2])
        assert row["N_pts"] == len(gram) + 1


def test_sensitivity_settings_cut_the_filtration(spark):
    all_paths = paths(sizes=(18,))
    cfg = AuditConfig(n_nulls=4)
    settings = A.sensitivity_settings(cfg, (3, 5), (90.0,))
    got = A.audit_lifetimes(frame(spark, all_paths), ["id"], ["t"], "point", cfg, settings).collect()
    gram = gram_of(all_paths["p0"])
    assert {r["null_id"] for r in got} == {-1, 0, 1, 2, 3}
    for row in got:
        order = None
        if row["null_id"] >= 0:
            master = cfg.seed + 9000 + 100 * row["k0"] + 90 + 100
            order = T.block_order(len(gram), 1, np.random.default_rng([master, row["null_id"], 1]))
        want = T.lifetime_pair(T.distances_from_gram(gram, order), row["k0"], 199, 90.0)
        assert np.allclose([row["L_euc"], row["L_geo"], row["k_used"]], want)


def test_each_setting_has_its_own_number_of_nulls(spark):
    cfg = AuditConfig(n_nulls=7, k0=3, block_sizes=(1, 4), nulls_per_task=3)
    df = frame(spark, paths(sizes=(12,)))
    grams = step_gram(df, ["id"], ["t"], "point", 600)
    life = A.null_lifetimes(grams, ["id"], A.targeted_settings(cfg, 2), cfg, 1, rng_key=A.offset_rng_key)
    rows = {r["block_size"]: r for r in A.audit_records(life, ["id", *A.SETTING], cfg).collect()}
    assert rows[1]["n_nulls_used"] == 7 and rows[4]["n_nulls_used"] == 2
    gram = gram_of(paths(sizes=(12,))["p0"])
    want = [
        T.lifetime_pair(T.distances_from_gram(gram, np.random.default_rng(cfg.seed + i).permutation(11)), 3, 199)[0]
        for i in range(7)
    ]
    assert rows[1]["euc_null_max"] == pytest.approx(max(want))
    tagged = {r["block_size"]: r for r in with_inference_role(A.audit_records(life, ["id", *A.SETTING], cfg)).collect()}
    assert tagged[1]["is_formal_inference"] and tagged[4]["analysis_role"] == "block_diagnostic"


def long_order(key, n_steps, b, master, null_id):
    blocks = -(-n_steps // b)
    token = {}
    for j in range(blocks):
        text = "|".join(map(str, [master, null_id, b, key, j]))
        token[j] = int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
    return np.array(sorted(range(n_steps), key=lambda s: (token[s // b], s)))


@pytest.mark.parametrize("rows", [None, 9])
def test_long_trajectories_are_permuted_at_full_length(spark, rows):
    """Beyond max_points: permute every step, then keep evenly spaced checkpoints."""
    all_paths = paths(seed=3, sizes=(41, 14))
    cfg = AuditConfig(n_nulls=3, k0=3, block_sizes=(1, 3), max_points=15, thin_long=True)
    if rows:
        spark.conf.set("spark.wanderloop.groupRows", str(rows))
    try:
        life = A.audit_lifetimes(frame(spark, all_paths), ["id"], ["t"], "point", cfg)
        got = [r for r in life.collect() if r["id"] == "p0"]
    finally:
        spark.conf.unset("spark.wanderloop.groupRows")
    assert len(got) == 8
    x = all_paths["p0"]
    steps, kept = np.diff(x, axis=0), np.linspace(0, 40, 15, dtype=int)
    for row in got:
        moved = steps
        if row["null_id"] >= 0:
            moved = steps[long_order("p0", 40, row["block_size"], cfg.seed + 100, row["null_id"])]
        path = np.vstack([np.zeros(5), moved.cumsum(axis=0)])[kept]
        want = T.lifetime_pair(T.point_distances(path), 3, 199)
        assert np.allclose([row["L_euc"], row["L_geo"], row["k_used"]], want, atol=1e-9)
        assert row["n_points"] == 15


def test_results_do_not_depend_on_partitioning(spark):
    df = frame(spark, paths())
    cfg = AuditConfig(n_nulls=6, k0=3)
    a = A.audit_lifetimes(df.repartition(1), ["id"], ["t"], "point", cfg).toPandas()
    b = A.audit_lifetimes(df.repartition(7), ["id"], ["t"], "point", AuditConfig(n_nulls=6, k0=3, nulls_per_task=2)).toPandas()
    order = ["id", "null_id"]
    pd.testing.assert_frame_equal(
        a.sort_values(order).reset_index(drop=True), b.sort_values(order).reset_index(drop=True)
    )


def test_circle_fires_helix_and_drift_do_not(spark):
    """Known answers: a loop is found, open curves are rejected by the geodesic test."""
    n, cfg = 48, AuditConfig(n_nulls=39, k0=6)
    runs = {
        "circle": synthetic.circle(spark, n, 3.0, 0.03, 11), "helix": synthetic.helix(spark, n, 3, 12.0, 0.03, 12),
        "drift": synthetic.drift(spark, n, 0.03, 13), "curved": synthetic.curved_drift(spark, n, 0.03, 14),
    }
    df = None
    for name, run in runs.items():
        run = run.withColumn("id", F.lit(name))
        df = run if df is None else df.unionByName(run)
    got = {r["id"]: r for r in A.ambient_audit(df, ["id"], ["t"], "point", cfg).collect()}
    assert got["circle"]["geo_formal_trigger"] is True
    assert not any(got[x]["geo_formal_trigger"] for x in ("helix", "drift", "curved"))


def test_projection_audit_equals_direct_loop(spark):
    x = paths(seed=5, sizes=(16,), d=4)["p0"]
    cfg = AuditConfig(n_nulls=5, nulls_per_task=2)
    got = projection_audit(
        frame(spark, {"p0": x}), ["id"], ["t"], "point", cfg, 4, ("raw", "dpca", "dtime"), (2, 4)
    ).collect()
    assert len(got) == 6
    planes = random_planes(4, 4, cfg.seed + 1000)
    undo = {"raw": lambda v: v, "dpca": without_main_axis, "dtime": without_time_trend}
    steps = np.diff(x, axis=0)
    for row in got:
        values = []
        for i in range(-1, 5):
            path = x
            if i >= 0:
                order = T.block_order(15, 1, np.random.default_rng([cfg.seed + 3000, i, 1]))
                path = np.vstack([x[:1], x[:1] + steps[order].cumsum(axis=0)])
            flat = undo[row["method"]](path)
            values.append(max(pair_cut_lifetime(flat @ p, 95.0) for p in planes[: row["budget"]]))
        for name, value in plain_record(values[0], np.array(values[1:])).items():
            assert row[name] == pytest.approx(value, rel=1e-9, abs=1e-9), name


def test_detrending():
    t = np.linspace(0, 1, 30)
    line = np.c_[2 * t + 1, -t]
    assert np.allclose(without_time_trend(line), 0)
    assert np.allclose(without_main_axis(line), 0)
    bent = np.c_[t, t**2]
    design = np.c_[t, np.ones(30)]
    want = bent - design @ np.linalg.lstsq(design, bent, rcond=None)[0]
    assert np.allclose(without_time_trend(bent), want)


def test_static_clouds(spark):
    ring = synthetic.circle(spark, 60, 2.0, 0.05, 21).withColumn("id", F.lit("ring"))
    blob = ring.select(
        "t", F.array(*[synthetic.hash_normal(9, F.col("t"), F.lit(j)) for j in range(3)]).alias("point")
    ).withColumn("id", F.lit("blob"))
    df = ring.unionByName(blob)
    for row in cloud_moments(df, ["id"], "point").collect():
        x = np.array([r["point"] for r in df.filter(F.col("id") == row["id"]).collect()])
        assert np.allclose(row["mean"], x.mean(axis=0)) and np.allclose(row["std"], x.std(axis=0) + 1e-12)
    got = static_cloud_audit(df, ["id"], "t", "point", AuditConfig(n_nulls=29, k0=6), {"ring": 1, "blob": 0})
    rows = {r["id"]: r for r in got.collect()}
    assert rows["ring"]["geo_empirical_tail_trigger"] and rows["ring"]["correct"]
    assert rows["ring"]["geo_formal_trigger"] is False and rows["ring"]["bar_check"] == "N/A"
    assert not rows["blob"]["geo_empirical_tail_trigger"] and rows["blob"]["correct"]


def test_locality_and_edges(spark):
    all_paths = paths(seed=7, sizes=(22,))
    grams = step_gram(frame(spark, all_paths), ["id"], ["t"], "point", 600)
    d = T.point_distances(all_paths["p0"])
    row = graph_locality(grams, ["id"], 1, k0=2).first()
    w, k, first, parts = T.grow_graph(d, 2, 21)
    edges = w[np.triu_indices(22, 1)]
    edges = edges[np.isfinite(edges)]
    assert (row["k_used"], row["initial_components"], row["edge_count"]) == (k, first, len(edges))
    assert np.isclose(row["edge_p95"], np.percentile(edges, 95))
    assert np.isclose(row["graph_density"], len(edges) / 231)
    got = {(r["src"], r["dst"]) for r in knn_edges(grams, ["id"], 1, 2).collect()}
    near = np.argsort(d + np.diag([np.inf] * 22), axis=1)[:, :2]
    assert got == {(min(i, j), max(i, j)) for i in range(22) for j in near[i].tolist()}


def test_pca(spark):
    x = paths(seed=8, sizes=(24,), d=6)["p0"]
    grams = step_gram(frame(spark, {"p0": x}), ["id"], ["t"], "point", 600)
    row = pca_profile(grams, ["id"], 1, dims=6).first()
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    cum = s.cumsum() / s.sum()
    assert np.allclose(row["cum"], cum)
    assert row["d_95"] == np.searchsorted(cum, 0.95) + 1
    got = pca_trajectories(grams, ["id"], 1, dims=(2,), prefixes=(10, 24)).toPandas()
    for prefix, part in got.groupby("prefix_ep"):
        c = x[:prefix] - x[:prefix].mean(axis=0)
        u, sv, _ = np.linalg.svd(c, full_matrices=False)
        want = (u * sv)[:, :2]
        coords = np.stack(part.sort_values("t")["point"])
        assert np.allclose(np.abs(coords), np.abs(want))
        assert np.allclose(part["pca_var"], (sv[:2] ** 2).sum() / (sv**2).sum())


@pytest.mark.parametrize("drift", [0.0, 1.0])
def test_injected_loop_equals_rebuilt_trajectory(spark, drift):
    x = paths(seed=9, sizes=(20,), d=11)["p0"]
    points = frame(spark, {"p0": x}).withColumnRenamed("t", "position")
    row = looped_grams(to_chunks(points, "point", 4), ["id"], 11, (0.5,), drift, 6, chunk_cols=4).first()
    support, u, v = sparse_plane(11, 6, 2026)
    assert np.isclose(u @ v, 0) and np.isclose(u @ u, 1)
    angle = np.arange(20) * 2 * np.pi / 20
    middle = np.median(T.point_distances(x)[np.triu_indices(20, 1)])
    y = drift * (x - x[0])
    y[:, support] += 0.5 * middle * (np.outer(np.cos(angle), u) + np.outer(np.sin(angle), v))
    assert np.isclose(row["median_pairwise"], middle)
    assert np.allclose(row["gram"], gram_of(y).ravel())


def test_calibration_walks(spark):
    draws = walk_draws(spark.range(1), 3, 10, 50, 7).toPandas()
    for c, part in draws.groupby("calib_id"):
        want = np.random.default_rng([7, c, 12345]).integers(0, 50, size=10)
        assert part.sort_values("pos")["idx"].tolist() == want.tolist()
    once = walk_draws(spark.range(1), 2, 10, 10, 7, replace=False).toPandas()
    assert once.groupby("calib_id")["idx"].nunique().tolist() == [10, 10]
    all_paths = paths(seed=10, sizes=(16, 21))
    cfg = AuditConfig(seed=5, n_nulls=4, k0=3, block_sizes=(1, 5))
    got = calibrate(frame(spark, all_paths), ["id"], ["t"], "point", cfg, n_calib=3).collect()
    assert len(got) == 6 and {r["n_steps"] for r in got} == {15}
    pool = np.vstack([np.diff(all_paths[k], axis=0) for k in sorted(all_paths)])
    for row in got:
        c, b = row["calib_id"], row["block_size"]
        s = pool[np.random.default_rng([5, c, 12345]).integers(0, len(pool), size=15)]
        gram = s @ s.T
        obs = T.lifetime_pair(T.distances_from_gram(gram), 3, 199)[1]
        nulls = []
        for j in range(4):
            order = T.block_order(15, b, np.random.default_rng([5, c, b, j]))
            nulls.append(T.lifetime_pair(T.distances_from_gram(gram, order), 3, 199)[1])
        want = plain_record(obs, np.array(nulls))
        assert row["pperm"] == pytest.approx(want["pperm"]) and row["Lobs"] == pytest.approx(want["Lobs"])
