"""Gates, reports, and the command line from array files to records."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wanderloop import __main__ as cli
from wanderloop.config import AuditConfig, run_seed
from wanderloop.operators import audits as A
from wanderloop.operators import gates as G
from wanderloop.sources import npy
from wanderloop.sources import reports as P
from wanderloop.sources import synthetic


def test_gates(spark):
    df = spark.createDataFrame([("a", True), ("b", False)], "id string, fired boolean")
    with pytest.raises(G.GateError):
        G.negative_control(df, "fired", "helix")
    with pytest.raises(G.GateError):
        G.positive_control(df, "fired", "circle")
    G.negative_control(df.filter("id = 'b'"), "fired", "helix")
    G.positive_control(df.filter("id = 'a'"), "fired", "circle")
    with pytest.raises(G.GateError, match="no rows"):
        G.positive_control(df.filter("id = 'z'"), "fired", "circle")
    with pytest.raises(G.GateError, match="placeholder"):
        G.refuse_stub_rows(df.withColumn("is_stub", F.col("fired")))
    rows = df.withColumn("space", F.when(F.col("fired"), " Full ").otherwise("pca"))
    assert [tuple(r) for r in G.full_space_rows(rows, ["fired", "gone", "id"]).collect()] == [(True, "a")]


def test_disconnected_cells_get_a_status(spark):
    two = np.r_[np.zeros((6, 2)), np.full((6, 2), 50.0)] + np.random.default_rng(0).normal(size=(12, 2))
    df = spark.createDataFrame([("far", t, x.tolist()) for t, x in enumerate(two)], "id string, t int, p array<double>")
    row = A.ambient_audit(df, ["id"], ["t"], "p", AuditConfig(n_nulls=3, k0=2, kmax=2)).first()
    assert row["geo_status"] == "disconnected" and row["geo_Lobs"] is None and row["geo_pperm"] is None
    assert row["euc_pperm"] is not None


def test_reports(spark, tmp_path):
    rows = [(o, s, lag, 0.1 * lag, 1.5 / (lag + 1)) for o in ("adam", "sgd") for s in (1, 2) for lag in range(21)]
    acf = spark.createDataFrame(rows, "optimizer string, seed int, lag int, acf_mag double, cos_sim double")
    text = P.dependence_report(acf, "optimizer", ["seed"], "net")
    assert "adam vs sgd: +0.0000" in text and "+0.100/+0.750" in text and "exchangeable" not in text
    P.write_text(spark, text, str(tmp_path / "text"))
    table = spark.createDataFrame([("a_b", 1, 0.25)], "name string, n int, v double")
    tex = P.latex_table(table, {"name": "Run_name", "v": "Value"})
    assert r"a\_b & 0.2500 \\" in tex and r"Run\_name & Value \\" in tex
    P.write_metadata(spark, str(tmp_path / "meta"), AuditConfig(), table)
    assert "k0" in P.read_metadata(spark, str(tmp_path / "meta/run")).first()["run"]
    with pytest.raises(ValueError):
        P.small_rows(spark.range(600))


def test_audit_command(spark, tmp_path):
    rng = np.random.default_rng(0)
    for seed in (1, 2):
        x = rng.standard_normal((14, 9)).cumsum(axis=0).astype(np.float32)
        np.save(tmp_path / f"net__adam__seed{seed}.npy", x)
    heads = npy.npy_headers(spark, str(tmp_path / "*.npy")).collect()
    assert [(r["n_rows"], r["n_cols"], r["dtype"]) for r in heads] == [(14, 9, str(x.dtype))] * 2
    out = str(tmp_path / "cells")
    first = ["audit", str(tmp_path / "*seed1.npy"), out, "--nulls", "5", "--k0", "3", "--chunk-cols", "4", "--resume"]
    cli.main(first)
    cli.main([*first[:1], str(tmp_path / "*.npy"), *first[2:]])
    got = spark.read.parquet(out).collect()
    assert sorted(r["seed"] for r in got) == [1, 2] and all(r["N_pts"] == 14 for r in got)


def test_resume_runs_new_settings_and_skips_finished_cells(spark, tmp_path):
    x = np.random.default_rng(1).standard_normal((12, 5)).cumsum(axis=0).astype(np.float32)
    np.save(tmp_path / "net__adam__seed1.npy", x)
    out = str(tmp_path / "cells")
    job = ["audit", str(tmp_path / "*.npy"), out, "--k0", "3", "--resume", "--nulls"]
    cells = lambda: sorted((r["block_size"], r["n_nulls"]) for r in spark.read.parquet(out).collect())
    cli.main([*job, "4", "--blocks", "1"])
    cli.main([*job, "4", "--blocks", "1", "3"])
    assert cells() == [(1, 4), (3, 4)]
    cli.main([*job, "5", "--blocks", "3"])
    cli.main([*job, "5", "--blocks", "3"])
    assert cells() == [(1, 4), (3, 4), (3, 5)]


def test_a_broken_folder_is_not_taken_for_an_empty_one(spark, tmp_path):
    from wanderloop.streaming.resume import finished, remaining

    assert finished(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/part-0.parquet").write_text("no parquet at all")
    with pytest.raises(Exception):
        finished(spark, str(tmp_path / "bad"))
    work = spark.createDataFrame([("a", 1), (None, 2)], "k string, b int")
    assert remaining(work, work.filter("k is null"), ["k", "b"]).collect() == [("a", 1)]


def test_null_keys_are_kept(spark):
    from wanderloop.operators.ordered import stride_subsample
    from wanderloop.operators.quantiles import median_and_mad
    from wanderloop.operators.trajectory import kinematics, step_gram

    rows = [(k, t, [float(t), 0.0], float(t)) for k in ("a", None) for t in range(4)]
    df = spark.createDataFrame(rows, "id string, t int, p array<double>, v double")
    assert {r["id"]: r["path_length"] for r in kinematics(df, ["id"], ["t"], "p").collect()} == {"a": 3.0, None: 3.0}
    assert {r["id"]: r["mad"] for r in median_and_mad(df, ["id"], "v").collect()} == {"a": 1.0, None: 1.0}
    assert stride_subsample(df, ["id"], ["t"], 3).groupBy("id").count().count() == 2
    assert step_gram(df, ["id"], ["t"], "p", 10).count() == 2


def test_release_and_manifest_commands(spark, tmp_path):
    (tmp_path / "in/results").mkdir(parents=True)
    (tmp_path / "in/results/a.csv").write_text("pperm,seed\n0.01,1\n")
    cli.main(["release", str(tmp_path / "in"), str(tmp_path / "out"), "--roots", "results"])
    back = spark.read.csv(str(tmp_path / "out/release_csv_inventory"), header=True).first()
    assert back["source_csv"] == "results/a.csv" and back["raw_pvalue_triggers"] == "1"
    cli.main(["manifest", str(tmp_path / "in"), str(tmp_path / "m")])
    assert spark.read.csv(str(tmp_path / "m"), header=True).first()["relative_path"] == "results/a.csv"


def test_run_seed():
    assert run_seed(0, 0, 0) == 42 and run_seed(2, 3, 7) == 20_349


@pytest.mark.parametrize(
    "make", [
        lambda s: synthetic.overpass(s, 40, 0.5, 1), lambda s: synthetic.embedded_circle(s, 40, 3, 1.0, 8, 0.01, 1),
        lambda s: synthetic.random_steps(s, 40, 5, 1), lambda s: synthetic.swiss_roll(s, 40, 0.05, 1),
        lambda s: synthetic.torus(s, 40, 3.0, 1.0, 0.05, 1), lambda s: synthetic.figure_eight(s, 40, 1.5, 0.05, 1),
        lambda s: synthetic.curvature_family(s, 40, 0.5, 0.03, 1),
    ],
)
def test_synthetic_rows_do_not_depend_on_partitions(spark, make):
    a = [tuple(r) for r in make(spark).orderBy("t").collect()]
    b = [tuple(r) for r in make(spark).repartition(5).orderBy("t").collect()]
    assert a == b and len(a) == 40 and np.isfinite(np.array([r[1] for r in a])).all()


def test_hashed_normals_look_normal(spark):
    df = spark.range(4000).select(synthetic.hash_normal(3, F.col("id")).alias("z"))
    row = df.agg(F.avg("z").alias("m"), F.stddev("z").alias("s"), F.kurtosis("z").alias("k")).first()
    assert abs(row["m"]) < 0.05 and abs(row["s"] - 1) < 0.05 and abs(row["k"]) < 0.3
