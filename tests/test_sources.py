"""Array files, manifests and resumable sweeps."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wanderloop.operators.trajectory import gram_from_chunks
from wanderloop.sources import manifests as M
from wanderloop.sources import npy
from wanderloop.streaming.resume import run_resumable


def test_npy_chunks_give_the_gram(spark, tmp_path):
    rng = np.random.default_rng(0)
    runs = {f"net__adam__seed{s}": rng.standard_normal((9, 13)).astype(np.float32) for s in (1, 22)}
    for name, x in runs.items():
        np.save(tmp_path / f"{name}.npy", x)
        np.save(tmp_path / f"{name}__metrics.npy", np.zeros((9, 2), np.float32))
    df = npy.with_run_keys(npy.read_npy(spark, str(tmp_path / "*.npy"), chunk_cols=5))
    assert df.count() == 2 * 9 * 3
    chunks = df.withColumnRenamed("t", "position")
    got = {r["seed"]: r["gram"] for r in gram_from_chunks(chunks, ["arch", "optimizer", "seed"]).collect()}
    for name, x in runs.items():
        s = np.diff(x.astype(float), axis=0)
        assert np.allclose(got[int(name.split("seed")[1])], (s @ s.T).ravel())
    order = npy.run_order({"net": 0}, {"sgd": 0, "adam": 1})
    assert [r["seed"] for r in df.select("arch", "optimizer", "seed").distinct().orderBy(*order).collect()] == [1, 22]


@pytest.mark.parametrize("order", ["C", "F"])
def test_npy_split_by_rows_and_columns(spark, tmp_path, order):
    x = np.asarray(np.random.default_rng(1).standard_normal((50, 37)), order=order)
    np.save(tmp_path / "a__b__seed1.npy", x)
    np.save(tmp_path / "a__b__seed2.npy", np.zeros((0, 4)))
    np.save(tmp_path / "a__b__seed3.npy", np.arange(6, dtype=np.int16).reshape(3, 2))
    for split in (64, 1000, 1 << 20):
        df = npy.read_npy(spark, str(tmp_path), chunk_cols=10, split_bytes=split)
        rows = df.withColumn("task", F.spark_partition_id()).collect()
        assert len(rows) == 50 * 4 + 3
        got = {(r["t"], r["chunk_id"]): r["vals"] for r in rows if "seed1" in r["file"]}
        for t in range(50):
            assert np.array_equal(np.concatenate([got[t, c] for c in range(4)]), x[t].astype(np.float32))
        assert sorted(v for r in rows if "seed3" in r["file"] for v in r["vals"]) == [0, 1, 2, 3, 4, 5]
        tasks = {r["task"] for r in rows if "seed1" in r["file"]}
        assert len(tasks) == 1 if split > 1000 else len(tasks) > 4


def test_products_at_the_source_equal_the_array_forms(spark, tmp_path):
    from wanderloop import __main__ as cli
    from wanderloop.operators.autocorrelation import acf_of_products, trajectory_acf
    from wanderloop.operators.trajectory import kinematics, kinematics_of_products

    rng, rows = np.random.default_rng(5), []
    for seed, n in ((1, 60), (2, 7), (3, 1)):
        x = np.cumsum(rng.standard_normal((n, 23)), axis=0).astype(np.float32)
        np.save(tmp_path / f"a__b__seed{seed}.npy", x)
        rows += [(f"a__b__seed{seed}.npy", i, v.tolist()) for i, v in enumerate(x)]
    points = spark.createDataFrame(rows, "file string, t int, x array<double>")

    def table(df, *key):
        return {tuple(r[k] for k in key): r.asDict() for r in df.collect()}

    def equal(got, want, fields):
        assert got.keys() == want.keys()
        for k in got:
            for f in fields:
                a, b = got[k][f], want[k][f]
                assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9, abs=1e-9))

    path = str(tmp_path / "*.npy")
    want = table(trajectory_acf(points, ["file"], ["t"], "x", 9), "file", "lag")
    lines = table(kinematics(points, ["file"], ["t"], "x"), "file")
    for split in (300, 1 << 20):
        products = npy.step_products(spark, path, 9, chunk_cols=10, split_bytes=split)
        got = table(acf_of_products(products, ["file"], max_lag=9), "file", "lag")
        equal(got, want, ["acf_mag", "cos_sim"])
        ends = npy.net_displacements(spark, path, chunk_cols=10)
        equal(table(kinematics_of_products(products, ends, ["file"]), "file"), lines,
              ["n_points", "path_length", "net_displacement", "kinematic_R"])
    cli.main(["acf", path, str(tmp_path / "out"), "--max-lag", "9", "--chunk-cols", "7"])
    cli.main(["kinematics", path, str(tmp_path / "kin"), "--chunk-cols", "7"])
    saved = {r["seed"]: r["kinematic_R"] for r in spark.read.parquet(str(tmp_path / "kin")).collect()}
    assert saved == pytest.approx({s: lines[f"a__b__seed{s}.npy",]["kinematic_R"] for s in (1, 2, 3)})
    assert spark.read.parquet(str(tmp_path / "out/acf")).count() == len(want)
    assert spark.read.parquet(str(tmp_path / "out/windows")).count() == 2


def test_facts_of_runs_and_manifest_of_the_pool(spark, tmp_path):
    for seed, n in ((1, 6), (2, 4)):
        np.save(tmp_path / f"a__b__seed{seed}.npy", np.zeros((n, 3), np.float32))
    metrics = np.random.default_rng(2).standard_normal((6, 3))
    np.save(tmp_path / "a__b__seed1__metrics.npy", metrics)
    path = str(tmp_path / "*.npy")
    got = {(r["file"][10:11], r["epoch"]): r[2:] for r in npy.with_run_keys(npy.run_facts(spark, path, [2, 5, 99])).select(
        "file", "epoch", "n_points", "d_full", "train_loss", "val_acc").collect()}
    assert got == {
        ("1", 2): (6, 3, *metrics[1, :2]), ("1", 5): (6, 3, *metrics[4, :2]), ("1", 6): (6, 3, *metrics[5, :2]),
        ("2", 2): (4, 3, None, None), ("2", 4): (4, 3, None, None),
    }
    rows = {r["path"][-9:-4]: r for r in npy.pool_manifest(spark, path).collect()}
    assert [(rows[s]["n_steps"], rows[s]["n_cols"], rows[s]["dtype"]) for s in ("seed1", "seed2")] == [
        (5, 3, "float32"), (3, 3, "float32")]
    raw = (tmp_path / "a__b__seed2.npy").read_bytes()
    assert (rows["seed2"]["size_bytes"], rows["seed2"]["sha256"]) == (len(raw), hashlib.sha256(raw).hexdigest())
    np.save(tmp_path / "a__b__seed3.npy", np.zeros((2, 4), np.float32))
    with pytest.raises(ValueError, match="3 and of 4"):
        npy.pool_manifest(spark, path)


def test_digests_of_files_of_any_size(spark, tmp_path):
    """A sparse file above Spark's limit of a row, an empty one and one of just two chunks."""
    size = (3 << 30) + 5
    with open(tmp_path / "big.bin", "wb") as file:
        file.truncate(size)
    (tmp_path / "none.txt").write_text("")
    (tmp_path / "even.txt").write_text("abcdefgh")
    seen, block = hashlib.sha256(), bytes(1 << 24)
    for _ in range(size >> 24):
        seen.update(block)
    seen.update(bytes(size & ((1 << 24) - 1)))
    got = {r["relative_path"]: (r["sha256"], r["size_bytes"]) for r in M.file_manifest(spark, str(tmp_path)).collect()}
    want = {"big.bin": (seen.hexdigest(), size)}
    want |= {n: (hashlib.sha256(t).hexdigest(), len(t)) for n, t in (("none.txt", b""), ("even.txt", b"abcdefgh"))}
    assert got == want
    small = M.listed(spark, str(tmp_path)).filter("length < 100")
    tree = {r["path"].rsplit("/", 1)[1]: r for r in M.tree_digests(small, chunk=4).collect()}
    hexes = [hashlib.sha256(t).hexdigest() for t in (b"abcd", b"efgh")]
    assert tree["even.txt"]["chunks"] == 2
    assert tree["even.txt"]["tree_sha256"] == hashlib.sha256("".join(hexes).encode()).hexdigest()
    before = M.chunk_digests(small, chunk=4).filter("length > 0").select("at", "sha256").collect()
    (tmp_path / "even.txt").write_text("abcdEfgh")
    after = M.chunk_digests(small, chunk=4).filter("length > 0").select("at", "sha256").collect()
    assert [r["at"] for r in set(after) - set(before)] == [1]


def test_npy_rejects_other_shapes(spark, tmp_path):
    np.save(tmp_path / "a__b__seed1.npy", np.zeros(4, np.float32))
    with pytest.raises(Exception, match="2-D"):
        npy.read_npy(spark, str(tmp_path / "*.npy")).count()


def test_file_manifest(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "skip").mkdir()
    for name, text in {"a/x.txt": "one", "a/b/y.txt": "two", "a/.gitkeep": "", "skip/z.txt": "no"}.items():
        (tmp_path / name).write_text(text)
    got = M.file_manifest(spark, str(tmp_path), ("a", "a/b", "skip"), exclude_top=("skip",))
    rows = {r["relative_path"]: (r["sha256"], r["size_bytes"]) for r in got.collect()}
    assert rows == {
        p: (hashlib.sha256(t.encode()).hexdigest(), len(t)) for p, t in (("a/x.txt", "one"), ("a/b/y.txt", "two"))
    }
    stale = got.select("relative_path", "sha256").unionByName(
        spark.createDataFrame([("gone.txt", "0")], "relative_path string, sha256 string")
    ).withColumn("sha256", F.when(F.col("relative_path") == "a/x.txt", "bad").otherwise(F.col("sha256")))
    status = {r["relative_path"]: r["status"] for r in M.check_manifest(stale, got).collect()}
    assert status == {"a/x.txt": "mismatch", "a/b/y.txt": "ok", "gone.txt": "missing"}


def test_copies_are_counted_by_hash(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "id int, text string")
    got = {r["id"]: r["n_copies"] for r in M.first_of_copies(df, "id", "text").collect()}
    assert got == {1: 2, 2: 1}


def test_resume_runs_only_the_rest(spark, tmp_path):
    path, seen = str(tmp_path / "cells"), []

    def run(cells):
        seen.append(cells.count())
        return cells.withColumn("result", F.col("cell") * 10)

    work = spark.range(6).select(F.col("id").alias("cell"), (F.col("id") % 2).alias("block"))
    run_resumable(spark, work.filter("cell < 4"), ["cell", "block"], path, run)
    out = run_resumable(spark, work, ["cell", "block"], path, run)
    assert seen == [4, 2]
    assert sorted((r["cell"], r["result"]) for r in out.collect()) == [(i, 10 * i) for i in range(6)]
