"""Sweep summaries, autocorrelation, roles and the CSV warehouse on small tables."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wanderloop.functions.columns import is_true_text, number_or_null, wilson_bounds
from wanderloop.operators import autocorrelation as A
from wanderloop.operators import roles as R
from wanderloop.operators import summaries as S
from wanderloop.operators.decisions import component_null_count
from wanderloop.plans.catalogue import ORACLES, QUERIES
from wanderloop.sources import result_csv as C


def test_wilson_known_value(spark):
    low, high = wilson_bounds(F.lit(4), F.lit(200))
    row = spark.range(1).select(low.alias("lo"), high.alias("hi")).first()
    assert row["lo"] == pytest.approx(0.0078043, abs=1e-7) and 0.02 < row["hi"] < 0.06


def test_lenient_cells(spark):
    df = spark.createDataFrame([(" YES ", "1.5"), ("no", "x"), (None, "NaN"), ("1", None)], "a string, b string")
    got = df.select(is_true_text(F.col("a")).alias("a"), number_or_null(F.col("b")).alias("b")).collect()
    assert [tuple(r) for r in got] == [(True, 1.5), (False, None), (False, None), (True, None)]


SWEEP = [
    ("d1", s, k, fired, 1.0 + k / 10 + s, 2.0 * k, float(k) - s, 0.01 * (k + s))
    for s in (1, 2) for k, fired in zip((6, 8, 10, 12), ([True, True, False, True] if s == 1 else [True] * 4))
]
SWEEP_SCHEMA = "dataset string, seed int, k int, formal_trigger boolean, Lobs double, TSR double, zrob double, pperm double"


def test_sweep_analysis(spark):
    df = spark.createDataFrame(SWEEP, SWEEP_SCHEMA).withColumn("type", F.lit("circle"))
    row = S.sweep_analysis(df, carried=("type",)).first()
    assert row["flip_count"] == 2 and row["total_pairs"] == 6 and row["flip_rate"] == pytest.approx(1 / 3)
    assert row["n_formal_positive"] == 7 and row["n_total"] == 8 and row["type"] == "circle"
    assert row["kendall_tau_TSR"] == pytest.approx(1.0) and row["tau_TSR_p"] == pytest.approx(2 / 24)
    per_k = {r["k"]: r for r in S.per_k_summary(df).collect()}
    assert per_k[10]["fire_rate"] == 0.5 and per_k[6]["n_total"] == 2
    seq = S.decision_sequences(df.filter("seed = 1"), ["dataset"], "k", F.col("formal_trigger").cast("int")).first()
    assert (seq["k_sequence"], seq["decision_sequence"]) == ("6,8,10,12", "1,1,0,1")


def test_curvature_summary(spark):
    rows = [(i / 7, float(v), i == 9, 0.1 * i) for i, v in enumerate([1, 2, 3, 4, 6, 5, 7, 8])]
    df = spark.createDataFrame(rows, "lambda_val double, proj_TSR double, geo_formal_trigger boolean, geo_TSR double")
    row = S.curvature_summary(df).first()
    assert row["spearman_proj_TSR_vs_lambda"] == pytest.approx(0.9761904761904762)
    assert row["spearman_p"] == pytest.approx(3.3143960262001e-05, rel=1e-9)
    assert row["any_geo_formal_trigger"] is False and row["max_geo_TSR"] == pytest.approx(0.7)


def test_component_null_count(spark):
    df = spark.createDataFrame([(0.95, 2.0), (0.95, 3.0), (0.5, 2.0)], "z double, r double")
    got = df.select(component_null_count(F.col("z"), F.col("r")).alias("n")).collect()
    assert [r["n"] for r in got] == [100, 200, 200]


def test_grid_lists_must_be_short(spark):
    df = spark.range(2000).select(F.lit("d").alias("dataset"), F.col("id").alias("k"), F.lit(1.0).alias("v"))
    with pytest.raises(ValueError, match="grid points"):
        S.grid_arrays(df, ["dataset"], "k", {"v": F.col("v")})


def test_pivot_and_stability(spark):
    rows = [("a", 1, True), ("a", 5, True), ("b", 1, True), ("b", 5, False), ("c", 1, False)]
    df = spark.createDataFrame(rows, "id string, block_size int, fired boolean")
    got = {r["id"]: r for r in S.decision_pivot(df, ["id"], ["block_size"], [[1], [5]], "fired", "stable").collect()}
    assert [got[i]["stable"] for i in "abc"] == [1, 0, 1]
    assert got["b"]["1"] is True and got["b"]["5"] is False and got["c"]["5"] is None


def test_locality_summary_keeps_null_groups(spark, small_groups):
    rows = [(None if i % 3 == 0 else "m", "o", i, i % 2 == 0, False, 12 + i, i / 40, 2.0 + i, 1.0, False) for i in range(40)]
    schema = (
        "arch string, optimizer string, seed int, connected_at_initial_k boolean, adaptive_growth_used boolean, "
        "k_used int, graph_density double, edge_max_over_median double, edge_max_over_allpair_p95 double, "
        "near_complete_graph_flag boolean"
    )
    got = {r["arch"]: r for r in S.locality_summary(spark.createDataFrame(rows, schema)).collect()}
    for key, keep in ((None, lambda i: i % 3 == 0), ("m", lambda i: i % 3)):
        mine = [i for i in range(40) if keep(i)]
        assert got[key]["n_paths"] == len(mine)
        assert got[key]["k_used_median"] == np.median([12 + i for i in mine])
        assert got[key]["graph_density_median"] == pytest.approx(np.median(mine) / 40)


def test_left_join_suffix(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    right = spark.createDataFrame([(1, "x", 9)], "k int, v string, w int")
    got = S.left_join_suffixed(left, right, ["k"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "a", "x", 9), (2, "b", None, None)]


@pytest.mark.parametrize("rows", [None, 16])
def test_acf_equals_numpy(spark, rows):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 3)).cumsum(axis=0)
    df = spark.createDataFrame([("a", t, p.tolist()) for t, p in enumerate(x)], "id string, t int, point array<double>")
    still = spark.createDataFrame([("z", t, [float(t), 0.0, 0.0]) for t in range(5)], df.schema)
    if rows:
        spark.conf.set("spark.wanderloop.groupRows", str(rows))
    got = A.trajectory_acf(df.unionByName(still), ["id"], ["t"], "point", 8).toPandas()
    spark.conf.unset("spark.wanderloop.groupRows")
    steps = np.diff(x, axis=0)
    m = np.linalg.norm(steps, axis=1)
    c = m - m.mean()
    a = got[got["id"] == "a"].set_index("lag")
    for lag in range(9):
        n = len(c) - lag
        acf = (c[: n] * c[lag:]).sum() / n / (c @ c / len(c))
        cos = 1.0 if lag == 0 else np.mean(
            (steps[:n] * steps[lag:]).sum(axis=1) / (m[:n] * m[lag:] + 1e-12)
        )
        assert a.loc[lag, "acf_mag"] == pytest.approx(acf) and a.loc[lag, "cos_sim"] == pytest.approx(cos)
    z = got[got["id"] == "z"].set_index("lag")
    assert z.loc[0, "acf_mag"] == 1.0 and np.isnan(z.loc[1, "acf_mag"]) and z.loc[2, "cos_sim"] == pytest.approx(1.0)
    assert np.isnan(z.loc[6, "cos_sim"])


def role(spark, **cells):
    row = {k: [v] for k, v in cells.items()}
    df = spark.createDataFrame(pd.DataFrame(row))
    return df.select(R.analysis_role(df)).first()[0]


def test_role_precedence(spark):
    assert role(spark, source_csv="results/main_neural.csv") == R.FORMAL
    assert role(spark, source_csv="x/acf_pca.csv") == R.PROJECTION
    assert role(spark, source_csv="x/main_neural.csv", space="pca") == R.PROJECTION
    assert role(spark, source_csv="x/main_neural.csv", k_value=8) == R.SENSITIVITY
    assert role(spark, source_csv="x/a.csv", k_value=8, is_formal_inference=True) == R.FORMAL
    assert role(spark, source_csv="x/main_neural.csv", is_formal_inference=False) == R.UNCLASSIFIED
    assert role(spark, source_csv="x/circle.csv", is_formal_inference=True) == R.CONTROL
    assert role(spark, source_csv="x/circle.csv", block_size=5) == R.BLOCK
    assert role(spark, source_csv="x/block.csv", block_size=1, is_formal_inference=True) == R.BLOCK
    assert role(spark, source_csv="x/block.csv") == R.BLOCK
    # without a block column the path alone cannot override the formal flag
    assert role(spark, source_csv="x/block.csv", is_formal_inference=True) == R.FORMAL
    assert role(spark, source_csv="q.csv", role="Formal matched step", analysis_role="pca") == R.PROJECTION


FILES = {
    "results/main_neural.csv": "arch,seed,geo_pperm,geo_formal_trigger,block_size\nm,1,0.01,True,1\nm,2,0.2,True,1\nm,3,,False,10\nm,4,0.01,True,10\n",
    "results/plain.csv": "a,a,,note\n1,2,3,\"x,\ny\"\n\n4,,NA,z\n",
    "acf/only_header.csv": "pperm,k\n",
    "acf/broken.csv": "a,b\n1,2,3\n",
    "acf/case.csv": "Geo_PPerm,N_NULLS,n_nulls\n0.001,5,6\n",
}


def test_warehouse(spark, tmp_path):
    for name, text in FILES.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    inventory, rows, summary = C.build_release(spark, str(tmp_path), ["results", "acf"])
    inv = {r["source_csv"]: r for r in inventory.collect()}
    assert sorted(inv) == ["acf/case.csv", "acf/only_header.csv", "results/main_neural.csv", "results/plain.csv"]
    main = inv["results/main_neural.csv"]
    assert (main["n_rows"], main["raw_pvalue_triggers"], main["formal_matched_step_triggers"]) == (4, 2, 1)
    assert main["block_diagnostic_triggers"] == 1 and main["pvalue_column"] == "geo_pperm"
    # stated True, rule says no: the p of .2 and the block row
    assert main["source_formal_trigger_mismatches"] == 2
    assert inv["results/plain.csv"]["columns"] == "a;a.1;Unnamed: 2;note" and inv["acf/only_header.csv"]["n_rows"] == 0
    assert inv["acf/case.csv"]["pvalue_column"] == "Geo_PPerm" and inv["acf/case.csv"]["unclassified_rows"] == 0
    plain = [r for r in rows.collect() if r["source_csv"] == "results/plain.csv"]
    assert {(r["a"], r["a.1"], r["Unnamed: 2"], r["note"]) for r in plain} == {("1", "2", "3", "x,\ny"), ("4", None, None, "z")}
    assert rows.count() == 7 and sum(r["n_rows"] for r in summary.collect()) == 7
    bad = C.unreadable_files(spark, str(tmp_path), ["results", "acf"]).collect()
    assert [r["source_csv"] for r in bad] == ["acf/broken.csv"]


def test_warehouse_rules_agree_with_column_rules(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/main_neural.csv").write_text(FILES["results/main_neural.csv"])
    _, rows, _ = C.build_release(spark, str(tmp_path), ["r"])
    df = spark.read.csv(str(tmp_path / "r"), header=True, inferSchema=True).withColumn(
        "source_csv", F.lit("r/main_neural.csv")
    )
    want = R.normalize_formal_rule(df)
    cols = ["pperm_normalized", "raw_pvalue_trigger", "analysis_role_normalized", "formal_trigger_normalized",
            "block_null_diagnostic", "source_formal_trigger_mismatch", "is_block_gt1"]
    assert sorted(map(tuple, rows.select("seed", *cols).collect())) == sorted(
        map(tuple, want.select(F.col("seed").cast("string"), *cols).collect())
    )


def test_empty_release(spark, tmp_path):
    (tmp_path / "results").mkdir()
    (tmp_path / "results/readme.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        C.build_release(spark, str(tmp_path), ["results"])
    assert C.build_release(spark, str(tmp_path), ["results"], allow_empty=True) is None


def test_large_csv_is_cut_between_records(spark, tmp_path):
    """Quoted line ends, doubled quotes, stray quotes and blank lines; every cut equals the file read whole."""
    import csv
    import random

    pick = random.Random(3)
    (tmp_path / "r").mkdir()
    cells = ["1.5", "", "two\nlines", 'say "so"', "a,b", "é" * 3, "\r\nx", '""']
    for end in ("\n", "\r\n"):
        with open(tmp_path / f"r/quoted{len(end)}.csv", "w", newline="", encoding="utf-8") as file:
            out = csv.writer(file, lineterminator=end)
            out.writerow(["name", "k", "k"])
            for i in range(60):
                out.writerow([pick.choice(cells), i, pick.choice(cells)])
                file.write(end if i % 9 == 0 else "")
    rows = "".join(f"x{i},5\" screen,{i}\n" for i in range(41))  # 41 quotes within fields
    (tmp_path / "r/stray.csv").write_text("a,b,c\n" + rows + '"q\nr",1,2\n')
    (tmp_path / "r/broken.csv").write_text("a,b\n" + "1,2\n" * 80 + "1,2,3\n" + "1,2\n" * 80)
    (tmp_path / "r/void.csv").write_text("")
    (tmp_path / "r/one.csv").write_text("a\n7")

    def scan(split):
        got = C.scan_result_csvs(spark, str(tmp_path), ["r"], split).collect()
        good = sorted((r["source_csv"], r["row_no"], r["names"], r["values"]) for r in got if r["row_no"] >= 0)
        last: dict = {}
        for path, number, *_ in good:
            assert number > last.get(path, -1)
            last[path] = number
        heads = sorted((r["source_csv"], r["names"]) for r in got if r["row_no"] < 0 and r["problem"] is None)
        bad = sorted(r["source_csv"] for r in got if r["problem"] is not None)
        return [(p, n, v) for p, _, n, v in good], heads, bad

    whole = scan(1 << 20)
    assert whole[2] == ["r/broken.csv", "r/void.csv"] and len(whole[0]) == 60 + 60 + 42 + 1
    for name, end in (("r/quoted1.csv", "\n"), ("r/quoted2.csv", "\r\n")):
        with open(tmp_path / name, newline="", encoding="utf-8") as file:
            want = [c for c in csv.reader(file, strict=True) if c][1:]
        found = [[v.get(n, "") for n in names] for p, names, v in whole[0] if p == name]
        assert found == want
    for split in (7, 64, 500):
        assert scan(split) == whole
    cuts = C.segments_of(C.ranges(C.listed(spark, str(tmp_path / "r"), "*.csv"), 64)).groupBy("path").count().collect()
    cuts = {r["path"].rsplit("/", 1)[1]: r["count"] for r in cuts}
    assert cuts["quoted1.csv"] > 5 and cuts["stray.csv"] == cuts["one.csv"] == 1


def test_means_on_the_limit_equal_sql(spark, tmp_path):
    """Values of two digits whose mean is the limit: the order of the sum decides."""
    rng = np.random.default_rng(1)
    rows = []
    for user in range(300):
        v = np.round(rng.uniform(20, 60, int(rng.integers(3, 12))), 2)
        rows += [(user, float(x)) for x in [*v, round(50.0 * (len(v) + 1) - float(v.sum()), 2)]]
    rows = [(i, *rows[k]) for i, k in enumerate(rng.permutation(len(rows)).tolist())]
    events = [(i, user, "click", value) for i, user, value in rows]
    df = spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double")
    df.repartition(7, "value").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT * FROM read_parquet(?) ORDER BY event_id", [str(tmp_path / "events.parquet" / "*.parquet")])
    want = set(con.execute(ORACLES["pivot_first_stability"]).fetchall())
    assert {tuple(r) for r in QUERIES["pivot_first_stability"](spark, str(tmp_path)).collect()} == want
    assert len({r[1] for r in want}) == 2
