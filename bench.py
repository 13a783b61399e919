"""Headline timings; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated subset).
"""

from __future__ import annotations

import json
import os
import time

os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

from pyspark.sql import SparkSession  # noqa: E402

from wanderloop.config import AuditConfig, ship_package  # noqa: E402
from wanderloop.operators.audits import ambient_audit, sensitivity_settings  # noqa: E402
from wanderloop.plans.catalogue import QUERIES  # noqa: E402
from wanderloop.plans.geometry import KEYS, ORDER, POINT, vectors  # noqa: E402

REGISTERED = (
    "perm_test_events", "block_perm_test", "magnitude_acf", "direction_acf", "kinematic_ratio",
    "mad_robust_z", "quantiles_linear", "spearman_rho", "adjacent_flips", "trigger_rollup",
    "named_agg_per_k", "pivot_two_keys", "budget_max", "dedup_paths", "locality_diagnostics",
    "pooled_walk_calibration",
)


def block_cells_200(spark, sf_dir):
    """Main audit: 200 nulls per cell, Euclidean and geodesic, complete filtration."""
    return ambient_audit(vectors(spark, sf_dir), KEYS, ORDER, POINT, AuditConfig(n_nulls=200))


def sensitivity_cells_50(spark, sf_dir):
    """Two cells of the k x percentile grid per trajectory, 50 nulls each."""
    cfg = AuditConfig(n_nulls=50)
    settings = sensitivity_settings(cfg, (8, 16), (95.0,))
    return ambient_audit(vectors(spark, sf_dir), KEYS, ORDER, POINT, cfg, settings)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    jobs = {name: QUERIES[name] for name in REGISTERED}
    jobs |= {"block_cells_200": block_cells_200, "sensitivity_cells_50": sensitivity_cells_50}
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(jobs)
    # Start the JVM code paths and the Python workers before the clock.
    spark.read.parquet(f"{sf_dir}/embeddings.parquet").mapInPandas(
        lambda it: it, "vec_id long, embedding array<float>, label int"
    ).groupBy("label").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        start = time.time()
        jobs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
