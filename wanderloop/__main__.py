"""Command line: ``spark-submit`` entry for the jobs a run needs.

    python -m wanderloop release BASE OUT --roots results acf --allow-empty
    python -m wanderloop manifest BASE OUT
    python -m wanderloop query NAME TABLES OUT
    python -m wanderloop audit "runs/*.npy" OUT --nulls 200 --blocks 1 5 10 20 --resume
    python -m wanderloop acf "runs/*.npy" OUT --max-lag 40
    python -m wanderloop kinematics "runs/*.npy" OUT
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from wanderloop.config import AuditConfig, build_session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wanderloop", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)
    release = jobs.add_parser("release")
    release.add_argument("base")
    release.add_argument("out")
    release.add_argument("--roots", nargs="+", default=["."])
    release.add_argument("--allow-empty", action="store_true")
    manifest = jobs.add_parser("manifest")
    manifest.add_argument("base")
    manifest.add_argument("out")
    manifest.add_argument("--exclude-top", nargs="*", default=[])
    query = jobs.add_parser("query")
    query.add_argument("name")
    query.add_argument("tables")
    query.add_argument("out")
    audit = jobs.add_parser("audit")
    audit.add_argument("pattern")
    audit.add_argument("out")
    audit.add_argument("--nulls", type=int, default=200)
    audit.add_argument("--blocks", type=int, nargs="+", default=[1])
    audit.add_argument("--k0", type=int, default=12)
    audit.add_argument("--kmax", type=int, default=199)
    audit.add_argument("--pct", type=float, default=None)
    audit.add_argument("--seed", type=int, default=42)
    audit.add_argument("--chunk-cols", type=int, default=50_000)
    audit.add_argument("--resume", action="store_true")
    for name in ("acf", "kinematics"):
        job = jobs.add_parser(name)
        job.add_argument("pattern")
        job.add_argument("out")
        job.add_argument("--chunk-cols", type=int, default=50_000)
        if name == "acf":
            job.add_argument("--max-lag", type=int, default=40)
    return top


def run_audit(spark, args) -> None:
    """Wide trajectories from array files: Gram, nulls, records; finished cells are kept."""
    from wanderloop.operators.audits import SETTING, audit_records, null_lifetimes, settings_of, with_settings
    from wanderloop.operators.trajectory import gram_from_chunks
    from wanderloop.sources.npy import npy_headers, read_npy, with_run_keys
    from wanderloop.streaming.resume import run_in_batches

    cfg = AuditConfig(
        seed=args.seed, n_nulls=args.nulls, block_sizes=tuple(args.blocks), k0=args.k0,
        kmax=args.kmax, filtration_pct=args.pct, chunk_cols=args.chunk_cols, seed_by_key=True,
    )
    keys = ["arch", "optimizer", "seed"]
    chunks = with_run_keys(read_npy(spark, args.pattern, cfg.chunk_cols)).withColumnRenamed("t", "position")
    files, longest = npy_headers(spark, args.pattern).agg(F.count(F.lit(1)), F.max("n_rows")).first()
    if not files:
        raise FileNotFoundError(f"no trajectory files match {args.pattern}")
    if longest > cfg.max_points:
        # Read by column chunks, such a matrix would not fit a task.
        raise ValueError(f"a trajectory has more than {cfg.max_points} checkpoints")

    def run(left, settings):
        grams = gram_from_chunks(left, keys)
        life = null_lifetimes(grams, keys, settings, cfg, files)
        records = audit_records(life, [*keys, *SETTING], cfg)
        # Together with the setting these name a cell of a sweep.
        return records.withColumn("n_nulls", F.lit(cfg.n_nulls)).withColumn("master_seed", F.lit(cfg.seed)).withColumn("kmax", F.lit(cfg.kmax))

    if not args.resume:
        run(chunks, settings_of(cfg)).write.mode("overwrite").parquet(args.out)
        return
    runs = chunks.select(*keys).distinct()
    cells = with_settings(runs, settings_of(cfg), cfg).select(
        *keys, *SETTING, "n_nulls", F.lit(cfg.seed).alias("master_seed"), F.lit(cfg.kmax).alias("kmax")
    )
    run_in_batches(
        spark, cells, cells.columns, args.out, settings_of(cfg),
        lambda all_cells, s: all_cells.filter(F.col("block_size") == s.block_size),
        lambda left, s: run(chunks.join(left.select(*keys).distinct(), keys, "left_semi"), [s]),
    )


def run_acf(spark, args) -> None:
    """Autocorrelation of step lengths and directions per lag, and window means, of wide trajectories."""
    from wanderloop.operators.autocorrelation import acf_of_products, window_means
    from wanderloop.sources.npy import step_products, with_run_keys

    keys = ["arch", "optimizer", "seed"]
    products = with_run_keys(step_products(spark, args.pattern, args.max_lag, args.chunk_cols))
    acf_of_products(products, keys, max_lag=args.max_lag).write.mode("overwrite").parquet(f"{args.out}/acf")
    acf = spark.read.parquet(f"{args.out}/acf")
    window_means(acf, keys).write.mode("overwrite").parquet(f"{args.out}/windows")


def run_kinematics(spark, args) -> None:
    """Path length, net displacement, their ratio, last loss and accuracy of wide trajectories."""
    from wanderloop.operators.trajectory import kinematics_of_products
    from wanderloop.sources.npy import net_displacements, run_facts, step_products, with_run_keys

    products = step_products(spark, args.pattern, 0, args.chunk_cols)
    rows = kinematics_of_products(products, net_displacements(spark, args.pattern), ["file"])
    facts = run_facts(spark, args.pattern).select("file", "d_full", "train_loss", "val_acc")
    with_run_keys(rows.join(facts, "file")).drop("file").write.mode("overwrite").parquet(args.out)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session(f"wanderloop-{args.job}")
    if args.job == "release":
        from wanderloop.sources.result_csv import build_release, write_csv

        built = build_release(spark, args.base, args.roots, args.allow_empty)
        empty = spark.createDataFrame([], "source_csv string, n_rows long, columns string")
        names = ("release_csv_inventory", "all_results_normalized", "trigger_summary")
        for name, df in zip(names, built or (empty, empty, empty)):
            write_csv(df, f"{args.out}/{name}", single=name != "all_results_normalized")
    elif args.job == "manifest":
        from wanderloop.sources.manifests import file_manifest

        found = file_manifest(spark, args.base, exclude_top=args.exclude_top)
        found.orderBy("relative_path").write.mode("overwrite").csv(args.out, header=True)
    elif args.job == "query":
        from wanderloop.plans.catalogue import QUERIES

        out = QUERIES[args.name](spark, args.tables)
        out.withColumn("query", F.lit(args.name)).write.mode("overwrite").parquet(args.out)
    else:
        {"audit": run_audit, "acf": run_acf, "kinematics": run_kinematics}[args.job](spark, args)


if __name__ == "__main__":
    main()
