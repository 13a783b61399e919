"""Resumable sweeps: finished cells are skipped, new ones are appended.

Cells are matched by their full key with an anti join against what is already
written. Each batch of cells is committed on its own, so a killed run loses
only the batch in flight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def finished(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows already written, or None where the folder does not exist or holds no rows yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def remaining(work: DataFrame, done: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """The rows of ``work`` whose key, NULLs included, is not yet in ``done``."""
    if done is None:
        return work
    seen = done.select(*[F.col(k).alias(f"_done_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_done_{k}"))
    return work.join(seen, same, "left_anti")


def run_resumable(
    spark: SparkSession,
    work: DataFrame,
    keys: Sequence[str],
    path: str,
    run: Callable[[DataFrame], DataFrame],
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Run ``run`` on the cells not yet in ``path``, append, return all rows."""
    run(remaining(work, finished(spark, path), keys)).write.mode("append").partitionBy(
        *partition_by
    ).parquet(path)
    return spark.read.parquet(path)


def run_in_batches(
    spark: SparkSession,
    cells: DataFrame,
    keys: Sequence[str],
    path: str,
    batches: Iterable[object],
    choose: Callable[[DataFrame, object], DataFrame],
    run: Callable[[DataFrame, object], DataFrame],
) -> DataFrame | None:
    """One commit per batch of cells: ``choose`` picks a batch of ``cells``, ``run`` makes its rows.

    What earlier runs or batches have written is looked up before each batch.
    """
    for batch in batches:
        left = remaining(choose(cells, batch), finished(spark, path), keys)
        if not left.isEmpty():
            run(left, batch).write.mode("append").parquet(path)
    return finished(spark, path)
