"""False-positive calibration on walks drawn from pooled increments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wanderloop.config import AuditConfig
from wanderloop.operators.audits import Setting, null_lifetimes
from wanderloop.operators.ordered import OrderedGroups
from wanderloop.operators.trajectory import gram_of_moves, steps_of
from wanderloop.operators.walk_nulls import record_from_lifetimes

DRAW_STREAM = 12345


def walk_draws(
    df: DataFrame, n_calib: int, n_steps: int, n_pool: int, seed: int, replace: bool = True
) -> DataFrame:
    """(calib_id, pos, idx): pool indices of each walk, seeded by the walk."""
    if not replace and n_steps > n_pool:
        raise ValueError("cannot draw more steps than the pool holds without replacement")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for calib_id in pdf["id"]:
                rng = np.random.default_rng([seed, int(calib_id), DRAW_STREAM])
                if replace:
                    idx = rng.integers(0, n_pool, size=n_steps)
                else:
                    idx = rng.choice(n_pool, size=n_steps, replace=False)
                yield pd.DataFrame(
                    {"calib_id": int(calib_id), "pos": np.arange(1, n_steps + 1), "idx": idx}
                )

    ids = df.sparkSession.range(n_calib)
    return ids.mapInPandas(draw, "calib_id long, pos long, idx long")


def calibrate(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], point: str, cfg: AuditConfig,
    n_calib: int = 200, n_steps: int | None = None, replace: bool = True,
) -> DataFrame:
    """Permutation records of (calib_id, block_size) cells.

    All increments form the pool. They are numbered across slices, and only the
    drawn ones are joined; a walk holds ``n_steps`` of them.
    """
    steps = steps_of(df, keys, order, point)
    if n_steps is None:
        n_steps = int(steps.groupBy(*keys).count().agg(F.min("count")).first()[0])
    if not 1 < n_steps <= cfg.max_points:
        raise ValueError("a calibration walk needs between 2 and max_points steps")
    pool = OrderedGroups(steps, [], [*keys, "pos"]).scan(position="idx").select("idx", "step")
    draws = walk_draws(df, n_calib, n_steps, pool.count(), cfg.seed, replace)
    drawn = draws.join(pool, "idx")
    walks = drawn.groupBy("calib_id").agg(
        # Exactly ``n_steps`` entries.
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "step"))), lambda p: p["step"]).alias("s")
    )
    grams = walks.select("calib_id", gram_of_moves("s").alias("gram"))
    settings = [Setting(b, cfg.k0, None, cfg.seed) for b in cfg.block_sizes]
    life = null_lifetimes(
        grams, ["calib_id"], settings, cfg, n_calib,
        rng_key=lambda row, j: [row["master"], int(row["calib_id"]), row["block_size"], j],
    )
    return record_from_lifetimes(
        life, ["calib_id", "block_size"], "L_geo", thresholds=cfg.thresholds
    ).withColumn("n_steps", F.lit(n_steps))
