"""Ordered work inside groups that may be larger than one task can hold.

A window partitioned by a key puts all rows of that key in one task. Here the
largest group is measured first. While it fits, the plain window is used. Once
it does not, rows are range-partitioned on (key, order), so that one key is cut
into many slices, and each scan is done in two steps: inside the slice, then
with the totals of the earlier slices of the same key. A slice holds at most
two keys that reach into another slice, so the table of totals has at most two
rows per slice whatever the data size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wanderloop.config import ensure_checkpoint_dir, group_rows

SLICE = "_slice"
# Slices up to which the table of carried totals (two rows each) is broadcast.
BROADCAST_SLICES = 20_000
# Longest list Spark cuts before the shuffle by itself, and parts otherwise.
GROUP_LIMIT_ROWS = 1_000
SALTS = 64


def fanned(df: DataFrame, *by: str) -> DataFrame:
    """Spread rows over all task slots before each is multiplied.

    Small partitions would otherwise be merged, and the multiplied rows of all
    of them be made in one task.
    """
    spark = df.sparkSession
    slots = max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    return df.repartition(slots, *by)


def settled(df: DataFrame) -> DataFrame:
    """Computed once and kept in the checkpoint folder, for costly small results."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


class GroupSizes(NamedTuple):
    largest: int
    total: int
    groups: int


def group_sizes(df: DataFrame, keys: Sequence[str]) -> GroupSizes:
    """Rows of the largest group, rows in total, and number of groups."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(
        F.max("n").alias("largest"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("groups")
    ).first()
    return GroupSizes(int(row["largest"] or 0), int(row["total"] or 0), int(row["groups"]))


class OrderedGroups:
    """Rows of ``df`` grouped by ``keys`` and totally ordered by ``order``."""

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        limit: int | None = None,
    ):
        self.keys = list(keys)
        self.order = list(order)
        limit = limit or group_rows(df.sparkSession)
        largest, total, _ = group_sizes(df, self.keys)
        self.largest = largest
        # Without keys the whole table would be one group of one task, however short.
        self.is_split = largest > limit or not self.keys
        if not self.is_split:
            self.df = df
            self.parts = self.keys
            return
        ensure_checkpoint_dir(df.sparkSession)
        least = 2 if self.keys else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.slices = slices = max(2, least, math.ceil(2 * total / limit))
        # The checkpoint pins which rows a slice holds: sampled range bounds
        # must not move when a lost task is run again.
        self.df = (
            df.repartitionByRange(slices, *self.keys, *self.order)
            .withColumn(SLICE, F.spark_partition_id())
            .checkpoint()
        )
        self.parts = [*self.keys, SLICE]

    def scan(
        self,
        position: str | None = None,
        sums: dict[str, Column | str] | None = None,
        lags: dict[str, str] | None = None,
    ) -> DataFrame:
        """Add 0-based positions, running sums and previous values."""
        sums = {k: F.col(v) if isinstance(v, str) else v for k, v in (sums or {}).items()}
        lags = lags or {}
        inside = Window.partitionBy(*self.parts).orderBy(*self.order)
        so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        added: dict[str, Column] = {}
        if position or (self.is_split and lags):
            added[position or "_at"] = F.row_number().over(inside).cast("long") - 1
        for name, value in sums.items():
            added[name] = F.sum(value).over(so_far)
        for name, value in lags.items():
            added[name] = F.lag(value).over(inside)
        out = self.df.withColumns(added)
        if not self.is_split:
            return out
        return self._carry(out, position, sums, lags)

    def _carry(self, out: DataFrame, position, sums, lags) -> DataFrame:
        totals = [F.count(F.lit(1)).alias("_rows")]
        totals += [F.sum(value).alias(f"_total_{name}") for name, value in sums.items()]
        if lags:
            last = F.struct(*[F.col(v).alias(n) for n, v in lags.items()])
            totals.append(F.max_by(last, F.struct(*self.order)).alias("_last"))
        slices = self.df.groupBy(*self.parts).agg(*totals)
        across = Window.partitionBy(*self.keys).orderBy(SLICE)
        before = across.rowsBetween(Window.unboundedPreceding, -1)
        carried = {"_before": F.sum("_rows").over(before)}
        for name in sums:
            carried[f"_sum_{name}"] = F.sum(f"_total_{name}").over(before)
        if lags:
            carried["_prev"] = F.lag("_last").over(across)
        keep = [F.col(k).alias(f"_k_{k}") for k in self.keys]
        carry = (
            slices.withColumns(carried)
            .filter(F.col("_before").isNotNull())
            .select(*keep, F.col(SLICE).alias("_k_slice"), *carried)
        )
        cond = out[SLICE] == F.col("_k_slice")
        for k in self.keys:
            cond = cond & out[k].eqNullSafe(F.col(f"_k_{k}"))
        if self.slices <= BROADCAST_SLICES:
            carry = F.broadcast(carry)
        joined = out.join(carry, cond, "left")
        at = position or "_at"
        fixed: dict[str, Column] = {}
        for name in lags:
            fixed[name] = F.when(F.col(at) == 0, F.col(f"_prev.{name}")).otherwise(F.col(name))
        for name in sums:
            carried_sum = F.col(f"_sum_{name}")
            fixed[name] = F.when(carried_sum.isNull(), F.col(name)).otherwise(
                F.coalesce(F.col(name), F.lit(0)) + carried_sum
            )
        if position:
            fixed[position] = F.col(position) + F.coalesce(F.col("_before"), F.lit(0))
        drop = [f"_k_{k}" for k in self.keys] + ["_k_slice", SLICE, *carried]
        if not position:
            drop.append("_at")
        return joined.withColumns(fixed).drop(*drop)


def stride_kept(position: Column, n: Column, cap: int) -> Column:
    """Whether a row survives an evenly spaced subsample of ``cap`` of ``n`` rows.

    The kept indices are the truncated points of an evenly spaced float grid
    from 0 to n-1, so a position can be tested on its own, without a join.
    """
    if cap < 2:
        return position < cap
    step = (n.cast("double") - 1.0) / F.lit(float(cap - 1))
    near = F.ceil(position.cast("double") / step)
    hit = F.lit(False)
    for shift in (-1, 0, 1):
        i = near + shift
        inside = (i >= 0) & (i < cap - 1)
        hit = hit | (inside & (F.floor(i.cast("double") * step) == position))
    return (n <= cap) | hit | (position == n - 1)


def stride_subsample(df: DataFrame, keys: Sequence[str], order: Sequence[str], cap: int) -> DataFrame:
    """Evenly spaced rows of each ordered group, with ``position`` and ``n_points``."""
    placed = OrderedGroups(df, keys, order).scan(position="position")
    sizes = df.groupBy(*[F.col(k).alias(f"_n_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("n_points"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_n_{k}"))
    return placed.join(sizes, same).drop(*[f"_n_{k}" for k in keys]).filter(
        stride_kept(F.col("position"), F.col("n_points"), cap)
    )


def hash_subsample(df: DataFrame, keys: Sequence[str], row_id: str, cap: int, seed: int) -> DataFrame:
    """``cap`` rows of each group, drawn without replacement by hash order.

    The filter on row_number lets Spark cut each group to ``cap`` rows before
    the shuffle, so a large group never meets in one task. Spark does so only
    for short lists; longer ones are cut in salted parts of a group first.
    """
    token = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string")))
    if cap > GROUP_LIMIT_ROWS:
        part = F.pmod(F.xxhash64(row_id), F.lit(SALTS))
        in_part = Window.partitionBy(*keys, part).orderBy(token, row_id)
        df = df.withColumn("_draw", F.row_number().over(in_part)).filter(F.col("_draw") <= cap).drop("_draw")
    ranked = Window.partitionBy(*keys).orderBy(token, row_id)
    return (
        df.withColumn("draw", F.row_number().over(ranked))
        .filter(F.col("draw") <= cap)
    )
