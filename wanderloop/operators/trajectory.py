"""Trajectories: ordering, increments, kinematics, packing and step Grams.

A trajectory is a group of rows (keys) in a total order with one array column.
Wide points can be kept as column chunks; inner products add up over chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wanderloop.functions import vectors as V
from wanderloop.operators.ordered import OrderedGroups, stride_kept, stride_subsample
from wanderloop.operators.quantiles import join_on_keys


def steps_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], point: str) -> DataFrame:
    """Increment rows: keys, ``pos`` (1 for the first increment) and ``step``."""
    placed = OrderedGroups(
        df.select(*keys, *order, V.as_doubles(F.col(point)).alias("point")), keys, order
    ).scan(position="pos", lags={"before": "point"})
    return placed.filter("pos >= 1").select(
        *keys, "pos", V.difference(F.col("point"), F.col("before")).alias("step")
    )


def kinematics(df: DataFrame, keys: Sequence[str], order: Sequence[str], point: str) -> DataFrame:
    """Path length, net displacement and their ratio, per trajectory."""
    path = steps_of(df, keys, order, point).groupBy(*keys).agg(
        F.sum(V.norm(F.col("step"))).alias("path_length")
    )
    at = F.struct(*order)
    ends = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min_by(V.as_doubles(F.col(point)), at).alias("first_point"),
        F.max_by(V.as_doubles(F.col(point)), at).alias("last_point"),
    )
    net = V.distance(F.col("first_point"), F.col("last_point"))
    return (
        join_on_keys(ends.withColumn("net_displacement", net), path, keys, "left", null_safe=True)
        .withColumn("path_length", F.coalesce("path_length", F.lit(0.0)))
        .withColumn(
            "kinematic_R", F.col("path_length") / F.greatest("net_displacement", F.lit(1e-8))
        )
        .drop("first_point", "last_point")
    )


def kinematics_of_products(
    products: DataFrame, ends: DataFrame, keys: Sequence[str], dots: str = "dots"
) -> DataFrame:
    """``kinematics`` from products of increments and (keys, n_points, net_displacement); no point is read again."""
    path = products.groupBy(*keys).agg(F.sum(F.sqrt(F.get(dots, F.lit(0)))).alias("path_length"))
    return (
        join_on_keys(ends, path, list(keys), "left", null_safe=True)
        .withColumn("path_length", F.coalesce("path_length", F.lit(0.0)))
        .withColumn(
            "kinematic_R", F.col("path_length") / F.greatest("net_displacement", F.lit(1e-8))
        )
    )


def pack_points(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], point: str, cap: int
) -> DataFrame:
    """One row per trajectory with at most ``cap`` evenly spaced points."""
    kept = stride_subsample(
        df.select(*keys, *order, V.as_doubles(F.col(point)).alias("point")), keys, order, cap
    )
    return kept.groupBy(*keys).agg(
        F.first("n_points").alias("n_points"),
        F.transform(
            # At most ``cap`` entries, cut by the filter above.
            F.array_sort(F.collect_list(F.struct("position", "point"))),
            lambda p: p["point"],
        ).alias("points"),
    )


def to_chunks(df: DataFrame, point: str, chunk_cols: int) -> DataFrame:
    """Cut an array column into (chunk_id, vals) rows of ``chunk_cols`` entries."""
    last = F.floor((F.size(point) - 1) / chunk_cols).cast("int")
    rest = [c for c in df.columns if c != point]
    return df.select(*rest, point, F.explode(F.sequence(F.lit(0), last)).alias("chunk_id")).select(
        *rest, "chunk_id", F.slice(point, F.col("chunk_id") * chunk_cols + 1, chunk_cols).alias("vals")
    )


def key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(k, df.schema[k].dataType) for k in keys]


def gram_from_chunks(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Step Gram matrix of each trajectory from (keys, position, chunk_id, vals) rows.

    Each (trajectory, chunk) gives its share of the inner products in one task;
    shares are added by a vector sum that combines on the map side. Rows per
    task are the points of one trajectory, which the caller has bounded.
    """
    keys = list(keys)
    schema = T.StructType(
        key_fields(chunks, keys)
        + [
            T.StructField("chunk_id", T.IntegerType()),
            T.StructField("share", T.ArrayType(T.DoubleType(), False)),
        ]
    )

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        steps = np.diff(np.stack(pdf["vals"].to_numpy()).astype(float), axis=0)
        head = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame(
            head | {"chunk_id": [pdf["chunk_id"].iloc[0]], "share": [(steps @ steps.T).ravel()]}
        )

    shares = chunks.groupBy(*keys, "chunk_id").applyInPandas(share, schema)
    # A trajectory of one point has no increments and so no Gram matrix.
    return (
        shares.filter(F.size("share") > 0)
        .groupBy(*keys)
        .agg(Summarizer.sum(array_to_vector("share")).alias("gram"))
        .select(*keys, vector_to_array("gram").alias("gram"))
    )


def step_gram(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    point: str,
    cap: int,
    chunk_cols: int = 50_000,
) -> DataFrame:
    """(keys, gram) with the flattened inner products of consecutive increments."""
    kept = stride_subsample(
        df.select(*keys, *order, V.as_doubles(F.col(point)).alias("point")), keys, order, cap
    ).select(*keys, "position", "point")
    return gram_from_chunks(to_chunks(kept, "point", chunk_cols), keys)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def gram_of_moves(moves: pd.Series) -> pd.Series:
    """Inner products of the increments packed in one row."""
    def gram(rows) -> np.ndarray:
        steps = np.stack(rows).astype(float)
        return (steps @ steps.T).ravel()

    return moves.map(gram)


def segment_of(rank: Column, n_points: Column, cap: int) -> Column:
    """Which gap between kept checkpoints the step of 1-based ``rank`` falls in.

    Checkpoints are kept as in ``stride_kept``; a segment is numbered by the
    kept checkpoint that ends it.
    """
    spacing = (n_points.cast("double") - 1.0) / F.lit(float(cap - 1))
    near = F.ceil(rank.cast("double") / spacing)
    at = lambda i: F.when(i >= cap - 1, n_points - 1).otherwise(
        F.floor(i.cast("double") * spacing)
    )
    long = (
        F.when((near >= 1) & (at(near - 1) >= rank), near - 1)
        .when(at(near) >= rank, near)
        .otherwise(near + 1)
    )
    return F.when(n_points <= cap, rank).otherwise(F.least(long, F.lit(cap - 1))).cast("long")


__all__ = [
    "gram_from_chunks", "gram_of_moves", "key_fields", "kinematics", "pack_points", "segment_of",
    "step_gram", "steps_of", "stride_kept", "to_chunks",
]
