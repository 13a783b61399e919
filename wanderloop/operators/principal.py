"""Principal components of trajectories, from the step Gram matrix or, for long ones, from small factors.

A trajectory with more checkpoints than a Gram matrix may have rows is factored where it lies:
each task reduces its checkpoints, with a one before each, to an upper triangle by QR, and
triangles of one trajectory are stacked and reduced again until one is left. Behind its first
row stands the triangle of the mean-free checkpoints, whose singular values are the exact
spectrum; the checkpoints never move.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wanderloop.config import bound_arrow_batches
from wanderloop.functions.vectors import as_doubles
from wanderloop.operators.locality import over_grams
from wanderloop.operators.ordered import settled
from wanderloop.operators.trajectory import key_fields

# Width up to which the triangle of a long trajectory is kept, triangles that meet in one
# reduction, and numbers that a task holds before it hands its triangles on.
TALL_WIDTH, FAN, HELD = 2048, 64, 1 << 24


def centred_gram(step_gram: np.ndarray) -> np.ndarray:
    """Inner products of the mean-free checkpoints behind a step Gram matrix."""
    n = len(step_gram) + 1
    b = np.zeros((n, n))
    b[1:, 1:] = step_gram.cumsum(axis=0).cumsum(axis=1)
    b -= b.mean(axis=0)[None, :]
    b -= b.mean(axis=1)[:, None]
    return (b + b.T) / 2.0


def spectrum(step_gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (descending, non-negative) and eigenvectors."""
    values, vectors = np.linalg.eigh(centred_gram(step_gram))
    return np.clip(values[::-1], 0.0, None), vectors[:, ::-1]


def components_for(values: np.ndarray, share: float, most: int) -> int:
    total = values.sum()
    if total <= 0:
        return 1
    return min(int(np.searchsorted(values.cumsum() / total, share)) + 1, most)


PROFILE = [
    T.StructField("max_d", T.IntegerType()), T.StructField("d_95", T.IntegerType()),
    T.StructField("d_99", T.IntegerType()), T.StructField("cum", T.ArrayType(T.DoubleType())),
]


def profile_row(values: np.ndarray, most: int) -> tuple:
    """Components kept, those for 95 and 99 percent, running shares."""
    kept = values[:most]
    total = kept.sum()
    cum = (kept.cumsum() / total).tolist() if total > 0 else []
    return most, components_for(kept, 0.95, most), components_for(kept, 0.99, most), cum


def pca_profile(grams: DataFrame, keys: Sequence[str], groups: int, dims: int | None = None) -> DataFrame:
    """Components for 95 and 99 percent of the variance, and the running shares."""
    def profile(g: np.ndarray) -> list[tuple]:
        values, _ = spectrum(g)
        return [profile_row(values, min(len(g), dims or len(g)))]

    return over_grams(grams, keys, groups, PROFILE, profile)


def triangles(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, at, width, r): rows (keys, at, width, r) of stacked matrices, reduced to one triangle per task and key."""
    keys = [*keys, "at"]
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("width", T.IntegerType()), T.StructField("r", T.ArrayType(T.DoubleType(), False))])
    kinds = pa_types(rows, keys)

    def run(batches):
        held: dict[tuple, list[np.ndarray]] = {}
        size = 0

        def hand_on():
            for key, parts in held.items():
                r = reduced(parts)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([v], k) for v, k in zip(key, kinds)), pa.array([r.shape[1]], pa.int32()), pa.array([r.ravel()], pa.list_(pa.float64()))],
                    names=schema.names,
                )
            held.clear()

        for batch in batches:
            lead = list(zip(*[batch.column(k).to_pylist() for k in range(len(keys))]))
            widths, matrices = batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1)
            touched = set()
            for i, key in enumerate(lead):
                part = matrices[i].values.to_numpy(zero_copy_only=False).reshape(-1, widths[i]).copy()
                held.setdefault(key, []).append(part)
                size += part.size
                touched.add(key)
            for key in touched:
                if sum(map(len, held[key])) > 2 * held[key][0].shape[1]:
                    before = sum(p.size for p in held[key])
                    held[key] = [reduced(held[key])]
                    size += held[key][0].size - before
            if size > HELD:
                yield from hand_on()
                size = 0
        yield from hand_on()

    return rows.select(*keys, "width", "r").mapInArrow(run, schema)


def pa_types(rows: DataFrame, keys: Sequence[str]) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(rows.schema[k].dataType) for k in keys]


def reduced(parts: list[np.ndarray]) -> np.ndarray:
    """Upper triangle with the same inner products of columns as the stacked parts."""
    return np.linalg.qr(np.concatenate(parts), mode="r")


def tall_profile(df: DataFrame, keys: Sequence[str], point: str, dims: int | None = None) -> DataFrame:
    """As ``pca_profile``, for trajectories of any length and up to ``TALL_WIDTH`` wide; wider ones get NULLs."""
    bound_arrow_batches(df.sparkSession)
    keys = list(keys)
    points = df.select(*keys, as_doubles(F.col(point)).alias("_p"))
    sizes = settled(points.groupBy(*keys).agg(F.max(F.size("_p")).alias("_width")))
    fits = points.filter(F.size("_p") <= TALL_WIDTH)
    start = fits.select(*keys, F.spark_partition_id().cast("long").alias("at"), (F.size("_p") + 1).alias("width"), F.concat(F.array(F.lit(1.0)), "_p").alias("r"))
    rows = settled(triangles(start, keys))
    while (rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > 1:
        nearer = rows.withColumn("at", F.floor(F.col("at") / FAN))
        rows = settled(triangles(nearer.repartition(*keys, "at"), keys))
    schema = T.StructType(key_fields(df, keys) + PROFILE)

    def profile(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                r = batch.column(len(keys) + 1)[i].values.to_numpy(zero_copy_only=False).reshape(-1, batch.column(len(keys))[i].as_py())
                n = round(float(r[0, 0]) ** 2)
                values = np.linalg.svd(r[1:, 1:], compute_uv=False) ** 2
                most = min(n - 1, dims or n - 1)
                out.append((*(batch.column(k)[i].as_py() for k in range(len(keys))), *profile_row(np.pad(values, (0, max(0, most - len(values)))), most)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(zip(*out), kinds)], names=schema.names
                )

    kinds = [*pa_types(df, keys), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
    found = rows.select(*keys, "width", "r").mapInArrow(profile, schema)
    return found.unionByName(sizes.filter(F.col("_width") > TALL_WIDTH).select(*keys), allowMissingColumns=True)


def pca_trajectories(
    grams: DataFrame, keys: Sequence[str], groups: int,
    dims: Sequence[int | str] = (3, 10, 50, "d95", "d99"), prefixes: Sequence[int] = (100, 150, 200),
) -> DataFrame:
    """(keys, pca_d, prefix_ep, pca_var, t, point) for each prefix and dimension.

    The components are fitted on the prefix itself; a named dimension is the
    number of components that reaches that share on the whole trajectory.
    """
    fields = [
        T.StructField("pca_d", T.IntegerType()), T.StructField("prefix_ep", T.IntegerType()),
        T.StructField("pca_var", T.DoubleType()), T.StructField("t", T.IntegerType()),
        T.StructField("point", T.ArrayType(T.DoubleType())),
    ]

    def project(g: np.ndarray) -> list[tuple]:
        n = len(g) + 1
        whole, _ = spectrum(g)
        most = len(g)
        named = {"d95": components_for(whole, 0.95, most), "d99": components_for(whole, 0.99, most)}
        wanted = sorted({named.get(d, d) for d in dims})
        rows = []
        for prefix in sorted({min(p, n) for p in prefixes}):
            values, vectors = spectrum(g[: prefix - 1, : prefix - 1])
            total = values.sum()
            for d in wanted:
                if not 0 < d < prefix or total <= 0:
                    continue
                coords = vectors[:, :d] * np.sqrt(values[:d])
                share = float(values[:d].sum() / total)
                rows += [(d, prefix, share, t, c) for t, c in enumerate(coords.tolist())]
        return rows

    return over_grams(grams, keys, groups, fields, project)
