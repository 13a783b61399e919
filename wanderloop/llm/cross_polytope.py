"""Approximate nearest neighbours by inner product with cross-polytope hashing.

The index is cut into bands by the norm's power of two. Vectors are scaled by the largest
norm of their band and get one more component that completes them to unit length (queries
get zero there), so that in a band the largest inner product is the smallest angle; one long
vector does not blur the directions of the others. Queries look into all bands. A table turns the unit vectors by three rounds of random signs and a fast Hadamard
transform, and the bucket of a vector is the signed axis nearest to it. A query looks into
its ``probes`` nearest signed axes of each of ``tables`` tables; what it meets is ranked by
the exact inner product in double precision.

Equal vectors are hashed once, with their k + 1 smallest ids: no more can enter an answer.
Buckets are split into chunks of at most about ``chunk`` vectors and queries on both sides,
so no task holds a bucket as a whole, and nothing is left out. A query that finds too few
neighbours looks through all buckets of one table.

Vectors that are null, empty, zero, or hold null or non-finite components take no part.
Repeated rows count once; ids that stand with several vectors answer and are found with
each, and are never their own neighbours. Vectors of different lengths do not meet. Extra
columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wanderloop.llm.shared import settle


@dataclass(frozen=True)
class AnnParams:
    k: int = 20
    tables: int = 12
    probes: int = 24
    chunk: int = 4000
    seed: int = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; the row length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def turned(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Rows, padded to a power of two, under the pseudo-rotation of one table."""
    d = 1 << max(x.shape[1] - 1, 1).bit_length()
    signs = np.random.default_rng([seed, table]).choice(np.array([-1.0, 1.0]), (3, d))
    out = np.zeros((len(x), d))
    out[:, :x.shape[1]] = x
    for s in signs:
        out = hadamard(out * s)
    return out


def axes_of(x: np.ndarray, table: int, seed: int, probes: int) -> np.ndarray:
    """The nearest signed axes of each row, nearest first; axis i up is 2 i, down 2 i + 1."""
    y = turned(x, table, seed)
    both = np.stack([y, -y], axis=2).reshape(len(y), -1)
    probes = min(probes, both.shape[1])
    near = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    order = np.argsort(-np.take_along_axis(both, near, axis=1), axis=1, kind="stable")
    return np.take_along_axis(near, order, axis=1)


def usable(vec: Column) -> Column:
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vec.isNotNull() & fine & F.exists(vec, lambda v: v != 0)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Vectors kept as bytes of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def keyed(vectors: DataFrame, p: AnnParams, probes: int) -> DataFrame:
    """Per vector and table (and probe): key, dim, table_no, bucket and the other columns.

    Vectors of the index come with ``band`` and ``top``, the largest norm of their band over
    two to the power of the band.
    """
    rest = [c for c in vectors.columns if c not in ("embedding", "top")]
    types = dict(vectors.dtypes)

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("embedding"))
            sizes = np.array([len(v) for v in column], np.int64)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = np.array([column[int(i)].as_py() for i in at], np.float64)
                blobs = [r.tobytes() for r in x]
                if probes == 1:
                    tops, bands = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)[at] for c in ("top", "band"))
                    scaled = np.ldexp(x, -bands[:, None]) / tops[:, None]
                    unit = np.column_stack([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1)))])
                else:
                    # The largest component first: squares of very small or large ones leave the range.
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    unit = np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))])
                part = batch.take(pa.array(at))
                for t in range(p.tables):
                    axes = axes_of(unit, t, p.seed, probes)
                    m = axes.shape[1]
                    rows = np.repeat(np.arange(len(at)), m)
                    again = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(part.schema.get_field_index(c)).take(again) for c in rest]
                        + [pa.array([blobs[i] for i in rows], pa.binary()), pa.array(np.full(len(rows), dim, np.int32)),
                           pa.array(np.full(len(rows), t, np.int32)), pa.array(axes.ravel().astype(np.int32))],
                        names=[*rest, "vec", "dim", "table_no", "bucket"],
                    )

    schema = ", ".join(f"{c} {types[c]}" for c in rest) + ", vec binary, dim int, table_no int, bucket int"
    return vectors.mapInArrow(run, schema)


PLACE = ["dim", "band", "table_no", "bucket"]


def ranked(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k best (id, score) of one chunk of the index for each query of one chunk."""
    names = ["query_key", "ids", "scores"]
    types = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.float64())]
    if not left.num_rows or not right.num_rows:
        return pa.Table.from_arrays([pa.array([], t) for t in types], names=names)
    dim = left["dim"][0].as_py()
    index, queries = matrix(left["vec"], dim), matrix(right["vec"], dim)
    ids = left["ids"].to_pylist()
    first = np.array([i[0] for i in ids])
    several = np.array([len(i) for i in ids]) > 1
    most = min(k, len(index))
    out_ids, out_scores = [], []
    for at in range(0, len(queries), 256):
        scores = queries[at:at + 256] @ index.T
        near = np.argpartition(-scores, most - 1, axis=1)[:, :most]
        found = np.take_along_axis(scores, near, axis=1)
        # Ties at the edge and equal vectors are settled by id, row by row.
        hard = ((scores >= found.min(axis=1)[:, None]).sum(axis=1) > most) | several[near].any(axis=1)
        easy_ids, easy_scores = first[near].tolist(), found.tolist()
        for j in np.flatnonzero(hard):
            row = scores[j]
            close = np.flatnonzero(row >= found[j].min())
            close = close[np.lexsort((first[close], -row[close]))][:k]
            pairs = sorted((-float(row[i]), x) for i in close for x in ids[i])[:k]
            easy_ids[j], easy_scores[j] = [x for _, x in pairs], [-s for s, _ in pairs]
        out_ids += easy_ids
        out_scores += easy_scores
    keys = right["query_key"].combine_chunks()
    return pa.Table.from_arrays([keys.cast(pa.string()), pa.array(out_ids, types[1]), pa.array(out_scores, types[2])], names=names)


def search(index: DataFrame, probes: DataFrame, p: AnnParams) -> DataFrame:
    """query_key, vec_id, score of what the probes meet, the k + 1 best of each query."""
    k = p.k + 1
    # One row per bucket: twice the padded length for each table and band of norms.
    sizes = index.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n_index"))
    asked = probes.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n_asked"))
    parts = F.broadcast(sizes.join(asked, PLACE).select(
        *PLACE, F.ceil(F.col("n_index") / p.chunk).cast("int").alias("parts"),
        F.ceil(F.col("n_asked") / p.chunk).cast("int").alias("turns"),
    ))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(parts, PLACE).withColumn("part", F.pmod(F.xxhash64("vec"), F.col("parts")).cast("int")).withColumn(
        "turn", every("turns")
    )
    right = probes.join(parts, PLACE).withColumn("turn", F.pmod(F.xxhash64("query_key"), F.col("turns")).cast("int")).withColumn(
        "part", every("parts")
    )
    cell = [*PLACE, "part", "turn"]
    met = (
        left.select(*cell, "ids", "vec").groupBy(*cell)
        .cogroup(right.select(*cell, "query_key", "vec").groupBy(*cell))
        .applyInArrow(lambda a, b: ranked(a, b, k), "query_key string, ids array<long>, scores array<double>")
    )
    pairs = met.select("query_key", F.explode(F.arrays_zip("ids", "scores")).alias("x")).groupBy(
        "query_key", F.col("x.ids").alias("vec_id")
    ).agg(F.max("x.scores").alias("score"))
    best = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).drop("place")


def nearest(vectors: DataFrame, asks: Column, vec_id: str = "vec_id", embedding: str = "embedding", p: AnnParams = AnnParams()) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of every row that ``asks`` picks."""
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"),
        F.coalesce(asks, F.lit(False)).alias("asks"),
    ).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).distinct()
    rows = settle(rows.withColumn("query_key", F.concat(F.hex(F.xxhash64("embedding")), F.hex(F.xxhash64(F.lit(p.seed), "embedding")))), "ann-rows")
    # Of equal vectors the k + 1 smallest ids; the limit applies before the rows move.
    first = Window.partitionBy("query_key").orderBy("vec_id")
    few = rows.drop("asks").withColumn("place", F.row_number().over(first)).filter(F.col("place") <= p.k + 1)
    same = few.groupBy("query_key").agg(
        F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("embedding")
    )
    # In logarithms, from components relative to the largest: no norm leaves the range of doubles.
    largest = F.array_max(F.transform("embedding", F.abs))
    relative = F.aggregate(F.transform("embedding", lambda v: v / F.col("largest")), F.lit(0.0), lambda s, v: s + v * v)
    same = same.withColumn("largest", largest).withColumn("power", F.log2("largest") + F.log2(relative) / 2)
    same = settle(same.withColumn("dim", F.size("embedding")).withColumn("band", F.floor("power").cast("int")).drop("largest"), "ann-same")
    # One row per length and power of two among the norms.
    bands = F.broadcast(settle(same.groupBy("dim", "band").agg(F.max(F.pow(F.lit(2.0), F.col("power") - F.col("band"))).alias("top")), "ann-bands"))
    index = settle(keyed(same.join(bands, ["dim", "band"]).select("ids", "band", "embedding", "top"), p, 1), "ann-index")
    asking = rows.filter("asks").select("vec_id", "query_key", "embedding")
    queries = settle(keyed(asking.select("query_key", "embedding").dropDuplicates(["query_key"]), p, p.probes), "ann-probes")
    in_all_bands = lambda asked: asked.join(bands.select("dim", "band"), "dim")
    found = settle(search(index, in_all_bands(queries), p), "ann-found")
    # Too few neighbours: look through one table as a whole.
    n_rows = rows.count()
    held = found.groupBy("query_key").agg(F.count(F.lit(1)).alias("n"))
    alone = queries.filter("table_no = 0").dropDuplicates(["query_key"]).join(held, "query_key", "left").filter(
        F.coalesce("n", F.lit(0)) < min(p.k + 1, n_rows)
    )
    everywhere = alone.select(
        "query_key", "vec", "dim", "table_no", F.explode(F.sequence(F.lit(0), _axes(F.col("dim")) - 1)).alias("bucket")
    )
    found = found.unionByName(search(index.filter("table_no = 0"), in_all_bands(everywhere), p)).dropDuplicates(["query_key", "vec_id"])
    mine = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return (
        asking.select(F.col("vec_id").alias("query_id"), "query_key").join(found, "query_key")
        .filter("query_id <> vec_id").withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= p.k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _axes(dim: Column) -> Column:
    """Signed axes of vectors of a length: twice the power of two that holds one component more."""
    return F.pow(F.lit(2), F.greatest(F.ceil(F.log2(dim + 1)), F.lit(1)) + 1).cast("int")
