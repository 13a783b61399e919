"""NumPy array files as rows of column chunks.

``read_npy`` returns (file, t, chunk_id, vals): one row per checkpoint and column chunk.
Splits are ranges of ``split_bytes`` bytes of a file, found from its length alone. A task reads
the header itself and gives the chunks that begin in its range, so a long or wide file is read by many
tasks, none holds more than one batch of chunks, and the driver opens no file. Files in Fortran
order are cut by the same places and read column by column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanderloop.sources.files import dealt, listed, open_file, ranges
from wanderloop.sources.manifests import streamed_digests

SCHEMA = "file string, t int, chunk_id int, vals array<float>"
# Pattern of trajectory names and suffix of side files.
NAME_PATTERN = r"^(.+?)__(.+?)__seed(\d+)$"
SIDE_SUFFIX = "__metrics"
SPLIT_BYTES = 128 << 20
BATCH_BYTES = 8 << 20


@dataclass(frozen=True)
class Header:
    rows: int
    cols: int
    fortran: bool
    dtype: np.dtype
    offset: int


def header_of(file: pa.NativeFile, path: str) -> Header:
    """Shape, order and type of an open file; only 2-D arrays of numbers are taken."""
    version = np.lib.format.read_magic(file)
    reader = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
    if reader is None:
        raise ValueError(f"{path}: format version {version} is not read")
    shape, fortran, dtype = reader(file)
    if len(shape) != 2:
        raise ValueError(f"{path}: expected a 2-D array, found shape {shape}")
    if dtype.hasobject or dtype.kind not in "biuf":
        raise ValueError(f"{path}: expected numbers, found {dtype}")
    return Header(*shape, fortran, dtype, file.tell())


def block_of(
    file: pa.NativeFile, h: Header, first: int, last: int, start: int, stop: int, kind: type = np.float32
) -> np.ndarray:
    """Rows ``first`` to ``last``, columns ``start`` to ``stop``, as ``kind``."""
    def run(place: int, many: int) -> np.ndarray:
        return np.frombuffer(file.read_at(many * h.dtype.itemsize, h.offset + place * h.dtype.itemsize), h.dtype)

    if h.fortran:
        return np.stack([run(c * h.rows + first, last - first) for c in range(start, stop)], axis=1).astype(kind)
    if start == 0 and stop == h.cols:
        return run(first * h.cols, (last - first) * h.cols).reshape(last - first, h.cols).astype(kind)
    return np.stack([run(r * h.cols + start, stop - start) for r in range(first, last)]).astype(kind)


def chunks_from(h: Header, start: int, stop: int, width: int, least: int = 1) -> Iterator[tuple[int, int, int]]:
    """(chunk, first row, last row) of the chunks whose first byte lies in a range of the file.

    Places count in row order for files of both orders. At least ``least`` rows go together, where there are as many.
    """
    per_row = -(-h.cols // width)
    many = max(1, least, BATCH_BYTES // (min(width, h.cols) * 4))
    place = h.dtype.itemsize

    for chunk in range(per_row):
        # Row r's chunk begins at offset + (r * cols + chunk * width) * place; the first range also has the header.
        def rows_before(at: int, chunk: int = chunk) -> int:
            cells = -(-max(at - h.offset, 0) // place)
            return min(h.rows, max(0, -(-(cells - chunk * width) // h.cols)))

        low, high = rows_before(start), rows_before(stop)
        for first in range(low, high, many):
            yield chunk, first, min(first + many, high)


def npy_files(spark: SparkSession, pattern: str, skip_side: bool = True) -> DataFrame:
    files = listed(spark, pattern)
    return files.filter(~F.element_at(F.split("path", "/"), -1).contains(SIDE_SUFFIX)) if skip_side else files


def npy_headers(spark: SparkSession, pattern: str, skip_side: bool = True) -> DataFrame:
    """(path, n_rows, n_cols, dtype) of the matching files; headers are read in tasks."""
    def peek(batches):
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                with open_file(path) as file:
                    h = header_of(file, path)
                rows.append({"path": path, "n_rows": h.rows, "n_cols": h.cols, "dtype": h.dtype.name})
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    files = dealt(npy_files(spark, pattern, skip_side).select("path"), "path")
    return files.mapInArrow(peek, "path string, n_rows long, n_cols long, dtype string")


def read_npy(
    spark: SparkSession, pattern: str, chunk_cols: int = 50_000, skip_side: bool = True, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """(file, t, chunk_id, vals) of all matching files; an array without rows or columns gives no row."""
    def read(batches):
        for batch in batches:
            for path, start, stop in zip(*(batch.column(i).to_pylist() for i in range(3))):
                name = path.rsplit("/", 1)[-1]
                with open_file(path) as file:
                    h = header_of(file, path)
                    for chunk, first, last in chunks_from(h, start, stop, chunk_cols) if h.rows and h.cols else ():
                        left = chunk * chunk_cols
                        block = block_of(file, h, first, last, left, min(left + chunk_cols, h.cols))
                        n, width = block.shape
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([name] * n, pa.string()),
                                pa.array(np.arange(first, last, dtype=np.int32)),
                                pa.array(np.full(n, chunk, dtype=np.int32)),
                                pa.ListArray.from_arrays(
                                    pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(block.ravel())
                                ),
                            ],
                            names=["file", "t", "chunk_id", "vals"],
                        )

    splits = ranges(npy_files(spark, pattern, skip_side), split_bytes).select("path", "start", "stop")
    return dealt(splits, "path", "start").mapInArrow(read, SCHEMA)


def step_products(
    spark: SparkSession, pattern: str, max_lag: int, chunk_cols: int = 50_000, skip_side: bool = True,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """(file, pos, dots): inner products of increment ``pos`` (from 1) with those 0 to ``max_lag`` later.

    Partial products are formed where the file is read: a split also reads the ``max_lag + 1`` rows behind
    its own, so no point is shuffled, only ``max_lag + 1`` sums per increment and column chunk. Products with
    increments beyond the end are 0. A task holds about two times ``max_lag`` rows of a chunk.
    """
    def read(batches):
        for batch in batches:
            for path, start, stop in zip(*(batch.column(i).to_pylist() for i in range(3))):
                name = path.rsplit("/", 1)[-1]
                with open_file(path) as file:
                    h = header_of(file, path)
                    for chunk, low, high in chunks_from(h, start, stop, chunk_cols, max_lag) if h.rows and h.cols else ():
                        left = chunk * chunk_cols
                        last = min(high + max_lag + 1, h.rows)
                        points = block_of(file, h, low, last, left, min(left + chunk_cols, h.cols))
                        steps = np.diff(points.astype(np.float64), axis=0)
                        own = min(high, h.rows - 1) - low
                        if own <= 0:
                            continue
                        dots = np.zeros((own, max_lag + 1))
                        for lag in range(min(max_lag, len(steps) - 1) + 1):
                            many = min(own, len(steps) - lag)
                            dots[:many, lag] = np.einsum("ij,ij->i", steps[:many], steps[lag:lag + many])
                        offsets = np.arange(own + 1, dtype=np.int32) * (max_lag + 1)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([name] * own, pa.string()), pa.array(np.arange(low + 1, low + own + 1, dtype=np.int64)),
                                pa.ListArray.from_arrays(pa.array(offsets), pa.array(dots.ravel())),
                            ],
                            names=["file", "pos", "dots"],
                        )

    splits = ranges(npy_files(spark, pattern, skip_side), split_bytes).select("path", "start", "stop")
    parts = dealt(splits, "path", "start").mapInArrow(read, "file string, pos long, dots array<double>")
    total = vector_to_array(Summarizer.sum(array_to_vector("dots")))
    return parts.groupBy("file", "pos").agg(total.alias("dots"))


def net_displacements(
    spark: SparkSession, pattern: str, chunk_cols: int = 1 << 20, skip_side: bool = True
) -> DataFrame:
    """(file, n_points, net_displacement): distance of the last row from the first; no other row is read."""
    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_file(path) as file:
                    h = header_of(file, path)
                    square = 0.0
                    for left in range(0, h.cols if h.rows else 0, chunk_cols):
                        right = min(left + chunk_cols, h.cols)
                        ends = [block_of(file, h, r, r + 1, left, right).astype(np.float64) for r in (0, h.rows - 1)]
                        square += float(((ends[1] - ends[0]) ** 2).sum())
                yield pa.RecordBatch.from_pylist(
                    [{"file": path.rsplit("/", 1)[-1], "n_points": h.rows, "net_displacement": square**0.5}]
                )

    files = dealt(npy_files(spark, pattern, skip_side).select("path"), "path")
    return files.mapInArrow(read, "file string, n_points long, net_displacement double")


def run_facts(spark: SparkSession, pattern: str, prefixes: Sequence[int] = ()) -> DataFrame:
    """(file, epoch, n_points, d_full, train_loss, val_acc) of every trajectory, at its end and at given epochs.

    Loss and accuracy are the first two columns of the side file beside it, at the row of the epoch;
    NULL where there is no side file, column or row. Epochs beyond a trajectory's end give no row.
    """
    asked = sorted(set(prefixes))

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_file(path) as file:
                    h = header_of(file, path)
                epochs = [e for e in asked if 0 < e < h.rows] + [h.rows]
                known: dict[int, list[float]] = {}
                try:
                    with open_file(path.removesuffix(".npy") + f"{SIDE_SUFFIX}.npy") as side:
                        m = header_of(side, path)
                        for e in epochs:
                            at = m.rows if e == h.rows else e
                            if 0 < at <= m.rows:
                                known[e] = block_of(side, m, at - 1, at, 0, min(m.cols, 2), np.float64)[0].tolist()
                except FileNotFoundError:
                    pass
                for e in epochs:
                    loss, acc = (known.get(e, []) + [None, None])[:2]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([path.rsplit("/", 1)[-1]]), pa.array([e], pa.int64()), pa.array([h.rows], pa.int64()),
                            pa.array([h.cols], pa.int64()), pa.array([loss], pa.float64()), pa.array([acc], pa.float64()),
                        ],
                        names=["file", "epoch", "n_points", "d_full", "train_loss", "val_acc"],
                    )

    files = dealt(npy_files(spark, pattern).select("path"), "path")
    return files.mapInArrow(
        read, "file string, epoch long, n_points long, d_full long, train_loss double, val_acc double"
    )


def pool_manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, n_rows, n_cols, dtype, n_steps, size_bytes, sha256) of the files whose increments form a pool.

    Files of different widths cannot share a pool: an error names both widths.
    """
    heads = npy_headers(spark, pattern)
    least, most = heads.agg(F.min("n_cols"), F.max("n_cols")).first()
    if least != most:
        raise ValueError(f"increments of {least} and of {most} columns cannot share a pool")
    files = npy_files(spark, pattern)
    return (
        heads.join(streamed_digests(files), "path").join(files, "path")
        .select(
            "path", "n_rows", "n_cols", "dtype", F.greatest(F.col("n_rows") - 1, F.lit(0)).alias("n_steps"),
            F.col("length").alias("size_bytes"), "sha256",
        )
    )


def with_run_keys(df: DataFrame, file: str = "file") -> DataFrame:
    """Architecture, optimizer and seed captured from the file name."""
    stem = F.regexp_replace(F.col(file), r"\.npy$", "")
    return df.withColumns(
        {
            "arch": F.regexp_extract(stem, NAME_PATTERN, 1),
            "optimizer": F.regexp_extract(stem, NAME_PATTERN, 2),
            "seed": F.regexp_extract(stem, NAME_PATTERN, 3).try_cast("long"),
        }
    )


def run_order(arch_order: dict[str, int], opt_order: dict[str, int]) -> list:
    """Sort keys with a given precedence; unknown names come last."""
    def place(c: str, order: dict[str, int]):
        pairs = [x for k, v in order.items() for x in (F.lit(k), F.lit(v))]
        return F.coalesce(F.create_map(*pairs)[F.col(c)], F.lit(99))

    return [place("arch", arch_order), place("optimizer", opt_order), F.col("seed")]
