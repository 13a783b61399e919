"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows form a matrix A that never exists as a whole: rows lie in blocks of some
thousand vectors, and every pass over the blocks gives back one vector of the embeddings'
length. A step makes both alternating products in one pass: y = A z for the new right
vector, then A^T y. The long left vectors are not kept. Each is A times a short vector
known to the driver, so their inner products with a new one, which full reorthogonalisation
needs, are short products with the A^T A w kept from earlier steps; right vectors are
reorthogonalised as they are. The small bidiagonal matrix's SVD gives components and
deviations. Steps end when the wanted components have settled, at the latest after as many
as there are dimensions.

Entries become integers floor(scale * c) + shift, so sums and the squared deviations from
the mean are exact in integers.

Rows whose vector is null or holds null or non-finite entries (or entries so large that the
integer exceeds 2^40) are left out; all others count, repeated rows and rows with the same
or no id included. Shorter vectors are completed with entries of 0, empty ones too.
Directions without variance have ``whitened`` null and are left out of the check of
identity; without any variance ``explained`` is null. A deviation beyond the range of a long
is null. There are as many components as dimensions, ``components`` at most. An empty table
gives no rows. Further columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wanderloop.llm.shared import settle

LARGEST = float(1 << 40)


@dataclass(frozen=True)
class WhiteningParams:
    components: int = 32
    scale: int = 64
    shift: int = 1_000_000
    block: int = 2048  # vectors of one block
    settled: float = 1e-15  # residual of a component, as a share of the largest deviation
    seed: int = 5


@dataclass(frozen=True)
class Whitening:
    """Sizes, sums and components (rows of ``axes``) with their eigenvalues; total is the trace."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    total: float
    steps: int

    @property
    def mean(self) -> np.ndarray:
        """Whole and broken part of the mean apart, so that nothing is rounded before centring."""
        return np.array([[s // self.n, (s % self.n) / self.n] for s in self.sums]).reshape(-1, 2)


def usable(vec: Column, scale: int) -> Column:
    return vec.isNotNull() & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST / scale))


def blocks_of(vectors: DataFrame, dim: int, p: WhiteningParams) -> DataFrame:
    """ids and x (bytes of whole numbers, row by row) of up to ``block`` vectors a row."""
    kind = vectors.schema["id"].dataType

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, p.block):
                part = batch.slice(low, p.block)
                lists = part.column(1)
                flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy()
                full = np.zeros((len(sizes), dim))
                full[np.arange(dim) < sizes[:, None]] = flat
                x = np.floor(p.scale * full).astype("<i8") + p.shift
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0)], pa.list_(part.column(0).type)), pa.array([x.tobytes()], pa.binary())], names=["ids", "x"]
                )

    return vectors.mapInArrow(run, f"ids array<{kind.simpleString()}>, x binary")


def whole(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, "<i8").reshape(-1, dim)


def centred(blob: bytes, mean: np.ndarray) -> np.ndarray:
    return (whole(blob, len(mean)) - mean[:, 0].astype(np.int64)).astype(np.float64) - mean[:, 1]


def pooled(blocks: DataFrame, part) -> np.ndarray:
    """Sum of ``part(x)``, an array of doubles, over all blocks: in each task, then by entry."""
    def run(batches):
        total = None
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                found = part(blob)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["sums"])

    # Partial sums combine before they move; one row per entry comes back, however many tasks there were.
    rows = blocks.select("x").mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "value"))
    found = rows.groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    return found["value"].to_numpy()[np.argsort(found["at"].to_numpy())]


def exact_sums(blocks: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    """Number of vectors and exact sums per dimension."""
    def run(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                x = whole(blob, dim)
                yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([x.sum(axis=0).tolist()], pa.list_(pa.int64()))], names=["n", "sums"])

    rows = blocks.select("x").mapInArrow(run, "n long, sums array<long>")
    found = rows.select("n", F.posexplode_outer("sums").alias("at", "value")).groupBy("at").agg(
        F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value")
    ).toArrow().to_pylist()
    return found[0]["n"], tuple(int(r["value"]) for r in sorted(found, key=lambda r: r["at"])) if dim else ()


def bidiagonalise(product, dim: int, wanted: int, p: WhiteningParams):
    """Right vectors, small matrix and steps; ``product(z)`` gives |A z|^2 and A^T A z of one pass."""
    rng = np.random.default_rng(p.seed)
    right, short, images = [], [], []  # v; w with left vector A w; A^T A w
    small = np.zeros((dim, dim))
    beta, largest = 0.0, 0.0

    def fresh(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for u in right:
                v = v - (u @ v) * u
        return v

    v = rng.standard_normal(dim)
    v /= np.linalg.norm(v)
    for k in range(dim):
        right.append(v)
        z = v.copy()
        for _ in range(2):
            for w, image in zip(short, images):
                z = z - (image @ z) * w
        square, image = product(z)
        alpha = np.sqrt(max(square, 0.0))
        small[k, k] = alpha
        largest = max(largest, alpha, beta)
        gone = alpha <= 1e-14 * largest or alpha == 0
        if gone:
            small[k, k] = 0.0
            short.append(np.zeros(dim))
            images.append(np.zeros(dim))
        else:
            short.append(z / alpha)
            images.append(image / alpha)
        if k + 1 == dim:
            break
        rest = fresh(images[-1] - small[k, k] * v)
        beta = np.linalg.norm(rest)
        if beta <= 1e-14 * largest or beta == 0:
            # An invariant subspace: go on in a direction not met yet.
            beta, rest = 0.0, fresh(rng.standard_normal(dim))
        else:
            left, deviations, _ = np.linalg.svd(small[:k + 1, :k + 1])
            if k + 1 >= wanted and np.all(beta * np.abs(left[k, :wanted]) <= p.settled * deviations[0]):
                break
        small[k, k + 1] = beta
        v = fresh(rest / np.linalg.norm(rest))
        v /= np.linalg.norm(v)
    steps = len(right)
    return np.array(right), small[:steps, :steps], steps


def fit_whitening(blocks: DataFrame, dim: int, p: WhiteningParams = WhiteningParams()) -> Whitening | None:
    """Components of all vectors of the blocks; None without vectors."""
    n, sums = exact_sums(blocks, dim) if blocks.first() is not None else (0, ())
    if not n:
        return None
    start = Whitening(n, sums, np.zeros((0, dim)), np.zeros(0), 0.0, 0)
    mean, wanted = start.mean, min(p.components, dim)
    if not dim:
        return start

    def product(z: np.ndarray):
        def part(blob: bytes) -> np.ndarray:
            a = centred(blob, mean)
            y = a @ z
            return np.append(a.T @ y, y @ y)

        found = pooled(blocks, part)
        return found[-1], found[:-1]

    total = pooled(blocks, lambda blob: np.array([np.sum(centred(blob, mean) ** 2)]))[0] / n
    right, small, steps = bidiagonalise(product, dim, wanted, p)
    _, deviations, turns = np.linalg.svd(small)
    return Whitening(n, sums, turns[:wanted] @ right, deviations[:wanted] ** 2 / n, float(total), steps)


def scales(fit: Whitening) -> np.ndarray:
    """One over the deviations; not a number for directions without variance."""
    floor = 1e-24 * max(fit.total, 0.0)
    return np.array([1 / np.sqrt(e) if e > floor else np.nan for e in fit.values])


def identity_error(blocks: DataFrame, fit: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    mean, factor = fit.mean, scales(fit)
    axes = fit.axes[~np.isnan(factor)] * factor[~np.isnan(factor)][:, None]
    if not len(axes):
        return 0.0
    middle = pooled(blocks, lambda blob: (centred(blob, mean) @ axes.T).sum(axis=0)) / fit.n

    def part(blob: bytes) -> np.ndarray:
        w = centred(blob, mean) @ axes.T - middle
        return (w.T @ w).ravel()

    gram = pooled(blocks, part).reshape(len(axes), -1) / fit.n
    return float(np.abs(gram - np.eye(len(axes))).max())


def deviations_of(x: np.ndarray, fit: Whitening) -> pa.Array:
    """Exact sums of (n x - S)^2: integers that wrap give the right long wherever it fits."""
    sums = np.array([s % (1 << 64) for s in fit.sums], np.uint64)
    apart = x.astype(np.uint64) * np.uint64(fit.n % (1 << 64)) - sums
    about = (((x - fit.mean[:, 0].astype(np.int64)) - fit.mean[:, 1]) * fit.n) ** 2
    fits = about.sum(axis=1) < 2.0**63 * (1 - 1e-9)
    return pa.array((apart * apart).sum(axis=1, dtype=np.uint64).view(np.int64), mask=~fits)


def whitened(blocks: DataFrame, fit: Whitening) -> DataFrame:
    """id, component, n, deviation, whitened, explained and identity_error of every row and component."""
    error = identity_error(blocks, fit)
    mean, factor, k = fit.mean, scales(fit), len(fit.axes)
    explained = pa.array(fit.values / fit.total if fit.total > 0 else np.zeros(k), mask=np.full(k, not fit.total > 0))
    kind = blocks.schema["ids"].dataType.elementType

    def run(batches):
        for batch in batches:
            for ids, blob in zip(batch.column(0), batch.column(1).to_pylist()):
                rows = len(ids)
                values = (centred(blob, mean) @ fit.axes.T * factor).ravel()
                each = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays([
                    ids.values.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, fit.n, np.int64)),
                    deviations_of(whole(blob, len(mean)), fit).take(each), pa.array(values, mask=np.isnan(values)),
                    explained.take(pa.array(np.tile(np.arange(k), rows))), pa.array(np.full(rows * k, error)),
                ], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.select("ids", "x").mapInArrow(
        run, f"id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )


def vector_blocks(vectors: DataFrame, vec_id: str, embedding: str, p: WhiteningParams = WhiteningParams()) -> tuple[DataFrame, int]:
    """Blocks of the usable vectors and their length."""
    vec = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).alias("id"), vec.alias("vec")).filter(usable(F.col("vec"), p.scale))
    dim = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    return settle(blocks_of(rows, dim, p), "vector-blocks"), dim


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", p: WhiteningParams = WhiteningParams()) -> DataFrame:
    """Whitened coordinates of every usable vector, one row per component."""
    blocks, dim = vector_blocks(vectors, vec_id, embedding, p)
    fit = fit_whitening(blocks, dim, p)
    if fit is None:
        fit, blocks = Whitening(1, (0,) * dim, np.zeros((0, dim)), np.zeros(0), 0.0, 0), blocks.filter("false")
    return whitened(blocks, fit).withColumnRenamed("id", vec_id)
