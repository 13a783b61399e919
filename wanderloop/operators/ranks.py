"""Rank correlations and their p-values."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wanderloop.config import group_rows
from wanderloop.operators.ordered import OrderedGroups, settled
from wanderloop.operators.trajectory import key_fields

# A grid of settings is a list the sweep's author wrote; pairs inside it are
# formed within one row and must stay few.
MAX_GRID = 1024
# Distinct pairs of a slice or bucket, which a Python task sorts bit by bit: some 100 MB.
SLICE_PAIRS = 1 << 19


def average_ranks(df: DataFrame, value: str, rank: str) -> DataFrame:
    """Distinct values of the whole table with their tie-averaged ranks."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_count"))
    upto = OrderedGroups(counts, [], [value]).scan(sums={"_upto": "_count"})
    return upto.select(
        F.col(value).alias(f"_v_{rank}"),
        (F.col("_upto") - (F.col("_count") - 1) / 2.0).alias(rank),
    )


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, rho) over the whole table.

    Pairs are counted first, so repeated values cross the shuffles once; ranks
    come from a slice-wise running count over the distinct values.
    """
    whole = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = whole.groupBy(x, y).agg(F.count(F.lit(1)).alias("_w"))
    rx, ry = average_ranks(whole, x, "_rx"), average_ranks(whole, y, "_ry")
    ranked = pairs.join(rx, F.col(x) == F.col("_v__rx")).join(ry, F.col(y) == F.col("_v__ry"))
    w, a, b = F.col("_w"), F.col("_rx"), F.col("_ry")
    sums = ranked.agg(
        F.sum(w).alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"),
        F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"), F.sum(w * a * b).alias("sab"),
    )
    n = F.col("n").cast("double")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    va = F.col("saa") - F.col("sa") * F.col("sa") / n
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / n
    return sums.select(F.col("n").cast("long").alias("n"), (cov / F.sqrt(va * vb)).alias("rho"))


def kendall_tau_b(x: Column, y: Column) -> Column:
    """Tau-b of two aligned arrays over one sweep grid."""
    sign = lambda a, b: F.signum(a - b)
    idx = F.sequence(F.lit(0), F.size(x) - 1)

    def pair_sum(term):
        return F.aggregate(
            idx, F.lit(0.0),
            lambda acc, i: acc + F.aggregate(
                idx, F.lit(0.0),
                lambda inner, j: inner + F.when(j > i, term(i, j)).otherwise(F.lit(0.0)),
            ),
        )

    sx = lambda i, j: sign(F.get(x, i), F.get(x, j)).cast("double")
    sy = lambda i, j: sign(F.get(y, i), F.get(y, j)).cast("double")
    score = pair_sum(lambda i, j: sx(i, j) * sy(i, j))
    left = pair_sum(lambda i, j: F.abs(sx(i, j)))
    right = pair_sum(lambda i, j: F.abs(sy(i, j)))
    tau = score / F.sqrt(left * right)
    return F.when(left * right > 0, tau)


def inversions(rank: np.ndarray, weight: np.ndarray) -> int:
    """Weighted number of pairs i < j with rank[i] > rank[j]; the ranks are 0, 1, ... in any order.

    Bit by bit from the top: among elements whose higher bits agree, every zero counts the ones
    before it; then zeros and ones part, in order.
    """
    total, n = 0, len(rank)
    wide = int(weight.sum()) ** 2 >= 1 << 62
    for bit in range(max(n - 1, 0).bit_length() - 1, -1, -1):
        order = np.argsort(rank >> (bit + 1), kind="stable")
        rank, weight = rank[order], weight[order]
        one = (rank >> bit) & 1 == 1
        ahead = np.cumsum(np.where(one, weight, 0))
        group = rank >> (bit + 1)
        first = np.concatenate([[True], group[1:] != group[:-1]])
        before = (ahead - np.where(one, weight, 0))[first]
        here = (ahead - np.repeat(before, np.diff(np.append(np.flatnonzero(first), n))))[~one]
        w = weight[~one]
        total += sum(int(a) * int(b) for a, b in zip(w, here)) if wide else int(w @ here)
    return total


def _count_inversions(rows: DataFrame, part: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(keys, value): inversions of the (_y, _x) order inside each part and key, where rows stand in ``order``."""
    keys = list(keys)
    schema = T.StructType([*key_fields(rows, keys), T.StructField("value", T.StringType())])
    n = len(keys)

    def run(batches):
        now, held = None, []

        def close() -> pa.RecordBatch:
            x, y, w = (np.concatenate([h[1 + k] for h in held]) for k in range(3))
            rank = np.empty(len(x), np.int64)
            rank[np.lexsort((x, y))] = np.arange(len(x))
            return pa.RecordBatch.from_arrays(
                [*held[0][0], pa.array([str(inversions(rank, w))])], names=schema.names
            )

        for batch in batches:
            lead = list(zip(*[batch.column(k).to_pylist() for k in range(n + 1)]))
            edges = [0, *(i for i in range(1, len(lead)) if lead[i] != lead[i - 1]), len(lead)]
            for low, high in zip(edges, edges[1:]):
                if high > low:
                    if held and lead[low] != now:
                        yield close()
                        held = []
                    now = lead[low]
                    # The numbers alone; of the keys one row.
                    part = batch.slice(low, high - low)
                    one = [] if held else [column.take(pa.array([low])) for column in batch.columns[:n]]
                    held.append((one, *(part.column(n + 1 + k).to_numpy(zero_copy_only=False).copy() for k in range(3))))
        if held:
            yield close()

    dealt = rows.repartition(part).sortWithinPartitions(part, *keys, *order)
    return dealt.select(*keys, part, "_x", "_y", "_w").mapInArrow(run, schema)


def _crossing(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, value): pairs of cells (_s, _b) of a key where the first stands before in _s and behind in _b."""
    keys = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, b = (np.unique(pdf[c].to_numpy(), return_inverse=True) for c in ("_s", "_b"))
        table = np.zeros((len(s[0]), len(b[0])), dtype=object if int(pdf["_w"].sum()) ** 2 >= 1 << 62 else np.int64)
        table[s[1], b[1]] = pdf["_w"].to_numpy()
        earlier = np.cumsum(table, axis=0) - table
        behind = np.cumsum(earlier[:, ::-1], axis=1)[:, ::-1] - earlier
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "value": [str(int((table * behind).sum()))]})

    schema = T.StructType([*key_fields(cells, keys), T.StructField("value", T.StringType())])
    return cells.groupBy(*keys).applyInPandas(run, schema)


def slice_count(pairs: int, rows: int) -> int:
    """Slices of at most half of ``rows`` and of what a Python task should hold."""
    return max(1, math.ceil(pairs / max(1, min(rows // 2, SLICE_PAIRS))))


def kendall(df: DataFrame, keys: Sequence[str], x: str, y: str, rows: int | None = None) -> DataFrame:
    """(keys, n, tau): tau-b of two columns per group, for groups of any size.

    Distinct pairs are cut into slices of the (x, y) order and, once more, into buckets of the
    (y, x) order. A pair of rows is discordant exactly if these orders disagree on it. Pairs in
    one slice are counted in its task, pairs in one bucket but different slices in the bucket's,
    all others from the table of weights by slice and bucket. Nothing moves more than twice,
    however many slices there are, and a value that very many rows share is cut like others.

    Rows where a value is NULL or NaN are left out; without two different values on each side tau
    is NULL. Values count as doubles.
    """
    keys = list(keys)
    fine = lambda c: F.col(c).cast("double").isNotNull() & ~F.isnan(F.col(c).cast("double"))
    # Negative zero counts as zero.
    value = lambda c, name: (F.col(c).cast("double") + F.lit(0.0)).alias(name)
    pairs = settled(
        df.filter(fine(x) & fine(y)).select(*keys, value(x, "_x"), value(y, "_y")).groupBy(*keys, "_x", "_y").agg(F.count(F.lit(1)).alias("_w"))
    )
    slices = slice_count(pairs.count(), rows or group_rows(df.sparkSession))
    cut = settled(pairs.repartitionByRange(slices, *keys, "_x", "_y").withColumn("_s", F.spark_partition_id()))
    cut = settled(cut.repartitionByRange(slices, *keys, "_y", "_x").withColumn("_b", F.spark_partition_id()))
    cells = cut.groupBy(*keys, "_s", "_b").agg(F.sum("_w").alias("_w"))
    found = _count_inversions(cut, "_s", keys, ["_x", "_y"]).unionByName(_count_inversions(cut, "_b", keys, ["_s", "_y", "_x"])).unionByName(_crossing(cells, keys))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    twos = (wide("_w") * (F.col("_w") - 1).cast("decimal(19,0)") / 2).cast("decimal(38,0)").alias("value")

    def tied(name: str, *by: str) -> DataFrame:
        return pairs.groupBy(*keys, *by).agg(F.sum("_w").alias("_w")).select(*keys, F.lit(name).alias("name"), twos)

    parts = found.select(*keys, F.lit("discordant").alias("name"), F.col("value").cast("decimal(38,0)").alias("value"))
    for name, by in (("all", ()), ("x", ("_x",)), ("y", ("_y",)), ("both", ("_x", "_y"))):
        parts = parts.unionByName(tied(name, *by))
    parts = parts.unionByName(pairs.select(*keys, F.lit("n").alias("name"), F.col("_w").cast("decimal(38,0)").alias("value")))
    names = ("n", "all", "x", "y", "both", "discordant")
    sums = parts.groupBy(*keys).agg(*[F.sum(F.when(F.col("name") == c, F.col("value"))).alias(f"_{c}") for c in names])
    score = F.col("_all") - F.col("_x") - F.col("_y") + F.col("_both") - 2 * F.col("_discordant")
    left, right = ((F.col("_all") - F.col(c)).cast("double") for c in ("_x", "_y"))
    return sums.select(*keys, F.col("_n").cast("long").alias("n"), F.when((left > 0) & (right > 0), score.cast("double") / F.sqrt(left) / F.sqrt(right)).alias("tau"))


def kendall_p(x: np.ndarray, y: np.ndarray) -> float:
    """Two-sided p-value of tau: exact for up to 33 untied points, else normal."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    if n < 2:
        return float("nan")
    i, j = np.triu_indices(n, 1)
    sx, sy = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
    score = float((sx * sy).sum())
    pairs = n * (n - 1) // 2
    if not (sx == 0).any() and not (sy == 0).any() and n <= 33:
        ways = np.ones(1)
        for size in range(2, n + 1):  # permutations by number of inversions
            ways = np.convolve(ways, np.ones(size))
        low = min(int(round((pairs - score) / 2)), int(round((pairs + score) / 2)))
        tail = 2.0 * ways[: low + 1].sum() / ways.sum()
        return float(min(1.0, tail))
    ties = lambda v: np.unique(v, return_counts=True)[1].astype(float)
    tx, ty = ties(x), ties(y)
    v0 = n * (n - 1) * (2 * n + 5)
    vx, vy = (tx * (tx - 1) * (2 * tx + 5)).sum(), (ty * (ty - 1) * (2 * ty + 5)).sum()
    px, py = (tx * (tx - 1)).sum(), (ty * (ty - 1)).sum()
    qx, qy = (tx * (tx - 1) * (tx - 2)).sum(), (ty * (ty - 1) * (ty - 2)).sum()
    var = (v0 - vx - vy) / 18.0 + px * py / (2.0 * n * (n - 1))
    if n > 2:
        var += qx * qy / (9.0 * n * (n - 1) * (n - 2))
    return math.erfc(abs(score) / math.sqrt(2.0 * var)) if var > 0 else float("nan")


def student_two_sided(t: float, dof: float) -> float:
    """P(|T| >= |t|) by the continued fraction of the incomplete beta function."""
    x = dof / (dof + t * t)
    a, b = dof / 2.0, 0.5
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1.0 - x
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny, frac, c = 1e-300, 1.0, 1.0
    d = 1.0 / (1.0 - (a + b) * x / (a + 1) or tiny)
    frac = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / (1.0 + num * d or tiny)
            c = 1.0 + num / c or tiny
            frac *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return 1.0 - front * frac if flip else front * frac


def spearman_p(rho: float, n: int) -> float:
    if n < 3:
        return float("nan")
    if abs(rho) >= 1.0:
        return 0.0
    return student_two_sided(rho * math.sqrt((n - 2) / (1.0 - rho * rho)), n - 2)


def kendall_p_column(x: str, y: str) -> Column:
    @F.pandas_udf("double")
    def p_value(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([kendall_p(u, v) for u, v in zip(a, b)], dtype="float64")

    return F.nanvl(p_value(x, y), F.lit(None).cast("double"))


def spearman_p_column(rho: str, n: str) -> Column:
    @F.pandas_udf("double")
    def p_value(r: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([spearman_p(u, int(v)) for u, v in zip(r, m)], dtype="float64")

    return F.nanvl(p_value(rho, n), F.lit(None).cast("double"))
