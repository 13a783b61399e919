"""Permutation audits of trajectories by their longest H1 bar.

Trajectories of up to ``max_points`` checkpoints are reduced to their step Gram
matrix once; every null is then a reordering of that matrix. The (trajectory x
setting x null batch) rows are spread evenly over tasks and each task returns
plain lifetime rows, from which Spark builds the permutation records.

Bars need a whole distance matrix. A longer trajectory gets a row per setting
with the status ``too_long`` and no numbers. With ``whole_long`` its points go to
the tasks instead, which permute the steps in the same way; their matrices lie in
files of the task. With ``thin_long`` it is
permuted row by row in Spark at full length and summed to the increments
between ``max_points`` evenly spaced checkpoints: another, coarser test that
has to be asked for. Trajectories without increments get ``too_short``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wanderloop.config import AuditConfig, bound_arrow_batches, group_rows
from wanderloop.functions import topology
from wanderloop.functions import vectors as V
from wanderloop.functions.record import with_record
from wanderloop.operators.ordered import OrderedGroups, fanned, group_sizes
from wanderloop.operators.quantiles import join_on_keys
from wanderloop.operators.trajectory import key_fields, pack_points, segment_of, step_gram
from wanderloop.operators.walk_nulls import TOKEN_SPAN, hash_number

LIFETIME_FIELDS = [
    T.StructField("block_size", T.IntegerType()),
    T.StructField("k0", T.IntegerType()),
    T.StructField("pct", T.DoubleType()),
    T.StructField("null_id", T.IntegerType()),
    T.StructField("L_euc", T.DoubleType()),
    T.StructField("L_geo", T.DoubleType()),
    T.StructField("k_used", T.IntegerType()),
    T.StructField("n_points", T.IntegerType()),
]
SETTING = ("block_size", "k0", "pct")


@dataclass(frozen=True)
class Setting:
    """One cell of a sweep: block size, starting k, filtration cut, seed, nulls.

    ``n_nulls=None`` takes the number of the run; diagnostics may use fewer.
    """

    block_size: int = 1
    k0: int = 12
    pct: float | None = None
    master: int = 0
    n_nulls: int | None = None


def settings_of(cfg: AuditConfig) -> list[Setting]:
    return [Setting(b, cfg.k0, cfg.filtration_pct, cfg.seed + 100) for b in cfg.block_sizes]


def sensitivity_settings(
    cfg: AuditConfig,
    k_values: Sequence[int] = (8, 10, 12, 16),
    percentiles: Sequence[float] = (90.0, 95.0, 99.0),
) -> list[Setting]:
    """The k x percentile grid; every cell has its own seed."""
    return [
        Setting(1, int(k), float(p), cfg.seed + 9000 + 100 * int(k) + int(p) + 100)
        for k in k_values
        for p in percentiles
    ]


def targeted_settings(cfg: AuditConfig, diagnostic_nulls: int = 50) -> list[Setting]:
    """Full ensembles for the formal block size 1, smaller ones for diagnostics."""
    return [
        Setting(b, cfg.k0, cfg.filtration_pct, cfg.seed, cfg.n_nulls if b == 1 else diagnostic_nulls)
        for b in cfg.block_sizes
    ]


def item_count(settings: Sequence[Setting], cfg: AuditConfig, groups: int) -> int:
    """Null batches of all cells."""
    per_group = (math.ceil(((s.n_nulls or cfg.n_nulls) + 1) / cfg.nulls_per_task) for s in settings)
    return groups * sum(per_group)


def null_count(settings: Sequence[Setting], cfg: AuditConfig) -> int:
    return sum((s.n_nulls or cfg.n_nulls) + 1 for s in settings)


def with_settings(df: DataFrame, settings: Sequence[Setting], cfg: AuditConfig) -> DataFrame:
    rows = F.array(
        *[
            F.struct(
                F.lit(int(s.block_size)).alias("block_size"),
                F.lit(int(s.k0)).alias("k0"),
                F.lit(s.pct).cast("double").alias("pct"),
                F.lit(int(s.master)).cast("long").alias("master"),
                F.lit(int(s.n_nulls or cfg.n_nulls)).alias("n_nulls"),
            )
            for s in settings
        ]
    )
    return df.withColumn("_s", F.explode(rows)).select("*", "_s.*").drop("_s")


def spread(df: DataFrame, items: int, by: Sequence[str]) -> DataFrame:
    """Deal compute-heavy rows to tasks, whatever their byte size.

    Rows are placed by their keys, never round-robin: a recomputed float sum
    may differ in its last bit, and a row must land where it was before. Few
    rows get several times as many partitions, so that few of them meet.
    """
    width = df.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(4 * items, max(64 * width, math.ceil(items / 32))))
    return df.repartition(parts, *by)


def key_seed(keys: Sequence[str]) -> Column:
    """A number of the trajectory's key, so that trajectories have nulls of their own."""
    return F.xxhash64(*keys).bitwiseAND(F.lit((1 << 62) - 1))


def audit_rng_key(row: dict, null_id: int) -> list[int]:
    """Seed of one permutation; it names the null (and the trajectory), never the task it runs in."""
    own = [row["key_seed"]] if "key_seed" in row else []
    return [row["master"], *own, null_id, row["block_size"]]


def with_key_seed(df: DataFrame, keys: Sequence[str], cfg: AuditConfig) -> DataFrame:
    return df.withColumn("key_seed", key_seed(keys)) if cfg.seed_by_key else df


def require_decisive(cfg: AuditConfig, n_nulls: int | None = None) -> AuditConfig:
    """Refuse ensembles whose smallest p-value cannot fall below alpha."""
    n = cfg.n_nulls if n_nulls is None else n_nulls
    if 1.0 / (n + 1) >= cfg.thresholds.alpha:
        raise ValueError(f"{n} nulls cannot reach p < {cfg.thresholds.alpha}")
    return cfg


def offset_rng_key(row: dict, null_id: int) -> int:
    """Seeds counted up from the master seed, for runs recorded that way."""
    return row["master"] + null_id


def null_lifetimes(
    grams: DataFrame,
    keys: Sequence[str],
    settings: Sequence[Setting],
    cfg: AuditConfig,
    groups: int,
    rng_key: Callable[[dict, int], list[int] | int] = audit_rng_key,
) -> DataFrame:
    """Lifetimes of the observed order (null_id = -1) and of each permutation."""
    keys = list(keys)
    per_task, kmax, fill = cfg.nulls_per_task, cfg.kmax, cfg.sentinel_fill
    batches = F.sequence(F.lit(-1), F.col("n_nulls") - 1, F.lit(per_task))
    cells = with_settings(with_key_seed(grams, keys, cfg), settings, cfg).withColumn(
        "first_null", F.explode(batches)
    )
    items = item_count(settings, cfg, groups)
    schema = T.StructType(key_fields(grams, keys) + LIFETIME_FIELDS)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                flat = np.asarray(row["gram"], dtype=float)
                n = math.isqrt(flat.size)
                gram = flat.reshape(n, n)
                pct = None if row["pct"] is None or math.isnan(row["pct"]) else row["pct"]
                first = row["first_null"]
                for null_id in range(first, min(first + per_task, row["n_nulls"])):
                    order = None
                    if null_id >= 0:
                        rng = np.random.default_rng(rng_key(row, null_id))
                        order = topology.block_order(n, row["block_size"], rng)
                    d = topology.distances_from_gram(gram, order)
                    euc, geo, k = topology.lifetime_pair(d, row["k0"], kmax, pct, fill)
                    head = [row[c] for c in keys]
                    out.append([*head, row["block_size"], row["k0"], pct, null_id, euc, geo, k, n + 1])
            yield lifetime_frame(out, schema)

    return spread(cells, items, [*keys, *SETTING, "first_null"]).mapInPandas(walk, schema)


def lifetime_frame(rows: list, schema: T.StructType) -> pd.DataFrame:
    """Rows as a frame whose missing numbers become NULL, never NaN."""
    frame = pd.DataFrame(rows, columns=schema.names)
    for c in {"pct", "L_geo"} & set(frame.columns):
        frame[c] = frame[c].astype(object).where(frame[c].notna(), None)
    return frame


def long_null_points(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], point: str,
    settings: Sequence[Setting], cfg: AuditConfig,
) -> DataFrame:
    """Kept checkpoints of full-length permutations, packed per (cell, null).

    The permutation is a hash order of block numbers. Ranks come from hash
    ranges of bounded size; steps are summed per segment between kept
    checkpoints, with map-side combining.
    """
    keys, cap = list(keys), cfg.max_points
    rows = group_rows(df.sparkSession)
    placed = OrderedGroups(
        df.select(*keys, *order, V.as_doubles(F.col(point)).alias("point")), keys, order
    ).scan(position="pos", lags={"before": "point"})
    sizes = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min_by(V.as_doubles(F.col(point)), F.struct(*order)).alias("start"),
    )
    steps = placed.filter("pos >= 1").join(sizes, keys)
    steps = steps.select(
        *keys, "pos", "n_points", V.difference(F.col("point"), F.col("before")).alias("step")
    )
    block = F.floor((F.col("pos") - 1) / F.col("block_size"))
    names = ("master", "null_id", "block_size", *keys)
    token = hash_number(
        F.concat_ws("|", *[F.col(c).cast("string") for c in names], block.cast("string"))
    )
    cell = [*keys, *SETTING, "null_id"]
    grid = with_settings(fanned(steps, *keys, "pos"), settings, cfg).withColumn(
        "null_id", F.explode(F.sequence(F.lit(-1), F.col("n_nulls") - 1))
    )
    observed = F.col("null_id") == -1
    grid = grid.withColumn("token", F.when(observed, F.lit(0)).otherwise(token))
    share = F.col("token") / TOKEN_SPAN
    cuts = F.ceil((F.col("n_points") - 1) / rows)
    grid = grid.withColumn(
        "cut",
        F.when(observed, F.floor((F.col("pos") - 1) / rows)).otherwise(F.floor(share * cuts)),
    )
    earlier = Window.partitionBy(*cell).orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = grid.groupBy(*cell, "cut").agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "offset", F.coalesce(F.sum("rows").over(earlier), F.lit(0))
    )
    inside = Window.partitionBy(*cell, "cut").orderBy("token", "pos")
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*cell, "cut"]]
    ranked = (
        grid.withColumn("local", F.row_number().over(inside)).alias("g")
        .join(offsets.alias("o"), same)
        .select("g.*", (F.col("o.offset") + F.col("g.local")).alias("rank"))
    )
    moved = (
        ranked.withColumn("segment", segment_of(F.col("rank"), F.col("n_points"), cap))
        .groupBy(*cell, "segment")
        .agg(Summarizer.sum(array_to_vector("step")).alias("move"))
        .select(*cell, "segment", vector_to_array("move").alias("move"))
    )
    packed = moved.groupBy(*cell).agg(
        # At most ``max_points`` segments.
        F.transform(
            F.array_sort(F.collect_list(F.struct("segment", "move"))), lambda p: p["move"]
        ).alias("moves")
    )
    return packed


def lifetimes_of_moves(packed: DataFrame, keys: Sequence[str], cfg: AuditConfig, items: int) -> DataFrame:
    keys = list(keys)
    kmax, fill = cfg.kmax, cfg.sentinel_fill
    schema = T.StructType(key_fields(packed, keys) + LIFETIME_FIELDS)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                moves = np.stack(row["moves"]).astype(float)
                path = np.vstack([np.zeros(moves.shape[1]), moves.cumsum(axis=0)])
                pct = None if row["pct"] is None or math.isnan(row["pct"]) else row["pct"]
                d = topology.point_distances(path)
                euc, geo, k = topology.lifetime_pair(d, row["k0"], kmax, pct, fill)
                out.append(
                    [*[row[c] for c in keys], row["block_size"], row["k0"], pct,
                     row["null_id"], euc, geo, k, len(path)]
                )
            yield lifetime_frame(out, schema)

    return spread(packed, items, [*keys, *SETTING, "null_id"]).mapInPandas(measure, schema)


def audit_lifetimes(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], point: str,
    cfg: AuditConfig, settings: Sequence[Setting] | None = None,
) -> DataFrame:
    """Observed and null lifetimes of every trajectory under every setting."""
    keys = list(keys)
    settings = list(settings or settings_of(cfg))
    short, groups, long, n_long = split_by_length(df, keys, cfg.max_points)
    grams = step_gram(short, keys, order, point, cfg.max_points, cfg.chunk_cols)
    lifetimes = null_lifetimes(grams, keys, settings, cfg, groups)
    if long is not None and cfg.whole_long:
        return lifetimes.unionByName(whole_lifetimes(whole_paths(long, keys, order, point), keys, settings, cfg, n_long))
    if long is None or not cfg.thin_long:
        return lifetimes
    moved = long_null_points(long, keys, order, point, settings, cfg)
    items = n_long * null_count(settings, cfg)
    return lifetimes.unionByName(lifetimes_of_moves(moved, keys, cfg, items))


def audit_records(lifetimes: DataFrame, cell: Sequence[str], cfg: AuditConfig) -> DataFrame:
    """Euclidean and geodesic permutation records with the graph-growth columns.

    A cell with a graph that stayed disconnected keeps its Euclidean record;
    its geodesic fields are NULL and ``geo_status`` says so.
    """
    observed = F.col("null_id") == -1
    whole = F.count("L_geo") == F.count(F.lit(1))
    pick = lambda c: F.max(F.when(observed, F.col(c)))
    rest = lambda c: F.collect_list(F.when(~observed, F.col(c)))
    gathered = lifetimes.groupBy(*cell).agg(
        F.max("n_points").alias("N_pts"),
        F.sum((~observed).cast("int")).alias("n_nulls_used"),
        F.when(whole, pick("L_geo")).alias("_geo"), F.when(whole, rest("L_geo")).alias("_geo_nulls"),
        F.when(whole, F.lit("ok")).otherwise(F.lit("disconnected")).alias("geo_status"),
        pick("L_euc").alias("_euc"), rest("L_euc").alias("_euc_nulls"),
        pick("k_used").alias("geo_k_used_obs"), rest("k_used").alias("_k"),
    )
    ceiling = 0.9 * F.greatest(F.col("N_pts") - 1, F.lit(1))
    k = F.array_sort("_k")
    half = F.floor((F.size(k) - 1) / 2).cast("int")
    mid = (F.get(k, half) + F.get(k, F.floor(F.size(k) / 2).cast("int"))) / 2.0
    gathered = gathered.withColumns(
        {
            "geo_null_k_min": F.array_min("_k").cast("double"),
            "geo_null_k_median": mid,
            "geo_null_k_max": F.array_max("_k").cast("double"),
            "geo_null_k_near_complete_frac": F.size(F.filter("_k", lambda x: x >= ceiling))
            / F.size("_k").cast("double"),
        }
    ).drop("_k")
    out = with_record(gathered, "_geo", "_geo_nulls", "geo_", cfg.thresholds)
    return with_record(out, "_euc", "_euc_nulls", "euc_", cfg.thresholds)


def ambient_audit(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], point: str,
    cfg: AuditConfig, settings: Sequence[Setting] | None = None,
) -> DataFrame:
    """Full-space audit: one row per trajectory and setting."""
    settings = list(settings or settings_of(cfg))
    lifetimes = audit_lifetimes(df, keys, order, point, cfg, settings)
    records = audit_records(lifetimes, [*keys, *SETTING], cfg)
    most = None if cfg.thin_long or cfg.whole_long else cfg.max_points
    missing = with_settings(unaudited(df, keys, most), settings, cfg).select(*keys, *SETTING, "N_pts", "geo_status")
    return records.unionByName(missing, allowMissingColumns=True)


def unaudited(df: DataFrame, keys: Sequence[str], most: int | None) -> DataFrame:
    """keys, N_pts and geo_status of the trajectories that have no record."""
    n = F.col("N_pts")
    status = F.when(n < 2, F.lit("too_short"))
    if most is not None:
        status = status.when(n > most, F.lit("too_long"))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("N_pts"))
    return sizes.withColumn("geo_status", status).filter(F.col("geo_status").isNotNull())


def split_by_length(
    df: DataFrame, keys: Sequence[str], cap: int
) -> tuple[DataFrame, int, DataFrame | None, int]:
    """Trajectories that fit one task and their number; longer ones, if any, and theirs."""
    keys = list(keys)
    known = group_sizes(df, keys)
    if known.largest <= cap:
        return df, known.groups, None, 0
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    is_long = F.col("_n") > cap
    short = join_on_keys(df, sizes.filter(~is_long).drop("_n"), keys, "left_semi", null_safe=True)
    long = join_on_keys(df, sizes.filter(is_long).drop("_n"), keys, "left_semi", null_safe=True)
    n_long = sizes.filter(is_long).count()
    return short, known.groups - n_long, long, n_long


def path_measures(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], point: str,
    cfg: AuditConfig, settings: Sequence[Setting],
    measure: Callable[[np.ndarray, dict], list[tuple]], fields: Sequence[T.StructField],
) -> DataFrame:
    """Apply ``measure`` to the observed path (null_id = -1) and each null path.

    ``measure`` gets the checkpoints as an array and the setting, and returns
    tuples for ``fields``. Null paths are built as in ``audit_lifetimes``.
    """
    keys = list(keys)
    short, groups, long, n_long = split_by_length(df, keys, cfg.max_points)
    packed = pack_points(short, keys, order, point, cfg.max_points).filter(F.size("points") > 1)
    out = measured_paths(packed, keys, settings, cfg, groups, measure, fields)
    if long is not None and cfg.whole_long:
        return out.unionByName(
            measured_paths(whole_paths(long, keys, order, point), keys, settings, few_at_once(cfg), n_long, measure, fields)
        )
    if long is None or not cfg.thin_long:
        return out
    schema = out.schema

    def long_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                moves = np.stack(row["moves"]).astype(float)
                path = np.vstack([np.zeros(moves.shape[1]), moves.cumsum(axis=0)])
                rows += measured(row, keys, row["null_id"], path, measure)
            yield lifetime_frame(rows, schema)

    moved = long_null_points(long, keys, order, point, settings, cfg)
    placed = spread(moved, n_long * null_count(settings, cfg), [*keys, *SETTING, "null_id"])
    return out.unionByName(placed.mapInPandas(long_paths, schema))


def measured(row: dict, keys: Sequence[str], null_id: int, path: np.ndarray, measure: Callable[[np.ndarray, dict], list[tuple]]) -> list:
    setting = {k: row[k] for k in SETTING}
    pct = setting["pct"]
    setting["pct"] = None if pct is None or math.isnan(pct) else pct
    lead = [*[row[c] for c in keys], *setting.values(), null_id]
    return [[*lead, *values] for values in measure(path, setting)]


def whole_paths(df: DataFrame, keys: Sequence[str], order: Sequence[str], point: str) -> DataFrame:
    """One row per trajectory with all its points, which grow with its length and not with the square of it."""
    bound_arrow_batches(df.sparkSession)
    # As in the Gram matrices, checkpoints without a point are passed over.
    known = df.filter(F.col(point).isNotNull())
    return pack_points(known, keys, order, point, np.iinfo(np.int32).max).filter(F.size("points") > 1)


def few_at_once(cfg: AuditConfig) -> AuditConfig:
    """Smaller batches of nulls: those of a long trajectory take far longer than its points to send."""
    return replace(cfg, nulls_per_task=max(1, cfg.nulls_per_task // 5))


def whole_lifetimes(
    packed: DataFrame, keys: Sequence[str], settings: Sequence[Setting], cfg: AuditConfig, groups: int
) -> DataFrame:
    """``null_lifetimes`` of trajectories of any length from (keys, points)."""
    kmax, fill = cfg.kmax, cfg.sentinel_fill

    def measure(path: np.ndarray, setting: dict) -> list[tuple]:
        d = topology.point_distances(path)
        return [(*topology.lifetime_pair(d, setting["k0"], kmax, setting["pct"], fill), len(path))]

    return measured_paths(packed, keys, settings, few_at_once(cfg), groups, measure, LIFETIME_FIELDS[4:])


def measured_paths(
    packed: DataFrame, keys: Sequence[str], settings: Sequence[Setting], cfg: AuditConfig, groups: int,
    measure: Callable[[np.ndarray, dict], list[tuple]], fields: Sequence[T.StructField],
) -> DataFrame:
    """``measure`` of the observed path and each null path of packed points."""
    keys = list(keys)
    per_task = cfg.nulls_per_task
    batches = F.sequence(F.lit(-1), F.col("n_nulls") - 1, F.lit(per_task))
    cells = with_settings(with_key_seed(packed, keys, cfg), settings, cfg).withColumn(
        "first_null", F.explode(batches)
    )
    schema = T.StructType(key_fields(packed, keys) + LIFETIME_FIELDS[:4] + list(fields))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                x = np.stack(row["points"]).astype(float)
                steps = np.diff(x, axis=0)
                first = row["first_null"]
                for null_id in range(first, min(first + per_task, row["n_nulls"])):
                    path = x
                    if null_id >= 0:
                        rng = np.random.default_rng(audit_rng_key(row, null_id))
                        moved = steps[topology.block_order(len(steps), row["block_size"], rng)]
                        path = np.vstack([x[:1], x[:1] + moved.cumsum(axis=0)])
                    out += measured(row, keys, null_id, path, measure)
            yield lifetime_frame(out, schema)

    items = item_count(settings, cfg, groups)
    return spread(cells, items, [*keys, *SETTING, "first_null"]).mapInPandas(walk, schema)
