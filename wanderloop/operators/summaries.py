"""Summaries of result tables: sweeps, blocks, calibration, locality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wanderloop.functions.columns import is_true_text, wilson_bounds
from wanderloop.operators.ordered import OrderedGroups, group_sizes
from wanderloop.operators.quantiles import group_summary, join_on_keys
from wanderloop.operators.ranks import (
    MAX_GRID, kendall_p_column, kendall_tau_b, spearman, spearman_p_column,
)

NUMBER = "double"


def as_flag(c: str) -> Column:
    return is_true_text(F.col(c))


def rate(c: str) -> Column:
    return F.avg(as_flag(c).cast(NUMBER))


def hits(c: str) -> Column:
    return F.sum(as_flag(c).cast("long"))


def per_k_summary(df: DataFrame, keys: Sequence[str] = ("dataset", "k")) -> DataFrame:
    """Fire rate and record statistics per dataset and k."""
    return df.groupBy(*keys).agg(
        rate("formal_trigger").alias("fire_rate"),
        hits("formal_trigger").alias("n_positive"),
        F.count("formal_trigger").alias("n_total"),
        F.avg("Lobs").alias("mean_Lobs"),
        F.avg("TSR").alias("mean_TSR"),
        F.avg("zrob").alias("mean_zrob"),
        F.min("pperm").alias("min_pperm"),
        F.max("pperm").alias("max_pperm"),
    )


def adjacent_flips(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], decision: str, by: Sequence[str]
) -> DataFrame:
    """Changes between neighbouring decisions of each sequence, summed ``by``."""
    paired = OrderedGroups(df.select(*dict.fromkeys([*keys, *order, decision])), keys, order).scan(
        lags={"_before": decision}
    )
    changed = (F.col(decision) != F.col("_before")).cast("long")
    return paired.groupBy(*by).agg(
        F.coalesce(F.sum(changed), F.lit(0)).alias("flip_count"),
        F.count("_before").alias("total_pairs"),
        F.avg(changed.cast(NUMBER)).alias("flip_rate"),
    )


def require_short(df: DataFrame, keys: Sequence[str], most: int = MAX_GRID) -> None:
    """Stop before gathering a list that is not a short list of settings."""
    largest = group_sizes(df, keys).largest
    if largest > most:
        raise ValueError(f"{largest} grid points in one group; a sweep grid has at most {most}")


def grid_arrays(df: DataFrame, by: Sequence[str], k: str, metrics: dict[str, Column]) -> DataFrame:
    """Per group: the k grid and each metric averaged at its points, as aligned arrays.

    The grid is the list of settings a sweep was run on.
    """
    points = df.groupBy(*by, k).agg(*[F.avg(m).alias(name) for name, m in metrics.items()])
    require_short(points, by)
    packed = points.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(F.col(k).alias("_k"), *metrics))).alias("_grid")
    )
    cols = [F.col("_grid._k").cast("array<double>").alias("_k")]
    # A field of an array of structs is the array of that field.
    cols += [F.col(f"_grid.{name}").alias(name) for name in metrics]
    return packed.select(*by, *cols)


def sweep_analysis(df: DataFrame, p_values: bool = True, carried: Sequence[str] = ()) -> DataFrame:
    """Per dataset: rates, extremes, flips over k and rank trends over the k grid.

    ``carried`` columns are constant within a dataset and are passed on.
    """
    by = ["dataset"]
    trigger = df.withColumn("_fired", as_flag("formal_trigger"))
    totals = trigger.groupBy(*by).agg(
        hits("formal_trigger").alias("n_formal_positive"),
        F.count(F.lit(1)).alias("n_total"),
        rate("formal_trigger").alias("formal_fire_rate"),
        F.min("pperm").alias("min_pperm"),
        F.avg("Lobs").alias("mean_Lobs"),
        F.avg("TSR").alias("mean_TSR"),
        F.avg("zrob").alias("mean_zrob"),
        F.max("TSR").alias("max_TSR"),
        *[F.min(c).alias(c) for c in carried],
    )
    flips = adjacent_flips(trigger, ["dataset", "seed"], ["k"], "_fired", by)
    arrays = grid_arrays(
        trigger, by, "k", {"_freq": F.col("_fired").cast(NUMBER), "_tsr": F.col("TSR")}
    )
    cols = {}
    for name, metric in (("formal_freq", "_freq"), ("TSR", "_tsr")):
        cols[f"kendall_tau_{name}"] = kendall_tau_b(F.col("_k"), F.col(metric))
        if p_values:
            cols[f"tau_{name}_p"] = kendall_p_column("_k", metric)
    trends = arrays.select(*by, *[c.alias(n) for n, c in cols.items()])
    out = join_on_keys(join_on_keys(totals, flips, by), trends, by)
    return out


def curvature_summary(df: DataFrame) -> DataFrame:
    """One row: trend of the projection ratio over lambda, and the geodesic extremes."""
    trend = spearman(df, "lambda_val", "proj_TSR").select(
        F.lit(1).alias("_one"), F.col("rho").alias("spearman_proj_TSR_vs_lambda"),
        spearman_p_column("rho", "n").alias("spearman_p"),
    )
    extremes = df.agg(
        F.bool_or(as_flag("geo_formal_trigger")).alias("any_geo_formal_trigger"),
        F.max("geo_TSR").alias("max_geo_TSR"),
    ).withColumn("_one", F.lit(1))
    return trend.join(extremes, "_one").drop("_one")


def decision_sequences(df: DataFrame, keys: Sequence[str], k: str, decision: Column) -> DataFrame:
    """The k grid and the decisions along it, as comma-separated text."""
    require_short(df, keys)
    packed = df.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(k).alias("k"), decision.alias("d")))).alias("_grid")
    )
    text = lambda f: F.array_join(F.transform("_grid", lambda g: g[f].cast("string")), ",")
    return packed.select(*keys, text("k").alias("k_sequence"), text("d").alias("decision_sequence"))


def cell_summary(df: DataFrame, keys: Sequence[str], with_lobs: bool = False) -> DataFrame:
    """Seeds, triggers, p-values and robust z per sweep cell."""
    medians = {"p_median": ("geo_pperm", 0.5), "zrob_median": ("geo_zrob", 0.5)}
    if with_lobs:
        medians["Lobs_median"] = ("geo_Lobs", 0.5)
    return group_summary(
        df, keys,
        {
            "n_seeds": F.count(F.lit(1)),
            "seeds_fired": hits("geo_formal_trigger"),
            "p_min": F.min("geo_pperm"),
        },
        medians,
    )


def mean_above(df: DataFrame, keys: Sequence[str], order: str, value: str, limit: float, name: str) -> DataFrame:
    """Whether the mean of each group is above a limit, the same however the rows are dealt.

    A sum of doubles depends on its order in the last bits, which decide where the mean is
    the limit itself. Only for such groups the rows are added once more, one by one in ``order``.
    """
    keys = list(keys)
    means = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.sum(F.abs(value)).alias("_weight"), F.count(value).alias("_n"))
    # Far above what a sum of _n rounded terms can be wrong by.
    close = F.abs(F.col("_mean") - limit) <= 1e-15 * F.col("_n") * (F.col("_weight") / F.col("_n") + abs(limit))
    close = F.coalesce(close, F.lit(False))
    near = join_on_keys(df.select(*keys, order, value), means.filter(close).select(*keys), keys, "left_semi", null_safe=True)
    so_far = F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    exact = near.withColumn("_sum", so_far).groupBy(*keys).agg((F.max_by("_sum", order) / F.count(value) > limit).alias(name))
    return means.filter(~close).select(*keys, (F.col("_mean") > limit).alias(name)).unionByName(exact.select(*keys, name))


def decision_pivot(
    df: DataFrame, index: Sequence[str], columns: Sequence[str], values: Sequence[Sequence],
    decision: str, stable_name: str,
) -> DataFrame:
    """One boolean column per grid point and whether all of them agree.

    ``values`` lists the grid points, so the columns are known beforehand.
    """
    label = lambda point: "_".join(_plain(v) for v in point)
    flag = as_flag(decision)
    aggs = []
    for point in values:
        here = F.lit(True)
        for c, v in zip(columns, point):
            here = here & (F.col(c) == F.lit(v))
        aggs.append(F.max(F.when(here, flag)).alias(label(point)))
    agree = (F.max(flag) == F.min(flag)).cast("int")
    return df.groupBy(*index).agg(*aggs, F.coalesce(agree, F.lit(1)).alias(stable_name))


def _plain(v) -> str:
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def calibration_summary(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """False-positive rate per block size with its Wilson interval."""
    out = group_summary(
        df, ["block_size"],
        {
            "n_calib_cells": F.count(F.lit(1)),
            "pperm_trigger_count": hits("formal_trigger"),
            "separation_flag_count": hits("separation_flag"),
            "nominal_trigger_count": hits("nominal_trigger"),
            "mean_Lobs": F.avg("Lobs"),
            "mean_null_median": F.avg("null_med"),
            "mean_pperm": F.avg("pperm"),
            "min_pperm": F.min("pperm"),
        },
        {"median_Lobs": ("Lobs", 0.5), "median_null_median": ("null_med", 0.5)},
    )
    k, n = F.col("pperm_trigger_count"), F.col("n_calib_cells")
    low, high = wilson_bounds(k, n)
    return out.withColumns(
        {
            "empirical_fpr": k.cast(NUMBER) / n,
            "empirical_fpr_wilson95_lo": low,
            "empirical_fpr_wilson95_hi": high,
            "alpha": F.lit(alpha),
        }
    )


def locality_summary(df: DataFrame, keys: Sequence[str] = ("arch", "optimizer")) -> DataFrame:
    """Graph-growth and density overview per group; NULL keys are a group."""
    return group_summary(
        df, keys,
        {
            "n_paths": F.count("seed"),
            "connected_initial_count": hits("connected_at_initial_k"),
            "adaptive_growth_count": hits("adaptive_growth_used"),
            "k_used_min": F.min("k_used"),
            "k_used_max": F.max("k_used"),
            "graph_density_max": F.max("graph_density"),
            "edge_max_over_median_max": F.max("edge_max_over_median"),
            "edge_max_over_allpair_p95_max": F.max("edge_max_over_allpair_p95"),
            "near_complete_graph_count": hits("near_complete_graph_flag"),
        },
        {
            "k_used_median": ("k_used", 0.5),
            "graph_density_median": ("graph_density", 0.5),
            "edge_max_over_median_median": ("edge_max_over_median", 0.5),
        },
    )


def methods_long(df: DataFrame, keys: Sequence[str], methods: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Unpivot ``<method>_<field>`` columns into one row per method."""
    rows = [
        F.struct(F.lit(m).alias("method"), *[F.col(f"{m}_{f}").alias(f) for f in fields])
        for m in methods
    ]
    return df.select(*keys, F.explode(F.array(*rows)).alias("_r")).select(*keys, "_r.*")


def budget_maxima(df: DataFrame, keys: Sequence[str], index: str, value: str, budgets: Sequence[int]) -> DataFrame:
    """Maximum over the first B projections, for each budget B."""
    best = df.groupBy(*keys).agg(
        *[F.max(F.when(F.col(index) < b, F.col(value))).alias(f"b{b}") for b in budgets]
    )
    rows = [F.struct(F.lit(int(b)).alias("budget"), F.col(f"b{b}").alias("max_value")) for b in budgets]
    return best.select(*keys, F.explode(F.array(*rows)).alias("_r")).select(*keys, "_r.*").filter(
        F.col("max_value").isNotNull()
    )


def left_join_suffixed(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str = "_main") -> DataFrame:
    """Left join in which clashing right columns get a suffix.

    Spark picks the join by the measured size of the right side.
    """
    clash = [c for c in right.columns if c in left.columns and c not in keys]
    return left.join(right.withColumnsRenamed({c: c + suffix for c in clash}), list(keys), "left")


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Union in first-seen column order, absent columns NULL."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def first_cut(
    df: DataFrame, keys: Sequence[str], share: str, order: Sequence[str], cuts: dict[str, float]
) -> DataFrame:
    """First rank at which the running share reaches each cut, and the row count.

    ``share`` values are non-negative; ``order`` ranks them, largest first.
    """
    whole = df.groupBy(*keys).agg(F.sum(share).alias("_whole"), F.count(F.lit(1)).alias("n_items"))
    running = OrderedGroups(df.withColumn("_neg", -F.col(share)), keys, ["_neg", *order]).scan(
        position="_pos", sums={"_cum": share}
    )
    part = F.col("_cum") / F.col("_whole")
    return (
        join_on_keys(running, whole, keys)
        .groupBy(*keys)
        .agg(
            F.max("n_items").alias("n_items"),
            *[
                F.least(F.coalesce(F.min(F.when(part >= c, F.col("_pos") + 1)), F.max("n_items")),
                        F.max("n_items")).alias(name)
                for name, c in cuts.items()
            ],
        )
    )
