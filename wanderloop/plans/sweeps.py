"""Whole summary operators of parameter sweeps over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanderloop.operators.autocorrelation import acf_statistics
from wanderloop.operators.summaries import curvature_summary, per_k_summary, sweep_analysis
from wanderloop.plans.registry import query, table


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(
    "per_k_records",
    """SELECT l_returnflag AS dataset, l_linenumber AS k,
              round(avg(CASE WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS fire_rate,
              CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive,
              count(l_discount) AS n_total, round(avg(l_quantity), 6) AS mean_Lobs,
              round(avg(l_extendedprice), 6) AS mean_TSR, round(avg(l_tax), 6) AS mean_zrob,
              min(l_discount) AS min_pperm, max(l_discount) AS max_pperm
       FROM lineitem GROUP BY ALL""",
)
def per_k_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every order line by flag and line number."""
    records = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("dataset"), F.col("l_linenumber").alias("k"),
        (F.col("l_discount") > 0.05).alias("formal_trigger"), F.col("l_quantity").alias("Lobs"),
        F.col("l_extendedprice").alias("TSR"), F.col("l_tax").alias("zrob"), F.col("l_discount").alias("pperm"),
    )
    return rounded(per_k_summary(records), "fire_rate", "mean_Lobs", "mean_TSR", "mean_zrob")


@query(
    "sweep_analysis",
    """WITH r AS (
         SELECT o_orderpriority AS dataset, o_custkey % 5 AS seed, CAST(year(o_orderdate) AS INTEGER) AS k,
                max(o_totalprice) > 400000 AS fired, max(o_totalprice) AS Lobs, round(avg(o_totalprice), 4) AS TSR,
                CAST(count(*) AS DOUBLE) AS zrob, min(o_totalprice) AS pperm
         FROM orders GROUP BY ALL),
       t AS (
         SELECT dataset, CAST(sum(CASE WHEN fired THEN 1 ELSE 0 END) AS BIGINT) AS n_formal_positive, count(*) AS n_total,
                round(avg(CASE WHEN fired THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS formal_fire_rate,
                min(pperm) AS min_pperm, round(avg(Lobs), 4) AS mean_Lobs, round(avg(TSR), 4) AS mean_TSR,
                round(avg(zrob), 6) AS mean_zrob, max(TSR) AS max_TSR
         FROM r GROUP BY dataset),
       b AS (SELECT dataset, fired, lag(fired) OVER (PARTITION BY dataset, seed ORDER BY k) AS before FROM r),
       f AS (
         SELECT dataset, CAST(sum(CASE WHEN fired <> before THEN 1 ELSE 0 END) AS BIGINT) AS flip_count,
                count(before) AS total_pairs,
                round(avg(CASE WHEN before IS NULL THEN NULL WHEN fired <> before THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS flip_rate
         FROM b GROUP BY dataset),
       g AS (
         SELECT dataset, k, avg(CASE WHEN fired THEN 1.0::DOUBLE ELSE 0.0 END) AS freq, avg(TSR) AS tsr FROM r GROUP BY ALL),
       p AS (
         SELECT x.dataset, sign(y.freq - x.freq) AS df, sign(y.tsr - x.tsr) AS dt
         FROM g x JOIN g y ON x.dataset = y.dataset AND x.k < y.k),
       u AS (
         SELECT dataset,
                round(sum(df) / sqrt(CAST(count(*) AS DOUBLE) * nullif(sum(abs(df)), 0)), 6) AS kendall_tau_formal_freq,
                round(sum(dt) / sqrt(CAST(count(*) AS DOUBLE) * nullif(sum(abs(dt)), 0)), 6) AS kendall_tau_TSR
         FROM p GROUP BY dataset)
       SELECT * FROM t JOIN f USING (dataset) JOIN u USING (dataset)""",
)
def sweep_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates, extremes, flips over the years and rank trends of every priority's orders."""
    price = F.col("o_totalprice")
    cells = table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("dataset"), (F.col("o_custkey") % 5).alias("seed"), F.year("o_orderdate").alias("k")
    ).agg(
        (F.max(price) > 400000).alias("formal_trigger"), F.max(price).alias("Lobs"), F.round(F.avg(price), 4).alias("TSR"),
        F.count(F.lit(1)).cast("double").alias("zrob"), F.min(price).alias("pperm"),
    )
    out = rounded(sweep_analysis(cells, p_values=False), "mean_Lobs", "mean_TSR", digits=4)
    return rounded(
        out, "formal_fire_rate", "mean_zrob", "flip_rate", "kendall_tau_formal_freq", "kendall_tau_TSR"
    )


@query(
    "curvature_summary",
    """WITH x AS (
         SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a,
                rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b
         FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL)
       SELECT (SELECT round(corr(a, b), 9) FROM x) AS spearman_proj_TSR_vs_lambda,
              bool_or(p_retailprice > 1800) AS any_geo_formal_trigger, max(p_retailprice * p_size) AS max_geo_TSR
       FROM part""",
)
def curvature_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend of price over size and the extremes; the p-value, which SQL cannot give, is left to the tests."""
    price, size = F.col("p_retailprice"), F.col("p_size")
    parts = table(spark, sf_dir, "part").select(
        size.alias("lambda_val"), price.alias("proj_TSR"), (price > 1800).alias("geo_formal_trigger"),
        (price * size).alias("geo_TSR"),
    )
    return rounded(curvature_summary(parts).drop("spearman_p"), "spearman_proj_TSR_vs_lambda", digits=9)


@query(
    "acf_statistics_half_even",
    """SELECT event_type, CAST(user_id % 20 AS INTEGER) AS lag,
              round_even(avg(value), 4) AS acf_mag_mean, round_even(stddev_samp(value), 4) AS acf_mag_std,
              round_even(avg(value / 3), 4) AS cos_sim_mean, round_even(stddev_samp(value / 3), 4) AS cos_sim_std
       FROM events GROUP BY ALL""",
)
def acf_statistics_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation per lag to four digits half-even, by the operator of the autocorrelation report."""
    events = table(spark, sf_dir, "events").select(
        "event_type", (F.col("user_id") % 20).cast("int").alias("lag"), F.col("value").alias("acf_mag"),
        (F.col("value") / 3).alias("cos_sim"),
    )
    return acf_statistics(events, ["event_type"])
