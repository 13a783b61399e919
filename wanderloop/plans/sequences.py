"""Ordered sequences: increments, flips, trends, autocorrelation, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanderloop.operators import autocorrelation as A
from wanderloop.operators.ordered import OrderedGroups, hash_subsample, settled, stride_subsample
from wanderloop.operators.quantiles import join_on_keys
from wanderloop.operators.summaries import adjacent_flips, calibration_summary, decision_sequences
from wanderloop.operators.trajectory import kinematics, steps_of
from wanderloop.operators.walk_nulls import hash_number, record_from_lifetimes, walk_extents
from wanderloop.plans.registry import query, table
from wanderloop.plans.walk_tests import RECORD_SQL, extent_sql, rounded_record


def placed_events(spark: SparkSession, sf_dir: str, **scan) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return OrderedGroups(events, ["user_id"], ["ts", "event_id"]).scan(**scan)


PLACED_SQL = """placed AS (
  SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos
  FROM events)"""


@query(
    "lag_steps",
    """SELECT user_id, event_id, row_number() OVER w - 1 AS pos,
              round(value - lag(value) OVER w, 6) AS step
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def lag_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = placed_events(spark, sf_dir, position="pos", lags={"before": "value"})
    return placed.select(
        "user_id", "event_id", "pos", F.round(F.col("value") - F.col("before"), 6).alias("step")
    )


@query(
    "running_path",
    """SELECT user_id, event_id, round(sum(value) OVER (
                PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS path
       FROM events""",
)
def running_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-integrated increments."""
    placed = placed_events(spark, sf_dir, sums={"path": "value"})
    return placed.select("user_id", "event_id", F.round("path", 4).alias("path"))


@query(
    "prefix_slices",
    "WITH " + PLACED_SQL + """
       SELECT user_id, prefix, count(*) AS n, round(avg(value), 6) AS mean_value,
              arg_max(value, pos) AS last_value
       FROM placed, (SELECT unnest([10, 25, 50]) AS prefix) WHERE pos < prefix GROUP BY ALL""",
)
def prefix_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence cut at several prefix lengths."""
    placed = placed_events(spark, sf_dir, position="pos")
    cut = placed.withColumn("prefix", F.explode(F.array(*[F.lit(p) for p in (10, 25, 50)])))
    return cut.filter("pos < prefix").groupBy("user_id", "prefix").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"),
        F.max_by("value", "pos").alias("last_value"),
    )


@query(
    "adjacent_flips",
    """WITH d AS (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice > 250000 AS fired FROM orders),
       p AS (SELECT o_custkey, fired, lag(fired) OVER (
               PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM d)
       SELECT o_custkey, CAST(coalesce(sum(CASE WHEN fired <> before THEN 1 ELSE 0 END), 0) AS BIGINT) AS flip_count,
              count(before) AS total_pairs,
              round(avg(CASE WHEN before IS NULL THEN NULL WHEN fired <> before THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS flip_rate
       FROM p GROUP BY o_custkey""",
)
def flips_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderdate", "o_orderkey", (F.col("o_totalprice") > 250000).alias("fired")
    )
    out = adjacent_flips(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "fired", ["o_custkey"])
    return out.withColumn("flip_rate", F.round("flip_rate", 9))


@query(
    "sequence_text",
    """WITH d AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS k, max(o_totalprice) > 400000 AS fired
                  FROM orders GROUP BY ALL)
       SELECT o_custkey, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS k_sequence,
              string_agg(CASE WHEN fired THEN '1' ELSE '0' END, ',' ORDER BY k) AS decision_sequence
       FROM d GROUP BY o_custkey""",
)
def sequence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly decisions along the years; a sequence is as long as the calendar."""
    yearly = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("k")).agg(
        (F.max("o_totalprice") > 400000).alias("fired")
    )
    return decision_sequences(yearly, ["o_custkey"], "k", F.col("fired").cast("int"))


@query(
    "kinematic_ratio",
    """WITH s AS (SELECT label, vec_id, embedding::DOUBLE[] AS p,
                    lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS q FROM embeddings),
       a AS (SELECT label, count(*) AS n_points, coalesce(sum(list_distance(p, q)), 0) AS path_length,
                    list_distance(arg_min(p, vec_id), arg_max(p, vec_id)) AS net_displacement
             FROM s GROUP BY label)
       SELECT label, n_points, round(path_length, 6) AS path_length,
              round(net_displacement, 6) AS net_displacement,
              round(path_length / greatest(net_displacement, 1e-8), 6) AS kinematic_R FROM a""",
)
def kinematic_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kinematics(table(spark, sf_dir, "embeddings"), ["label"], ["vec_id"], "embedding")
    names = ("path_length", "net_displacement", "kinematic_R")
    return out.select("label", "n_points", *[F.round(c, 6).alias(c) for c in names])


@query(
    "kinematic_ratio_events",
    "WITH " + PLACED_SQL + """,
       s AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY pos)) AS d FROM placed),
       a AS (SELECT user_id, coalesce(sum(d), 0) AS path_length,
                    abs(arg_max(value, pos) - arg_min(value, pos)) AS net_displacement FROM s GROUP BY user_id)
       SELECT user_id, round(path_length, 4) AS path_length, round(net_displacement, 4) AS net_displacement,
              round(path_length / greatest(net_displacement, 0.005), 4) AS ratio FROM a""",
)
def kinematic_ratio_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = placed_events(spark, sf_dir, position="pos", lags={"before": "value"})
    out = placed.groupBy("user_id").agg(
        F.coalesce(F.sum(F.abs(F.col("value") - F.col("before"))), F.lit(0.0)).alias("path_length"),
        F.abs(F.max_by("value", "pos") - F.min_by("value", "pos")).alias("net_displacement"),
    )
    # Prices move in cents, so half a cent is the floor of a displacement.
    ratio = F.col("path_length") / F.greatest("net_displacement", F.lit(0.005))
    return out.select(
        "user_id", F.round("path_length", 4).alias("path_length"),
        F.round("net_displacement", 4).alias("net_displacement"), F.round(ratio, 4).alias("ratio"),
    )


@query(
    "magnitude_acf",
    "WITH " + PLACED_SQL + """,
       steps AS (SELECT user_id, pos, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY pos)) AS m FROM placed),
       d AS (SELECT user_id, pos, m - avg(m) OVER (PARTITION BY user_id) AS x,
                    count(*) OVER (PARTITION BY user_id) AS n FROM steps WHERE pos >= 1),
       p AS (SELECT user_id, sum(x * x) / any_value(n) AS power, any_value(n) AS n FROM d GROUP BY user_id),
       l AS (SELECT user_id, power, n, unnest(range(0, 11)) AS lag FROM p),
       q AS (SELECT l.user_id, l.lag, l.power, l.n, sum(a.x * b.x) AS dot
             FROM l LEFT JOIN d a ON a.user_id = l.user_id
             LEFT JOIN d b ON b.user_id = a.user_id AND b.pos = a.pos + l.lag GROUP BY ALL)
       SELECT user_id, CAST(lag AS INTEGER) AS lag, round(CASE WHEN lag = 0 THEN 1.0
                WHEN abs(power) < 1e-12 THEN NULL ELSE dot / (n - lag) / power END, 6) AS acf_mag FROM q""",
)
def magnitude_acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = placed_events(spark, sf_dir, position="pos", lags={"before": "value"}).filter("pos >= 1")
    lengths = placed.select("user_id", "pos", F.abs(F.col("value") - F.col("before")).alias("length"))
    out = A.magnitude_acf(lengths, ["user_id"], "pos", "length", 10)
    return out.withColumn("acf_mag", F.round("acf_mag", 6))


DIRECTION_SQL = """WITH o AS (SELECT label, embedding::DOUBLE[] AS p,
              row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings),
       s AS (SELECT b.label, b.pos, list_transform(list_zip(b.p, a.p), lambda z: z[1] - z[2]) AS v
             FROM o b JOIN o a ON a.label = b.label AND a.pos = b.pos - 1),
       m AS (SELECT *, sqrt(list_inner_product(v, v)) AS m FROM s),
       c AS (SELECT a.label, b.pos - a.pos AS lag,
                    avg(list_inner_product(a.v, b.v) / (a.m * b.m + 1e-12)) AS cos
             FROM m a JOIN m b ON a.label = b.label AND b.pos > a.pos AND b.pos <= a.pos + 20 GROUP BY ALL)"""


@query(
    "direction_acf",
    DIRECTION_SQL + """ SELECT label, CAST(lag AS INTEGER) AS lag, round(cos, 6) AS cos_sim FROM c
       UNION ALL SELECT DISTINCT label, 0, 1.0::DOUBLE FROM m""",
)
def direction_acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = steps_of(table(spark, sf_dir, "embeddings"), ["label"], ["vec_id"], "embedding")
    out = A.direction_acf(steps, ["label"], "pos", "step", 20)
    return out.withColumn("cos_sim", F.round("cos_sim", 6))


@query(
    "window_means",
    DIRECTION_SQL + """ SELECT label, round(avg(CASE WHEN lag BETWEEN 1 AND 10 THEN cos END), 6) AS "C1_10",
              round(avg(CASE WHEN lag BETWEEN 11 AND 20 THEN cos END), 6) AS "C11_20",
              round(avg(CASE WHEN lag BETWEEN 1 AND 20 THEN cos END), 6) AS "C1_20" FROM c GROUP BY label""",
)
def window_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = steps_of(table(spark, sf_dir, "embeddings"), ["label"], ["vec_id"], "embedding")
    acf = A.direction_acf(steps, ["label"], "pos", "step", 20)
    out = A.window_means(acf, ["label"])
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("C1_10", "C11_20", "C1_20")])


@query(
    "persistence_differences",
    DIRECTION_SQL + """, w AS (SELECT label, avg(cos) AS c FROM c GROUP BY label)
       SELECT a.label AS label_a, b.label AS label_b, round(a.c - b.c, 6) AS diff
       FROM w a JOIN w b ON a.label < b.label""",
)
def persistence_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = steps_of(table(spark, sf_dir, "embeddings"), ["label"], ["vec_id"], "embedding")
    windows = A.window_means(A.direction_acf(steps, ["label"], "pos", "step", 20), ["label"])
    out = A.persistence_differences(windows, "label")
    return out.withColumn("diff", F.round("diff", 6))


@query(
    "acf_statistics",
    "WITH " + PLACED_SQL + """,
       s AS (SELECT user_id, pos, value - lag(value) OVER (PARTITION BY user_id ORDER BY pos) AS d FROM placed),
       x AS (SELECT user_id, pos, abs(d) - avg(abs(d)) OVER (PARTITION BY user_id) AS x,
                    count(*) OVER (PARTITION BY user_id) AS n FROM s WHERE pos >= 1),
       b AS (SELECT p.user_id, q.pos - p.pos AS lag, p.n, p.x * q.x AS xx
             FROM x p JOIN x q ON p.user_id = q.user_id AND q.pos - p.pos BETWEEN 0 AND 5),
       a AS (SELECT user_id, lag, sum(xx) / (any_value(n) - lag) AS c FROM b GROUP BY user_id, lag),
       r AS (SELECT a.user_id, a.lag, CASE WHEN a.lag = 0 THEN 1.0 ELSE a.c / z.c END AS acf
             FROM a JOIN a z ON a.user_id = z.user_id AND z.lag = 0)
       SELECT CAST(lag AS INTEGER) AS lag, round(avg(acf), 6) AS acf_mag_mean,
              round(stddev_samp(acf), 6) AS acf_mag_std FROM r GROUP BY lag""",
)
def acf_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the autocorrelation over users, per lag."""
    placed = placed_events(spark, sf_dir, position="pos", lags={"before": "value"}).filter("pos >= 1")
    lengths = placed.select("user_id", "pos", F.abs(F.col("value") - F.col("before")).alias("length"))
    acf = A.magnitude_acf(lengths, ["user_id"], "pos", "length", 5)
    return acf.groupBy("lag").agg(
        F.round(F.avg("acf_mag"), 6).alias("acf_mag_mean"),
        F.round(F.stddev_samp("acf_mag"), 6).alias("acf_mag_std"),
    )


@query(
    "ols_detrend_time",
    "WITH " + PLACED_SQL + """,
       f AS (SELECT user_id, regr_slope(value, pos) AS slope, regr_intercept(value, pos) AS intercept
             FROM placed GROUP BY user_id)
       SELECT event_id, user_id, round(value - (f.slope * pos + f.intercept), 6) AS residual
       FROM placed JOIN f USING (user_id)""",
)
def ols_detrend_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = placed_events(spark, sf_dir, position="pos")
    fit = placed.groupBy("user_id").agg(
        F.regr_slope("value", "pos").alias("slope"), F.regr_intercept("value", "pos").alias("intercept")
    )
    residual = F.col("value") - (F.col("slope") * F.col("pos") + F.col("intercept"))
    return join_on_keys(placed, fit, ["user_id"]).select(
        "event_id", "user_id", F.round(residual, 6).alias("residual")
    )


@query(
    "stride_subsample",
    """WITH o AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS position,
                   count(*) OVER (PARTITION BY label) AS n_points FROM embeddings),
       k AS (SELECT DISTINCT label, n_points,
               CASE WHEN i = 19 THEN n_points - 1
                    ELSE CAST(floor(i * (CAST(n_points - 1 AS DOUBLE) / 19)) AS BIGINT) END AS position
             FROM (SELECT DISTINCT label, n_points FROM o), range(20) r(i))
       SELECT o.label, o.vec_id, o.position, o.n_points FROM o JOIN k USING (label, position)""",
)
def stride_subsample_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty evenly spaced vectors of each label."""
    vectors = table(spark, sf_dir, "embeddings").select("label", "vec_id")
    return stride_subsample(vectors, ["label"], ["vec_id"], 20).select(
        "label", "vec_id", "position", "n_points"
    )


@query(
    "random_subsample_hash",
    """SELECT doc_id, lang, draw FROM (
         SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id) AS draw
         FROM documents) WHERE draw <= 50""",
)
def random_subsample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents of each language drawn without replacement."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return hash_subsample(documents, ["lang"], "doc_id", 50, 7).select(
        "doc_id", "lang", F.col("draw").cast("long").alias("draw")
    )


N_WALKS, WALK_NULLS = 200, 200

CALIBRATION_SQL = (
    "WITH RECURSIVE " + PLACED_SQL + """,
shortest AS (SELECT min(n) - 1 AS n FROM (SELECT count(*) AS n FROM events GROUP BY user_id)),
pool AS (
  SELECT value - before AS step, row_number() OVER (ORDER BY user_id, pos) - 1 AS idx
  FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY pos) AS before FROM placed) WHERE pos >= 1),
draws AS (
  SELECT CAST(c AS BIGINT) AS calib_id, CAST(s AS BIGINT) AS pos,
         ('0x' || substr(md5('20260506|' || c || '|' || s), 1, 15))::BIGINT % (SELECT count(*) FROM pool) AS idx
  FROM range(200) x(c), (SELECT unnest(range(1, n + 1)) AS s FROM shortest)),
steps AS (SELECT d.calib_id, d.pos, p.step FROM draws d JOIN pool p USING (idx)),"""
    + extent_sql("calib_id", "1, 5, 10, 20", WALK_NULLS)
    + "," + RECORD_SQL.format(cell="calib_id, block_size") + """
SELECT block_size, count(*) AS n_calib_cells,
       CAST(sum(formal_trigger::INTEGER) AS BIGINT) AS pperm_trigger_count,
       CAST(sum(separation_flag::INTEGER) AS BIGINT) AS separation_flag_count,
       CAST(sum(nominal_trigger::INTEGER) AS BIGINT) AS nominal_trigger_count,
       round(sum(formal_trigger::INTEGER) / CAST(count(*) AS DOUBLE), 9) AS empirical_fpr,
       round(greatest(0.0, (avg(formal_trigger::INTEGER) + 1.96^2/(2*count(*)) - 1.96*sqrt(
         avg(formal_trigger::INTEGER)*(1-avg(formal_trigger::INTEGER))/count(*) + 1.96^2/(4.0*count(*)*count(*))))
         / (1 + 1.96^2/count(*))), 9) AS empirical_fpr_wilson95_lo,
       round(least(1.0, (avg(formal_trigger::INTEGER) + 1.96^2/(2*count(*)) + 1.96*sqrt(
         avg(formal_trigger::INTEGER)*(1-avg(formal_trigger::INTEGER))/count(*) + 1.96^2/(4.0*count(*)*count(*))))
         / (1 + 1.96^2/count(*))), 9) AS empirical_fpr_wilson95_hi,
       round(avg("Lobs"), 6) AS "mean_Lobs", round(median("Lobs"), 6) AS "median_Lobs",
       round(avg(null_med), 6) AS mean_null_median, round(median(null_med), 6) AS median_null_median,
       round(avg(pperm), 6) AS mean_pperm, round(min(pperm), 6) AS min_pperm, 0.05::DOUBLE AS alpha
FROM rec GROUP BY block_size"""
)


@query("pooled_walk_calibration", CALIBRATION_SQL)
def pooled_walk_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False-positive rate of the block tests on walks drawn from all increments.

    Draws are hashed indices into the pool of every user's increments, so a
    walk does not depend on how the pool is partitioned. Walks are as long as the
    shortest source.
    """
    events = table(spark, sf_dir, "events")
    n_steps = (events.groupBy("user_id").count().agg(F.min("count")).first()[0] or 1) - 1
    placed = placed_events(spark, sf_dir, position="pos", lags={"before": "value"}).filter("pos >= 1")
    pool = placed.select("user_id", "pos", (F.col("value") - F.col("before")).alias("step"))
    indexed = OrderedGroups(pool, [], ["user_id", "pos"]).scan(position="idx").select("idx", "step")
    n_pool = pool.count()
    draws = (
        spark.range(N_WALKS).withColumnRenamed("id", "calib_id")
        .withColumn("pos", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n_steps).cast("long"))))
    )
    drawn = F.concat_ws("|", F.lit("20260506"), F.col("calib_id").cast("string"), F.col("pos").cast("string"))
    draws = draws.withColumn("idx", hash_number(drawn) % F.lit(n_pool))
    steps = draws.join(indexed, "idx").select(
        "calib_id", "pos", "step", F.lit(n_steps).cast("long").alias("n_steps")
    )
    extents = walk_extents(steps, ["calib_id"], WALK_NULLS, (1, 5, 10, 20), 42, n_steps)
    record = rounded_record(record_from_lifetimes(extents, ["calib_id", "block_size"], tie_digits=9))
    out = calibration_summary(settled(record))
    nine = ("empirical_fpr", "empirical_fpr_wilson95_lo", "empirical_fpr_wilson95_hi")
    six = ("mean_Lobs", "median_Lobs", "mean_null_median", "median_null_median", "mean_pperm", "min_pperm")
    return out.withColumns(
        {c: F.round(c, 9) for c in nine} | {c: F.round(c, 6) for c in six}
    )


