"""Filters, projections, joins, set operations and grouped summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanderloop.functions.columns import (
    flag, grid, is_true_text, number_or_null, select_existing, wilson_bounds,
)
from wanderloop.operators.quantiles import group_summary, join_on_keys, median_and_mad
from wanderloop.operators.ranks import kendall, kendall_p_column, kendall_tau_b, spearman, spearman_p_column
from wanderloop.operators.summaries import (
    budget_maxima, decision_pivot, first_cut, grid_arrays, left_join_suffixed, mean_above, methods_long,
    union_by_name,
)
from wanderloop.plans.registry import query, table
from wanderloop.sources.manifests import first_of_copies


@query(
    "scan_project_filter",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
       WHERE l_returnflag = 'R' AND l_discount > 0.05 AND l_tax IS NOT NULL""",
)
def scan_project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .filter((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05) & F.col("l_tax").isNotNull())
        .select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    )


@query(
    "flag_without_other",
    """SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS rushed,
              o_orderstatus = 'F' AS closed
       FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT (o_orderstatus = 'F')""",
)
def flag_without_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with one flag set and an independent one not set."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("rushed"),
        (F.col("o_orderstatus") == "F").alias("closed"),
    )
    return orders.filter(F.col("rushed") & ~F.col("closed"))


@query(
    "existing_cols_reorder",
    """SELECT o_orderpriority, o_orderkey, o_totalprice, o_custkey, o_orderstatus FROM orders""",
)
def existing_cols_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").drop("o_orderdate")
    return select_existing(
        orders, ["o_orderpriority", "analysis_role", "o_orderkey", "o_totalprice"], keep_rest=True
    )


@query(
    "unpivot_stats",
    """WITH wide AS (
         SELECT l_returnflag, l_linestatus,
           round(avg(l_quantity), 6) AS quantity_mean, max(l_quantity) AS quantity_max,
           round(avg(l_extendedprice), 6) AS price_mean, max(l_extendedprice) AS price_max,
           round(avg(l_discount), 6) AS discount_mean, max(l_discount) AS discount_max
         FROM lineitem GROUP BY ALL)
       SELECT l_returnflag, l_linestatus, 'quantity' AS method, quantity_mean AS mean, quantity_max AS max FROM wide
       UNION ALL SELECT l_returnflag, l_linestatus, 'price', price_mean, price_max FROM wide
       UNION ALL SELECT l_returnflag, l_linestatus, 'discount', discount_mean, discount_max FROM wide""",
)
def unpivot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Method-prefixed columns to one row per method."""
    measures = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount"}
    aggs = []
    for name, c in measures.items():
        aggs += [F.round(F.avg(c), 6).alias(f"{name}_mean"), F.max(c).alias(f"{name}_max")]
    keys = ["l_returnflag", "l_linestatus"]
    wide = table(spark, sf_dir, "lineitem").groupBy(*keys).agg(*aggs)
    return methods_long(wide, keys, list(measures), ["mean", "max"])


@query(
    "truthy_parse",
    """SELECT doc_id, lower(trim(' ' || CASE WHEN quality = 1 THEN 'TRUE ' ELSE 'No' END)) IN
                ('true', '1', 'yes', 'y', 'formal', 'primary') AS is_quality,
              lower(trim(CAST(toxic AS VARCHAR))) IN
                ('true', '1', 'yes', 'y', 'formal', 'primary') AS is_toxic
       FROM labels""",
)
def truthy_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    worded = F.concat(F.lit(" "), F.when(F.col("quality") == 1, "TRUE ").otherwise("No"))
    return table(spark, sf_dir, "labels").select(
        "doc_id", is_true_text(worded).alias("is_quality"), is_true_text(F.col("toxic")).alias("is_toxic")
    )


URL = r"^https?://([^/]+)/([a-z]+)/(\d+)"


@query(
    "regex_capture_name",
    r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)/([a-z]+)/(\d+)', 1) AS host,
              regexp_extract(url, '^https?://([^/]+)/([a-z]+)/(\d+)', 2) AS section,
              TRY_CAST(regexp_extract(url, '^https?://([^/]+)/([a-z]+)/(\d+)', 3) AS BIGINT) AS number
       FROM pages""",
)
def regex_capture_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda i: F.regexp_extract("url", URL, i)
    return table(spark, sf_dir, "pages").select(
        "page_id", part(1).alias("host"), part(2).alias("section"),
        part(3).try_cast("long").alias("number"),
    )


@query(
    "try_numeric",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
              TRY_CAST(event_type AS DOUBLE) AS not_a_number,
              coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50, FALSE) AS is_high
       FROM events""",
)
def try_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = number_or_null(F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").select(
        "event_id", k.alias("k"), number_or_null(F.col("event_type")).alias("not_a_number"),
        flag(k > 50).alias("is_high"),
    )


@query(
    "left_join_suffix",
    """SELECT c.c_custkey AS id, c.c_nationkey AS nationkey, c.c_name AS name,
              n.n_name AS name_main, n.n_regionkey AS regionkey
       FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""",
)
def left_join_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nationkey"), F.col("c_name").alias("name")
    )
    right = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("name"),
        F.col("n_regionkey").alias("regionkey"),
    )
    return left_join_suffixed(left, right, ["nationkey"])


@query(
    "anti_join_resume",
    """SELECT p_partkey, p_brand FROM part
       WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem
                               WHERE l_partkey IS NOT NULL AND l_returnflag = 'R' AND l_quantity > 40)""",
)
def anti_join_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work items without a finished row; finished keys are made distinct first."""
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 40")
    done = done.select(F.col("l_partkey").alias("p_partkey")).distinct()
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(done, "p_partkey", "left_anti")


@query(
    "semi_join_exists",
    """SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""",
)
def semi_join_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(
        labelled, "doc_id", "left_semi"
    )


@query(
    "sweep_grid",
    """SELECT n_nationkey, n_name, k, pct, CAST(42 + 10000 * n_regionkey + 100 * k AS BIGINT) AS seed
       FROM nation, (SELECT unnest([8, 10, 12, 16]) AS k), (SELECT unnest([90.0::DOUBLE, 95.0, 99.0]) AS pct)""",
)
def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item under every setting; the settings are short literal lists."""
    cells = grid(
        table(spark, sf_dir, "nation"), {"k": [8, 10, 12, 16], "pct": [90.0, 95.0, 99.0]}
    )
    seed = (F.lit(42) + 10000 * F.col("n_regionkey") + 100 * F.col("k")).cast("long")
    return cells.select("n_nationkey", "n_name", "k", "pct", seed.alias("seed"))


@query(
    "union_by_name_missing",
    """SELECT s_acctbal AS acctbal, s_name AS name, s_nationkey AS nationkey,
              CAST(NULL AS VARCHAR) AS segment, 'supplier' AS source_csv FROM supplier
       UNION ALL SELECT c_acctbal, c_name, c_nationkey, c_mktsegment, 'customer' FROM customer""",
)
def union_by_name_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").alias("acctbal"), F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("nationkey"), F.lit("supplier").alias("source_csv"),
    )
    c = table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("source_csv"), F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("acctbal"),
    )
    return union_by_name([s, c])


@query(
    "dedup_paths",
    """SELECT min(doc_id) AS doc_id, sha256(text) AS sha256, count(*) AS n_copies
       FROM documents GROUP BY sha256(text)""",
)
def dedup_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_of_copies(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "set_difference",
    """SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.09""",
)
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").filter("l_discount > 0.09").select("l_partkey").distinct()
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).subtract(used)


@query(
    "named_agg_per_k",
    """SELECT l_returnflag, l_linestatus,
              round(avg(CASE WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS fire_rate,
              CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive,
              count(l_discount) AS n_total, round(avg(l_quantity), 6) AS mean_quantity,
              round(avg(l_extendedprice), 6) AS mean_price, min(l_tax) AS min_tax, max(l_tax) AS max_tax
       FROM lineitem GROUP BY ALL""",
)
def named_agg_per_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    fired = F.col("l_discount") > 0.05
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.avg(fired.cast("double")), 9).alias("fire_rate"),
        F.sum(fired.cast("long")).alias("n_positive"),
        F.count("l_discount").alias("n_total"),
        F.round(F.avg("l_quantity"), 6).alias("mean_quantity"),
        F.round(F.avg("l_extendedprice"), 6).alias("mean_price"),
        F.min("l_tax").alias("min_tax"),
        F.max("l_tax").alias("max_tax"),
    )


@query(
    "locality_style_summary",
    """SELECT o_orderpriority, count(o_orderkey) AS n_paths,
              CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS closed_count,
              min(o_totalprice) AS price_min, round(median(o_totalprice), 6) AS price_median,
              max(o_totalprice) AS price_max
       FROM orders GROUP BY o_orderpriority""",
)
def locality_style_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = group_summary(
        table(spark, sf_dir, "orders"), ["o_orderpriority"],
        {
            "n_paths": F.count("o_orderkey"),
            "closed_count": F.sum((F.col("o_orderstatus") == "F").cast("long")),
            "price_min": F.min("o_totalprice"),
            "price_max": F.max("o_totalprice"),
        },
        {"price_median": ("o_totalprice", 0.5)},
    )
    return out.withColumn("price_median", F.round("price_median", 6))


@query(
    "mean_std_round",
    """SELECT l_linenumber, round(avg(l_extendedprice), 4) AS price_mean,
              round(stddev_samp(l_extendedprice), 4) AS price_std,
              round(coalesce(stddev_samp(l_quantity), 0), 4) AS quantity_std
       FROM lineitem GROUP BY l_linenumber""",
)
def mean_std_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(
        F.round(F.avg("l_extendedprice"), 4).alias("price_mean"),
        F.round(F.stddev_samp("l_extendedprice"), 4).alias("price_std"),
        F.round(F.coalesce(F.stddev_samp("l_quantity"), F.lit(0.0)), 4).alias("quantity_std"),
    )


@query(
    "pivot_first_stability",
    """WITH cells AS (SELECT user_id, event_type, avg(value) > 50 AS fired FROM events GROUP BY ALL)
       SELECT user_id, max(CASE WHEN event_type = 'click' THEN fired END) AS click,
              max(CASE WHEN event_type = 'error' THEN fired END) AS error,
              max(CASE WHEN event_type = 'purchase' THEN fired END) AS purchase,
              max(CASE WHEN event_type = 'signup' THEN fired END) AS signup,
              max(CASE WHEN event_type = 'view' THEN fired END) AS view,
              CAST(count(DISTINCT fired) <= 1 AS INTEGER) AS decision_stable
       FROM cells GROUP BY user_id""",
)
def pivot_first_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = mean_above(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", "value", 50.0, "fired")
    points = [["click"], ["error"], ["purchase"], ["signup"], ["view"]]
    return decision_pivot(cells, ["user_id"], ["event_type"], points, "fired", "decision_stable")


@query(
    "pivot_two_keys",
    """WITH cells AS (
         SELECT l_suppkey, l_returnflag, l_linestatus, avg(l_quantity) > 25.5 AS fired
         FROM lineitem GROUP BY ALL)
       SELECT l_suppkey, max(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN fired END) AS "A_F",
              max(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN fired END) AS "A_O",
              max(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN fired END) AS "N_F",
              max(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN fired END) AS "N_O",
              max(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN fired END) AS "R_F",
              max(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN fired END) AS "R_O",
              CAST(count(DISTINCT fired) <= 1 AS INTEGER) AS decision_stable_across_grid
       FROM cells GROUP BY l_suppkey""",
)
def pivot_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(
        (F.avg("l_quantity") > 25.5).alias("fired")
    )
    points = [[f, s] for f in "ANR" for s in "FO"]
    return decision_pivot(
        cells, ["l_suppkey"], ["l_returnflag", "l_linestatus"], points, "fired",
        "decision_stable_across_grid",
    )


@query(
    "mad_robust_z",
    """WITH c AS (SELECT user_id, median(value) AS center FROM events GROUP BY user_id),
       m AS (SELECT user_id, median(abs(value - center)) AS mad FROM events JOIN c USING (user_id) GROUP BY user_id)
       SELECT event_id, user_id, round(center, 6) AS center, round(mad, 6) AS mad,
              round((value - center) / greatest(1.4826 * mad, 1e-6), 6) AS zrob
       FROM events JOIN c USING (user_id) JOIN m USING (user_id)""",
)
def mad_robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    scale = median_and_mad(events.select("user_id", "value"), ["user_id"], "value")
    z = (F.col("value") - F.col("center")) / F.greatest(1.4826 * F.col("mad"), F.lit(1e-6))
    return join_on_keys(events, scale, ["user_id"]).select(
        "event_id", "user_id", F.round("center", 6).alias("center"), F.round("mad", 6).alias("mad"),
        F.round(z, 6).alias("zrob"),
    )


@query(
    "quantiles_linear",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS price_median,
              round(quantile_cont(l_extendedprice, 0.9), 6) AS price_p90,
              round(quantile_cont(l_extendedprice, 0.95), 6) AS price_p95,
              round(quantile_cont(l_extendedprice, 0.99), 6) AS price_p99,
              round(quantile_cont(l_quantity, 0.95), 6) AS quantity_p95
       FROM lineitem GROUP BY l_returnflag""",
)
def quantiles_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    probs = {
        "price_median": ("l_extendedprice", 0.5), "price_p90": ("l_extendedprice", 0.9),
        "price_p95": ("l_extendedprice", 0.95), "price_p99": ("l_extendedprice", 0.99),
        "quantity_p95": ("l_quantity", 0.95),
    }
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    out = group_summary(lines, ["l_returnflag"], {}, probs)
    return out.select("l_returnflag", *[F.round(n, 6).alias(n) for n in probs])


@query(
    "wilson_ci",
    """WITH g AS (SELECT d.lang, CAST(sum(l.quality) AS BIGINT) AS k, count(*) AS n
                  FROM documents d JOIN labels l USING (doc_id) GROUP BY d.lang),
       p AS (SELECT *, CAST(k AS DOUBLE) / n AS p, 1.96::DOUBLE AS z FROM g)
       SELECT lang, k, n, round(p, 9) AS rate,
         round(greatest(0.0, (p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 9) AS wilson95_lo,
         round(least(1.0, (p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 9) AS wilson95_hi
       FROM p""",
)
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = (
        table(spark, sf_dir, "documents").select("doc_id", "lang")
        .join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
        .groupBy("lang").agg(F.sum(F.col("quality").cast("long")).alias("k"), F.count(F.lit(1)).alias("n"))
    )
    low, high = wilson_bounds(F.col("k"), F.col("n"))
    return counted.select(
        "lang", "k", "n", F.round(F.col("k").cast("double") / F.col("n"), 9).alias("rate"),
        F.round(low, 9).alias("wilson95_lo"), F.round(high, 9).alias("wilson95_hi"),
    )


SPEARMAN_SQL = """WITH r AS (
         SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a,
                rank() OVER (ORDER BY l_extendedprice)
                  + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b
         FROM lineitem)
       SELECT count(*) AS n, round(corr(CAST(a AS DOUBLE), CAST(b AS DOUBLE)), 9) AS rho FROM r"""


@query("spearman_rho", SPEARMAN_SQL)
def spearman_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of quantity and price over all order lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    out = spearman(lines, "l_quantity", "l_extendedprice")
    return out.select("n", F.round("rho", 9).alias("rho"))


@query("spearman_with_p")
def spearman_with_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of part size and retail price with its t-test p-value."""
    parts = table(spark, sf_dir, "part").select("p_size", "p_retailprice")
    return spearman(parts, "p_size", "p_retailprice").withColumn("p", spearman_p_column("rho", "n"))


def _price_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    # l_quantity is the grid: a domain of fifty whole numbers.
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return grid_arrays(lines, ["l_returnflag"], "l_quantity", {"price": F.col("l_extendedprice")})


@query(
    "kendall_tau_b",
    """WITH g AS (SELECT l_returnflag, l_quantity AS k, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
       p AS (SELECT a.l_returnflag, sign(a.k - b.k) AS sx, sign(a.v - b.v) AS sy
             FROM g a JOIN g b ON a.l_returnflag = b.l_returnflag AND a.k < b.k)
       SELECT l_returnflag,
              round(sum(sx * sy) / sqrt(CAST(sum(abs(sx)) AS DOUBLE) * sum(abs(sy))), 9) AS tau
       FROM p GROUP BY l_returnflag""",
)
def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend of the mean price over the quantity grid."""
    tau = kendall_tau_b(F.col("_k"), F.col("price"))
    return _price_trend(spark, sf_dir).select("l_returnflag", F.round(tau, 9).alias("tau"))


@query(
    "kendall_long_columns",
    """WITH o AS (SELECT o_orderpriority, row_number() OVER () AS r, CAST(o_orderdate AS DATE) AS x, o_totalprice AS y FROM orders),
       p AS (SELECT a.o_orderpriority, sign(date_diff('day', b.x, a.x)) AS sx, sign(a.y - b.y) AS sy
             FROM o a JOIN o b ON a.o_orderpriority = b.o_orderpriority AND a.r < b.r)
       SELECT o_orderpriority, (SELECT count(*) FROM o WHERE o.o_orderpriority = p.o_orderpriority) AS n,
              round(sum(sx * sy) / sqrt(sum(abs(sx))) / sqrt(sum(abs(sy))), 9) AS tau
       FROM p GROUP BY o_orderpriority""",
)
def kendall_long_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of date and price over all orders of a priority."""
    orders = table(spark, sf_dir, "orders").withColumn("day", F.unix_date(F.col("o_orderdate").cast("date")))
    return kendall(orders, ["o_orderpriority"], "day", "o_totalprice").withColumn("tau", F.round("tau", 9))


@query("kendall_with_p")
def kendall_with_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    tau = kendall_tau_b(F.col("_k"), F.col("price"))
    return _price_trend(spark, sf_dir).select(
        "l_returnflag", tau.alias("tau"), kendall_p_column("_k", "price").alias("p")
    )


@query(
    "decision_counts",
    """SELECT event_type, CASE WHEN value > 100 THEN 'matched_step_trigger'
                ELSE 'matched_step_non_detection' END AS decision, count(*) AS n
       FROM events GROUP BY ALL""",
)
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wanderloop.operators.decisions import audit_decision

    return (
        table(spark, sf_dir, "events")
        .withColumn("decision", audit_decision(F.col("value") > 100, "matched_step"))
        .groupBy("event_type", "decision").agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "expected_map_check",
    """WITH d AS (SELECT event_type, CASE WHEN avg(value) > 50 THEN 'robust_recurrence'
                    WHEN max(value) > 360 THEN 'projection_hallucination'
                    ELSE 'no_recurrence' END AS decision FROM events GROUP BY event_type),
       e(event_type, expected) AS (VALUES ('click', 'robust_recurrence'), ('error', 'no_recurrence'),
         ('purchase', 'projection_hallucination'), ('signup', 'robust_recurrence'), ('view', 'no_recurrence'))
       SELECT event_type, decision, expected, decision = expected AS correct FROM d LEFT JOIN e USING (event_type)""",
)
def expected_map_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions against a literal map of expected ones."""
    from wanderloop.operators.decisions import archetype_decision

    expected = {
        "click": "robust_recurrence", "error": "no_recurrence", "purchase": "projection_hallucination",
        "signup": "robust_recurrence", "view": "no_recurrence",
    }
    pairs = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    grouped = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.avg("value").alias("m"), F.max("value").alias("top")
    )
    decided = grouped.select(
        "event_type", archetype_decision(F.col("m") > 50, F.col("top") > 360).alias("decision"),
        pairs[F.col("event_type")].alias("expected"),
    )
    return decided.withColumn("correct", F.col("decision") == F.col("expected"))


@query(
    "budget_max",
    """SELECT l_suppkey, l_returnflag, budget, max(l_extendedprice) AS max_value
       FROM lineitem, (SELECT unnest([1, 2, 4, 7]) AS budget)
       WHERE l_linenumber - 1 < budget GROUP BY ALL""",
)
def budget_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("proj", F.col("l_linenumber") - 1)
    return budget_maxima(lines, ["l_suppkey", "l_returnflag"], "proj", "l_extendedprice", [1, 2, 4, 7])


@query(
    "cum_variance_threshold",
    """WITH b AS (SELECT l_returnflag, l_suppkey, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY ALL),
       c AS (SELECT *, row_number() OVER w AS rn,
                    sum(s) OVER (PARTITION BY l_returnflag ORDER BY s DESC, l_suppkey ROWS UNBOUNDED PRECEDING)
                      / sum(s) OVER (PARTITION BY l_returnflag) AS cum
             FROM b WINDOW w AS (PARTITION BY l_returnflag ORDER BY s DESC, l_suppkey))
       SELECT l_returnflag, count(*) AS n_items, min(CASE WHEN cum >= 0.95 THEN rn END) AS d95,
              min(CASE WHEN cum >= 0.99 THEN rn END) AS d99
       FROM c GROUP BY l_returnflag""",
)
def cum_variance_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many suppliers make up 95 and 99 percent of the revenue of a flag."""
    shares = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("s")
    )
    return first_cut(shares, ["l_returnflag"], "s", ["l_suppkey"], {"d95": 0.95, "d99": 0.99})
