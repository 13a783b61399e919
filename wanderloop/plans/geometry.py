"""Distances, neighbour graphs, H1 bars and audits of the embedding trajectories.

A trajectory is the embeddings of one label in vec_id order, whole. Labels with
more than ``max_points`` rows, whose distance matrix no task may hold, go through
tiles, or for H1 bars as points to a task that keeps their matrices in files; where
only a Gram matrix in memory will do (audits of components) they get one row with NULLs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wanderloop.config import AuditConfig
from wanderloop.functions import topology
from wanderloop.functions.vectors import as_doubles
from wanderloop.operators import locality as L
from wanderloop.operators import tiles
from wanderloop.operators.audits import (
    SETTING, ambient_audit, audit_records, null_lifetimes, require_decisive, sensitivity_settings,
    split_by_length, targeted_settings, whole_lifetimes, whole_paths,
)
from wanderloop.operators.calibration import calibrate
from wanderloop.operators.controls import looped_grams, looped_points
from wanderloop.operators.decisions import archetype_decision, audit_decision, with_inference_role
from wanderloop.operators.ordered import settled, stride_subsample
from wanderloop.operators.principal import pca_profile, pca_trajectories, tall_profile
from wanderloop.operators.projections import projection_audit, wide_by_method
from wanderloop.operators.static_clouds import static_cloud_audit
from wanderloop.operators.summaries import calibration_summary, cell_summary, locality_summary
from wanderloop.operators.trajectory import step_gram, steps_of, to_chunks
from wanderloop.plans.registry import query, table

MAX_POINTS = AuditConfig().max_points
KEYS, ORDER, POINT = ["label"], ["vec_id"], "embedding"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def grams_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    df, groups, _, _ = split_by_length(vectors(spark, sf_dir), KEYS, MAX_POINTS)
    return step_gram(df, KEYS, ORDER, POINT, MAX_POINTS), groups


def whole(
    spark: SparkSession, sf_dir: str, in_task: Callable[[DataFrame, int], DataFrame], in_tiles: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Short labels by their Gram matrices, a task each, long ones by tiles."""
    return divided(spark, sf_dir, in_task, lambda long, _: in_tiles(long))


def divided(
    spark: SparkSession, sf_dir: str, in_task: Callable[[DataFrame, int], DataFrame], longer: Callable[[DataFrame, int], DataFrame]
) -> DataFrame:
    """Short labels by their Gram matrices, a task each; ``longer`` gets the others and their number."""
    df, groups, long, n_long = split_by_length(vectors(spark, sf_dir), KEYS, MAX_POINTS)
    out = in_task(step_gram(df, KEYS, ORDER, POINT, MAX_POINTS), groups)
    return out if long is None else out.unionByName(longer(long, n_long).select(*out.columns))


def whole_audit(n_nulls: int, **more) -> AuditConfig:
    """Audits of all labels whole, each with nulls of its own."""
    return require_decisive(AuditConfig(seed_by_key=True, n_nulls=n_nulls, max_points=MAX_POINTS, whole_long=True, **more))


def tiled(df: DataFrame) -> tiles.Tiles:
    return tiles.tiled(df, KEYS, ORDER, POINT)


def with_long(out: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows and, for each label that is too long for a matrix, one with NULLs."""
    sizes = vectors(spark, sf_dir).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
    return out.unionByName(sizes.filter(F.col("_n") > MAX_POINTS).select(*KEYS), allowMissingColumns=True)


POINTS_SQL = """ordered AS (
  SELECT label, embedding::DOUBLE[] AS p, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos,
         count(*) OVER (PARTITION BY label) AS n FROM embeddings),
pts AS (SELECT label, p, CAST(pos AS INTEGER) AS i, CAST(n AS INTEGER) AS n FROM ordered)"""

PAIRS_SQL = POINTS_SQL + """,
dist AS (
  SELECT a.label, a.i, b.i AS j, a.n, list_distance(a.p, b.p) AS d
  FROM pts a JOIN pts b ON a.label = b.label AND a.i <> b.i),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label, i ORDER BY round(d, 9), j) AS r FROM dist)"""

STEPS_SQL = POINTS_SQL + """,
steps AS (
  SELECT b.label, b.i, list_transform(list_zip(b.p, a.p), lambda z: z[1] - z[2]) AS v
  FROM pts b JOIN pts a ON a.label = b.label AND a.i = b.i - 1)"""


@query(
    "pairwise_distance_profile",
    "WITH " + PAIRS_SQL + """ SELECT label, CAST(count(*) AS INTEGER) AS n_pairs, round(min(d), 6) AS d_min,
        round(avg(d), 6) AS d_mean, round(median(d), 6) AS d_median, round(max(d), 6) AS d_max
      FROM dist WHERE i < j GROUP BY label""",
)
def pairwise_distance_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pair distances of a trajectory, summarised where they are formed."""
    names = ("d_min", "d_mean", "d_median", "d_max")
    fields = [T.StructField("n_pairs", T.IntegerType())]
    fields += [T.StructField(n, T.DoubleType()) for n in names]

    def profile(g):
        d = topology.distances_from_gram(g)
        upper = d[topology.np.triu_indices(len(d), 1)]
        return [(len(upper), *(float(f(upper)) for f in (
            topology.np.min, topology.np.mean, topology.np.median, topology.np.max)))]

    def by_tiles(long):
        return tiles.distance_profile(tiled(long)).withColumn("n_pairs", F.col("n_pairs").try_cast("int"))

    out = whole(spark, sf_dir, lambda grams, groups: L.over_grams(grams, KEYS, groups, fields, profile), by_tiles)
    return out.select("label", "n_pairs", *[F.round(n, 6).alias(n) for n in names])


@query(
    "step_gram",
    "WITH " + STEPS_SQL + """,
      g AS (SELECT a.label, a.i AS a, b.i AS b, list_inner_product(a.v, b.v) AS dot
            FROM steps a JOIN steps b ON a.label = b.label)
      SELECT label, CAST(max(a) AS INTEGER) AS n_steps, round(sum(CASE WHEN a = b THEN dot END), 6) AS trace,
             round(sum(dot), 6) AS total, round(sum(CASE WHEN a <> b THEN dot * dot END), 6) AS off_square,
             round(max(CASE WHEN a <> b THEN dot END), 6) AS off_max
      FROM g GROUP BY label""",
)
def step_gram_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner products of all increments of a trajectory, added over column chunks."""
    df, _, long, _ = split_by_length(vectors(spark, sf_dir), KEYS, MAX_POINTS)
    grams = step_gram(df, KEYS, ORDER, POINT, MAX_POINTS, chunk_cols=16)
    n = F.sqrt(F.size("gram")).cast("int")
    wide = grams.withColumn("n", n)
    i = F.sequence(F.lit(0), F.col("n") - 1)
    diag = F.transform(i, lambda k: F.get("gram", k * (F.col("n") + 1)))
    off = F.filter(
        F.transform("gram", lambda x, k: F.when(k % (F.col("n") + 1) != 0, x)), lambda x: x.isNotNull()
    )
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    out = wide.select(
        "label", F.col("n").alias("n_steps"), total(diag).alias("trace"), total(F.col("gram")).alias("total"),
        F.aggregate(off, F.lit(0.0), lambda s, x: s + x * x).alias("off_square"), F.array_max(off).alias("off_max"),
    )
    if long is not None:
        moves = tiles.tiled(steps_of(long, KEYS, ORDER, POINT), KEYS, ["pos"], "step")
        sums = tiles.product_sums(moves).join(moves.paths.select("path", F.col("n_points").cast("int").alias("n_steps")), "path")
        out = out.unionByName(moves.named(sums))
    return out.select("label", "n_steps", *[F.round(c, 6).alias(c) for c in ("trace", "total", "off_square", "off_max")])


@query(
    "gram_distance_identity",
    "WITH " + PAIRS_SQL + """ SELECT label, i, round(sum(d), 6) AS row_sum, round(max(d), 6) AS row_max
      FROM dist GROUP BY label, i""",
)
def gram_distance_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint distances read off the step Gram matrix, against direct ones in SQL."""
    fields = [
        T.StructField("i", T.IntegerType()), T.StructField("row_sum", T.DoubleType()),
        T.StructField("row_max", T.DoubleType()),
    ]

    def rows(g):
        d = topology.distances_from_gram(g)
        return [(i, float(r.sum()), float(r.max())) for i, r in enumerate(d)]

    def by_tiles(long):
        cut = tiled(long)
        return cut.named(tiles.point_sums(cut).select(
            "path", F.col("pos").cast("int").alias("i"), F.col("total").alias("row_sum"), F.col("far").alias("row_max")
        ))

    out = whole(spark, sf_dir, lambda grams, groups: L.over_grams(grams, KEYS, groups, fields, rows), by_tiles)
    return out.select("label", "i", F.round("row_sum", 6).alias("row_sum"), F.round("row_max", 6).alias("row_max"))


@query(
    "knn_sym_graph",
    "WITH " + PAIRS_SQL + """ SELECT DISTINCT label, least(i, j) AS src, greatest(i, j) AS dst, round(d, 6) AS w
      FROM ranked WHERE r <= 5""",
)
def knn_sym_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whole(spark, sf_dir, lambda grams, groups: L.knn_edges(grams, KEYS, groups, 5), lambda long: tiles.knn_edges(tiled(long), 5))
    return out.withColumn("w", F.round("w", 6))


COMPONENTS_SQL = """,
ks AS (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512]) AS k),
edges AS (
  SELECT label, k, i, j FROM ranked, ks WHERE r <= k
  UNION SELECT label, k, j, i FROM ranked, ks WHERE r <= k),
"""

REACH_SQL = """
reach AS (
  SELECT p.label, k.k, p.i AS root, p.i AS node FROM pts p, ks k
  UNION
  SELECT r.label, r.k, r.root, e.j FROM reach r JOIN edges e ON e.label = r.label AND e.k = r.k AND e.i = r.node),
low AS (SELECT label, k, node, min(root) AS root FROM reach GROUP BY ALL),
parts AS (SELECT label, k, count(DISTINCT root) AS n_components FROM low GROUP BY label, k)"""


@query(
    "components_at_k",
    "WITH RECURSIVE " + PAIRS_SQL + COMPONENTS_SQL.replace("[1, 2, 4, 8, 16, 32, 64, 128, 256, 512]", "[2]") + REACH_SQL
    + """ SELECT label, CAST(n_components AS INTEGER) AS n_components FROM parts""",
)
def components_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of the union graph of the two nearest neighbours."""
    def by_tiles(long):
        cut = tiled(long)
        return cut.named(tiles.grown(cut, 2, 2).select("path", F.col("initial_components").cast("int").alias("n_components")))

    return whole(
        spark, sf_dir,
        lambda grams, groups: L.graph_locality(grams, KEYS, groups, k0=2, kmax=2).select("label", F.col("initial_components").alias("n_components")),
        by_tiles,
    )


FROM_FIRST_SQL = """
reach AS (
  SELECT label, k, CAST(0 AS INTEGER) AS node FROM (SELECT DISTINCT label FROM pts), ks
  UNION
  SELECT r.label, r.k, e.j FROM reach r JOIN edges e ON e.label = r.label AND e.k = r.k AND e.i = r.node),
whole AS (
  SELECT r.label, r.k, count(*) AS reached, any_value(s.n) AS n FROM reach r
  JOIN (SELECT DISTINCT label, n FROM pts) s USING (label) GROUP BY r.label, r.k),
grown AS (SELECT label, min(k) AS k, any_value(n) AS n FROM whole WHERE reached = n GROUP BY label)"""


@query(
    "adaptive_k",
    "WITH RECURSIVE " + PAIRS_SQL + COMPONENTS_SQL + FROM_FIRST_SQL
    + """ SELECT label, CAST(least(k, n - 1) AS INTEGER) AS k_used, k > 1 AS adaptive_growth_used FROM grown""",
)
def adaptive_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubling k from 1 until the neighbour graph connects."""
    def by_tiles(long):
        cut = tiled(long)
        return cut.named(tiles.grown(cut, 1).select(
            "path", F.col("k_used").cast("int").alias("k_used"), (F.col("k_used") > F.col("k_initial")).alias("adaptive_growth_used")
        ))

    columns = ("label", "k_used", "adaptive_growth_used")
    return whole(spark, sf_dir, lambda grams, groups: L.graph_locality(grams, KEYS, groups, k0=1).select(*columns), by_tiles)


LOCALITY_NUMBERS = (
    "k_used_over_n_minus_1", "graph_density", "edge_median", "edge_p95", "edge_p99", "edge_max",
    "edge_max_over_median", "allpair_median", "allpair_p95", "allpair_p99", "allpair_max",
    "edge_max_over_allpair_median", "edge_max_over_allpair_p95", "edge_p95_over_allpair_p95",
)

LOCALITY_SQL = (
    "WITH RECURSIVE " + PAIRS_SQL + COMPONENTS_SQL.replace("[1, 2, 4, 8", "[4, 8")
    + FROM_FIRST_SQL + """,
e AS (SELECT DISTINCT x.label, least(x.i, x.j) AS a, greatest(x.i, x.j) AS b, d.d
      FROM edges x JOIN grown g ON g.label = x.label AND g.k = x.k
      JOIN dist d ON d.label = x.label AND d.i = x.i AND d.j = x.j),
es AS (SELECT label, count(*) AS edge_count, median(d) AS em, quantile_cont(d, 0.95) AS e95,
              quantile_cont(d, 0.99) AS e99, max(d) AS top FROM e GROUP BY label),
ps AS (SELECT label, median(d) AS am, quantile_cont(d, 0.95) AS a95, quantile_cont(d, 0.99) AS a99,
              max(d) AS far FROM dist WHERE i < j GROUP BY label),
m AS (SELECT label, g.n, least(4, g.n - 1) AS k_initial, least(g.k, g.n - 1) AS k_used,
             edge_count, g.n * (g.n - 1) / 2 AS possible, em, e95, e99, top, am, a95, a99, far
      FROM grown g JOIN es USING (label) JOIN ps USING (label))
SELECT label, CAST(n AS INTEGER) AS n_points, CAST(k_initial AS INTEGER) AS k_initial,
  CAST(k_used AS INTEGER) AS k_used, CAST(n - 1 AS INTEGER) AS kmax,
  round(CAST(k_used AS DOUBLE) / (n - 1), 6) AS k_used_over_n_minus_1, k_used > k_initial AS adaptive_growth_used,
  k_used = k_initial AS connected_at_initial_k, TRUE AS connected_at_final_k, CAST(1 AS INTEGER) AS final_components,
  CAST(edge_count AS INTEGER) AS edge_count, CAST(possible AS INTEGER) AS possible_edges,
  round(CAST(edge_count AS DOUBLE) / possible, 6) AS graph_density,
  round(em, 6) AS edge_median, round(e95, 6) AS edge_p95, round(e99, 6) AS edge_p99, round(top, 6) AS edge_max,
  round(top / (em + 1e-12), 6) AS edge_max_over_median, round(am, 6) AS allpair_median,
  round(a95, 6) AS allpair_p95, round(a99, 6) AS allpair_p99, round(far, 6) AS allpair_max,
  round(top / (am + 1e-12), 6) AS edge_max_over_allpair_median,
  round(top / (a95 + 1e-12), 6) AS edge_max_over_allpair_p95,
  round(e95 / (a95 + 1e-12), 6) AS edge_p95_over_allpair_p95,
  (CAST(edge_count AS DOUBLE) / possible >= 0.5 OR CAST(k_used AS DOUBLE) / (n - 1) >= 0.5) AS near_complete_graph_flag
FROM m"""
)


def locality_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole(
        spark, sf_dir, lambda grams, groups: L.graph_locality(grams, KEYS, groups, k0=4),
        lambda long: tiles.graph_locality(tiled(long), k0=4),
    )
    return rows.withColumns({c: F.round(c, 6) for c in LOCALITY_NUMBERS})


@query("locality_diagnostics", LOCALITY_SQL)
def locality_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph growth from k=4 with edge and pair-distance quantiles."""
    return locality_rows(spark, sf_dir).drop("initial_components")


@query(
    "locality_overview",
    "WITH RECURSIVE rows AS (" + LOCALITY_SQL + """)
    SELECT 'embedding' AS arch, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS optimizer,
      count(*) AS n_paths, CAST(sum(connected_at_initial_k::INTEGER) AS BIGINT) AS connected_initial_count,
      CAST(sum(adaptive_growth_used::INTEGER) AS BIGINT) AS adaptive_growth_count, min(k_used) AS k_used_min,
      CAST(median(k_used) AS DOUBLE) AS k_used_median, max(k_used) AS k_used_max,
      median(graph_density) AS graph_density_median, max(graph_density) AS graph_density_max,
      round(median(edge_max_over_median), 5) AS edge_max_over_median_median,
      max(edge_max_over_median) AS edge_max_over_median_max,
      max(edge_max_over_allpair_p95) AS edge_max_over_allpair_p95_max,
      CAST(sum(near_complete_graph_flag::INTEGER) AS BIGINT) AS near_complete_graph_count
    FROM rows GROUP BY 1, 2""",
)
def locality_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locality columns rolled up over groups of trajectories."""
    rows = locality_rows(spark, sf_dir).withColumn("arch", F.lit("embedding")).withColumn(
        "optimizer", F.when(F.col("label") % 2 == 0, "even").otherwise("odd")
    ).withColumn("seed", F.col("label"))
    out = locality_summary(settled(rows))
    return out.withColumn("edge_max_over_median_median", F.round("edge_max_over_median_median", 5))


def _squared(level: int) -> str:
    """Paths of up to 2**level edges from paths of half as many."""
    return f"""
p{level} AS (
  SELECT a.label, a.i, b.j, min(a.d + b.d) AS d FROM p{level - 1} a JOIN p{level - 1} b
    ON a.label = b.label AND a.j = b.i GROUP BY a.label, a.i, b.j)"""


GEODESIC_SQL = (
    "WITH RECURSIVE " + PAIRS_SQL
    + COMPONENTS_SQL.replace("[1, 2, 4, 8, 16, 32, 64, 128, 256, 512]", "[12, 24, 48, 96, 192, 199]") + FROM_FIRST_SQL + """,
p0 AS (
  SELECT x.label, x.i, x.j, d.d FROM edges x JOIN grown g ON g.label = x.label AND g.k = x.k
    JOIN dist d ON d.label = x.label AND d.i = x.i AND d.j = x.j
  UNION ALL SELECT label, i, i, 0.0 FROM pts),"""
    + ",".join(_squared(level) for level in range(1, 11))
    + """ SELECT p.label, p.i AS t, CAST(least(g.k, g.n - 1) AS INTEGER) AS k_used,
      round(sum(p.d) / (g.n - 1), 6) AS mean_geodesic, round(max(p.d), 6) AS max_geodesic
    FROM p10 p JOIN grown g USING (label) GROUP BY p.label, p.i, g.k, g.n"""
)


@query("geodesic_apsp", GEODESIC_SQL)
def geodesic_apsp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest-path distances on the grown graph, per checkpoint."""
    out = whole(
        spark, sf_dir, lambda grams, groups: L.geodesic_rows(grams, KEYS, groups, 12, 199),
        lambda long: tiles.geodesic_rows(tiled(long), 12, 199),
    )
    return out.withColumns({c: F.round(c, 6) for c in ("mean_geodesic", "max_geodesic")})


@query("h1_max_lifetime")
def h1_max_lifetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divided(
        spark, sf_dir, lambda grams, groups: L.lifetimes(grams, KEYS, groups, 12, 199),
        lambda long, n: L.whole_lifetimes(long, KEYS, ORDER, POINT, n, 12, 199),
    )


@query("h1_diagram")
def h1_diagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_of(spark, sf_dir)


def bars_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of all labels; a long one without any has a row with NULLs."""
    return divided(
        spark, sf_dir, lambda grams, groups: L.h1_diagram(grams, KEYS, groups),
        lambda long, n: L.whole_h1_diagram(long, KEYS, ORDER, POINT, n),
    )


@query("top_h1_bar")
def top_h1_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest bar of each trajectory and the number of bars a tenth as long."""
    life = F.col("death") - F.col("birth")
    bars = bars_of(spark, sf_dir).withColumn("life", life)
    best = bars.groupBy(*KEYS).agg(
        F.max_by(F.struct("birth", "death"), "life").alias("bar"), F.max("life").alias("top"),
        F.count("birth").alias("n_bars"),
    )
    return best.select(*KEYS, "n_bars", "bar.*", F.col("top").alias("lifetime"))


@query("full_audit_geo")
def full_audit_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched-step audit of every label: Euclidean and geodesic records."""
    cfg = whole_audit(200)
    out = ambient_audit(vectors(spark, sf_dir), KEYS, ORDER, POINT, cfg)
    return out.withColumn("decision", audit_decision(F.col("geo_formal_trigger"), "matched_step"))


@query("block_robustness")
def block_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block audits summarised per block size."""
    cfg = whole_audit(200, block_sizes=(1, 5, 10, 20))
    rows = ambient_audit(vectors(spark, sf_dir), KEYS, ORDER, POINT, cfg, targeted_settings(cfg, 50))
    return cell_summary(settled(rows), ["block_size"])


@query("neural_sensitivity")
def neural_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k x percentile grid, summarised per cell."""
    cfg = require_decisive(AuditConfig(seed_by_key=True, n_nulls=50))
    rows = ambient_audit(vectors(spark, sf_dir), KEYS, ORDER, POINT, cfg, sensitivity_settings(cfg))
    return cell_summary(settled(rows), ["k0", "pct"], with_lobs=True)


@query("projection_max_test")
def projection_max_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximum over random planes, raw and detrended, per projection budget."""
    cfg = whole_audit(39)
    records = projection_audit(
        vectors(spark, sf_dir), KEYS, ORDER, POINT, cfg, n_planes=40,
        methods=("raw", "dpca", "dtime"), budgets=(5, 10, 20, 40),
    )
    fields = ("Lobs", "null_med", "pperm", "formal_trigger")
    return wide_by_method(records, [*KEYS, "budget"], ("raw", "dpca", "dtime"), fields)


@query("archetype_decisions")
def archetype_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust, projected-only or no recurrence, from both audits of a label."""
    df, cfg = vectors(spark, sf_dir), whole_audit(39)
    geo = ambient_audit(df, KEYS, ORDER, POINT, whole_audit(200)).select("label", "geo_pperm", "geo_formal_trigger")
    proj = projection_audit(df, KEYS, ORDER, POINT, cfg, n_planes=20).select(
        "label", F.col("pperm").alias("proj_pperm"), F.col("formal_trigger").alias("proj_formal_trigger")
    )
    # Labels too short for either audit keep their row.
    return geo.join(proj, "label", "left").withColumn(
        "decision", archetype_decision(F.col("geo_formal_trigger"), F.col("proj_formal_trigger"))
    )


@query("gaussian_null")
def gaussian_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as unordered clouds against Gaussian clouds of equal moments."""
    cfg = require_decisive(AuditConfig(seed_by_key=True, n_nulls=200))
    return static_cloud_audit(vectors(spark, sf_dir), KEYS, "vec_id", POINT, cfg)


@query("pca_profile")
def pca_profile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of every label, from small factors where its Gram matrix would be too large."""
    return whole(
        spark, sf_dir, lambda grams, groups: pca_profile(grams, KEYS, groups, dims=64),
        lambda long: tall_profile(long, KEYS, POINT, dims=64),
    ).drop("cum")


@query("pca_prefix_audit")
def pca_prefix_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits of principal-component trajectories for several prefixes."""
    grams, groups = grams_of(spark, sf_dir)
    paths = pca_trajectories(grams, KEYS, groups, dims=(3, "d95"), prefixes=(25, 200))
    keys = ["label", "pca_d", "prefix_ep"]
    rows = ambient_audit(paths, keys, ["t"], "point", require_decisive(AuditConfig(seed_by_key=True, n_nulls=99)))
    return with_long(rows.withColumn("decision", audit_decision(F.col("geo_formal_trigger"), "pca_diagnostic")), spark, sf_dir)


@query("loop_control")
def loop_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pure planar loop at several amplitudes must be found."""
    df, cfg = vectors(spark, sf_dir), whole_audit(200, block_sizes=(1, 10))
    df, groups, long, n_long = split_by_length(df, KEYS, MAX_POINTS)
    kept = stride_subsample(
        df.select(*KEYS, *ORDER, as_doubles(F.col(POINT)).alias("point")), KEYS, ORDER, MAX_POINTS
    ).select(*KEYS, "position", "point")
    grams = looped_grams(
        to_chunks(kept, "point", 16), KEYS, 64, (0.1, 1.0), drift_scale=0.0, support_size=24, chunk_cols=16
    )
    keys = ["label", "amp_frac"]
    settings = targeted_settings(cfg, 50)
    life = null_lifetimes(grams, keys, settings, cfg, 2 * groups)
    if long is not None:
        looped = looped_points(whole_paths(long, KEYS, ORDER, POINT), KEYS, (0.1, 1.0), drift_scale=0.0, support_size=24)
        life = life.unionByName(whole_lifetimes(looped, keys, settings, cfg, 2 * n_long))
    return with_inference_role(audit_records(life, [*keys, *SETTING], cfg))


@query("vector_walk_calibration")
def vector_walk_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False-positive rate of the geodesic test on walks of pooled increments."""
    cfg = require_decisive(AuditConfig(seed_by_key=True, seed=20260506, n_nulls=39, block_sizes=(1, 5)))
    rows = calibrate(vectors(spark, sf_dir), KEYS, ORDER, POINT, cfg, n_calib=100, n_steps=40)
    return calibration_summary(settled(rows))
