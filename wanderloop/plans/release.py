"""Result-table warehouse: roles, the formal rule, inventory and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanderloop.operators import roles as R
from wanderloop.operators.summaries import union_by_name
from wanderloop.plans.registry import query, table
from wanderloop.sources.manifests import text_manifest


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as rows of result files: paths, spaces, blocks and p-values."""
    k = F.regexp_extract("props", r'"k": (\d+)', 1).try_cast("long")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") == "view", "results/block_robustness/rows.csv")
        .when(F.col("event_type") == "click", "exp4_results/main_paper/table_main_topology.csv")
        .when(F.col("event_type") == "purchase", "results/k_sensitivity/rows.csv")
        .when(F.col("event_type") == "signup", "results/circle_noise/rows.csv")
        .otherwise("acf_results/stage1/rows.csv").alias("source_csv"),
        F.when(F.col("user_id") % 3 == 0, "full").when(F.col("user_id") % 3 == 1, " PCA ").alias("space"),
        F.when(k % 5 == 0, "5").when(k % 5 == 1, "n/a").otherwise("1").alias("block_size"),
        F.when(F.col("user_id") % 7 == 0, "True").when(F.col("user_id") % 7 < 3, "no")
        .otherwise("YES ").alias("is_formal_inference"),
        F.when(F.col("value") < 1, "bad").otherwise((F.col("value") / 500).cast("string")).alias("geo_pperm"),
        F.when(F.col("value") < 40, "True").otherwise("False").alias("geo_formal_trigger"),
        F.col("event_type").alias("arch"),
    )


ROWS_SQL = """rows AS (
  SELECT event_id, event_type AS arch,
    CASE event_type WHEN 'view' THEN 'results/block_robustness/rows.csv'
      WHEN 'click' THEN 'exp4_results/main_paper/table_main_topology.csv'
      WHEN 'purchase' THEN 'results/k_sensitivity/rows.csv'
      WHEN 'signup' THEN 'results/circle_noise/rows.csv' ELSE 'acf_results/stage1/rows.csv' END AS source_csv,
    CASE user_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN ' PCA ' END AS space,
    CASE k % 5 WHEN 0 THEN '5' WHEN 1 THEN 'n/a' ELSE '1' END AS block_size,
    CASE WHEN user_id % 7 = 0 THEN 'True' WHEN user_id % 7 < 3 THEN 'no' ELSE 'YES ' END AS is_formal_inference,
    CASE WHEN value < 1 THEN NULL ELSE value / 500 END AS p, value < 40 AS stated
  FROM (SELECT *, TRY_CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) AS k FROM events)),
based AS (
  SELECT *, CASE
      WHEN regexp_matches(source_csv, 'main_paper/table_main_topology|neural_fullspace|fullspace_audit|main_neural|neural_audit') THEN 'formal_matched_step'
      WHEN regexp_matches(source_csv, 'synthetic|control|benchmark|manifold|archetype|helix|circle|curvature|sanity') THEN 'control_or_benchmark'
      WHEN regexp_matches(source_csv, 'sensitivity|threshold|k_sensitivity|robustness|off_default') THEN 'metric_sensitivity'
      WHEN regexp_matches(source_csv, 'projection|pca|acf') THEN 'projection_diagnostic'
      WHEN regexp_matches(source_csv, 'block') THEN 'block_diagnostic' ELSE 'unclassified' END AS r0
  FROM rows),
spaced AS (
  SELECT *, CASE WHEN lower(trim(space)) = 'full' THEN 'formal_matched_step'
                 WHEN lower(trim(space)) = 'pca' THEN 'projection_diagnostic' ELSE r0 END AS r1 FROM based),
flagged AS (
  SELECT *, CASE WHEN lower(trim(is_formal_inference)) IN ('true', '1', 'yes', 'y', 'formal', 'primary') THEN 'formal_matched_step'
                 WHEN r1 = 'formal_matched_step' THEN 'unclassified' ELSE r1 END AS r2 FROM spaced),
roled AS (
  SELECT *, CASE WHEN regexp_matches(source_csv, 'block') OR coalesce(TRY_CAST(block_size AS DOUBLE) > 1, FALSE) THEN 'block_diagnostic'
                 WHEN regexp_matches(source_csv, 'synthetic|control|benchmark|manifold|archetype|helix|circle|curvature|sanity')
                   THEN 'control_or_benchmark' ELSE r2 END AS role FROM flagged),
normal AS (
  SELECT *, coalesce(p < 0.05, FALSE) AS raw, TRY_CAST(block_size AS DOUBLE) AS b,
         coalesce(p < 0.05, FALSE) AND role = 'formal_matched_step' AS formal,
         coalesce(p < 0.05, FALSE) AND role = 'block_diagnostic' AS blocky FROM roled)"""


@query(
    "role_rules",
    "WITH " + ROWS_SQL + """ SELECT event_id, role AS analysis_role_normalized,
        role = 'formal_matched_step' AS is_formal_matched_step_row FROM roled""",
)
def role_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = result_rows(spark, sf_dir)
    role = R.analysis_role(rows)
    return rows.select(
        "event_id", role.alias("analysis_role_normalized"),
        (role == R.FORMAL).alias("is_formal_matched_step_row"),
    )


@query(
    "formal_rule",
    "WITH " + ROWS_SQL + """ SELECT event_id, p AS pperm_normalized, raw AS raw_pvalue_trigger,
        b AS block_size_normalized, coalesce(b > 1, FALSE) AS is_block_gt1, role AS analysis_role_normalized,
        formal AS formal_trigger_normalized, blocky AS block_null_diagnostic,
        p IS NOT NULL AND stated <> formal AS source_formal_trigger_mismatch FROM normal""",
)
def formal_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One p-value rule and role for every row, with mismatches to the stated flag."""
    return R.normalize_formal_rule(result_rows(spark, sf_dir)).select(
        "event_id", "pperm_normalized", "raw_pvalue_trigger", "block_size_normalized", "is_block_gt1",
        "analysis_role_normalized", "formal_trigger_normalized", "block_null_diagnostic",
        "source_formal_trigger_mismatch",
    )


@query(
    "role_text_rules",
    """SELECT conv_id, turn, CASE
          WHEN regexp_matches(t, 'formal.*matched|matched.*formal|primary.*matched|main.*neural|neural.*fullspace') THEN 'formal_matched_step'
          WHEN regexp_matches(t, 'control|synthetic|benchmark|manifold|archetype|acf') THEN 'control_or_benchmark'
          WHEN regexp_matches(t, 'sensitivity|threshold|off.default|robust') THEN 'metric_sensitivity'
          WHEN regexp_matches(t, 'projection|pca') THEN 'projection_diagnostic'
          WHEN regexp_matches(t, 'block') THEN 'block_diagnostic' ELSE 'unclassified' END AS analysis_role
       FROM (SELECT conv_id, turn, lower(trim(CASE role WHEN 'user' THEN ' Matched-step FORMAL '
               WHEN 'assistant' THEN 'Block PCA' ELSE role END)) AS t FROM conversations)""",
)
def role_text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated role texts through the text patterns."""
    worded = F.when(F.col("role") == "user", " Matched-step FORMAL ").when(
        F.col("role") == "assistant", "Block PCA"
    ).otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", R.last_match(R.clean_text(worded), R.ROLE_TEXT_PATTERNS).alias("analysis_role")
    )


@query(
    "trigger_rollup",
    "WITH " + ROWS_SQL + """ SELECT source_csv, arch, b AS block_size_normalized, role AS analysis_role_normalized,
        count(*) AS n_rows, CAST(sum(raw::INTEGER) AS BIGINT) AS raw_pvalue_triggers,
        CAST(sum(formal::INTEGER) AS BIGINT) AS formal_triggers,
        CAST(sum(blocky::INTEGER) AS BIGINT) AS block_diagnostic_triggers,
        CAST(sum((p IS NOT NULL AND stated <> formal)::INTEGER) AS BIGINT) AS source_formal_trigger_mismatches
      FROM normal GROUP BY ALL""",
)
def trigger_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trigger_summary(R.normalize_formal_rule(result_rows(spark, sf_dir)))


def _inventory_sql(name: str, columns: str) -> str:
    return (
        f"SELECT '{name}' AS source_csv, '{columns}' AS columns, count(*) AS n_rows, CAST(NULL AS VARCHAR) AS pvalue_column, "
        "CAST(0 AS BIGINT) AS raw_pvalue_triggers, CAST(0 AS BIGINT) AS formal_matched_step_triggers, "
        "CAST(0 AS BIGINT) AS block_diagnostic_triggers, count(*) AS unclassified_rows, "
        f"CAST(0 AS BIGINT) AS source_formal_trigger_mismatches FROM {name}"
    )


INVENTORY = {
    "orders": "o_orderkey;o_custkey;o_orderstatus;o_totalprice;o_orderdate;o_orderpriority",
    "customer": "c_custkey;c_name;c_nationkey;c_acctbal;c_mktsegment",
    "labels": "doc_id;quality;toxic",
    "nation": "n_nationkey;n_name;n_regionkey",
}


@query("warehouse_inventory", " UNION ALL ".join(_inventory_sql(n, c) for n, c in INVENTORY.items()))
def warehouse_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per table: columns, rows and trigger counts."""
    rows, headers = [], []
    for name in INVENTORY:
        raw = table(spark, sf_dir, name)
        headers.append((name, ";".join(raw.columns)))
        ruled = R.normalize_formal_rule(raw.withColumn("source_csv", F.lit(name)))
        rows.append(ruled.drop(*raw.columns))
    files = spark.createDataFrame(headers, "source_csv string, columns string")
    return R.release_inventory(union_by_name(rows), files)


@query(
    "manifest_texts",
    """SELECT 'documents/' || doc_id AS relative_path, sha256(text) AS sha256,
              CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents""",
)
def manifest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("documents/"), F.col("doc_id").cast("string"))
    return text_manifest(table(spark, sf_dir, "documents"), name, "text")


@query("manifest_files")
def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of the table files themselves."""
    from wanderloop.sources.manifests import file_manifest

    return file_manifest(spark, sf_dir)
