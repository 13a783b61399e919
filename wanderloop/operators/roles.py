"""Inferential role of result rows and the one formal rule applied to all of them.

Whether a rule applies to a table at all depends on its columns and is decided
on the driver from the schema; the rules themselves are column expressions.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wanderloop.functions.columns import flag, is_true_text, number_or_null

# Column names looked for, by priority, ignoring case.
P_VALUE_COLUMNS = (
    "geo_pperm", "pperm", "p_perm", "perm_p", "p_value", "pvalue", "geo_pnull", "pnull",
)
FORMAL_COLUMNS = ("geo_formal_trigger", "formal_trigger")
# Column names looked for in alphabetical order.
BLOCK_COLUMNS = ("b", "block", "block_size")
ROLE_COLUMNS = (
    "analysis_role", "analysis_type", "inference_role", "inferential_role", "role", "test_role",
)
FORMAL_FLAG_COLUMNS = ("formal_family", "is_formal_inference", "is_primary_test")
SENSITIVITY_COLUMNS = ("k_value", "filtration_pct", "threshold_pct")
SUMMARY_KEYS = (
    "source_csv", "arch", "architecture", "model", "optimizer", "seed", "metric", "k", "k_value",
    "pct", "filtration_pct", "block_size_normalized", "n_nulls", "n_nulls_used",
    "analysis_role_normalized",
)

UNCLASSIFIED = "unclassified"
FORMAL = "formal_matched_step"
BLOCK = "block_diagnostic"
PROJECTION = "projection_diagnostic"
SENSITIVITY = "metric_sensitivity"
CONTROL = "control_or_benchmark"

# Patterns in rising precedence, the last match wins.
ROLE_TEXT_PATTERNS = (
    ("block", BLOCK),
    ("projection|pca", PROJECTION),
    ("sensitivity|threshold|off.default|robust", SENSITIVITY),
    ("control|synthetic|benchmark|manifold|archetype|acf", CONTROL),
    ("formal.*matched|matched.*formal|primary.*matched|main.*neural|neural.*fullspace", FORMAL),
)
SOURCE_PATTERNS = (
    ("block", BLOCK),
    ("projection|pca|acf", PROJECTION),
    ("sensitivity|threshold|k_sensitivity|robustness|off_default", SENSITIVITY),
    ("synthetic|control|benchmark|manifold|archetype|helix|circle|curvature|sanity", CONTROL),
    (
        "main_paper/table_main_topology|neural_fullspace|fullspace_audit|main_neural|neural_audit",
        FORMAL,
    ),
)
CONTROL_SOURCE = "synthetic|control|benchmark|manifold|archetype|helix|circle|curvature|sanity"
ALPHA = 0.05


def find_column(columns: Iterable[str], wanted: Sequence[str]) -> str | None:
    """First wanted name present, ignoring case; of equal names the last column."""
    by_name = {c.lower(): c for c in columns}
    return next((by_name[w] for w in wanted if w in by_name), None)


def last_match(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    role = F.lit(UNCLASSIFIED)
    for pattern, label in patterns:
        role = F.when(flag(text.rlike(pattern)), F.lit(label)).otherwise(role)
    return role


def clean_text(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


@dataclass(frozen=True)
class RuleInputs:
    """What the rules read: the cells of a row and which columns its table has.

    For a DataFrame with real columns presence is known on the driver and the
    flags are literals, which Catalyst folds away. For rows kept as maps, from
    many files with different headers, they are columns.
    """

    path: Column
    role_text: Column
    has_role: Column
    space: Column
    has_space: Column
    has_sensitivity: Column
    formal_flag: Column
    has_formal_flag: Column
    block: Column
    has_block: Column
    p_name: Column
    p_value: Column
    stated_name: Column
    stated: Column


def inputs_of_columns(df: DataFrame, source: str = "source_csv") -> RuleInputs:
    def cell(name: str | None) -> Column:
        return F.col(f"`{name}`").cast("string") if name else F.lit(None).cast("string")

    have = df.columns
    role, flag_col = find_column(have, ROLE_COLUMNS), find_column(have, FORMAL_FLAG_COLUMNS)
    block, p = find_column(have, BLOCK_COLUMNS), find_column(have, P_VALUE_COLUMNS)
    stated = find_column(have, FORMAL_COLUMNS)
    space = "space" if "space" in have else None
    return RuleInputs(
        path=cell(source if source in have else None),
        role_text=cell(role), has_role=F.lit(role is not None),
        space=cell(space), has_space=F.lit(space is not None),
        has_sensitivity=F.lit(any(c in have for c in SENSITIVITY_COLUMNS)),
        formal_flag=cell(flag_col), has_formal_flag=F.lit(flag_col is not None),
        block=cell(block), has_block=F.lit(block is not None),
        p_name=F.lit(p).cast("string"), p_value=cell(p),
        stated_name=F.lit(stated).cast("string"), stated=cell(stated),
    )


def inputs_of_maps(values: str, names: str, source: str = "source_csv") -> RuleInputs:
    """Inputs for rows kept as a map of cells beside the header of their file."""
    def found(wanted: Sequence[str]) -> Column:
        # Of equal names the last column counts.
        return F.coalesce(*[_last_named(F.col(names), w) for w in wanted])

    def cell(name: Column) -> Column:
        return F.when(name.isNotNull(), F.try_element_at(F.col(values), name))

    role, flag_col, block = found(ROLE_COLUMNS), found(FORMAL_FLAG_COLUMNS), found(BLOCK_COLUMNS)
    p, stated = found(P_VALUE_COLUMNS), found(FORMAL_COLUMNS)
    return RuleInputs(
        path=F.col(source),
        role_text=cell(role), has_role=role.isNotNull(),
        space=F.try_element_at(F.col(values), F.lit("space")),
        has_space=F.array_contains(names, "space"),
        has_sensitivity=F.arrays_overlap(F.col(names), F.array(*[F.lit(c) for c in SENSITIVITY_COLUMNS])),
        formal_flag=cell(flag_col), has_formal_flag=flag_col.isNotNull(),
        block=cell(block), has_block=block.isNotNull(),
        p_name=p, p_value=cell(p), stated_name=stated, stated=cell(stated),
    )


def _last_named(names: Column, wanted: str) -> Column:
    same = F.filter(names, lambda n: F.lower(n) == wanted)
    return F.when(F.size(same) > 0, F.get(same, F.size(same) - 1))


def role_of(x: RuleInputs) -> Column:
    """Role of each row: later rules override earlier ones."""
    path = F.lower(F.coalesce(x.path, F.lit("")))
    role = F.when(x.has_role, last_match(clean_text(x.role_text), ROLE_TEXT_PATTERNS)).otherwise(
        last_match(path, SOURCE_PATTERNS)
    )
    space = clean_text(x.space)
    role = (
        F.when(flag(x.has_space & (space == "full")), F.lit(FORMAL))
        .when(flag(x.has_space & (space == "pca")), F.lit(PROJECTION))
        .otherwise(role)
    )
    role = F.when(flag(x.has_sensitivity), F.lit(SENSITIVITY)).otherwise(role)
    formal = is_true_text(x.formal_flag)
    role = (
        F.when(x.has_formal_flag & formal, F.lit(FORMAL))
        .when(x.has_formal_flag & (role == FORMAL), F.lit(UNCLASSIFIED))
        .otherwise(role)
    )
    role = F.when(path.rlike(CONTROL_SOURCE), F.lit(CONTROL)).otherwise(role)
    is_block = path.rlike("block") | flag(number_or_null(x.block) > 1)
    return F.when(x.has_block & is_block, F.lit(BLOCK)).otherwise(role)


def analysis_role(df: DataFrame, source: str = "source_csv") -> Column:
    return role_of(inputs_of_columns(df, source))


def with_formal_rule(df: DataFrame, x: RuleInputs) -> DataFrame:
    """Append the normalised p-value, role and trigger columns."""
    # Inputs become columns first, so that each is looked up once per row.
    staged = {f"_in_{f.name}": getattr(x, f.name) for f in fields(x)}
    df = df.withColumns(staged)
    x = RuleInputs(**{f.name: F.col(f"_in_{f.name}") for f in fields(x)})
    p, block = number_or_null(x.p_value), number_or_null(x.block)
    df = df.withColumns(
        {
            "pvalue_source_column": x.p_name,
            "pperm_normalized": p,
            # A missing p-value in a table that has them is no trigger; a table
            # without them leaves the question open.
            "raw_pvalue_trigger": F.when(x.p_name.isNotNull(), flag(p < ALPHA)),
            "block_size_normalized": block,
            "is_block_gt1": flag(block > 1),
            "analysis_role_normalized": role_of(x),
            "source_formal_column": x.stated_name,
            "source_formal_trigger_raw": x.stated,
        }
    ).drop(*staged)
    role, fired = F.col("analysis_role_normalized"), flag(F.col("raw_pvalue_trigger"))
    triggered = fired & (role == FORMAL)
    return df.withColumns(
        {
            "is_formal_matched_step_row": role == FORMAL,
            "block_null_diagnostic": fired & (role == BLOCK),
            "formal_trigger_normalized": triggered,
            "source_formal_trigger_mismatch": F.col("source_formal_column").isNotNull()
            & F.col("pperm_normalized").isNotNull()
            & (is_true_text(F.col("source_formal_trigger_raw")) != triggered),
        }
    )


def normalize_formal_rule(df: DataFrame, source: str = "source_csv") -> DataFrame:
    return with_formal_rule(df, inputs_of_columns(df, source))


def _counted(c: str) -> Column:
    return F.sum(flag(F.col(c)).cast("long"))


INVENTORY_COUNTS = {
    "raw_pvalue_triggers": "raw_pvalue_trigger",
    "formal_matched_step_triggers": "formal_trigger_normalized",
    "block_diagnostic_triggers": "block_null_diagnostic",
    "source_formal_trigger_mismatches": "source_formal_trigger_mismatch",
}


def release_inventory(normalized: DataFrame, files: DataFrame) -> DataFrame:
    """One row per result table: rows, columns, p-value column and trigger counts.

    ``files`` has (source_csv, columns); a table without rows is listed too.
    """
    unclassified = (F.col("analysis_role_normalized") == UNCLASSIFIED).cast("long")
    counts = normalized.groupBy("source_csv").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max("pvalue_source_column").alias("pvalue_column"),
        *[_counted(c).alias(name) for name, c in INVENTORY_COUNTS.items()],
        F.sum(unclassified).alias("unclassified_rows"),
    )
    out = files.select("source_csv", "columns").join(counts, "source_csv", "left")
    numbers = ["n_rows", *INVENTORY_COUNTS, "unclassified_rows"]
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers})


def trigger_summary(normalized: DataFrame) -> DataFrame:
    """Trigger counts by whichever summary keys exist; NULL keys are a group."""
    keys = [c for c in SUMMARY_KEYS if c in normalized.columns] or ["source_csv"]
    return normalized.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        _counted("raw_pvalue_trigger").alias("raw_pvalue_triggers"),
        _counted("formal_trigger_normalized").alias("formal_triggers"),
        _counted("block_null_diagnostic").alias("block_diagnostic_triggers"),
        _counted("source_formal_trigger_mismatch").alias("source_formal_trigger_mismatches"),
    )
