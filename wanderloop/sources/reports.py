"""Small written reports: run metadata, dependence text, LaTeX tables.

Everything here is about tables that were already reduced to a few rows; their
size is checked before a row comes to the driver.
"""

from __future__ import annotations

import json
import platform
from collections.abc import Mapping, Sequence
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanderloop.operators.autocorrelation import persistence_differences, window_means
from wanderloop.operators.summaries import require_short

REPORT_ROWS = 500
SPOT_LAGS = (1, 5, 10, 20)
PERSISTENCE_THRESHOLD = 0.10


def small_rows(df: DataFrame, most: int = REPORT_ROWS) -> list:
    """Rows of a report table, refused beyond ``most``."""
    require_short(df, [], most)
    return list(df.toLocalIterator())


def write_metadata(
    spark: SparkSession, path: str, config, source_manifest: DataFrame | None = None, **extra
) -> None:
    """Run settings, versions and input checksums as JSON."""
    settings = asdict(config) if is_dataclass(config) else dict(config)
    head = {"config": settings, "python": platform.python_version(), "platform": platform.platform(),
            "spark": spark.version, **extra}
    df = spark.createDataFrame([(json.dumps(head, default=list),)], "run string").withColumn(
        "created_at", F.current_timestamp()
    )
    df.coalesce(1).write.mode("overwrite").json(f"{path}/run")
    if source_manifest is not None:
        source_manifest.write.mode("overwrite").json(f"{path}/sources")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Nested metadata written as one JSON object per file."""
    return spark.read.option("multiLine", True).json(path)


def dependence_report(acf: DataFrame, group: str, unit: Sequence[str], title: str) -> str:
    """Fixed-width text: spot lags, window means, pairwise differences, next step."""
    spots = small_rows(
        acf.filter(F.col("lag").isin(*SPOT_LAGS)).groupBy(group, "lag").agg(
            F.bround(F.avg("acf_mag"), 4).alias("mag"), F.bround(F.avg("cos_sim"), 4).alias("cos")
        )
    )
    windows = window_means(acf, [group, *unit])
    names = ("C1_10", "C11_20", "C1_20")
    means = small_rows(
        windows.groupBy(group).agg(*[F.bround(F.avg(c), 4).alias(c) for c in names]).orderBy(group)
    )
    at = {(r[group], r["lag"]): r for r in spots}
    lines = [f"TEMPORAL DEPENDENCE REPORT -- {title}", "Diagnostic only; does not establish recurrence.", ""]
    lines.append(f"{'group':<18}" + "".join(f"{f'lag={lag} mag/cos':>20}" for lag in SPOT_LAGS))
    for row in means:
        cells = []
        for lag in SPOT_LAGS:
            r = at.get((row[group], lag))
            cells.append(f"{_signed(r['mag'], 3)}/{_signed(r['cos'], 3)}" if r else "N/A")
        lines.append(f"{row[group]!s:<18}" + "".join(f"{c:>20}" for c in cells))
    lines += ["", "mean cosine over lag windows"]
    for row in means:
        lines.append(f"{row[group]!s:<18}" + "".join(f"{n} {_signed(row[n], 4):>10}   " for n in names).rstrip())
    lines += ["", "pairwise differences of C1_20"]
    for row in small_rows(persistence_differences(windows, group), 10 * REPORT_ROWS):
        lines.append(f"{row[f'{group}_a']} vs {row[f'{group}_b']}: {_signed(row['diff'], 4)}")
    strong = any(r["C1_20"] is not None and abs(r["C1_20"]) > PERSISTENCE_THRESHOLD for r in means)
    lines += ["", "directional persistence found: a further stage may be useful" if strong
              else "step directions look exchangeable: further stages are optional"]
    return "\n".join(lines)


def _signed(value: float | None, digits: int) -> str:
    return "N/A" if value is None else f"{value:+.{digits}f}"


def latex_table(df: DataFrame, columns: Mapping[str, str], digits: int = 4) -> str:
    """Renamed columns of a report table as a LaTeX tabular."""
    kinds = dict(df.dtypes)
    cells = [
        F.format_string(f"%.{digits}f", F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string")
        for c in columns
    ]
    rows = small_rows(df.select(F.concat_ws(" & ", *[F.coalesce(x, F.lit("")) for x in cells]).alias("line")))
    escape = lambda s: s.replace("_", r"\_")
    body = [escape(r["line"]) + r" \\" for r in rows]
    head = " & ".join(escape(v) for v in columns.values()) + r" \\"
    return "\n".join(
        [r"\begin{tabular}{" + "l" * len(columns) + "}", r"\toprule", head, r"\midrule", *body,
         r"\bottomrule", r"\end{tabular}"]
    )


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
