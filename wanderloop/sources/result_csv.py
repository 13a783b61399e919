"""Result tables kept as many CSV files with differing headers.

All files are read by one Spark job, large ones by many tasks. A row becomes a map of its cells beside
the header of its file, so files need not share columns, and the rules of
``roles`` run over all of them at once. Columns are spread out at the end.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wanderloop.operators.roles import (
    SUMMARY_KEYS, inputs_of_maps, release_inventory, trigger_summary, with_formal_rule,
)
from wanderloop.sources.files import dealt, empty_files, listed, open_file, ranges

# Cell texts read as missing.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
ROW_SCHEMA = (
    "path string, row_no long, names array<string>, values map<string,string>, problem string"
)

SPLIT_BYTES = 32 << 20
PIECE = 1 << 20
ROWS_AT_ONCE = 10_000
NEWLINE, QUOTE = ord("\n"), ord('"')
OPENS_AFTER = np.frombuffer(b',\n\r"', np.uint8)
SCANNED = pa.schema([
    *[(c, pa.string() if c == "path" else pa.int64()) for c in ("path", "length", "at", "start", "stop")],
    ("odd", pa.int32()), ("first_out", pa.int64()), ("first_in", pa.int64()), ("stray_out", pa.bool_()), ("stray_in", pa.bool_()),
])


def header_names(cells: Sequence[str]) -> list[str]:
    """Column names with blanks numbered and repeats suffixed .1, .2, ..."""
    seen: dict[str, int] = {}
    names = []
    for i, cell in enumerate(cells):
        name = cell or f"Unnamed: {i}"
        again = seen.get(name, 0)
        seen[name] = again + 1
        names.append(f"{name}.{again}" if again else name)
    return names


class ByteRange(io.RawIOBase):
    """Bytes ``start`` to ``stop`` of an open file as a stream."""

    def __init__(self, file: pa.NativeFile, start: int, stop: int):
        self.file, self.place, self.stop = file, start, stop

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        piece = self.file.read_at(min(len(into), self.stop - self.place), self.place) if self.place < self.stop else b""
        into[:len(piece)] = piece
        self.place += len(piece)
        return len(piece)


def records_of(file: pa.NativeFile, start: int, stop: int) -> "csv.reader":
    """Records of a range that begins and ends between records, read piece by piece."""
    text = io.TextIOWrapper(io.BufferedReader(ByteRange(file, start, stop), PIECE), encoding="utf-8", newline="")
    return csv.reader(text, strict=True)


def scan_range(file: pa.NativeFile, start: int, stop: int) -> dict:
    """What a range holds if it begins outside quotes (``_out``) and if it begins inside (``_in``).

    ``odd``: whether it changes the state; ``first``: where its first new record begins; ``stray``:
    whether a quote opens within a field. Such a quote is plain text, so that quotes do not tell the state.
    """
    before = file.read_at(1, start - 1)[0] if start else NEWLINE
    seen, first, stray = 0, [None, None], [False, False]
    for place in range(start, stop, PIECE):
        piece = np.frombuffer(file.read_at(min(PIECE, stop - place), place), np.uint8)
        quotes, lines = np.flatnonzero(piece == QUOTE), np.flatnonzero(piece == NEWLINE)
        # Quotes and line ends with an even number of quotes before them stand outside, if the range begins outside.
        even = (np.arange(len(quotes)) + seen) % 2 == 0
        previous = np.where(quotes > 0, piece[quotes - 1], before)
        within = ~np.isin(previous, OPENS_AFTER)
        line_even = (np.searchsorted(quotes, lines) + seen) % 2 == 0
        for state, (opening, ending) in enumerate(((even, line_even), (~even, ~line_even))):
            stray[state] |= bool((opening & within).any())
            if first[state] is None and ending.any():
                first[state] = place + int(lines[np.argmax(ending)]) + 1
        seen += len(quotes)
        before = piece[-1]
    return {
        "odd": seen % 2, "first_out": first[0], "first_in": first[1], "stray_out": stray[0], "stray_in": stray[1],
    }


def segments_of(splits: DataFrame) -> DataFrame:
    """(path, length, start, stop, alone) of ranges between records that cover every file.

    Only totals of the ranges meet by file: a running sum of quotes tells for each whether it
    begins inside quotes. A file with a stray quote is one segment. ``alone``: a file of one small segment.
    """
    def scan(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["path"]) as file:
                    yield pa.RecordBatch.from_pylist([row | scan_range(file, row["start"], row["stop"])], schema=SCANNED)

    several = splits.filter(F.col("start") > 0).select("path").distinct()
    scanned = dealt(splits.join(several, "path", "left_semi"), "path", "at").mapInArrow(
        scan,
        "path string, length long, at long, start long, stop long, odd int, "
        "first_out long, first_in long, stray_out boolean, stray_in boolean",
    )
    ordered = Window.partitionBy("path").orderBy("at")
    inside = F.coalesce(F.sum("odd").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    state = scanned.withColumn("inside", inside).withColumn(
        "begin", F.when(F.col("at") == 0, F.lit(0)).when(F.col("inside"), F.col("first_in")).otherwise(F.col("first_out"))
    ).withColumn("stray", F.max(F.when(F.col("inside"), F.col("stray_in")).otherwise(F.col("stray_out"))).over(
        Window.partitionBy("path")
    ))
    kept = state.filter(F.when(F.col("stray"), F.col("at") == 0).otherwise(F.col("begin") < F.col("length")))
    cut = kept.select(
        "path", "length", F.col("begin").alias("start"),
        F.coalesce(F.lead("begin").over(ordered), F.col("length")).alias("stop"), F.lit(False).alias("alone"),
    )
    whole = splits.join(several, "path", "left_anti").select(
        "path", "length", "start", "stop", F.lit(True).alias("alone")
    )
    return whole.unionByName(cut)


def parse_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments to row maps; row_no -1 stands for the file itself.

    Rows count from the segment's first byte, so their numbers grow along a file, and from 0 in a file
    of one segment. A problem takes the place of what is left of its segment.
    """
    missing = set(MISSING)
    columns = ["path", "row_no", "names", "values", "problem"]
    for pdf in batches:
        for path, length, start, stop, alone in pdf.itertuples(index=False):
            rows, number = [], start
            with open_file(path) as file:
                try:
                    lines = records_of(file, start, stop)
                    names = header_names(next(lines if start == 0 else records_of(file, 0, length)))
                    if start == 0:
                        rows.append((path, -1, names, None, None))
                    for cells in lines:
                        if not cells:
                            continue
                        if len(cells) > len(names):
                            raise ValueError(f"line {lines.line_num} from byte {start} has more cells than the header")
                        kept = {n: c for n, c in zip(names, cells) if c not in missing}
                        rows.append((path, number, names, kept, None))
                        number += 1
                        if len(rows) >= ROWS_AT_ONCE and not alone:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                except (csv.Error, UnicodeDecodeError, StopIteration, ValueError) as exc:
                    rows = [(path, -1, None, None, f"{type(exc).__name__}: {exc}")]
            if rows:
                yield pd.DataFrame(rows, columns=columns)


def scan_result_csvs(
    spark: SparkSession, base: str, roots: Sequence[str], split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """(source_csv, row_no, names, values, problem) of all files below the roots.

    A file of at most ``split_bytes`` is parsed by one task; a larger one is cut between records,
    quoted line ends included. A file with a problem anywhere gives that problem alone: large files are
    gone through once more for it. A file without any byte is a problem, too.
    """
    base = base.rstrip("/")
    paths = [f"{base}/{r}" for r in roots]
    files = listed(spark, paths, "*.csv").dropDuplicates(["path"])
    segments = dealt(segments_of(ranges(files, split_bytes)), "path", "start")

    def parsed(some: DataFrame) -> DataFrame:
        return some.mapInPandas(parse_segments, ROW_SCHEMA)

    large = segments.filter(~F.col("alone"))
    problems = (
        parsed(large).filter("problem IS NOT NULL").groupBy("path").agg(F.min("problem").alias("problem"))
        .select("path", F.lit(-1).cast("long").alias("row_no"), F.lit(None).cast("array<string>").alias("names"),
                F.lit(None).cast("map<string,string>").alias("values"), "problem")
    )
    void = empty_files(listed(spark, paths, "*.csv")).select(
        "path", F.lit(-1).cast("long").alias("row_no"), F.lit(None).cast("array<string>").alias("names"),
        F.lit(None).cast("map<string,string>").alias("values"), F.lit("StopIteration: ").alias("problem"),
    )
    rows = parsed(segments.filter("alone")).unionByName(void)
    if files.filter(F.col("length") > split_bytes).count():
        good = parsed(large).filter("problem IS NULL").join(problems.select("path"), "path", "left_anti")
        rows = rows.unionByName(good).unionByName(problems)
    rel = F.substr(F.regexp_replace("path", r"^file:/+", "/"), F.lit(len(base) + 2))
    return rows.select(rel.alias("source_csv"), "row_no", "names", "values", "problem")


def column_names(rows: DataFrame) -> list[str]:
    """All column names in order of first appearance by path; one name per header cell."""
    seen = (
        rows.filter("row_no = -1 AND problem IS NULL")
        .select("source_csv", F.posexplode("names").alias("at", "name"))
        .groupBy("name").agg(F.min(F.struct("source_csv", "at")).alias("first"))
        .orderBy("first")
    )
    return [r["name"] for r in seen.select("name").toLocalIterator()]


def build_release(
    spark: SparkSession, base: str, roots: Sequence[str], allow_empty: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(inventory, normalised rows of all files, trigger summary)."""
    scanned = scan_result_csvs(spark, base, roots).persist(StorageLevel.MEMORY_AND_DISK)
    good = scanned.filter("problem IS NULL")
    files = good.filter("row_no = -1").select(
        "source_csv", F.array_join("names", ";").alias("columns")
    )
    names = column_names(scanned)
    if not names:
        if allow_empty:
            return None
        raise FileNotFoundError(f"no readable CSV files under {base}")
    rows = with_formal_rule(good.filter("row_no >= 0"), inputs_of_maps("values", "names"))
    ruled = [c for c in rows.columns if c not in scanned.columns]
    taken = {"source_csv", *(c.lower() for c in ruled)}
    spellings: dict[str, list[str]] = {}
    for name in names:
        spellings.setdefault(name.lower(), []).append(name)
    # Spark ignores case in column names: spellings of one name share a column.
    cells = [
        F.coalesce(*[F.try_element_at(F.col("values"), F.lit(n)) for n in same]).alias(same[0])
        for lower, same in spellings.items() if lower not in taken
    ]
    everything = rows.select("source_csv", *cells, *ruled)
    keys = [
        F.try_element_at(F.col("values"), F.lit(k)).alias(k)
        for k in SUMMARY_KEYS if k in names and k not in taken
    ]
    summary = trigger_summary(rows.select("source_csv", *keys, *ruled))
    return release_inventory(rows, files), everything, summary


def unreadable_files(spark: SparkSession, base: str, roots: Sequence[str]) -> DataFrame:
    return scan_result_csvs(spark, base, roots).filter("problem IS NOT NULL").select("source_csv", "problem")


def typed(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Named text columns read as the given types; unreadable cells become NULL."""
    return df.withColumns({c: F.col(f"`{c}`").try_cast(t) for c, t in schema.items() if c in df.columns})


def read_result_csv(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """Files that share one header; blanks become NULL, never NaN."""
    reader = spark.read.option("header", True).option("nullValue", "")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV at the edge; ``single`` is for report tables of a few rows."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)
