"""Files of any size as rows of byte ranges.

Spark lists the files (any pattern, folder or scheme its file systems know) and only their
paths and lengths become rows. Ranges are dealt to tasks, and a task opens its file itself and
reads no more than it asks for, so neither the number nor the size of files meets in one place.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_TASKS = 20_000


def local_or_uri(path: str) -> str:
    """Spark writes ``file:/x`` or ``file:///x`` for a local file; the plain path is ``/x``."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:/") else path


def open_file(path: str) -> pa.NativeFile:
    """A file for reading at any place."""
    path = local_or_uri(path)
    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    scheme, rest = path.split("://", 1)
    authority, _, inner = rest.partition("/")
    system, root = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system.open_input_file(f"{root.rstrip('/')}/{inner}")


def listed(spark: SparkSession, paths: str | Sequence[str], name_pattern: str | None = None) -> DataFrame:
    """(path, length) of all files, below folders too; contents are not read.

    Spark gives no row for an empty file; see ``empty_files``.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if name_pattern:
        reader = reader.option("pathGlobFilter", name_pattern)
    return reader.load([paths] if isinstance(paths, str) else list(paths)).select("path", "length")


def empty_files(files: DataFrame) -> DataFrame:
    """(path, length) of the empty files among those a reader has listed; Spark gives no row for them.

    The names come from the listing that the driver holds for the reader anyway.
    """
    spark = files.sparkSession
    names = spark.createDataFrame([(local_or_uri(unquote(p)),) for p in files.inputFiles()], "path string").distinct()
    full = files.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"))
    return names.join(full, "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"))


def ranges(files: DataFrame, size: int) -> DataFrame:
    """(path, length, at, start, stop) of consecutive ranges of ``size`` bytes; an empty file has one empty range."""
    last = F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / size).cast("long")
    start = F.col("at") * size
    return files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("at")).select(
        "path", "length", "at", start.alias("start"), F.least(start + size, "length").alias("stop")
    )


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that each stand for much work, over as many tasks as there are rows (up to a bound)."""
    return df.repartition(max(1, min(df.count(), MOST_TASKS)), *keys)
