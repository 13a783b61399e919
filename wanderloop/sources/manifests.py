"""Checksum manifests of files and of text columns."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wanderloop.operators.quantiles import join_on_keys
from wanderloop.sources.files import dealt, empty_files, listed, open_file, ranges

SKIPPED_NAMES = (".gitkeep",)
AS_ROW = 256 << 20  # Spark refuses rows above 2 GB
PIECE = 4 << 20


def streamed_digests(files: DataFrame) -> DataFrame:
    """(path, sha256) of listed files: one task streams a file in pieces of ``PIECE`` bytes."""
    def digest(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                seen = hashlib.sha256()
                with open_file(path) as file:
                    while piece := file.read(PIECE):
                        seen.update(piece)
                yield pa.RecordBatch.from_pylist([{"path": path, "sha256": seen.hexdigest()}])

    return dealt(files.select("path"), "path").mapInArrow(digest, "path string, sha256 string")


def tree_digests(files: DataFrame, chunk: int = 64 << 20) -> DataFrame:
    """(path, length, chunks, tree_sha256) of listed files, chunks of one file hashed by many tasks.

    The digest is SHA-256 over the lowercase hex digests of the chunks in order. It tells files apart as
    SHA-256 of the whole does, at the same ``chunk``, and one large file needs no single long task.
    """
    return (
        chunk_digests(files, chunk).groupBy("path", "length")
        .agg(F.count(F.lit(1)).alias("chunks"), F.sort_array(F.collect_list(F.struct("at", "sha256"))).alias("all"))
        .select("path", "length", "chunks", F.sha2(F.array_join("all.sha256", "").cast("binary"), 256).alias("tree_sha256"))
    )


def chunk_digests(files: DataFrame, chunk: int = 64 << 20) -> DataFrame:
    """(path, length, at, sha256) of every chunk; two of these tables tell which parts of a file changed."""
    def digest(batches):
        for batch in batches:
            for row in batch.to_pylist():
                seen, place = hashlib.sha256(), row["start"]
                with open_file(row["path"]) as file:
                    while place < row["stop"]:
                        piece = file.read_at(min(PIECE, row["stop"] - place), place)
                        if not piece:
                            raise OSError(f"{row['path']}: shorter than when it was listed")
                        seen.update(piece)
                        place += len(piece)
                yield pa.RecordBatch.from_pylist([
                    {"path": row["path"], "length": row["length"], "at": row["at"], "sha256": seen.hexdigest()}
                ])

    return dealt(ranges(files, chunk), "path", "at").mapInArrow(digest, "path string, length long, at long, sha256 string")


def file_manifest(
    spark: SparkSession, base: str, roots: Sequence[str] = (".",), exclude_top: Sequence[str] = (), as_row: int = AS_ROW
) -> DataFrame:
    """(relative_path, sha256, size_bytes) of every file, each path once.

    Files of at most ``as_row`` bytes are hashed as rows by Spark's own function; larger ones, of
    any size, are streamed. Both give the SHA-256 of the whole file.
    """
    base = base.rstrip("/")
    paths = [base if r == "." else f"{base}/{r}" for r in roots]
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    small = rows.filter(F.col("length") <= as_row).select("path", "length", F.sha2("content", 256).alias("sha256"))
    files = small.unionByName(empty_files(rows).withColumn("sha256", F.sha2(F.lit("").cast("binary"), 256)))
    large = listed(spark, paths).filter(F.col("length") > as_row).dropDuplicates(["path"])
    if not large.isEmpty():
        files = files.unionByName(large.join(streamed_digests(large), "path"))
    rel = F.regexp_replace("path", r"^file:/+", "/")
    rel = F.substr(rel, F.lit(len(base) + 2))
    named = files.select(rel.alias("relative_path"), "sha256", F.col("length").alias("size_bytes"))
    leaf = F.element_at(F.split("relative_path", "/"), -1)
    top = F.split("relative_path", "/")[0]
    kept = named.filter(~leaf.isin(*SKIPPED_NAMES))
    if exclude_top:
        kept = kept.filter(~top.isin(*exclude_top))
    return kept.dropDuplicates(["relative_path"])


def text_manifest(df: DataFrame, name: Column, text: str) -> DataFrame:
    """The manifest columns for a table of texts."""
    return df.select(
        name.alias("relative_path"), F.sha2(F.col(text).cast("binary"), 256).alias("sha256"),
        F.octet_length(text).cast("long").alias("size_bytes"),
    )


def check_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per expected path: ok, mismatch or missing."""
    found = actual.select("relative_path", F.col("sha256").alias("found"))
    joined = join_on_keys(expected, found, ["relative_path"], "left")
    status = (
        F.when(F.col("found").isNull(), F.lit("missing"))
        .when(F.col("found") == F.col("sha256"), F.lit("ok"))
        .otherwise(F.lit("mismatch"))
    )
    return joined.select("relative_path", "sha256", status.alias("status"))


def first_of_copies(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """One row per distinct text: lowest id, hash and number of copies.

    Only the 32-byte hash and the id are shuffled, never the text, and copies
    are counted before the shuffle.
    """
    hashed = df.select(F.col(row_id), F.sha2(F.col(text).cast("binary"), 256).alias("sha256"))
    return hashed.groupBy("sha256").agg(
        F.min(row_id).alias(row_id), F.count(F.lit(1)).alias("n_copies")
    )
