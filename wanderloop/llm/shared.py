"""What the operators share: words, bounded Arrow batches, tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wanderloop.config import ensure_checkpoint_dir

SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A batch of whole texts that one Python worker holds at a time.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small whatever the length of a text.

    Only lowers the session's limits; a batch always holds at least one row.
    """
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        raw = spark.conf.get(key).rstrip("bB")
        now = int(raw) if raw.lstrip("-").isdigit() else 0
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the cluster's shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks that read the table, not
    the work that made it. Columns that a later step leaves out are not read.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """All columns of a row as one struct ``_row``, beside ``more``: no name can clash."""
    return docs.select(*more, F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))


def row_schema(docs: DataFrame, more: str = "") -> T.StructType:
    """Schema of ``_row`` and, behind it, of further columns."""
    extra = T._parse_datatype_string(more).fields if more else []
    return T.StructType([T.StructField("_row", docs.schema), *extra])


def unpacked(rows: DataFrame, columns: list[str], *more: Column, names: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``_row`` but for those named like a result, then ``more``."""
    return rows.select(*[F.col("_row")[c].alias(c) for c in columns if c not in names], *more)


def hashed_share(ids: DataFrame, key: Column, rows: int) -> DataFrame:
    """About one and a half times ``rows`` of the rows, by a hash of the key (all, if fewer).

    Taking the first ``rows`` of these makes each task send its share of them only.
    """
    n = ids.count()
    if n <= 2 * rows:
        return ids
    return ids.filter(F.pmod(F.xxhash64(F.lit(1), key), F.lit(1 << 30)) < int(1.5 * rows / n * (1 << 30)))


def text_of(text: str) -> Column:
    """The text column with null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_CLASS + "+")).cast("long")


def fold(value: int, parts: int) -> "callable":
    """Whether crc32 of the id as text leaves ``value`` modulo ``parts``."""
    def of(doc_id: Column) -> Column:
        return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == value

    return of
