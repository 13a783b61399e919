"""From raw documents to encoded training text: the stages, each over all its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wanderloop.config import ship_package
from wanderloop.llm.bpe import encode, load_spec
from wanderloop.llm.disclosure import sanitise
from wanderloop.llm.fingerprints import one_of_each
from wanderloop.llm.mixing import repeat_rows
from wanderloop.llm.quality import fit_quality_trees, keep_good
from wanderloop.llm.shared import bounded_batches, settle, text_of, word_count

# The quality model, the fingerprints and the merges are beyond SQL.
ORACLE_SQL = None


def prepared(spark: SparkSession) -> None:
    ship_package(spark)
    bounded_batches(spark)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the boosted trees go."""
    prepared(spark)
    return keep_good(docs, fit_quality_trees(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    prepared(spark)
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data labelled, disclosing words generalised or removed."""
    prepared(spark)
    clean = sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' quotas ask for them."""
    prepared(spark)
    return repeat_rows(docs, word_count(text_of("text")), F.array("source"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row."""
    prepared(spark)
    spec = load_spec(spark, public_tokenizers.path("word_bpe_49k.json"))
    return encode(docs.select("doc_id", "lang", "source", "text"), spec).select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids"
    )


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixing),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
