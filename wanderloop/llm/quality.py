"""Quality of documents: rules with a boosted verdict, and an additive classifier.

Both learn from a bounded, documented sample of labelled rows and score every whole
text where it is read: no shuffle, no join with the corpus. Null or empty text is
scored as an empty text; repeated rows get equal results; an empty table gives no rows;
columns other than id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wanderloop.llm.additive import Additive, AdditiveParams, fit_additive
from wanderloop.llm.boosting import BoostParams, Trees, fit_trees
from wanderloop.llm.docstats import BASE, FALLING, FEATURES, id_type, labelled_sample, stats_of
from wanderloop.llm.shared import fold, packed, row_schema, unpacked

# Labelled rows a model is fitted on, at most.
TRAIN_ROWS = 20_000
LEAST_WORDS, MOST_REPEATED_PERCENT = 20, 30
KEEP_FROM = 0.5
PREDICT_FROM = 0.3
HELD_OUT = fold(0, 5)


def fit_quality_trees(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", label="quality", rows=TRAIN_ROWS) -> Trees:
    x, y = labelled_sample(docs, labels, doc_id, text, label, rows)
    falling = tuple(FEATURES.index(f) for f in FALLING)
    return fit_trees(x, y, BoostParams(falling=falling))


def failed_base(base: np.ndarray) -> np.ndarray:
    n, repeats = base[:, 0], base[:, 4]
    return (n < LEAST_WORDS) | (100 * repeats > MOST_REPEATED_PERCENT * n)


def quality_rules(docs: DataFrame, trees: Trees, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, the base counts, base_failed, the trees' score and kept of every row."""
    def score(batches):
        for batch in batches:
            base, x = stats_of(batch)
            failed, verdict = failed_base(base), trees.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, base.T), pa.array(failed), pa.array(~failed & (verdict >= KEEP_FROM)), pa.array(verdict)],
                names=["doc_id", *BASE, "base_failed", "kept", "quality_score"],
            )

    schema = (
        f"doc_id {id_type(docs, doc_id)}, " + ", ".join(f"{c} long" for c in BASE)
        + ", base_failed boolean, kept boolean, quality_score double"
    )
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(score, schema)


def keep_good(docs: DataFrame, trees: Trees, text="text") -> DataFrame:
    """The rows that ``quality_rules`` keeps, whole and unchanged, in one pass."""
    def good(batches):
        for batch in batches:
            base, x = stats_of(batch)
            keep = ~failed_base(base) & (trees.score(x) >= KEEP_FROM)
            yield pa.RecordBatch.from_arrays([batch.column(2)], names=["_row"]).filter(pa.array(keep))

    # The id is not needed here; the text is the second column as everywhere.
    rows = packed(docs, F.lit(0).alias("_none"), F.col(text).alias("_text"))
    return unpacked(rows.mapInArrow(good, row_schema(docs)), docs.columns)


def fit_quality_tables(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", label="quality", rows=TRAIN_ROWS, params=AdditiveParams()) -> Additive:
    """Learns from labelled rows that are not held out."""
    x, y = labelled_sample(docs, labels.filter(~HELD_OUT(F.col(doc_id))), doc_id, text, label, rows)
    return fit_additive(x, y, params)


def quality_scores(docs: DataFrame, model: Additive, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    def score(batches):
        for batch in batches:
            _, x = stats_of(batch)
            p = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= PREDICT_FROM).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    schema = f"doc_id {id_type(docs, doc_id)}, score double, predicted int"
    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(score, schema)
    return out.select("doc_id", HELD_OUT(F.col("doc_id")).alias("held_out"), "score", "predicted")
