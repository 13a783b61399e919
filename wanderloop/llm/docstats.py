"""Statistics of whole texts, computed one text at a time inside Arrow tasks.

Null text counts as empty. An empty text has zero in every count and ratio. A text of
any length is read whole; the memory of one text is a few times its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wanderloop.llm.shared import hashed_share

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
REPEAT_WINDOW = 8
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
MARKS = b".,;:?"

FEATURES = (
    "log_words", "mean_word_chars", "symbol_share", "bang_share", "upper_share", "digit_share",
    "mark_share", "bracket_share", "dup_line_share", "repeat_share", "distinct_words",
    "distinct_pairs", "same_neighbour", "top_word_share", "words_per_line", "line_end_share",
    "long_word_share", "pipe_share", "non_ascii_share", "one_char_share",
)
# The larger these are, the lower the quality: splits that say otherwise are refused.
FALLING = (
    "symbol_share", "bang_share", "upper_share", "dup_line_share", "repeat_share", "same_neighbour",
    "pipe_share",
)


def _bytes_of(chars: bytes) -> np.ndarray:
    return np.frombuffer(chars, np.uint8)


_SPACE, _SYMBOL, _MARK = map(_bytes_of, (SPACES, SYMBOLS, MARKS))
_DIGIT = _bytes_of(b"0123456789")
_UPPER = _bytes_of(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_BRACKET = _bytes_of(b"(){}[]=\"'")
# One odd multiplier per place of the window.
_PLACES = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) | 1 for i in range(REPEAT_WINDOW)], np.uint64)


def repeated_cover(ids: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of words found at least twice.

    Windows are hashed; those whose hash occurs twice are then compared word by word.
    """
    n = len(ids) - window + 1
    if n < 2:
        return 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    code = np.zeros(n, np.uint64)
    for place in range(window):
        code += mixed[place:place + n] * _PLACES[place]
    ordered = np.sort(code)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(code, twice))
    rows = np.ascontiguousarray(ids[at[:, None] + np.arange(window)])
    _, inverse, counts = np.unique(rows.view(np.dtype((np.void, rows.itemsize * window))).ravel(), return_inverse=True, return_counts=True)
    at = at[counts[inverse.ravel()] > 1]
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def text_stats(raw: bytes) -> tuple[list[int], list[float]]:
    """(base counts, features) of one UTF-8 text."""
    words = raw.split()
    n = len(words)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = int(hist[:0x80].sum() + hist[0xC0:].sum())
    word_chars = chars - int(hist[_SPACE].sum())
    symbols = int(hist[_SYMBOL].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    repeats = repeated_cover(ids) if len(index) < n else 0
    base = [n, word_chars, symbols, dup_lines, repeats]
    if not n:
        return base, [0.0] * len(FEATURES)
    distinct = len(index)
    pairs = np.unique(ids[:-1] * distinct + ids[1:]).size if n > 1 else 1
    sizes = np.fromiter(map(len, words), np.int64, n)
    c = max(word_chars, 1)
    features = [
        np.log1p(n), word_chars / n, symbols / c, hist[0x21] / c, hist[_UPPER].sum() / c,
        hist[_DIGIT].sum() / c, hist[_MARK].sum() / c, hist[_BRACKET].sum() / c,
        dup_lines / max(len(lines), 1), repeats / n, distinct / n, pairs / max(n - 1, 1),
        (ids[1:] == ids[:-1]).sum() / max(n - 1, 1), np.bincount(ids).max() / n, n / max(len(lines), 1),
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / max(len(lines), 1),
        (sizes > 24).sum() / n, hist[0x7C] / n, hist[0xC0:].sum() / c, (sizes == 1).sum() / n,
    ]
    return base, [float(x) for x in features]


def raw_texts(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """The texts of one batch as bytes, null as empty."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def stats_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Base counts and features of a batch whose second column is the text."""
    base = np.zeros((batch.num_rows, len(BASE)), np.int64)
    features = np.zeros((batch.num_rows, len(FEATURES)))
    for i, raw in enumerate(raw_texts(batch.column(1))):
        base[i], features[i] = text_stats(raw)
    return base, features


def id_type(docs: DataFrame, doc_id: str) -> str:
    return docs.schema[doc_id].dataType.simpleString()


def labelled_sample(
    docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, rows: int
) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``rows`` labelled documents, in order of a hash of the id.

    ``rows`` is the documented bound of what reaches the driver: one feature row per
    sampled id, however often the id repeats. Rows without id or label take no part;
    of contradicting labels the smaller holds.
    """
    spark = docs.sparkSession
    ids = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    single = ids.groupBy("doc_id").agg(F.min("label").alias("label"))
    picked = hashed_share(single, F.col("doc_id"), rows).orderBy(F.xxhash64("doc_id"), "doc_id").take(rows)
    kind = id_type(docs, doc_id)
    small = spark.createDataFrame([(r["doc_id"], r["label"]) for r in picked], f"doc_id {kind}, label int")
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(small), "doc_id")

    def features(batches):
        for batch in batches:
            _, x = stats_of(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), *map(pa.array, x.T), batch.column(0)], names=["label", *FEATURES, "doc_id"]
            )

    schema = "label int, " + ", ".join(f"{f} double" for f in FEATURES) + f", doc_id {kind}"
    found = (
        chosen.select("doc_id", "text", "label").mapInArrow(features, schema)
        .groupBy("doc_id").agg(F.min(F.struct("label", *FEATURES)).alias("x"))
        .select("doc_id", "x.*").toArrow().sort_by("doc_id")
    )
    x = np.column_stack([found[f].to_numpy() for f in FEATURES]) if found.num_rows else np.zeros((0, len(FEATURES)))
    return x, found["label"].to_numpy().astype(float)
