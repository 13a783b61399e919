"""Substring dedup: words of passages that stand elsewhere, too, are removed.

A window is ``size`` consecutive words. Its minimiser is the smallest hash among the runs of
``seed_words`` words inside it; consecutive windows that share one occurrence of a minimiser
are one super-k-mer and travel as one packed string to the minimiser's bucket. Equal windows
have equal minimisers, so they meet in one bucket, where all windows are sorted and counted
by their full text. Two windows of one super-k-mer cannot be equal, as the minimiser stands at
another place in each.

What need not travel does not: a first pass over the texts counts the super-k-mers of each
minimiser by numbers only. A minimiser met once has unique windows; one whose super-k-mers all
have the same content has repeated ones; only where contents differ are strings cut out, one
for each distinct content. Texts are kept once each (by digest, with the number of their
copies) in a table bucketed by that digest, so both later passes over the texts join without
moving them.

A bucket with more than ``crowd`` distinct strings (the edge of a passage that very many texts
share) is not gathered: its windows are counted as 128-bit digests, combined before they move.
Contents and whole texts are told apart by the same kind of digest.

Null and empty texts and texts below ``size`` words keep all words. Long texts are cut into
super-k-mers block by block. Repeated rows are copies of each other; their windows count as
repeated. An empty table gives an empty one. Further columns are handed on; those named like
a result column give way to it.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wanderloop.config import ensure_checkpoint_dir
from wanderloop.llm.docstats import raw_texts
from wanderloop.llm.shared import packed, settle, text_of, unpacked

_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, np.uint64(0x100000001B3)), dtype=np.uint64)
KEY = ["k1", "k2"]


@dataclass(frozen=True)
class RepeatParams:
    size: int = 35
    seed_words: int = 8
    crowd: int = 2000
    block: int = 1 << 16  # windows cut at a time


def spaced(raw: bytes) -> bytes:
    """The words of a text joined by one space."""
    out = raw.translate(_SPACES).strip(b" ")
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out


def word_edges(norm: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words' starts and ends."""
    if not norm:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    return np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(norm)]])


def word_hashes(norm: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of every word, good for spreading, not for telling words apart."""
    low = int(starts[0])
    buf = np.frombuffer(norm, np.uint8, int(ends[-1]) - low, low).astype(np.uint64) + np.uint64(1)
    begin = starts - low
    place = np.arange(len(buf)) - np.repeat(begin, np.diff(np.append(begin, len(buf))))
    buf *= _POWERS[place & 4095]
    buf[ends[:-1] - low] = 0
    return np.add.reduceat(buf, begin)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first smallest value in each run of ``width`` values."""
    at, best, span = np.arange(len(values)), values, 1
    while span < width:
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        take = right < left
        best, at = np.where(take, right, left), np.where(take, at[step:], at[:-step])
        span += step
    return at


def super_kmers(norm: bytes, starts: np.ndarray, ends: np.ndarray, p: RepeatParams):
    """Arrays first window, windows, minimiser of the super-k-mers of a text, block by block."""
    windows, seed = len(starts) - p.size + 1, p.seed_words
    for low in range(0, windows, p.block):
        high = min(low + p.block, windows)
        words = word_hashes(norm, starts[low:high + p.size - 1], ends[low:high + p.size - 1])
        runs = np.zeros(len(words) - seed + 1, np.uint64)
        for j in range(seed):
            runs = runs * _ODD + words[j:len(words) - seed + 1 + j]
        runs = (runs ^ (runs >> np.uint64(32))) * _ODD
        runs ^= runs >> np.uint64(29)
        at = least(runs, p.size - seed + 1)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        yield first + low, np.diff(np.append(first, high - low)), runs[at[first]].view(np.int64)


def halves(digests: list[bytes]) -> np.ndarray:
    """128 bits of each SHA-256 digest as two longs."""
    return np.frombuffer(b"".join(d[:16] for d in digests), np.int64).reshape(-1, 2)


def digest_of(text: Column) -> list[Column]:
    hexed = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(hexed, at, 16), 16, -10).cast("long").alias(k) for k, at in zip(KEY, (1, 17))]


def batch_of(arrays: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in arrays.values()], names=list(arrays))


def bucketed(df: DataFrame, keys: list[str]) -> DataFrame:
    """A table in the shared folder in hash buckets of the keys: joins on them move the other side only."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{spark.sparkContext.getCheckpointDir()}/{name}").saveAsTable(name)
    out = spark.table(name)
    # The catalogue forgets an external table; its files stay, as those of settle() do.
    spark.sql(f"DROP TABLE {name}")
    return out


def occurrences(texts: DataFrame, p: RepeatParams) -> DataFrame:
    """Super-k-mers of all distinct texts as numbers: where, how many windows, minimiser, content digest."""
    def run(batches):
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            for i, raw in enumerate(raw_texts(batch.column(3))):
                norm = spaced(raw)
                starts, ends = word_edges(norm)
                for first, n, mini in super_kmers(norm, starts, ends, p):
                    spans = zip(starts[first].tolist(), ends[first + n + p.size - 2].tolist())
                    content = halves([hashlib.sha256(norm[a:b]).digest() for a, b in spans])
                    same = {k: np.full(len(first), columns[j][i], np.int64) for j, k in enumerate((*KEY, "copies"))}
                    yield batch_of({**same, "start": first, "n": n, "mini": mini, "c1": content[:, 0], "c2": content[:, 1]})

    return texts.select(*KEY, "copies", "text").mapInArrow(
        run, "k1 long, k2 long, copies long, start long, n long, mini long, c1 long, c2 long"
    )


ASKED = ("start", "n", "mini", "c1", "c2", "weight")


def asked_strings(batches, p: RepeatParams):
    """Per asked super-k-mer: its numbers, the text and the first and last byte of each window."""
    for batch in batches:
        for raw, asks in zip(raw_texts(batch.column(0)), batch.column(1).to_pylist()):
            norm = spaced(raw)
            starts, ends = word_edges(norm)
            for ask in asks:
                low, high = ask["start"], ask["start"] + ask["n"]
                yield ask, norm, starts[low:high].tolist(), ends[low + p.size - 1:high + p.size - 1].tolist()


def strings(texts: DataFrame, p: RepeatParams) -> DataFrame:
    """The packed strings of the asked super-k-mers."""
    def run(batches):
        rows, size = [], 0
        for ask, norm, starts, ends in asked_strings(batches, p):
            rows.append((ask["mini"], ask["c1"], ask["c2"], ask["weight"], norm[starts[0]:ends[-1]]))
            size += len(rows[-1][-1])
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["mini", "c1", "c2", "weight", "packed"])
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["mini", "c1", "c2", "weight", "packed"])

    return texts.select("text", "asks").mapInArrow(run, "mini long, c1 long, c2 long, weight long, packed binary")


def window_digests(texts: DataFrame, p: RepeatParams) -> DataFrame:
    """Every window of the asked super-k-mers as a digest."""
    def run(batches):
        for ask, norm, starts, ends in asked_strings(batches, p):
            content = halves([hashlib.sha256(norm[a:b]).digest() for a, b in zip(starts, ends)])
            same = {k: np.full(len(starts), ask[k], np.int64) for k in ("mini", "c1", "c2", "weight")}
            yield batch_of({**same, "low": np.arange(len(starts)), "w1": content[:, 0], "w2": content[:, 1]})

    return texts.select("text", "asks").mapInArrow(run, "mini long, c1 long, c2 long, weight long, low long, w1 long, w2 long")


def repeated_windows(bucket: list[tuple], size: int) -> list[tuple]:
    """(string number, low, high): runs of windows that stand more than once in a bucket."""
    windows = []
    for number, (weight, packed_words) in enumerate(bucket):
        starts, ends = (edges.tolist() for edges in word_edges(packed_words))
        windows += [(packed_words[starts[i]:ends[i + size - 1]], number, i, weight) for i in range(len(starts) - size + 1)]
    windows.sort()
    hits, at = [], 0
    while at < len(windows):
        end, weight = at, 0
        while end < len(windows) and windows[end][0] == windows[at][0]:
            weight += windows[end][3]
            end += 1
        if weight > 1:
            hits += [w[1:3] for w in windows[at:end]]
        at = end
    hits.sort()
    out: list[list] = []
    for number, place in hits:
        if out and out[-1][0] == number and out[-1][2] == place:
            out[-1][2] = place + 1
        else:
            out.append([number, place, place + 1])
    return out


def counted(cut: DataFrame, p: RepeatParams) -> DataFrame:
    """mini, c1, c2, low, high of the repeated windows of every bucket."""
    names = ["mini", "c1", "c2", "low", "high"]

    def run(batches):
        mini, bucket, rows = None, [], []

        def close():
            if bucket:
                rows.extend((mini, *bucket[k][0], low, high) for k, low, high in repeated_windows([b[1] for b in bucket], p.size))

        for batch in batches:
            for m, c1, c2, weight, words in zip(*[c.to_pylist() for c in batch.columns]):
                if m != mini:
                    close()
                    mini, bucket = m, []
                bucket.append(((c1, c2), (weight, words)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=names)
                rows.clear()
        close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=names)

    return cut.repartition("mini").sortWithinPartitions("mini").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def cleaned(texts: DataFrame) -> DataFrame:
    """k1, k2, n_words, n_removed and kept of every distinct text with its ``spans`` of words."""
    def run(batches):
        for batch in batches:
            counts, removed, out = [], [], []
            for raw, spans in zip(raw_texts(batch.column(2)), batch.column(3).to_pylist()):
                norm = spaced(raw)
                starts, ends = word_edges(norm)
                change = np.zeros(len(starts) + 1, np.int64)
                edges = np.array([(s["low"], s["high"]) for s in spans or []], np.int64).reshape(-1, 2)
                np.add.at(change, edges[:, 0], 1)
                np.add.at(change, edges[:, 1], -1)
                stays = np.concatenate([[0], np.cumsum(change[:-1]) == 0, [0]]).astype(np.int8)
                turn = np.diff(stays)
                low, high = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) - 1
                counts.append(len(starts))
                removed.append(len(starts) - int(stays.sum()))
                out.append(b" ".join(norm[a:b] for a, b in zip(starts[low].tolist(), ends[high].tolist())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                names=[*KEY, "n_words", "n_removed", "kept"],
            )

    return texts.select(*KEY, "text", "spans").mapInArrow(run, "k1 long, k2 long, n_words long, n_removed long, kept string")


def repeat_spans(texts: DataFrame, p: RepeatParams) -> DataFrame:
    """k1, k2 and spans (low, high) of words under repeated windows, for texts that have any."""
    found = settle(occurrences(texts, p), "super-k-mers")
    # Numbers only, combined before they move.
    met = found.groupBy("mini").agg(
        F.sum("copies").alias("n_met"),
        ((F.min("c1") != F.max("c1")) | (F.min("c2") != F.max("c2"))).alias("differ"),
    ).filter("n_met > 1")
    shared = settle(found.join(settle(met.select("mini", "differ"), "shared-minimisers"), "mini"), "shared-super-k-mers")
    content = settle(
        shared.filter("differ").groupBy("mini", "c1", "c2").agg(
            F.sum("copies").alias("weight"), *[F.first(c).alias(c) for c in (*KEY, "start", "n")]
        ), "contents",
    )
    crowded = settle(content.groupBy("mini").agg(F.count(F.lit(1)).alias("n_strings")).filter(F.col("n_strings") > p.crowd).select("mini"), "crowded")

    def with_asks(asked: DataFrame) -> DataFrame:
        # Of a text no more than its own super-k-mers.
        asks = asked.groupBy(*KEY).agg(F.collect_list(F.struct(*ASKED)).alias("asks"))
        return texts.join(asks, KEY)

    sorted_ones = counted(strings(with_asks(content.join(crowded, "mini", "left_anti")), p), p)
    hashed = settle(window_digests(with_asks(content.join(crowded, "mini", "left_semi")), p), "crowded-windows")
    again = settle(hashed.groupBy("w1", "w2").agg(F.sum("weight").alias("n_met")).filter("n_met > 1").select("w1", "w2"), "crowded-repeats")
    by_digest = hashed.join(again, ["w1", "w2"]).select("mini", "c1", "c2", "low", (F.col("low") + 1).alias("high"))
    marks = settle(sorted_ones.unionByName(by_digest), "repeated-windows")
    whole = shared.filter("NOT differ").select(*KEY, F.col("start").alias("low"), (F.col("start") + F.col("n")).alias("high"))
    part = shared.filter("differ").join(marks, ["mini", "c1", "c2"]).select(
        *KEY, (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high")
    )
    span = F.struct("low", (F.col("high") + p.size - 1).alias("high"))
    return settle(whole.unionByName(part).groupBy(*KEY).agg(F.collect_list(span).alias("spans")), "repeat-spans")


def remove_repeats(
    docs: DataFrame, text: str = "text", of_kept: dict[str, Column] | None = None, p: RepeatParams = RepeatParams()
) -> DataFrame:
    """The rows with n_words, n_removed and, in place of the text, what is kept of it.

    ``of_kept`` names columns made from ``kept`` (the remaining words joined by one space)
    before it moves; by default the text column itself.
    """
    if not 1 <= p.seed_words <= p.size:
        raise ValueError("seed_words must lie between 1 and size")
    of_kept = of_kept or {text: F.col("kept")}
    whole = text_of(text)
    texts = bucketed(
        docs.select(*digest_of(whole), whole.alias("text")).groupBy(*KEY).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), KEY
    )
    kept = cleaned(texts.join(repeat_spans(texts, p), KEY, "left"))
    results = settle(kept.select(*KEY, "n_words", "n_removed", *[c.alias(n) for n, c in of_kept.items()]), "kept-texts")
    others = docs.drop(text)
    rows = packed(docs, *digest_of(whole)).select(*KEY, F.struct(*[F.col("_row")[c].alias(c) for c in others.columns]).alias("_row"))
    names = ("n_words", "n_removed", *of_kept)
    return unpacked(rows.join(results, KEY), others.columns, *[F.col(n) for n in names], names=names)
