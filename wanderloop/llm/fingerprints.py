"""SimHash near-duplicates through Golay-code fuzzy hashing.

A text's fingerprint has 64 bits; two texts are linked when at most two bits differ. The
bits are cut into three segments of 22, 21 and 21. With two errors over three segments,
one segment is free of errors and the segment after it, in a ring, has one at most or
both of the wrong ones lie elsewhere: for each of the three places i, "segment i equal
and segment i+1 within one bit" covers all cases. The inexact half goes through the perfect
binary Golay code of length 23: every word lies within three bits of exactly one codeword,
so the codewords decoded from a word and from its 23 neighbours (one or six different ones)
must hold the codeword of any word within one bit. One side of the join sends all of those
as keys, the other side its own; joined pairs are verified on all 64 bits.

Only distinct fingerprints are joined, so copies cost nothing. A key with more than
``dense`` fingerprints is not paired up: its fingerprints are linked through shared
neighbours instead (two words are within two bits exactly if some word is within one bit
of both), which grows with the number of fingerprints and loses no link.

Texts without words, null and empty ones included, have fingerprint zero. Repeated rows
share a component. A component's id is its smallest document id; rows without an id get
the id of their component, too, or null if no row of it has one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from wanderloop.llm.docstats import id_type, raw_texts
from wanderloop.llm.shared import packed, row_schema, settle, unpacked

SEED = 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift and width
DENSE = 64
_GENERATOR = 0b101011100011  # of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


_GENERATOR_SHIFTED = [_GENERATOR << i for i in range(13)]


def error_table() -> np.ndarray:
    """The error pattern of at most three bits behind every syndrome of eleven bits."""
    out = np.zeros(1 << 11, np.int32)
    bits = [1 << i for i in range(23)]
    patterns = [0, *bits]
    patterns += [a | b for i, a in enumerate(bits) for b in bits[:i]]
    patterns += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    words = np.array(patterns, np.int32)
    out[_syndromes(words)] = words
    return out


def _syndromes(words: np.ndarray) -> np.ndarray:
    out = words.astype(np.int32).copy()
    for bit in range(22, 10, -1):
        hit = (out >> bit) & 1 == 1
        out[hit] ^= _GENERATOR_SHIFTED[bit - 11]
    return out


class Golay:
    """Decoding to the nearest codeword's index (its twelve upper bits)."""

    def __init__(self):
        self.errors = error_table()

    def index(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.errors[_syndromes(words)]) >> 11

    def near(self, words: np.ndarray) -> np.ndarray:
        """Indices of a word and of all words one bit away, as columns, repeats included."""
        shifts = np.concatenate([[0], 1 << np.arange(23)]).astype(np.int32)
        return self.index((words[:, None] ^ shifts[None, :]).ravel()).reshape(len(words), 24)


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """SimHash over the word shingles of one lower-cased text, repeats included; signed 64 bits."""
    words = raw.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b" ".join(s), SEED) for s in zip(*[words[i:] for i in range(shingle)])]
    # Counts per bit over chunks: memory stays bounded for texts of any length.
    counts = np.zeros(64, np.int64)
    values = np.array(hashes, "<u8")
    for at in range(0, len(values), 1 << 15):
        part = values[at:at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(values), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (long) of every row."""
    def run(batches):
        for batch in batches:
            found = np.fromiter(map(fingerprint, raw_texts(batch.column(1))), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {id_type(docs, doc_id)}, fp long"
    )


def fuzzy_keys(distinct: DataFrame) -> DataFrame:
    """fp, key, own (whether the key is the fingerprint's own index) for all three places."""
    def run(batches):
        golay = Golay()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = [((fp >> s) & ((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
            out_fp, out_key, out_own = [], [], []
            for place in range(3):
                exact, near = parts[place], golay.near(parts[(place + 1) % 3].astype(np.int32))
                near = np.concatenate([near[:, :1], np.sort(near[:, 1:], axis=1)], axis=1)
                fresh = np.ones(near.shape, bool)
                fresh[:, 2:] = near[:, 2:] != near[:, 1:-1]
                fresh[:, 1:] &= near[:, 1:] != near[:, :1]
                rows, cols = np.nonzero(fresh)
                out_fp.append(fp[rows])
                out_key.append((exact[rows] << 14) | (near[rows, cols].astype(np.int64) << 2) | place)
                out_own.append(cols == 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (out_fp, out_key, out_own)], names=["fp", "key", "own"]
            )

    return distinct.select("fp").mapInArrow(run, "fp long, key long, own boolean")


def apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def neighbour_links(dense: DataFrame) -> DataFrame:
    """Edges from each fingerprint to all words within one bit: enough to tell who is within two."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    return dense.select("fp", F.explode(flips).alias("flip")).select(
        F.col("fp").alias("a"), F.col("fp").bitwiseXOR(F.col("flip")).alias("b")
    )


def links(distinct: DataFrame, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) between words of 64 bits, whose components are those of all links."""
    keys = settle(fuzzy_keys(distinct), "fuzzy-keys")
    crowd = keys.filter("own").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    crowded = crowd.filter(F.col("n") > dense).select("key")
    thin = keys.join(crowd.filter(F.col("n") <= dense).select("key"), "key", "left_semi")
    own = thin.filter("own").select("key", F.col("fp").alias("b"))
    pairs = (
        thin.select("key", F.col("fp").alias("a")).join(own, "key")
        .filter((F.col("a") < F.col("b")) & (apart(F.col("a"), F.col("b")) <= 2)).select("a", "b").distinct()
    )
    # Whoever may meet others under a crowded key is linked through shared neighbours.
    many = keys.join(crowded, "key", "left_semi").select("fp").distinct()
    shared = neighbour_links(many).withColumn("n", F.lit(1))
    met = shared.groupBy("b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("b")
    return pairs.unionByName(shared.select("a", "b").join(met, "b", "left_semi").select("a", "b"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (least node) of every node of the edges, by large and small stars.

    Each round hangs all larger neighbours of a node on its least one, then all smaller
    ones; the rows per node never exceed the edges, and the paths halve.
    """
    least, state = F.least("a", "b"), F.greatest("a", "b")
    edges = edges.filter("a <> b").select(state.alias("a"), least.alias("b")).distinct()
    edges = edges.checkpoint()
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
            .unionByName(low2.select("a", F.col("m").alias("b"))).distinct()
        )
        edges = small.checkpoint()
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if seen == state:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", dense: int = DENSE) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    marked = settle(fingerprints(docs, doc_id, text), "fingerprints")
    return with_components(marked, dense)


def with_components(marked: DataFrame, dense: int = DENSE) -> DataFrame:
    """The rows of (doc_id, fp, ...) with component_id, the smallest id that links reach."""
    return marked.join(component_of(marked, dense).select("fp", "component_id"), "fp")


def component_of(marked: DataFrame, dense: int = DENSE) -> DataFrame:
    """fp, root and component_id of every distinct fingerprint of (doc_id, fp)."""
    distinct = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    tree = components(links(distinct, dense))
    rooted = distinct.join(tree, distinct["fp"] == tree["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(named, "root").select("fp", "root", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", dense: int = DENSE) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, of equal rows any.

    Texts move once, to the rows that stay.
    """
    def mark(batches):
        for batch in batches:
            found = np.fromiter(map(fingerprint, raw_texts(batch.column(1))), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(found)], names=["_row", "_id", "_fp"])

    rows = packed(docs, F.col(doc_id).alias("_id"), F.col(text).alias("_text")).mapInArrow(
        mark, row_schema(docs, f"_id {id_type(docs, doc_id)}, _fp long")
    )
    marked = settle(fingerprints(docs, doc_id, text), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    stays = (
        marked.groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("n"))
        .join(component_of(marked, dense).select("fp", "root"), "fp")
        .groupBy("root").agg(F.min_by(F.struct("doc_id", "fp"), order).alias("s"))
        .select(F.col("s.doc_id").alias("_keep"), F.col("s.fp").alias("_kept_fp"))
    )
    kept = rows.join(stays, (F.col("_fp") == F.col("_kept_fp")) & F.col("_id").eqNullSafe(F.col("_keep")))
    # Rows whose id and fingerprint repeat come together in the join already.
    return unpacked(kept.dropDuplicates(["_id", "_fp"]), docs.columns)
