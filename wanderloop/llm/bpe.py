"""BPE with word ends, by forced-boundary splitting.

A pair of bytes that stands next to each other inside no vocabulary token can never be
merged over, so it marks a certain cut. A piece of text is cut there, the fragments are
merged one by one, and their ids are put behind each other; the result equals merging
the piece as a whole. Long pieces of unusual bytes fall into many short fragments, and
what stays long is merged with a heap in n log n.

Null text is an empty text and has no ids. Texts of any length are encoded whole.
Repeated rows are encoded alike; other columns pass through, and a column that has the
name of a result is replaced.
"""

from __future__ import annotations

import heapq
import json
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from wanderloop.llm.shared import packed, row_schema, text_of, unpacked

# White space and the pattern of pieces, as the vocabulary's own file has them (fixed values).
SPACE = r"\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECE = regex.compile(PATTERN.replace(r"\s", SPACE))
WORD = regex.compile(rf"[^{SPACE}]+")
# Characters that str.split takes for space though the pattern does not.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
# Below this all characters are composed, and letters are the same in every version of
# Unicode; above, the library's own normaliser and character classes decide.
LATER = regex.compile(r"[^\x00-\u02ff]")
KEPT_WORDS, KEPT_CHARS = 200_000, 64
SHORT = 64
NEVER = 1 << 62


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, free = {b: chr(b) for b in printable}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(free)
            free += 1
    return [letters[b] for b in range(256)]


class Recent:
    """Ids of short strings in two generations: a full one becomes the old one, so that what
    is used stays and the size has a bound."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def keep(self, key: str, ids: bytes) -> None:
        if len(key) <= KEPT_CHARS:
            if len(self.young) >= KEPT_WORDS:
                self.old, self.young = self.young, {}
            self.young[key] = ids


class WordBpe:
    """One vocabulary: encodes and decodes texts; keeps the ids of short words it has met."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        letters = byte_letters()
        self.first = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        # Rank and new id of a merge in one number, so that the least number is the first merge.
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = rank << 32 | vocab[a + b]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        size = max(chain(vocab.values(), self.special.values())) + 1
        self.tokens: list[str | None] = [None] * size
        for text, i in chain(vocab.items(), self.special.items()):
            self.tokens[i] = text
        byte_of = {c: b for b, c in enumerate(letters)}
        self.joined = np.zeros((256, 256), bool)
        for text in vocab:
            inner = [byte_of[c] for c in text.removesuffix(self.end)]
            self.joined[inner[:-1], inner[1:]] = True
        self.joined_bytes = self.joined.tobytes()
        self.recent = Recent()
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.cut = pre_tokenizers.Split(Regex(PATTERN), "removed", invert=True)

    def fragments(self, piece: bytes) -> list[tuple[int, int]]:
        """Start and stop of the parts of a piece between certain cuts."""
        if len(piece) <= SHORT:
            table = self.joined_bytes
            cuts = [i for i, (a, b) in enumerate(zip(piece, piece[1:]), 1) if not table[a << 8 | b]]
        else:
            b = np.frombuffer(piece, np.uint8)
            cuts = (np.flatnonzero(~self.joined[b[:-1], b[1:]]) + 1).tolist()
        return list(zip([0, *cuts], [*cuts, len(piece)]))

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the lowest rank first, of equal ranks the leftmost."""
        if len(ids) < 2:
            return ids
        get = self.merges.get
        if len(ids) <= SHORT:
            codes = [get(p, NEVER) for p in zip(ids, ids[1:])]
            while codes and (code := min(codes)) != NEVER:
                i = codes.index(code)
                ids[i:i + 2] = [code & 0xFFFFFFFF]
                del codes[i]
                if i:
                    codes[i - 1] = get((ids[i - 1], ids[i]), NEVER)
                if i < len(codes):
                    codes[i] = get((ids[i], ids[i + 1]), NEVER)
            return ids
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(code, i) for i, p in enumerate(zip(ids, ids[1:])) if (code := get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            code, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get((ids[i], ids[j])) != code:
                continue
            ids[i], ids[j] = code & 0xFFFFFFFF, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (found := get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (found, a))
        return [x for x in ids if x >= 0]

    def piece_ids(self, piece: str) -> bytes:
        """Ids of one piece as 32-bit numbers."""
        raw = piece.encode()
        first, out = self.first, []
        for start, stop in self.fragments(raw):
            ids = [first[b] for b in raw[start:stop]]
            if stop == len(raw):
                ids[-1] = self.last[raw[-1]]
            out += self.merge(ids)
        return array("i", out).tobytes()

    def fresh(self, word: str) -> bytes:
        """Ids of a word or piece that the young generation does not hold."""
        ids = self.recent.old.get(word)
        if ids is None:
            if LATER.search(word):
                pieces = [word[a:z] for _, (a, z) in self.cut.pre_tokenize_str(word)]
            else:
                pieces = PIECE.findall(word)
            if len(pieces) == 1:
                ids = self.piece_ids(pieces[0])
            else:
                known = self.recent.young.get
                ids = b"".join([known(p) or self.fresh(p) for p in pieces])
        self.recent.keep(word, ids)
        return ids

    def encode_plain(self, text: str) -> bytes:
        if not text.isascii():
            text = self.normal.normalize_str(text) if LATER.search(text) else text.lower()
        else:
            text = text.lower()
        words = WORD.findall(text) if any(c in text for c in SEPARATORS) else text.split()
        known, fresh = self.recent.young.get, self.fresh
        return b"".join([known(w) or fresh(w) for w in words])

    def encode(self, text: str) -> np.ndarray:
        if self.split_special is None or not any(s in text for s in self.special):
            return np.frombuffer(self.encode_plain(text), np.int32)
        parts = self.split_special.split(text)
        return np.frombuffer(
            b"".join([array("i", [self.special[p]]).tobytes() if p in self.special else self.encode_plain(p) for p in parts]), np.int32
        )

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space; ids beyond the vocabulary are left out."""
        size, tokens = len(self.tokens), self.tokens
        return " ".join([t for i in ids if 0 <= i < size and (t := tokens[i]) is not None])


_loaded: dict[int, WordBpe] = {}


def tokenizer_of(spec: Broadcast) -> WordBpe:
    """The vocabulary of a broadcast file, built once per worker."""
    key = hash(spec.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(spec.value)
    return _loaded[key]


def load_spec(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file, read on the driver and sent to the workers; its size is the vocabulary's."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def _with(docs: DataFrame, name: str, kind: str, source, convert) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), convert(batch.column(0))], names=["_row", "_out"])

    rows = packed(docs, source.alias("_in")).mapInArrow(run, row_schema(docs, f"_out {kind}"))
    return unpacked(rows, docs.columns, F.col("_out").alias(name), names=(name,))


def encode(docs: DataFrame, spec: Broadcast, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with an array column of token ids."""
    def convert(column):
        bpe = tokenizer_of(spec)
        found = [bpe.encode(t or "") for t in column.to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        values = np.concatenate(found) if found else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))

    return _with(docs, ids, "array<int>", text_of(text), convert)


def decode(rows: DataFrame, spec: Broadcast, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The rows with the text that the ids stand for; null ids give an empty text."""
    def convert(column):
        bpe = tokenizer_of(spec)
        flat = column.flatten()
        inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(bpe.tokens)))
        if flat.null_count or None in bpe.tokens or not pc.all(inside, min_count=0).as_py():
            return pa.array([bpe.decode([i for i in x or [] if i is not None]) for x in column.to_pylist()], pa.string())
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bpe.tokens, pa.string()).take(flat))
        return pc.binary_join(tokens, " ")

    return _with(rows, decoded, "string", F.col(ids), convert)
