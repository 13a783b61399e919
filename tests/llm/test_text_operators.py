"""Quality, fingerprints, BPE, mixing, personal data and LM scores against slow definitions."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from wanderloop.llm import bpe, disclosure, fingerprints, lm, mixing, quality
from wanderloop.llm.additive import fit_additive
from wanderloop.llm.attention import Attention, AttentionParams, blocks_of, first_weights, pack
from wanderloop.llm.boosting import BoostParams, fit_trees
from wanderloop.llm.docstats import FALLING, FEATURES, text_stats
from wanderloop.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(spark, sf_dir):
    return {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def slow_base(text):
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count, cover = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            cover.update(range(i, i + 8))
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)]


def test_base_counts_of_random_texts():
    rng = random.Random(4)
    for _ in range(300):
        words = [rng.choice(["a", "bé", "c#", "漢", " ", "x|y"]) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", "\n", "\t ", "\x0b"]) for w in words)
        assert text_stats(text.encode())[0] == slow_base(text)


def test_quality_queries_on_the_tables(spark, sf_dir):
    texts = texts_of(spark, sf_dir)
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").collect()}
    rules = QUERIES["op2_quality_rules"](spark, sf_dir).collect()
    assert len(rules) == len(texts)
    for r in rules:
        base = slow_base(texts[r.doc_id])
        assert list(r)[1:6] == base
        assert r.base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0]) and not (r.base_failed and r.kept)
    good = [r.kept for r in rules if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in rules if labels.get(r.doc_id) == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.1
    scores = QUERIES["op4_quality_classifier"](spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scores)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in scores)
    held = [r.predicted == labels[r.doc_id] for r in scores if r.held_out and r.doc_id in labels]
    assert np.mean(held) > 0.9


def test_quality_of_odd_rows_and_without_labels(odd_docs, no_docs, no_labels):
    trees = quality.fit_quality_trees(odd_docs, no_labels)
    rows = quality.quality_rules(odd_docs, trees).collect()
    assert len(rows) == 9 and all(r.base_failed for r in rows)
    assert quality.quality_rules(no_docs, trees).collect() == []
    model = quality.fit_quality_tables(odd_docs, no_labels)
    assert len({r.score for r in quality.quality_scores(odd_docs, model).collect()}) == 1
    assert quality.keep_good(odd_docs, trees).columns == odd_docs.columns


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] < 0.6) ^ (rng.random(600) < 0.1)).astype(float)
    trees = fit_trees(x, y, BoostParams(trees=20, falling=(0, 1)))
    grid = np.linspace(0, 1, 50)
    for j in (0, 1):
        rows = np.full((50, 3), 0.5)
        rows[:, j] = grid
        assert (np.diff(trees.score(rows)) <= 1e-12).all()
    assert ((trees.score(x) > 0.5) == (x[:, 0] < 0.6)).mean() > 0.95
    assert set(FALLING) <= set(FEATURES)


def test_additive_model_needs_its_pairs():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit_additive(x, y)
    assert (0, 1) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def slow_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return "0" * 16
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)):016x}"


def slow_components(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            root[find(a)] = find(b)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(fps))]


def test_simhash_on_the_tables(spark, sf_dir):
    texts = texts_of(spark, sf_dir)
    rows = QUERIES["op5_simhash"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    assert all(r.fingerprint == slow_fingerprint(texts[r.doc_id]) for r in rows)
    want = slow_components([int(r.fingerprint, 16) for r in rows], [r.doc_id for r in rows])
    assert [r.component_id for r in rows] == want


@pytest.mark.parametrize("dense", [64, 3])
def test_components_of_planted_clusters(spark, dense):
    rng, fps = random.Random(9), []
    for _ in range(40):
        word = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            fps.append(word)
            for _ in range(rng.randint(0, 2)):
                word ^= 1 << rng.randrange(64)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in fingerprints.with_components(rows, dense).collect()}
    assert [got[i] for i in range(len(fps))] == slow_components(fps, range(len(fps)))


def test_golay_keys_meet_within_one_bit():
    code = fingerprints.Golay()
    words = np.random.default_rng(2).integers(0, 1 << 23, 500).astype(np.int32)
    near = code.near(words)
    assert {len(set(r)) for r in near} == {1, 6}
    for bit in range(23):
        assert (near == code.index(words ^ np.int32(1 << bit))[:, None]).any(axis=1).all()


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    rows = fingerprints.near_duplicates(odd_docs).collect()
    zero = {r.component_id for r in rows if r.doc_id in (2, 3, 4)}
    assert len(rows) == 9 and zero == {2}
    kept = fingerprints.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 5, 6, 7]
    assert fingerprints.near_duplicates(no_docs).collect() == fingerprints.one_of_each(no_docs).collect() == []


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_equals_the_library_on_random_strings(library):
    with open(public_tokenizers.path("word_bpe_49k.json")) as file:
        own = bpe.WordBpe(file.read())
    rng = random.Random(1)
    letters = "abcdeéèßÉÀ漢кириллица12½² \t\n\x1c\x85​　'sΣςİ́̈🙂👍🏽<|>endoftext.,!?-aaaathe ing"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["x<|endoftext|>y <|startoftext|>", "a" * 5000, "#$%" * 900, "the" * 3000]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_query_and_odd_rows(spark, sf_dir, library, odd_docs, no_docs):
    texts = texts_of(spark, sf_dir)
    for r in QUERIES["op6_bpe"](spark, sf_dir).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    spec = bpe.load_spec(spark, public_tokenizers.path("word_bpe_49k.json"))
    coded = bpe.encode(odd_docs, spec)
    assert sorted(coded.columns) == sorted(odd_docs.columns)  # the clashing column is replaced
    assert [len(r.ids) for r in coded.filter("doc_id in (2, 3, 4)").collect()] == [0, 0, 0]
    assert bpe.decode(coded, spec).filter("doc_id = 2").first().decoded == ""
    assert bpe.encode(no_docs, spec).collect() == []
    wild = spark.createDataFrame([([0, None, 10**6, -1],), (None,)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(wild, spec).collect()] == ["!", ""]


def test_quotas_stop_at_the_cap_and_reshare():
    p = mixing.MixParams()
    got = mixing.quotas({"b": 10, "a": 100, None: 1000}, 1110, p)
    assert got["b"] == 30.0 and sum(got.values()) == pytest.approx(1110)
    assert got[None] == pytest.approx(3 * got["a"])
    assert mixing.quotas({}, 0, p) == {} and mixing.quotas({"a": 0}, 0, p) == {"a": 0.0}


def test_flow_sends_shared_documents_where_they_are_short():
    patterns = {'["a"]': 100, '["a","b"]': 100, '["b"]': 10}
    taken = mixing.route(patterns, {"a": 100.0, "b": 110.0}, 3)
    assert taken == {'["a"]': 100, '["a","b"]': 100, '["b"]': 10}  # nothing repeats
    assert sum(mixing.route(patterns, {"a": 0.0, "b": 60.0}, 3).values()) == 60


def test_mixing_on_the_tables(spark, sf_dir):
    rows = QUERIES["op7_mixing"](spark, sf_dir).collect()
    again = QUERIES["op7_mixing"](spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    size = {i: len(WORD.findall(r.text or "")) for i, r in docs.items()}
    whole, want = Counter(), Counter()
    for i, r in docs.items():
        whole[r.source] += size[i]
    quota = mixing.quotas(dict(whole), sum(whole.values()), mixing.MixParams())
    for r in rows:
        source = docs[r.doc_id].source
        assert (r.size, r.source_size) == (size[r.doc_id], whole[source]) and r.target == pytest.approx(quota[source])
        assert 0 <= r.taken <= 3 * r.size
        want[source] += r.taken
    most = max(size.values())
    assert all(abs(want[s] - quota[s]) <= most for s in whole)


def test_mixing_of_odd_rows_and_overlapping_sources(spark, odd_docs, no_docs):
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    mixed, known = mixing.mix(odd_docs, F.coalesce(words, F.lit(0)), F.array("source"))
    assert mixed.count() == 9 and None in known
    assert mixing.mix(no_docs, F.coalesce(words, F.lit(0)), F.array("source"))[0].collect() == []
    two = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["a"]) for i in range(200)], "doc_id long, sources array<string>")
    mixed, known = mixing.mix(two, F.lit(1), F.col("sources"))
    assert abs(mixed.agg(F.sum("repeats")).first()[0] - sum(t for _, t in known.values())) <= 2
    with pytest.raises(ValueError):
        mixing.mix(two, F.lit(1), F.col("sources"), p=mixing.MixParams(max_patterns=1))


def slow_spans(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for rank, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c.isdigit()] if kind != "email" else []
            luhn = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits[::-1])) % 10 == 0
            if (
                kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and luhn)
                or kind == "phone" and not 9 <= len(digits) <= 15
            ):
                continue
            out.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{a}:{z}" for a, _, k, z in sorted(out))


def test_personal_data_in_random_and_long_texts(spark):
    rng = random.Random(5)
    bits = ["a@b.c", "@", ".", "x_", "1.2.3.4", "256.", "+1 (499) 555-6503", "4111 1111-1111 1111", " ", "-", "7", "é漢🙂", "\n", "+", "%", "a@b.c._d@e.ff", "4111111111111111"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(800)]
    texts += ["9" * 30000, "1 " * 20000, "a" * 30000, "a@" + "b." * 9000 + "c", "1.2.3.4 " * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select(
        "doc_id", disclosure.spans_text(disclosure.personal_spans(F.col("text"))).alias("spans")
    ).collect()
    for r in rows:
        assert r.spans == slow_spans(texts[r.doc_id]), texts[r.doc_id][:80]


def test_personal_data_of_odd_rows(odd_docs, no_docs):
    rows = {r.doc_id: disclosure_text(r) for r in disclosure.find_personal_data(odd_docs).collect()}
    assert rows[2] == rows[3] == rows[5] == "" and rows[6].startswith("email:5:22,")
    assert disclosure.find_personal_data(no_docs).collect() == []
    clean = disclosure.sanitise(odd_docs)
    assert clean.columns == odd_docs.columns and clean.count() == 9
    assert clean.filter("doc_id = 6").first().text == "mail [EMAIL] or [PHONE] from [IP], card [CARD] ."
    assert clean.filter("doc_id = 2").first().text is None


def disclosure_text(row):
    return ",".join(f"{s.kind}:{s.start}:{s.stop}" for s in row.all_spans)


def test_words_that_disclose_an_entity_are_found_and_common_ones_are_not(spark):
    fill = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    docs = [(i, f"{fill[i]} we met Zorblax the {fill[-i]} one zo@x.example.com said {fill[i - 2]} here") for i in range(6)]
    docs += [(10 + i, f"{fill[i % 6]} we met the {fill[i % 5]} one who said it here") for i in range(60)]
    copies = [(100 + i, "say qwerty now at cp@y.example.com please do") for i in range(30)]
    table = spark.createDataFrame(docs + copies, "doc_id long, text string")
    rows = {r.doc_id: r for r in disclosure.find_personal_data(table).collect()}
    for i in range(6):
        words = {docs[i][1][s.start:s.stop] for s in rows[i].all_spans}
        assert words == {"Zorblax", "zo@x.example.com"}
    assert all(len(rows[100 + i].all_spans) == 1 for i in range(30))  # copies of one context disclose nothing
    clean = disclosure.sanitise(table).filter("doc_id = 1").first().text
    assert "Zorblax" not in clean and "[EMAIL]" in clean


def test_disclosing_words_go_anywhere_in_all_documents(spark):
    fill = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    far = "we met the one who said it " * 9
    docs = [(i, f"Zorblax {fill[i]} zo@x.example.com {fill[i - 2]} {far}{fill[-i]} far Qwyx signed by Vrontz") for i in range(6)]
    docs += [(10 + i, f"{fill[i % 6]} we met the {fill[i % 5]} one who said it far signed by") for i in range(600)]
    docs += [(1000 + i, f"say {fill[i]} of wuzzle at wu@x.example.com") for i in range(6)] + [(1010, "wuzzle alone, [EMAIL] at say of"), (1011, "at say of")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in disclosure.sanitise(table).collect()}
    assert len(clean) == len(docs)
    for i in range(6):
        assert clean[i] == f" {fill[i]} [EMAIL] {fill[i - 2]} {far}{fill[-i]} far  signed by "
    assert all(clean[10 + i] == docs[6 + i][1] for i in range(600))
    assert "wuzzle" not in clean[1000] and clean[1010].startswith("[TERM] alone, [EMAIL]")


def test_personal_data_query_against_sql(spark, sf_dir, tmp_path):
    fill = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    docs = [(i, f"{fill[i]} we met Zorblax the {fill[-i]} one zo@x.example.com said {fill[i - 2]} here") for i in range(6)]
    docs += [(10 + i, f"{fill[i % 6]} we met the {fill[i % 5]} one who said it here") for i in range(60)]
    docs += [(100, "say 4111 1111 1111 1111 do 1.2.3.4 +1 (499) 555-6503 é")] * 3 + [(None, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for folder, files in ((tmp_path, f"{tmp_path}/documents.parquet/*.parquet"), (sf_dir, f"{sf_dir}/documents.parquet")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{files}'")
        cur = con.execute(ORACLES["op10_pii"])
        df = QUERIES["op10_pii"](spark, str(folder))
        assert [d[0] for d in cur.description] == df.columns
        got = sorted(map(str, map(tuple, df.collect())))
        assert got == sorted(map(str, cur.fetchall()))
        assert folder == sf_dir or sum("term:" in row for row in got) == 6


def test_attention_gradients_and_scores():
    p = AttentionParams(classes=5, width=4, block=3)
    rng = np.random.default_rng(0)
    w = {k: rng.standard_normal(s) * 0.5 for k, s in p.shapes.items()}
    windows, targets, real, owner = blocks_of([rng.integers(0, 5, n).astype(np.uint8) for n in (1, 7, 4)], p)
    assert real.sum() == 12 and np.bincount(owner).tolist() == [1, 3, 2]
    g, loss = Attention(w, p).gradients(windows, targets, real)
    for k in w:
        at, e = tuple(rng.integers(0, s) for s in w[k].shape), 1e-4
        w[k][at] += e
        up = Attention(w, p).gradients(windows, targets, real)[1]
        w[k][at] -= 2 * e
        down = Attention(w, p).gradients(windows, targets, real)[1]
        w[k][at] += e
        assert g[k][at] == pytest.approx((up - down) / 2 / e, abs=1e-4)
    logs = Attention({k: v.astype(np.float32) for k, v in w.items()}, p).log_probs(windows, targets)
    assert -(logs * real).sum() / real.sum() == pytest.approx(loss, rel=1e-4)


def test_adaptive_softmax_of_attention():
    """Probabilities of all classes add up to one, gradients are those of the loss, and the bias starts at the shares."""
    p, rng = AttentionParams(classes=9, width=4, block=3, cuts=(3, 5)), np.random.default_rng(0)
    w = {k: rng.standard_normal(s) * 0.5 for k, s in p.shapes.items()}
    windows, targets, real, _ = blocks_of([rng.integers(0, 9, n).astype(np.uint8) for n in (1, 7, 40)], p)
    g, loss = Attention(w, p).gradients(windows, targets, real)
    for k in w:
        for _ in range(5):
            at, e = tuple(rng.integers(0, s) for s in w[k].shape), 1e-4
            w[k][at] += e
            up = Attention(w, p).gradients(windows, targets, real)[1]
            w[k][at] -= 2 * e
            down = Attention(w, p).gradients(windows, targets, real)[1]
            w[k][at] += e
            assert g[k][at] == pytest.approx((up - down) / 2 / e, abs=1e-4)
    model = Attention({k: v.astype(np.float32) for k, v in w.items()}, p)
    assert -(model.log_probs(windows, targets) * real).sum() / real.sum() == pytest.approx(loss, rel=1e-4)
    every = sum(np.exp(model.log_probs(windows, np.full_like(targets, c))) for c in range(9))
    assert every[real] == pytest.approx(1, abs=1e-5)
    share = np.array([0.3, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])
    flat = {k: np.zeros(n, np.float32) for k, n in p.shapes.items()} | {"bias": first_weights(p, share)["bias"]}
    logs = Attention(flat, p).log_probs(windows, targets)
    assert np.exp(logs[real]) == pytest.approx(share[targets[real]], rel=1e-5)


def test_words_of_many_texts_at_once():
    texts = [None, "", " ", "a\x0bb\x0cc\x1cd\x85e g\xa0h \t\r\nI \xc4B", "  X  y", "z\x00q", *[f"u{chr(i)}V" for i in range(128)]]
    for column in (pa.array(texts), pa.array(texts).slice(3, 20)):
        want = [lm.words_of((t or "").encode()) for t in column.to_pylist()]
        words, sizes = lm.words_in(column)
        assert words.to_pylist() == [w for ws in want for w in ws] and sizes.tolist() == [len(ws) for ws in want]
        assert lm.last_bytes(words).tolist() == [w[-1] for ws in want for w in ws]


def test_lm_repeated_rows_score_alike_and_texts_are_split_twice_at_most(spark, odd_docs, monkeypatch):
    """Also where nearly all words are joined; no round of training and no scoring looks at texts again."""
    monkeypatch.setattr(lm, "HEAVY", 3)
    seen = []
    for name in ("word_rows", "coded_rows"):
        monkeypatch.setattr(lm, name, lambda *a, f=getattr(lm, name), name=name: seen.append(name) or f(*a))
    rows = lm.lm_scores(odd_docs.unionAll(odd_docs), p=lm.LmParams(rounds=2, least_steps=2)).collect()
    assert seen == ["word_rows", "coded_rows"]
    found = Counter(tuple(r)[:6] for r in rows)
    assert len(rows) == 2 * odd_docs.count() and all(n % 2 == 0 for n in found.values())


def test_lm_scores_on_the_tables(spark, sf_dir):
    texts = texts_of(spark, sf_dir)
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    split = {i: word.findall(t.encode().lower()) + [b"\n"] for i, t in texts.items()}
    count = Counter(w for i, ws in split.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    rows = QUERIES["op3_lm_scoring"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ws = split[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            zlib.crc32(str(r.doc_id).encode()) % 7 == 2, len(ws), sum(count[w] > 0 for w in ws), n
        )
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r.score < 0


def test_every_token_is_a_target_once_in_all_rounds():
    p, rng = lm.LmParams(attention=AttentionParams(classes=5, width=4, block=3)), np.random.default_rng(2)
    class_of = np.arange(100).astype(np.uint8) % 5
    texts = [np.append(rng.integers(0, 99, n), 99).astype(np.uint16) for n in (0, 1, 2, 3, 700, 5000)]
    rounds = [lm.windows_of_round(np.concatenate(texts), class_of, r, p) for r in range(p.rounds)]
    windows, targets, _, _ = blocks_of([class_of[t] for t in texts], p.attention)
    rows = lambda w, t: sorted(map(tuple, np.concatenate([w, t], axis=1).tolist()))
    assert sorted(x for w, t in rounds for x in rows(w, t)) == rows(windows, targets)
    assert sum(int((t != p.attention.pad).sum()) for _, t in rounds) == sum(map(len, texts))


def test_lm_scores_with_light_words_joined(spark, odd_docs, no_docs, monkeypatch):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    p = lm.LmParams(rounds=1, least_steps=2)
    whole = sorted(map(str, lm.lm_scores(odd_docs, path, p=p).drop("score").collect()))
    monkeypatch.setattr(lm, "HEAVY", 3)  # almost every word is light now
    light = lm.lm_scores(odd_docs, path, p=p).drop("score")
    got = sorted(map(str, light.withColumn("base_score", F.round("base_score", 9)).collect()))
    assert len(got) == 9 and [x.split("base_score")[0] for x in got] == [x.split("base_score")[0] for x in whole]
    assert lm.lm_scores(no_docs, path, p=p).collect() == []


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_lm_beats_word_counts_on_held_out_texts(spark, size):
    rows = QUERIES["op3_lm_scoring"](spark, f"/root/testdata/{size}").filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.1 * sum(r.n_tokens for r in rows)


def test_lm_words_share_their_class_by_counts(spark, odd_docs, no_docs, monkeypatch):
    """A model that gives each class its share scores like the base, but for one unknown word per last byte."""
    monkeypatch.setattr(lm, "LISTED", 4)
    monkeypatch.setattr(lm, "learn", lambda texts, classes, share, p: pack(
        {k: np.zeros(n, np.float32) if k != "bias" else np.log(np.maximum(share, 1e-9)).astype(np.float32) for k, n in p.attention.shapes.items()}))
    p = lm.LmParams(attention=AttentionParams(classes=6, width=4, block=3), alone=3)
    for heavy in (300_000, 3):  # almost every word is light with 3
        monkeypatch.setattr(lm, "HEAVY", heavy)
        rows = lm.lm_scores(odd_docs, p=p).collect()
        words = [(r.doc_id, lm.words_of((r.text or "").encode())) for r in odd_docs.select("doc_id", "text").collect()]
        learnt = Counter(w for i, ws in words if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*ws, b"\n"])
        n, v = sum(learnt.values()), len(learnt)
        assert len(rows) == len(words) and rows[0].train_tokens == n
        for r in rows:
            extra = r.n_tokens * (math.log10(n + v + 256) - math.log10(n + v + 1))
            assert r.score == pytest.approx(r.base_score - extra, rel=1e-5, abs=1e-5)
    assert lm.lm_scores(no_docs, p=p).collect() == []


def test_pipeline_stages(spark, sf_dir, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        rows = corpus_pipeline.settle(stage(spark, rows, sf_dir), "test-stage")
        if name == "near duplicates":
            ids = [r[0] for r in rows.select("doc_id").collect()]
            assert len(ids) == len(set(ids)) and len(ids) > 100
        if name == "personal data":
            assert not any(slow_spans(r.text) for r in rows.collect())
        assert name == "encoding" or rows.columns == columns
    assert rows.filter("n_tokens <> size(ids)").count() == 0


def test_lm_spells_unknown_words(spark, odd_docs, no_docs, monkeypatch):
    """Every unknown word of a text is scored by its subwords, as often as it stands there; all else scores as before."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    p = lm.LmParams(rounds=1, least_steps=2)
    plain = sorted((tuple(r)[:6] for r in lm.lm_scores(odd_docs, p=p).collect()), key=str)
    rows = lm.lm_scores(odd_docs, p=p, spell_path=path).collect()
    assert rows[0].__fields__[-1] == "spelling_score" and sorted((tuple(r)[:6] for r in rows), key=str) == plain
    assert all((r.spelling_score < 0) == (r.n_known < r.n_tokens) for r in rows)
    assert all(r.spelling_score == 0 for r in rows if not r.held_out)

    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    learnt = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 != 2)
    docs = spark.createDataFrame(
        [(learnt, "one two three"), (held, "one zebra"), (held, "zebra two zebra qqxz"), (held, "qqxz"), (held, "two")], "doc_id long, text string"
    )
    for heavy in (300_000, 1):
        monkeypatch.setattr(lm, "HEAVY", heavy)
        got = {r.n_tokens - r.n_known if r.held_out else -1: r.spelling_score for r in lm.lm_scores(docs, p=p, spell_path=path).collect()}
        one = {r.n_tokens: r.spelling_score for r in lm.lm_scores(docs, p=p, spell_path=path).filter("held_out and n_tokens - n_known = 1").collect()}
        assert got[-1] == got[0] == 0 and got[3] == pytest.approx(2 * one[3] + one[2], rel=1e-6)
    assert lm.lm_scores(no_docs, p=p, spell_path=path).collect() == []


def test_lm_query_spells_unknown_words(spark, sf_dir):
    rows = QUERIES["op3_lm_scoring"](spark, sf_dir).filter("held_out").collect()
    assert any(r.n_known < r.n_tokens for r in rows)
    assert all((r.spelling_score < 0) == (r.n_known < r.n_tokens) for r in rows)
