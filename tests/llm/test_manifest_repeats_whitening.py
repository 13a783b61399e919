"""Manifest, repeated passages and whitening against slow definitions."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wanderloop.llm import cross_polytope, disclosure, extraction, merkle, repeats, whitening
from wanderloop.llm.queries import QUERIES
from wanderloop.llm.repeats import RepeatParams
from wanderloop.llm.whitening import WhiteningParams

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Manifest

def slow_field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def slow_tree(nodes):
    """Root, and for every node its siblings level by level as (before, after)."""
    paths, level = [[] for _ in nodes], [(h, [i]) for i, h in enumerate(nodes)]
    while len(level) > 1:
        up = []
        for at in range(0, len(level), 8):
            run = level[at:at + 8]
            for k, (_, below) in enumerate(run):
                step = ("".join(h for h, _ in run[:k]), "".join(h for h, _ in run[k + 1:]))
                for i in below:
                    paths[i].append(step)
            up.append((sha("".join(h for h, _ in run)), [i for _, below in run for i in below]))
        level = up
    return level[0][0], paths


def slow_manifest(rows):
    """(doc_id, leaf, subroot, root, path) of rows (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = []
    for lang in langs:
        leaves = sorted(((r[0] is not None, r[0] or 0, sha("".join(map(slow_field, r)))) for r in rows if r[2] == lang))
        trees.append(([x if known else None for known, x, _ in leaves], [h for *_, h in leaves], *slow_tree([h for *_, h in leaves])))
    root, tops = slow_tree([t[2] for t in trees])
    return [
        (i, leaf, sub, root, tuple(path + top)) for (ids, leaves, sub, paths), top in zip(trees, tops) for i, leaf, path in zip(ids, leaves, paths)
    ]


def found_manifest(df, **more):
    rows = merkle.manifest(df, **more).withColumn("folded", merkle.fold(F.col("seen"), F.col("path"))).collect()
    return [((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((s["before"], s["after"]) for s in r["path"])), r["folded"] == r["root"]) for r in rows]


@pytest.mark.parametrize("n,slices", [(1, 3), (8, 2), (9, 4), (150, 5)])
def test_manifest_of_trees_of_all_sizes(spark, n, slices):
    rng = random.Random(n)
    rows = [(rng.randint(0, n), rng.choice(["a", None]), rng.choice(["de", "en", "en", "en", None, "éü"]), rng.randint(0, 9), rng.choice(["x", "", None, "Yé"])) for _ in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = found_manifest(df, slices=slices)
    assert sorted((g for g, _ in got), key=repr) == sorted(slow_manifest(rows), key=repr)
    assert all(same for _, same in got)


def test_manifest_of_odd_documents(odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = found_manifest(odd_docs, slices=3)
    assert sorted((g for g, _ in got), key=repr) == sorted(slow_manifest(rows), key=repr)
    assert merkle.manifest(no_docs).count() == 0


def test_a_change_of_one_field_shows(odd_docs):
    lowered = merkle.manifest(odd_docs, changed={"text": merkle.lowered(F.col("text"))}, slices=3)
    rows = lowered.withColumn("ok", merkle.fold(F.col("seen"), F.col("path")) == F.col("root")).collect()
    assert {r["doc_id"] for r in rows if not r["ok"]} == {5, 7}


# Repeated passages

def slow_repeats(texts, size):
    words = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i:i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - size + 1) if count[tuple(w[i:i + size])] > 1 for j in range(i, i + size)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("p", [
    RepeatParams(size=5, seed_words=2), RepeatParams(size=5, seed_words=5, block=7), RepeatParams(size=6, seed_words=1, crowd=1, block=3),
    RepeatParams(size=1, seed_words=1), RepeatParams(size=4, seed_words=2, crowd=0),
], ids=str)
def test_repeats_of_random_texts(spark, p):
    rng = random.Random(repr(p))
    passages = [[rng.choice("abcdé漢") * rng.randint(1, 3) for _ in range(rng.randint(3, 12))] for _ in range(6)]
    texts = [None, "", " \n", "a b a b a b a b a b a b", "x y", "x y"]
    for _ in range(120):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(["one", "two", "three", "a"]) + str(rng.randint(0, 30)) for _ in range(rng.randint(1, 8))]
        texts.append("".join(w + rng.choice([" ", "\n", "  ", "\t", "\x0b"]) for w in words))
    texts += texts[-20:]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = repeats.remove_repeats(df, p=p).collect()
    assert [tuple(r)[1:] for r in sorted(rows)] == slow_repeats(texts, p.size)


def test_repeats_of_odd_documents(odd_docs, no_docs):
    out = repeats.remove_repeats(odd_docs)
    assert set(out.columns) == {*odd_docs.columns, "n_words", "n_removed"}
    rows = out.select("doc_id", "n_words", "n_removed", "text").collect()
    texts = odd_docs.select("doc_id", "text").collect()
    want = [(r[0], *s) for r, s in zip(texts, slow_repeats([r[1] for r in texts], 35))]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert repeats.remove_repeats(no_docs).count() == 0


def test_a_passage_of_many_documents_is_gone_everywhere(spark):
    """One passage in all texts, between words of their own: its edges crowd one bucket."""
    passage = " ".join(f"p{i}" for i in range(50))
    texts = [" ".join(f"u{i}x{j}" for j in range(40)) + f" {passage} " + " ".join(f"v{i}x{j}" for j in range(40)) for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for crowd in (5, 10_000):
        rows = repeats.remove_repeats(df, p=RepeatParams(crowd=crowd)).collect()
        assert {(r["n_words"], r["n_removed"]) for r in rows} == {(130, 50)}
        assert all("p0" not in r["text"] for r in rows)


# Whitening

def slow_whitening(vectors, k):
    x = np.floor(64 * vectors).astype(np.int64) + 1_000_000
    n, total = len(x), [int(s) for s in x.astype(object).sum(axis=0)]
    c = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:k]
    deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(row, total)) for row in x]
    return n, deviation, c @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def check_whitening(got, ids, vectors, k):
    n, deviation, want, explained = slow_whitening(vectors, k)
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    assert sorted(by_id) == sorted(ids) and all(sorted(rows) == list(range(1, k + 1)) for rows in by_id.values())
    values = np.array([[by_id[i][j + 1]["whitened"] for j in range(k)] for i in ids])
    signs = np.sign((values * want).sum(axis=0))
    assert np.abs(values * signs - want).max() < 1e-8
    for i, d in zip(ids, deviation):
        assert {(r["n"], r["deviation"]) for r in by_id[i].values()} == {(n, d)}
        assert all(abs(by_id[i][j + 1]["explained"] / explained[j] - 1) < 1e-9 for j in range(k))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-8


def test_whitening_of_the_tables(spark, sf_dir):
    rows = [r for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r["embedding"] is not None]
    rows = [r for r in rows if all(v is not None and np.isfinite(v) for v in r["embedding"])]
    check_whitening(QUERIES["op11_whitening"](spark, sf_dir).collect(), [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float), 32)


def test_whitening_of_few_dimensions_in_small_blocks(spark):
    vectors = np.random.default_rng(1).normal(size=(200, 5)) * [3, 2, 1, 0.7, 0.5]
    df = spark.createDataFrame([(i, v.tolist(), i) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, component int")
    check_whitening(whitening.whiten(df, p=WhiteningParams(block=7)).collect(), list(range(200)), vectors, 5)


def test_whitening_of_odd_vectors(spark):
    good = [(1, [1.0, 0.0, 2.0]), (2, [0.5, 0.0, -1.0]), (2, [0.5, 0.0, -1.0]), (None, [0.0, 0.0, 0.25]), (5, [2.0]), (6, [])]
    bad = [(7, None), (8, [1.0, None, 0.0]), (9, [float("nan"), 0.0, 0.0]), (10, [float("inf"), 0.0, 0.0]), (11, [1e160, 0.0, 0.0])]
    kind = "vec_id long, embedding array<double>"
    rows = whitening.whiten(spark.createDataFrame(good + bad, kind)).collect()
    assert len(rows) == len(good) * 3 and {r["n"] for r in rows} == {len(good)}
    full = np.array([v + [0.0] * (3 - len(v)) for _, v in good])
    _, deviation, want, _ = slow_whitening(full, 2)
    assert sorted(r["deviation"] for r in rows if r["component"] == 1) == sorted(deviation)
    for j in (1, 2):
        assert np.allclose(sorted(abs(r["whitened"]) for r in rows if r["component"] == j), sorted(np.abs(want[:, j - 1])))
    assert all(r["whitened"] is None for r in rows if r["component"] == 3)
    assert rows[0]["identity_error"] < 1e-9
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], kind)).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 0, None, None), (2, 0, None, None)]
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame(bad, kind)).count() == 0


def test_deviations_beyond_a_long_are_null():
    fit = whitening.Whitening(1 << 22, (0,), np.zeros((0, 1)), np.zeros(0), 0.0, 0)
    assert whitening.deviations_of(np.array([[3], [1 << 12]], np.int64), fit).to_pylist() == [9 << 44, None]


def test_equal_deviations_restart_the_bidiagonalisation():
    """A multiple of the identity ends every Krylov space after one step."""
    a = np.vstack([np.eye(6), -np.eye(6)])
    right, small, steps = whitening.bidiagonalise(lambda z: (float((a @ z) @ (a @ z)), a.T @ (a @ z)), 6, 6, WhiteningParams())
    assert steps == 6 and np.allclose(right @ right.T, np.eye(6), atol=1e-12) and np.allclose(np.linalg.svd(small)[1], np.sqrt(2))


# Nearest neighbours of vectors beyond the range of squares

def test_nearest_neighbours_of_tiny_and_huge_vectors(spark):
    rng = np.random.default_rng(2)
    scale = [1e-170] * 30 + [1.0] * 30 + [1e160, 1e-320]
    vectors = [(rng.normal(size=8) / 3 * s).tolist() for s in scale]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    rows = cross_polytope.nearest(df, F.col("vec_id") % 20 == 0).collect()
    asked = {r["query_id"] for r in rows}
    assert asked == {0, 20, 40, 60}  # the last one is huge
    with np.errstate(over="ignore", under="ignore"):
        for q in asked:
            got = [(r["vec_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q]
            want = sorted(((-float(np.dot(vectors[q], v)), i) for i, v in enumerate(vectors) if i != q))[:20]
            assert len(got) == 20 and all(np.isclose(s, np.dot(vectors[q], vectors[i]), rtol=1e-9, atol=0) or s == np.dot(vectors[q], vectors[i]) for i, s in got)
            assert len({i for i, _ in got} & {i for _, i in want}) >= 18


def test_pages_with_very_many_inline_elements_take_linear_time():
    source = "<div>" + "<b>x</b> y <i>z</i><br>" * 50_000 + "</div>"
    began = time.monotonic()
    blocks = extraction.Blocks(source)
    assert time.monotonic() - began < 20
    assert [len(text.split(" ")) for _, text, _ in blocks.texts] == [150_000]


# Personal data

def test_words_at_the_ends_of_texts_and_in_other_documents_disclose(spark):
    fill = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    docs = [(i, f"Zorblax {fill[i]} wrote from zo@x.example.com " + f"{fill[-i]} " * 40 + "Quuxley") for i in range(6)]
    docs += [(10, "zorblax alone"), (11, "nothing here")] + [(20 + i, f"{fill[i % 6]} and {fill[i % 5]}") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in disclosure.find_personal_data(df).collect()}
    joined = disclosure.find_personal_data(df, cfg=disclosure.Disclosure(near_keys=0)).collect()
    assert {r["doc_id"]: r for r in joined} == rows
    for i in range(6):
        text = docs[i][1]
        found = {text[t["start"]:t["stop"]]: t["action"] for t in rows[i]["terms"]}
        # Seven documents hold the one word, six the address; the other word stands beside it alone.
        assert found["Quuxley"] == "remove" and found.get("Zorblax") in (None, "generalise")
    assert rows[11]["terms"] == [] and rows[20]["terms"] == []


def test_many_values_in_one_text(spark):
    text = " ".join(f"user{i}@mail.example.com met Someone{i % 7}" for i in range(2000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.monotonic()
    row = disclosure.find_personal_data(df).first()
    assert len(row["spans"]) == 2000 and time.monotonic() - began < 60
