"""Model columns of the quality and language-model operators against scalar definitions."""

from __future__ import annotations

import math
import random

import numpy as np
import public_tokenizers
import pytest

from wanderloop.llm import lm, quality
from wanderloop.llm.attention import AttentionParams, first_weights, pack
from wanderloop.llm.docstats import text_stats
from wanderloop.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, {r[0]: text_stats((r[1] or "").encode())[1] for r in docs.select("doc_id", "text").collect()}


def logistic(z):
    return 1 / (1 + math.exp(-z))


def walked(trees, node, x):
    """Value of the leaf below a node, one comparison at a time."""
    if trees.left[node] == node:
        return float(trees.value[node])
    return walked(trees, trees.left[node] if x[trees.feature[node]] <= trees.cut[node] else trees.right[node], x)


def test_verdicts_of_trees_walked_one_by_one(spark, sf_dir, tables):
    docs, labels, features = tables
    trees = quality.fit_quality_trees(docs, labels)
    want = {i: logistic(trees.start + sum(walked(trees, root, x) for root in trees.roots)) for i, x in features.items()}
    assert len(trees.roots) > 5 and len({round(v, 6) for v in want.values()}) > 10
    for r in QUERIES["op2_quality_rules"](spark, sf_dir).collect():
        assert abs(r["quality_score"] - want[r["doc_id"]]) < 1e-6
        assert abs(want[r["doc_id"]] - 0.5) < 1e-6 or r["kept"] == (not r["base_failed"] and want[r["doc_id"]] >= 0.5)


def test_additive_scores_summed_one_by_one(spark, sf_dir, tables):
    docs, labels, features = tables
    model = quality.fit_quality_tables(docs, labels)

    def place(cuts, value):
        return sum(1 for c in cuts if c < value)

    def slow(x):
        total = model.start
        for cuts, values, v in zip(model.edges, model.tables, x):
            total += values[place(cuts, v)]
        for (i, j), values in zip(model.pairs, model.pair_tables):
            total += values[place(model.pair_edges[i], x[i]), place(model.pair_edges[j], x[j])]
        return logistic(total)

    assert model.pairs
    for r in QUERIES["op4_quality_classifier"](spark, sf_dir).collect():
        assert abs(r["score"] - slow(features[r["doc_id"]])) < 1e-6


def slow_log_probs(classes, w, p):
    """Natural log probability of each class of one text: every sum written out."""
    s, d, out = p.block, p.width, []
    inputs = [p.start, *classes[:-1]]
    for t, target in enumerate(classes):
        own = t // s * s
        seen = range(max(own - s, 0), t + 1)

        def at(i):
            return [float(w["embed"][inputs[i]][c]) + float(w["place"][i - own + s][c]) for c in range(d)]

        def through(x, name, m):
            return [sum(x[c] * float(w[name][c][k]) for c in range(d)) for k in range(m)]

        x = at(t)
        q = through(x, "query", d)
        scores = [sum(a * b for a, b in zip(q, through(at(i), "key", d))) / math.sqrt(d) for i in seen]
        top = max(scores)
        share = [math.exp(v - top) for v in scores]
        values = [through(at(i), "value", d) for i in seen]
        h = [x[c] + sum(a * v[c] for a, v in zip(share, values)) / sum(share) for c in range(d)]
        logits = [v + float(b) for v, b in zip(through(h, "out", p.classes), w["bias"])]
        top = max(logits)
        out.append(logits[target] - top - math.log(sum(math.exp(v - top) for v in logits)))
    return out


def test_scores_of_attention_written_out(spark):
    p = lm.LmParams(attention=AttentionParams(classes=20, width=6, block=4))
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), encoding="ascii") as file:
        ranks = file.read()
    sub = lm.Subwords(ranks)
    rng = np.random.default_rng(4)
    class_of = rng.integers(0, 20, sub.size).astype(np.uint8)
    log_in = np.log(rng.random(sub.size))
    weights = first_weights(p.attention, np.full(20, 0.05))
    weights = {k: v * 2 + 0.1 for k, v in weights.items()}
    pick = random.Random(1)
    texts = [None, "", "one", "The quick brown fox", " ".join(pick.choice(["alpha", "béta", "gamma42", "x"]) for _ in range(30))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sc = spark.sparkContext
    model = sc.broadcast((class_of, log_in, pack({k: v.astype(np.float32) for k, v in weights.items()}), {}))
    rows = lm.score_rows(docs, "doc_id", "text", sc.broadcast(ranks), model, p).filter("word is null").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = [i for word in (texts[r["doc_id"]] or "").encode().lower().split() for i in sub.of(word)] + [sub.end]
        want = sum(slow_log_probs([int(class_of[i]) for i in ids], weights, p.attention)) + sum(float(log_in[i]) for i in ids)
        assert abs(r["score"] * math.log(10) - want) < 1e-4 * abs(want)
