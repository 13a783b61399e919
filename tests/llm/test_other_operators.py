"""URL lists, nearest neighbours and page extraction."""

from __future__ import annotations

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wanderloop.llm import cross_polytope, extraction, url_lists
from wanderloop.llm.dom import read_page
from wanderloop.llm.queries import ORACLES, QUERIES


def test_url_filters_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    cur = con.execute(ORACLES["op1_url_filters"])
    df = QUERIES["op1_url_filters"](spark, sf_dir)
    assert [d[0] for d in cur.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_entries_hold_from_their_day_to_the_next(spark):
    entries = spark.createDataFrame(
        [
            ("l", "host", "bad.com", "block", day(10)), ("l", "host", "bad.com", "remove", day(20)),
            ("l", "prefix", "bad.com/ok/", "allow", day(0)), ("m", "host", "bad.com", "allow", day(15)),
            ("m", "host", "bad.com", "block", day(15)), ("l", "host", None, "block", day(1)), ("l", "host", "bad.com", "block", None),
        ],
        "list_name string, kind string, pattern string, action string, day date",
    )
    captures = [(i, "HTTP://www.BAD.com/x?q#f", day(i)) for i in (9, 10, 14, 19, 20)]
    captures += [(50, "http://bad.com/ok/y", day(12)), (51, None, day(12)), (52, "http://bad.com/x", None), (53, "nonsense", day(12))]
    captures += [(50, "http://bad.com/ok/y", day(12))]
    df = spark.createDataFrame([(*c, "old") for c in captures], "page_id long, url string, day date, lists string")
    got = sorted((r.page_id, r.n_active, r.lists, r.blocked) for r in url_lists.filter_urls(df, entries).collect())
    assert got == [
        (9, 0, "", False), (10, 1, "l", True), (14, 1, "l", True), (19, 2, "l,m", True), (20, 1, "m", True),
        (50, 2, "l", False), (50, 2, "l", False), (51, 0, "", False), (52, 0, "", False), (53, 0, "", False),
    ]
    assert url_lists.filter_urls(df.filter("false"), entries).collect() == []
    assert url_lists.filter_urls(df, entries.filter("false")).filter("blocked").collect() == []


def brute(rows, queries, k=20):
    out = {}
    for q in queries:
        mine = [v for i, v in rows if i == q]
        for x in mine:
            scored = sorted({(-float(np.dot(x, v)), i) for i, v in rows if i != q})[:k]
            out[q] = [i for _, i in scored]
    return out


def test_nearest_neighbours_recall(spark, sf_dir):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = QUERIES["op8_nearest"](spark, sf_dir).collect()
    want = brute(rows, [i for i, _ in rows if i % 20 == 0])
    found = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in want}
    assert all(len(found[q]) == min(20, len(rows) - 1) for q in want)
    assert np.mean([len(set(found[q]) & set(want[q])) / len(want[q]) for q in want]) >= 0.9
    vectors = dict(rows)
    assert all(r.score == pytest.approx(float(vectors[r.query_id] @ vectors[r.vec_id]), abs=1e-12) for r in got)


def test_nearest_neighbours_recall_with_norms_that_differ(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((40, 128)).repeat(50, axis=0) + 0.7 * rng.standard_normal((2000, 128))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1] *= 10
    x[2::7] *= 1 + 0.3 * rng.random((len(x[2::7]), 1))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = cross_polytope.nearest(table, F.col("vec_id") % 20 == 0).collect()
    scores = x[::20] @ x.T
    scores[np.arange(len(scores)), np.arange(0, len(x), 20)] = -np.inf
    want = {20 * q: set(row[:20].tolist()) for q, row in enumerate(np.argsort(-scores, axis=1))}
    found = [len(want[q] & {r.vec_id for r in got if r.query_id == q}) / 20 for q in want]
    print("recall", np.mean(found))
    assert np.mean(found) >= 0.9


def test_nearest_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(5) * (1 + i % 3)]) for i in range(1, 40)]
    rows += [(100 + i, [1.0, 2.0, 0.0, 0.0, 0.5]) for i in range(60)]  # one hot vector
    bad = [(200, None), (201, [0.0] * 5), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [float("nan")] * 5), (204, [float("inf")] * 5), (205, []), (None, [1.0] * 5)]
    table = spark.createDataFrame([(*r, 0) for r in rows + bad + rows[:2]], "vec_id long, embedding array<double>, rank int")
    got = cross_polytope.nearest(table, F.col("vec_id") % 20 == 0).collect()
    want = brute([(i, np.array(v)) for i, v in rows], [i for i, _ in rows if i % 20 == 0])
    for q, ids in want.items():
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == ids
    assert {r.query_id for r in got} == set(want)
    assert cross_polytope.nearest(table.filter("false"), F.col("vec_id") % 20 == 0).collect() == []


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).standard_normal((4, 16))
    assert np.allclose(np.linalg.norm(cross_polytope.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(cross_polytope.hadamard(cross_polytope.hadamard(x)), x)


PAGE = (
    '<!doctype html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav>'
    '<div class="ad">Buy now</div><article><h1>A &amp; B</h1><p>First   paragraph\nwith <b>words, and<br>more.<p>Second one follows, it is long enough.</p>'
    '<table><tr><td>cell one<td>cell two</table></article><div class="comments"><p>I disagree with all of this, really.</p></div><footer>&copy; us</footer>'
)


def test_page_reader_mends_what_is_left_open():
    page = read_page(PAGE)
    tags = [n.tag for n in page.nodes]
    assert tags.count("p") == 3 and tags.count("td") == 2
    second = page.nodes[[i for i, t in enumerate(tags) if t == "p"][1]]
    assert page.nodes[second.parent].tag == "article"
    assert all("var t" not in t for _, t in page.texts)
    assert read_page("").texts == [] and read_page("a < b <!-- x").texts[0][1].startswith("a ")
    read_page("<a " + '"' * 5000 + "<b>" * 20000)  # no pattern goes over a page again and again


def test_choice_keeps_all_below_a_kept_node():
    parent, depth = [-1, 0, 0, 1, 1], [0, 1, 1, 2, 2]
    kept = extraction.choose(parent, depth, np.array([0.1, 0.9, 0.2, 0.8, 0.4]))
    assert kept.tolist() == [False, True, False, True, True]
    kept = extraction.choose(parent, depth, np.array([0.1, 0.6, 0.2, 0.8, 0.01]))
    assert kept.tolist() == [False, False, False, True, False]


def test_extraction_on_the_tables_and_odd_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    trees = extraction.fit_extractor(pages)
    good = 0
    rows = pages.collect()
    for r in rows:
        blocks = extraction.Blocks(r.html)
        own = [t for (_, t, _), w in zip(blocks.texts, extraction.own_labels(blocks)) if w]
        good += extraction.main_text(r.html, trees) == "\n".join(own)
    assert good / len(rows) > 0.97
    text = extraction.main_text(PAGE, trees).split("\n")
    assert text[:3] == ["A & B", "First paragraph with words, and more.", "Second one follows, it is long enough."]
    assert not any("Buy" in t or "Home" in t or "us" == t[-2:] for t in text)
    long_page = "<article>" + "<p>Some words that are main text, again.</p>" * 5000 + "</article>"
    odd = spark.createDataFrame(
        [(1, "u", None, 1), (2, None, "", 2), (3, "u", long_page, 3), (3, "u", long_page, 3), (4, "u", "<div><div>" * 3000, 4)],
        "page_id long, url string, html string, text int",
    )
    out = {r.page_id: r.text for r in extraction.extract(odd, trees).collect()}
    assert out[1] == out[2] == out[4] == "" and out[3].count("\n") == 4999
    assert extraction.extract(odd.filter("false"), trees).collect() == []
    assert extraction.fit_extractor(odd.filter("false")).score(np.zeros((1, 1)))[0] == pytest.approx(0.5)


def held_out_layouts(pages, trees, seed):
    hit = kept_n = wanted_n = 0
    sources = [r.html for r in pages]
    for i, source in enumerate(sources):
        blocks = extraction.Blocks(source)
        body = [t for (at, t, _), w in zip(blocks.texts, extraction.own_labels(blocks)) if w and blocks.tags[at] not in extraction.TAG_GROUPS["heading"]]
        spare = [t for _, t, _ in extraction.Blocks(sources[i - 1]).texts]
        if not body:
            continue
        made = extraction.Blocks(extraction.layout(body[:8], spare, np.random.default_rng([seed, i])))
        marked = ["data-k" in a or t == "#text" and "data-k" in made.attrs[p] for a, t, p in zip(made.attrs, made.tags, made.parent)]
        kept = extraction.choose(made.parent, made.depth, trees.score(made.features()))
        for at, _, _ in made.texts:
            hit += kept[at] and marked[at]
            kept_n += kept[at]
            wanted_n += marked[at]
    return hit / kept_n, hit / wanted_n


def test_extraction_in_layouts_not_seen(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    trees = extraction.fit_extractor(pages, rows=100)
    precision, recall = held_out_layouts(pages.collect()[:150], trees, 77)
    assert precision > 0.95 and recall > 0.95
