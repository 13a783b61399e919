"""Every stage of the pipeline on odd rows, on repeated rows and on a table without rows."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)


def texts_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("name", STAGES)
def test_no_rows_give_no_rows(spark, sf_dir, no_docs, name):
    out = STAGES[name](spark, no_docs, sf_dir)
    assert name == "encoding" or out.columns == no_docs.columns
    assert out.collect() == []


@pytest.mark.parametrize("name", [n for n in STAGES if n != "encoding"])
def test_filters_keep_columns_and_give_known_rows_only(spark, sf_dir, odd_docs, name):
    """Names that clash with a stage's own stay what they were."""
    out = STAGES[name](spark, odd_docs, sf_dir)
    assert out.columns == odd_docs.columns and out.dtypes == odd_docs.dtypes
    rows = out.collect()
    assert all((r["kept"], r["ids"], r["_text"]) == ("x", 0, "k") for r in rows)
    assert {r["doc_id"] for r in rows} <= {1, 2, 3, 4, 5, 6, 7, None}


def test_quality_rejects_texts_without_enough_words(spark, sf_dir, odd_docs):
    """Null, empty and short texts fail the base rules, the text that repeats itself, too."""
    kept = {r["doc_id"] for r in STAGES["quality rules"](spark, odd_docs, sf_dir).collect()}
    assert not kept & {1, 2, 3, 4, 5, 6, 7, None}


def test_one_of_repeated_and_of_empty_texts_stays(spark, sf_dir, odd_docs):
    got = texts_of(STAGES["near duplicates"](spark, odd_docs, sf_dir))
    ids = Counter(i for i, _ in got.elements())
    assert ids[6] == 1  # two equal rows
    assert len({2, 3, 4} & set(ids)) == 1 and ids[2] == 1  # null, empty and blank have the fingerprint zero
    assert ids[1] == ids[5] == ids[7] == 1


def test_personal_data_goes_and_the_rest_stays(spark, sf_dir, odd_docs):
    got = texts_of(STAGES["personal data"](spark, odd_docs, sf_dir))
    before = texts_of(odd_docs)
    assert sum(got.values()) == sum(before.values())
    for pair in ((2, None), (3, ""), (4, " \n\t ")):
        assert got[pair] == 1
    for i, text in got:
        if i == 6:
            assert not any(v in text for v in ("bob@", "555-6503", "10.2.3.4", "4111")) and got[i, text] == 2


def test_every_row_is_encoded_once(spark, sf_dir, odd_docs):
    rows = STAGES["encoding"](spark, odd_docs, sf_dir).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in texts_of(odd_docs).elements())
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)] == [0, 0]


def test_mixing_repeats_at_most_three_times_and_alike(spark, sf_dir, odd_docs):
    """Documents without words weigh nothing: they stay as often as their source is taken whole."""
    got, before = texts_of(STAGES["mixing"](spark, odd_docs, sf_dir)), texts_of(odd_docs)
    assert got and set(got) <= set(before) and all(n <= 3 * before[k] for k, n in got.items())
    assert got == texts_of(STAGES["mixing"](spark, odd_docs, sf_dir))
