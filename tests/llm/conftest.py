from __future__ import annotations

import pytest

LONG = "Sie said hello to mary " * 8000
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from the angry bear again", "en", "a"),
    (2, None, "en", "b"), (3, "", None, None), (4, " \n\t ", "en", "a"), (5, LONG, "en", "b"),
    (6, "mail bob@x.example.com or +1 (499) 555-6503 from 10.2.3.4, card 4111 1111 1111 1111 .", "en", "a"),
    (6, "mail bob@x.example.com or +1 (499) 555-6503 from 10.2.3.4, card 4111 1111 1111 1111 .", "en", "a"),
    (7, "line one\nline one\nÉCOLE İstanbul ΣΑΣ 漢字 <|endoftext|> it's 3.14", "fr", None), (None, "no id here at all", "en", "c"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash."""
    rows = [(*r, -1, "x", 0, "k") for r in TEXTS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, ids int, _text string"
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session", autouse=True)
def batches(spark):
    from wanderloop.llm.shared import bounded_batches

    bounded_batches(spark)
