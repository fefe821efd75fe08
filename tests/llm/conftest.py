from __future__ import annotations

import pytest

TEXTS = [
    (0, "One two three four five six seven eight nine ten eleven twelve"),
    (1, "one two three four five six seven eight nine ten eleven twelve"),
    (2, "zero one two three four five six seven eight nine ten eleven twelve"),
    (3, None), (4, ""), (5, " \n\t "), (6, "short text"), (6, "short text"), (7, "SHORT\ttext"), (8, "word " * 5000), (None, "a null id"), (9, "straße ñandú 漢字 \U0001F600"),
]


@pytest.fixture
def docs(spark):
    """Nulls, empty and long texts, copies, a repeated row, a null identifier, and columns with names that operators use themselves."""
    rows = [(i, t, "en", "s", 0, "x", 1, None) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, shard int, node string")


@pytest.fixture
def none(docs):
    return docs.where("doc_id = -1")
