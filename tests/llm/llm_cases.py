"""Rows and tables that the tests of the subpackage share; test modules import the fixtures that they use."""

from __future__ import annotations

import pytest

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
#: Nulls, empty and blank texts, one word, a very long text, repeated rows and ids, marks inside texts, bytes beyond ASCII.
MESSY = [
    (None, None), (1, ""), (2, "  \n\t "), (3, "one"), (4, "a b c d e f g"), (4, "a b c d e f g"), (4, "other text of the same id"), (5, LONG), (6, LONG),
    (7, "Größe ﬁ 漢字 <|endoftext|> a\x1cb\u0085c   d\r\ne'll 12½"), (None, "x y z x y z x y z x y z x y z"), (9, "A b C d e F g"),
]


@pytest.fixture(scope="session")
def messy(spark):
    """Rows of MESSY with columns whose names the operators use themselves."""
    rows = [(i, t, "s", 5, 1.5, "q", True, 3) for i, t in MESSY]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, fp int, score double, row string, kept boolean, ids int").repartition(3)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
