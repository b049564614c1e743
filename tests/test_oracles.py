"""Every registered query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import check_oracles
import pytest

import __spark_entry__ as entry
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check_oracles.connect(SF)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_matches_sql(spark, duck, name):
    text, _, _, fine = check_oracles.compare(spark, duck, name, SF)
    assert fine, text


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)
    assert set(registry.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
