"""Every registered query against its SQL; the others must give rows."""

from __future__ import annotations

import pytest

from oddlines.plans import catalog
from tests.compare import connect, differences

QUERIES, CHECKS = catalog.queries(), catalog.checks()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_same_as_sql(spark, duck, sf_dir, name):
    assert differences(spark, duck, QUERIES[name], CHECKS[name], sf_dir) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_gives_rows(spark, sf_dir, name):
    assert not QUERIES[name](spark, sf_dir).isEmpty()


def test_checks_have_queries():
    assert set(CHECKS) <= set(QUERIES)
