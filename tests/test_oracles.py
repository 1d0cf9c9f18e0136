"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from tallyforge import registry

from .oracle import compare


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    compare(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() >= 0
