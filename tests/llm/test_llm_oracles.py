"""Registered queries of the subpackage against their SQL, and the contract's columns."""

from __future__ import annotations

import pytest

import __spark_entry__
from tallyforge.llm import queries

from ..oracle import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    compare(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], sf_dir)


COLUMNS = {
    1: {"vec_id", "n_links", "component_id", "kept"},
    2: {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    3: {"doc_id", "fingerprint", "component_id"},
    5: {"query_id", "rank", "vec_id", "score"},
    7: {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    8: {"doc_id", "start", "n_tokens", "ids_crc32"},
    9: {"doc_id", "size", "source_size", "target", "taken"},
    10: {"doc_id", "held_out", "score", "predicted"},
    11: {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"},
    12: {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"},
    13: {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
}


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)


@pytest.mark.parametrize("number", sorted(COLUMNS))
def test_columns(spark, sf_dir, number):
    name = next(n for n in queries.QUERIES if n.startswith(f"op{number}_"))
    assert COLUMNS[number] <= set(queries.QUERIES[name](spark, sf_dir).columns)
