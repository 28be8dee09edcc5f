"""The registered corpus queries on the smallest tables, against their SQL where they have any."""

from __future__ import annotations

import pytest

from __spark_entry__ import oracle_sql, queries
from check_queries import compare, connect
from hostpulse.llm.queries import CHECKS, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), name, QUERIES[name], CHECKS.get(name), sf_dir) == ""


def test_all_operators_and_the_pipeline_are_registered():
    registered = queries()
    assert [n for n in range(1, 14) if not any(name.startswith(f"op{n}_") for name in registered)] == []
    assert "pipeline" in registered and set(CHECKS) <= set(oracle_sql())
