"""Every registered query against its DuckDB oracle; rows-only ones run."""

from __future__ import annotations

import pytest

from catalyte.plans import registry

from .conftest import TINY
from .oracle import same

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    same(spark, TINY, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, TINY).count() > 0


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and {"item_id", "candidates", "confidence"} <= set(rows[0].asDict())


def test_exact_fold_agrees(spark):
    assert not QUERIES["q04_exact_fold"](spark, TINY).where("NOT same").count()
