from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as entry
from visbag.plans import later, more, more_oracles
from visbag.plans.oracles import ORACLES as FIRST
from visbag.plans.queries import QUERIES as SECOND

ORACLES, QUERIES = FIRST | more_oracles.ORACLES | later.ORACLES, SECOND | more.QUERIES | later.QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert oracle.difference(spark, QUERIES[name], ORACLES[name], sf) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "item_id", "score"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_training_query(spark, sf):
    assert QUERIES["kmeans_train"](spark, sf).count() == 16 * 64
