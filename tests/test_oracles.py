"""Every registered query against its SQL on the smallest data, and plan checks."""

import pathlib
import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from ledgerflow.plans.queries import registered
from tests.compare import connection, differences
from tests.conftest import SMALL

LIBRARY = pathlib.Path(__file__).parent.parent / "ledgerflow"


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(registered()))
def test_query_equals_its_sql(spark, con, name):
    assert differences(queries()[name](spark, SMALL), con, oracle_sql()[name]) == []


def test_entry(spark):
    assert entry(spark).count() == 3


@pytest.mark.parametrize("name", ["flow_type_stats", "top_buyers_6m", "wallet_history", "exchange_activity", "block_gaps"])
def test_plans_stay_on_the_jvm_without_cartesian_products(spark, name):
    plan = queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for operator in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "Arrow"):
        assert operator not in plan


def test_library_neither_collects_nor_uses_python_functions():
    collects = {}
    for path in LIBRARY.rglob("*.py"):
        if path.is_relative_to(LIBRARY / "llm"):  # has rules of its own
            continue
        text = path.read_text()
        assert not re.search(r"toPandas|toLocalIterator|localCheckpoint|crossJoin|\budf\b|\.rdd\b", text), path
        if count := text.count(".collect()"):
            collects[path.name] = count
    # One helper, ``tables.weeks``: one number per week of chain.
    assert collects == {"tables.py": 1}
