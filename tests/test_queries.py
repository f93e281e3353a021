import pytest
from conftest import SMALL
from oracle import same

import __spark_entry__ as entry
from tablescore.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name], SMALL)


def test_queries_without_sql_give_rows(spark):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    rows = {r["kind"]: r for r in entry.entry(spark).collect()}
    assert rows["same"]["levenshtein"] == rows["same"]["teds"] == rows["decorated"]["teds"] == 1.0


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
