"""Every query with SQL against DuckDB on the driver's tables."""

import os

import pytest

import __spark_entry__ as entry
from listlight.plans.registry import ORACLES, QUERIES
from tests.oracle import SF, connect, same


@pytest.fixture(scope="module")
def duck():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    same(QUERIES[name](spark, SF), duck, ORACLES[name])


def test_rows_only(spark):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_nothing_outside_imports_the_llm_folder():
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(f"{top}/listlight"):
        if not folder.rstrip("/").endswith("llm"):
            for f in files:
                if f.endswith(".py"):
                    with open(f"{folder}/{f}", encoding="utf-8") as text:
                        assert ".llm" not in text.read()
