"""Every catalogued query against its SQL at sf0.01."""

import pytest

import __spark_entry__ as contract
from martflow.plans.oracle import ORACLE
from martflow.plans.queries import BATCH
from martflow.streaming.replay import STREAMS
from oracle_compare import compare, connect

QUERIES = {name: contract.queries()[name] for name in (*BATCH, *STREAMS)}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLE[name]) > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert contract.entry(spark).columns == ["name", "value"]
