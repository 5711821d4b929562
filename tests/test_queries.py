"""Every named query with SQL, on the smallest tables, against that SQL."""

import os

import pytest
from compare import compare, duck

import __spark_entry__ as contract
from veristrand.plans.registry import CATALOGS

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = contract.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, connection, name):
    problem, _ = compare(spark, connection, FOLDER, contract.queries()[name], ORACLES[name])
    assert problem == ""


def test_every_query_has_sql():
    own = {name for catalog in CATALOGS for name in catalog.queries}
    assert own <= set(contract.queries()) and own <= set(ORACLES)


def test_smoke_query_returns_ranked_rows(spark):
    assert contract.entry(spark).columns == ["doc_id", "score"]
