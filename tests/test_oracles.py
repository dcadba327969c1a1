"""Every registered query with an oracle equals its DuckDB SQL on the sf0.01 fixtures."""

import pytest

import __spark_entry__ as entry
from fleetgrade.plans.registered import REGISTRY
from tests.compare import compare, duck
from tests.conftest import SF01

QUERIES = REGISTRY
ORACLES = {k: v for k, v in entry.oracle_sql().items() if k in REGISTRY}


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_has_an_oracle():
    missing = sorted(set(QUERIES) - set(ORACLES))
    assert missing == [], f"queries without oracle: {missing}"


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_oracle(spark, con, key):
    ok, msg = compare(spark, SF01, key, QUERIES[key], ORACLES[key], con)
    assert ok, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert "maturity" in df.columns
