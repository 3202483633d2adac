"""Every registered query against its DuckDB SQL on sf0.001."""

import pytest

import __spark_entry__ as ent
from fleetlog.plans.catalog import QUERIES
from fleetlog.plans.oracle import ORACLE as SQL
from tests.oracle_compare import compare, duck

KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


@pytest.mark.parametrize("key", [k for k in KEYS if k in SQL])
def test_matches_oracle(spark, con, sf_small, key):
    r = compare(spark, con, key, sf_small, QUERIES[key], SQL[key])
    assert r["cols_ok"], r
    assert r["values_ok"], r


def test_every_key_has_an_oracle():
    assert [k for k in KEYS if k not in SQL] == []
    assert set(QUERIES) <= set(ent.queries())


def test_entry(spark):
    df = ent.entry(spark)
    assert df.count() > 0
    assert df.columns == ["node", "tid", "function", "lvl", "id", "puttime", "end_time", "end_function", "duration",
                          "matched"]
