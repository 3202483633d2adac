"""Registered queries: names, and SQL where SQL can express them."""

import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from fleetlog.llm.oracle import ORACLE
from fleetlog.llm.queries import QUERIES
from tests.oracle_compare import compare, duck


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, sf_small, key):
    r = compare(spark, duck(sf_small), key, sf_small, QUERIES[key], ORACLE[key])
    assert r["cols_ok"] and r["values_ok"], r


def test_workers_need_no_installed_package(spark):
    """The package travels with the job."""
    from fleetlog.session import ship
    ship(spark)

    def where(_):
        import fleetlog.llm.common as c
        yield c.__file__

    assert spark.sparkContext.parallelize([0], 1).mapPartitions(where).collect()
    assert any("fleetlog_pkg.zip" in f for f in spark.sparkContext.listFiles)
    assert corpus_pipeline.STAGES[1][0] == "near_duplicates"
