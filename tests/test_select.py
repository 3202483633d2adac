"""Time-range bounds (FIXTURES §8), defaults, pushdown."""

import datetime as dt

from fleetlog.operators import select
from fleetlog.sources import store


def _rows(spark, times):
    data = [("n", i, "INFO", 1, dt.datetime.fromisoformat(t), "a.cpp:1", "F", "m") for i, t in enumerate(times)]
    return spark.createDataFrame(
        data, "node string, id long, level string, tid long, puttime timestamp_ntz, fileline string, "
              "function string, message string")


def test_half_open_truncated_bounds(spark):
    times = ["2024-01-01 10:00:00.999", "2024-01-01 10:00:01", "2024-01-01 10:00:01.500",
             "2024-01-01 11:00:00.999", "2024-01-01 11:00:01", "2024-01-01 11:00:01.500"]
    df = _rows(spark, times)
    got = sorted(r["id"] for r in select.time_range(df, "2024-01-01 10:00:01.9", "2024-01-01 11:00:01.9").collect())
    assert got == [1, 2, 3]


def test_unreadable_bound_selects_nothing(spark):
    df = _rows(spark, ["2024-01-01 10:00:00"])
    assert select.time_range(df, "yesterday-ish", "now").count() == 0
    assert select.time_range(df).count() == 1  # defaults: epoch .. now


def test_stored_table_prunes_by_node_and_time(spark, sf_small):
    from fleetlog.session import scratch_path
    from fleetlog.sources import fixtures
    root = scratch_path(spark, "t-store")
    skipped = store.write_logs(fixtures.logs(spark, sf_small), root)
    assert skipped == []
    again = store.write_logs(fixtures.logs(spark, sf_small), root)   # nodes refused
    assert sorted(again) == [f"node-{i}" for i in range(5)]
    st = store.read_stored(spark, root)
    assert st.count() == fixtures.logs(spark, sf_small).count()
    q = select.time_range(st.where("node = 'node-1'"), "2024-01-05", "2024-01-06")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(node" in plan and "node-1" in plan
    assert "PushedFilters" in plan and "puttime" in plan.split("PushedFilters")[1][:300]
    assert store.stored_nodes(spark, root) == [f"node-{i}" for i in range(5)]


def test_unknown_node_is_an_error(spark, sf_small):
    import pytest
    from fleetlog.sources import fixtures
    with pytest.raises(ValueError):
        store.node_select(fixtures.logs(spark, sf_small), "node-99")


def test_rows_from_goes_by_arrival(spark):
    df = _rows(spark, ["2024-01-01 10:00:05", "2024-01-01 10:00:00", "2024-01-01 10:00:09"])
    got = select.natural_order(select.rows_from(df, "n", 1, 1)).collect()
    assert [r["id"] for r in got] == [1, 2]


def test_cluster_needs_a_shared_folder():
    import pytest
    from fleetlog.session import build_session, is_local
    with pytest.raises(ValueError, match="checkpoint"):
        build_session(master="spark://nowhere:7077")
    assert is_local("local[4]") and not is_local("local-cluster[2,1,1024]")


def test_nearest_scans_keep_no_frame_to_the_end(spark):
    """A frame that reaches to the end of its group is computed anew for every
    row, in time quadratic in the group."""
    from pyspark.sql import functions as F
    from fleetlog.operators.ordered import id_chunk, nearest_marked
    rows = [(i, i % 7 == 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, mark boolean").withColumn("k", F.lit(1))
    near = nearest_marked(df, ["k"], ["id"], F.col("mark"), F.col("id"), id_chunk("id", 4), before="b", after="a")
    assert "unboundedfollowing" not in near._jdf.queryExecution().executedPlan().toString().lower()
    marks = [i for i, m in rows if m]
    for r in near.collect():
        assert r["b"] == max((m for m in marks if m < r["id"]), default=None)
        assert r["a"] == min((m for m in marks if m > r["id"]), default=None)
