"""Plan shapes that the scale design relies on."""

import re

from fleetlog.operators import select, stacks
from fleetlog.plans import catalog
from fleetlog.sources import fixtures


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _shape(spark, df):
    """(shuffles that run, scans that run) with automatic broadcast off, i.e.
    the plan that a large join side gets."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(old, ("-1", "false")):
        spark.conf.set(k, v)
    try:
        plan = _plan(df())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    own = [ln for ln in plan.split("\n") if "ReusedExchange" not in ln]
    return sum("Exchange " in ln and "Broadcast" not in ln for ln in own), sum("FileScan" in ln for ln in own)


def test_row_windows_are_chunked(spark, sf_small):
    """No window over log rows is partitioned by the thread alone: every
    row-level window also carries the chunk, so one hot thread is spread over
    many tasks.  Windows over the per-chunk summaries may use the thread."""
    plan = _plan(stacks.call_spans(fixtures.logs(spark, sf_small)))
    specs = re.findall(r"Window \[.*?\], \[([^\]]*)\], \[([^\]]*)\]", plan)
    assert specs
    for part, order in specs:
        if re.search(r"\bid#", order):  # a row-level window
            assert "__fl_chunk" in part, (part, order)


def test_call_spans_shuffles_little(spark, sf_small):
    lg = fixtures.logs(spark, sf_small)
    shuffles, scans = _shape(spark, lambda: stacks.call_spans(lg))
    assert scans == 1 and shuffles <= 4, (shuffles, scans)


def test_nearest_entries_scans_the_logs_once(spark, sf_small):
    lg = fixtures.logs(spark, sf_small)
    probes = catalog.probes_from_events(spark, sf_small)
    shuffles, scans = _shape(spark, lambda: select.nearest_entries(lg, probes))
    # the (small) probe side may be read for the chunk summary again
    assert scans <= 3 and shuffles <= 5, (shuffles, scans)


def test_token_sets_take_one_scan_and_no_distinct(spark, sf_small):
    """No shuffle where the scan has a split for every core; one that deals the
    rows over the cores where it has fewer."""
    assert _shape(spark, lambda: catalog.QUERIES["tokens_sub"](spark, sf_small)) == (1, 1)
    assert "RoundRobinPartitioning" in _plan(catalog.QUERIES["tokens_sub"](spark, sf_small))
    small = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "1k"}
    old = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        for key in ("tokens_sub", "postings"):
            assert _shape(spark, lambda: catalog.QUERIES[key](spark, sf_small)) == (0, 1), key
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_clean_threads_stay_out_of_python(spark, sf_small):
    from fleetlog.operators import lenient
    spans, mism = lenient.lenient_fold(fixtures.logs(spark, sf_small))
    assert mism.count() == 0
    assert spans.count() == stacks.call_spans(fixtures.logs(spark, sf_small)).count()


def test_one_hot_thread_is_split_by_chunks(spark):
    """A single thread holding every row: its row windows are partitioned by
    (node, tid, chunk), groups of at most 2**bits rows, and the depth still
    matches a sequential count."""
    import datetime as dt
    from fleetlog.operators.ordered import id_chunk
    base = dt.datetime(2024, 1, 1)
    rows = [("n", i, "INFO", 1, base, "a.cpp:1", "F", "BEG" if i % 2 == 0 else "END") for i in range(10000)]
    df = spark.createDataFrame(rows, "node string, id long, level string, tid long, puttime timestamp_ntz, "
                                     "fileline string, function string, message string")
    sizes = df.groupBy(id_chunk("id", 8).alias("c")).count().collect()
    assert len(sizes) >= 39 and max(r["count"] for r in sizes) <= 256
    got = stacks.depth_all_rows(df, bits=8).select("id", "depth").collect()
    assert len(got) == 10000
    assert all(r["depth"] == (1 if r["id"] % 2 == 0 else 0) for r in got)
