"""The streaming ingest gives the same tables as the batch scan."""

import os
import tempfile

from fleetlog.session import scratch_path
from fleetlog.sources import fixtures, ingest as tables, logtext
from fleetlog.streaming import ingest


def test_stream_ingest_equals_batch(spark, sf_small):
    src = fixtures.rendered_dir(spark, sf_small)
    root, ck = scratch_path(spark, "s-root"), scratch_path(spark, "s-ck")
    q = ingest.start_ingest(spark, src, root, ck, available_now=True, max_files_per_trigger=2)
    q.awaitTermination(300)
    got = tables.read_table(spark, root, "logs").drop("id")
    good, bad = logtext.read_logs(spark, src)
    want = good.drop("id")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0
    assert tables.read_table(spark, root, "quarantine").count() == bad.count()


def test_second_file_of_a_node_goes_to_the_quarantine(spark):
    line = "[INFO][   12][24-01-02T03:04:05.123456][a.cpp:10][F] hello\n"
    src = tempfile.mkdtemp(prefix="fl-stream-")
    root, ck = scratch_path(spark, "s-root"), scratch_path(spark, "s-ck")
    for name in ("n1.txt", "n1.log"):
        with open(os.path.join(src, name), "w") as f:
            f.write(line)
        ingest.start_ingest(spark, src, root, ck).awaitTermination(300)
    assert tables.read_table(spark, root, "logs").count() == 1
    assert [r["reason"] for r in tables.read_table(spark, root, "quarantine").collect()] == ["node_already_stored"]


def test_an_epoch_played_again_is_stored_once(spark):
    line = "[INFO][   12][24-01-02T03:04:05.123456][a.cpp:10][F] hello\n"
    src = tempfile.mkdtemp(prefix="fl-stream-")
    root, ck = scratch_path(spark, "s-root"), scratch_path(spark, "s-ck")
    with open(os.path.join(src, "n1.txt"), "w") as f:
        f.write(line)
    ingest.start_ingest(spark, src, root, ck).awaitTermination(300)
    assert list(tables.committed(spark, root)) and tables.read_table(spark, root, "logs").count() == 1
    batch = next(iter(tables.committed(spark, root)))
    assert not tables.write_batch(logtext.scan_records(spark, src), root, batch)
    assert tables.read_table(spark, root, "logs").count() == 1
    assert tables.read_table(spark, root, "quarantine").count() == 0
