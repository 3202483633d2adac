"""Record framing, header parse and quarantine on literal text files."""

import os
import tempfile

import pytest

from pyspark.sql import functions as F

from fleetlog.sources import fixtures, logtext

GOOD = "[INFO][   12][24-01-02T03:04:05.123456][atch/Commit.cpp:10][CommitBatch         ] first line"


def _write(d, name, text):
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_grammar_edge_cases(spark):
    d = tempfile.mkdtemp(prefix="fl-scan-")
    text = "\n".join([
        "orphan before the first header",
        GOOD, "  continuation one", "  continuation two",
        "[bad line", "  orphan after bad",
        "[WARNING][ 3][24-01-02T03:04:06.000001][x.cpp:1][OnlyFive no close",
        "[DEBUG][ abc][24-01-02T03:04:07.5][x.cpp:2][Fn] tid is not a number",
        "[FATAL][7][24-01-02T03:04:08.25][x.cpp:3][Fn][ [bracketed] message ] tail ",
        "[INFO][8][not a time][x.cpp:4][Fn] bad time",
    ]) + "\n"
    _write(d, "node-a.log", text)
    _write(d, "nodot", GOOD + "\n")
    p = logtext.check_files(logtext.parse_records(logtext.scan_records(spark, d)))
    good = logtext.good_rows(p).orderBy("node", "id").collect()
    assert [(r["node"], r["tid"]) for r in good] == [("node-a", 12), ("node-a", 7), ("nodot", 12)]
    assert good[0]["message"] == "first line\n  continuation one\n  continuation two"
    assert str(good[0]["puttime"]) == "2024-01-02 03:04:05.123456"
    # the message piece loses leading '[' and surrounding whitespace
    assert good[1]["message"] == "[bracketed] message ] tail"
    assert good[1]["function"] == "Fn" and good[1]["fileline"] == "x.cpp:3"
    reasons = sorted(r["reason"] for r in logtext.quarantine(p).collect())
    assert reasons == ["bad_tid", "bad_time", "five_fields", "orphan", "too_few_fields"]


def test_records_survive_split_boundaries(spark):
    """Many small splits: every record is framed whole exactly once."""
    d = tempfile.mkdtemp(prefix="fl-split-")
    lines = []
    for i in range(3000):
        lines.append(f"[INFO][{i % 7:5d}][24-01-02T03:04:05.{i:06d}][a.cpp:{i}][F{i % 13:<19}] msg {i}")
        if i % 5 == 0:
            lines.append(f"  continuation of {i}")
    _write(d, "big.txt", "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        recs = logtext.scan_records(spark, d)
        assert recs.rdd.getNumPartitions() > 4
        good = logtext.good_rows(logtext.parse_records(recs))
        got = good.select("id", "message").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 3000
    msgs = [r["message"] for r in sorted(got, key=lambda r: r["id"])]
    assert msgs[0] == "msg 0\n  continuation of 0"
    assert msgs[1] == "msg 1"
    # arrival keys follow file order across splits
    assert [int(m.split()[1]) for m in msgs] == list(range(3000))


def test_good_plus_quarantine_is_all_records(spark, sf_small):
    from fleetlog.sources import fixtures
    d = fixtures.rendered_dir(spark, sf_small)
    recs = logtext.scan_records(spark, d)
    p = logtext.parse_records(recs)
    assert logtext.good_rows(p).count() + logtext.quarantine(p).count() == recs.count()
    assert logtext.good_rows(p).where(F.col("tid").isNull()).count() == 0


def _model_records(text):
    """Plain model of the framing: a line starting with '[' opens a record;
    lines before the first one form one leading block."""
    recs, cur = [], None
    for line in text.split("\n"):
        if line.startswith("["):
            if cur is not None:
                recs.append(cur)
            cur = [line]
        elif cur is None:
            cur = [line]
        else:
            cur.append(line)
    if cur is not None:
        recs.append(cur)
    out = ["\n".join(r) for r in recs]
    # the framed text drops the '[' that separated a record from the one before
    return [out[0]] + [r[1:] for r in out[1:]]


def test_random_text_framing_matches_model(spark):
    import random
    rnd = random.Random(5)
    alphabet = "ab[] :.\t0123456789xyz"
    lines = ["junk at start"]
    for i in range(4000):
        kind = rnd.random()
        if kind < 0.6:
            lines.append(f"[INFO][{rnd.randint(0, 99):5d}][24-01-02T03:04:{rnd.randint(0, 59):02d}.{i:06d}]"
                         f"[f.cpp:{i}][Fn{i % 7}] " + "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))))
        elif kind < 0.8:
            lines.append("  " + "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))).lstrip("["))
        else:
            lines.append("[" + "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))))
    text = "\n".join(lines) + "\n"
    d = tempfile.mkdtemp(prefix="fl-rand-")
    _write(d, "r.txt", text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        recs = logtext.scan_records(spark, d)
        got = [r["text"] for r in recs.orderBy("id").collect()]
        p = logtext.parse_records(recs)
        n_good, n_bad = logtext.good_rows(p).count(), logtext.quarantine(p).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = _model_records(text.rstrip("\n"))
    assert got == want
    assert n_good + n_bad == len(want)


def test_text_before_the_first_header_is_never_a_row(spark):
    """A file that starts in mid-record, even if the rest looks like a header."""
    d = tempfile.mkdtemp(prefix="fl-orphan-")
    _write(d, "n1.txt", GOOD[1:] + "\n" + GOOD + "\n")
    _write(d, "n2.txt", GOOD + "\n")
    good, bad = logtext.read_logs(spark, d)
    assert sorted(r["node"] for r in good.collect()) == ["n1", "n2"]
    assert [(r["node"], r["reason"]) for r in bad.collect()] == [("n1", "orphan")]


def test_second_file_of_a_node_is_set_aside(spark):
    d = tempfile.mkdtemp(prefix="fl-two-")
    _write(d, "n1.log", GOOD + "\n")
    _write(d, "n1.txt", GOOD + "\n" + GOOD + "\n")
    good, bad = logtext.read_logs(spark, d)
    assert good.count() == 1
    assert [r["reason"] for r in bad.collect()] == ["node_in_two_files"] * 2


def test_ingest_keeps_every_record(spark):
    from fleetlog.session import scratch_path
    from fleetlog.sources import ingest, store
    d, root = tempfile.mkdtemp(prefix="fl-in-"), scratch_path(spark, "ingest")
    first = _write(d, "n1.txt", "\n".join([GOOD, "[bad line", GOOD.replace("first line", "second epoch")]) + "\n")
    ingest.ingest_files(spark, first, root)
    again = _write(d, "n1.log", GOOD + "\n")
    other = _write(d, "n2.txt", GOOD + "\n")
    ingest.ingest_files(spark, [again, other], root)
    rows = ingest.read_table(spark, root, "logs")
    assert sorted((r["node"], r["message"]) for r in rows.collect()) == [
        ("n1", "first line"), ("n1", "second epoch"), ("n2", "first line")]
    bad = ingest.read_table(spark, root, "quarantine").collect()
    assert sorted((r["node"], r["reason"]) for r in bad) == [("n1", "node_already_stored"), ("n1", "too_few_fields")]
    values = store.list_items(ingest.read_table(spark, root, "items"), "n1", "tid").collect()
    assert [r["value"] for r in values] == ["12"]
    hits = ingest.read_index(spark, root).prefix("epo")
    from fleetlog.operators import search
    assert [r["message"] for r in search.node_rows(rows, hits, "n1").collect()] == ["second epoch"]


def test_overwritten_input_is_read_anew(spark):
    from fleetlog.operators import search
    from fleetlog.session import scratch_path
    path = scratch_path(spark, "again")
    for n in (5, 7):
        spark.range(n).selectExpr("id AS doc_id", "'some license' AS text").write.mode("overwrite").parquet(path)
        spark.catalog.refreshByPath(path)
        docs = search.with_tokens(spark.read.parquet(path), "text")
        assert docs.where(search.term("license", text="text")).count() == n


@pytest.mark.parametrize("at", ["quarantine", "write_index", "write_depths", "write_items", "write_logs", "_commit"])
def test_a_batch_tried_again_is_stored_once(spark, monkeypatch, at):
    """A failure after each of the writes, and one before the commit."""
    from fleetlog.operators import depths, search
    from fleetlog.session import scratch_path
    from fleetlog.sources import ingest, store
    d, root = tempfile.mkdtemp(prefix="fl-retry-"), scratch_path(spark, "retry")
    f = _write(d, "n1.txt", "\n".join([GOOD, "[bad line", GOOD.replace("first line", "second epoch"),
                                        GOOD.replace("first line", "BEG")]) + "\n")
    module = {"quarantine": logtext, "write_index": search, "write_depths": depths, "_commit": ingest}.get(at, store)
    real = getattr(module, at)

    def fails(*args, **kw):
        if at not in ("quarantine", "_commit"):
            real(*args, **kw)
        raise OSError("lost")

    monkeypatch.setattr(module, at, fails)
    with pytest.raises(OSError):
        ingest.ingest_files(spark, f, root, "b1")
    assert all(ingest.read_table(spark, root, t).count() == 0 for t in ingest.TABLES)
    monkeypatch.undo()
    assert ingest.ingest_files(spark, f, root, "b1")
    assert not ingest.ingest_files(spark, f, root, "b1")  # committed already
    counts = [ingest.read_table(spark, root, t).count() for t in ingest.TABLES]
    assert counts == [3, 2, 5, 1, 1]
    gone = ingest.vacuum(spark, root)
    assert (at == "quarantine") == (not gone)
    assert counts == [ingest.read_table(spark, root, t).count() for t in ingest.TABLES]
    assert ingest.stored_nodes(spark, root) == ["n1"]


def test_a_node_of_an_earlier_batch_is_refused(spark):
    from fleetlog.session import scratch_path
    from fleetlog.sources import ingest
    d, root = tempfile.mkdtemp(prefix="fl-refuse-"), scratch_path(spark, "refuse")
    f = _write(d, "n1.txt", GOOD + "\n")
    ingest.ingest_files(spark, f, root)
    ingest.ingest_files(spark, f, root)
    assert ingest.read_table(spark, root, "logs").count() == 1
    assert [r["reason"] for r in ingest.read_table(spark, root, "quarantine").collect()] == ["node_already_stored"]


def test_derived_tables_follow_their_input(spark):
    """A table rewritten in place gives new rows in the same session."""
    from fleetlog.session import scratch_path
    from fleetlog.sources import fixtures
    folder = scratch_path(spark, "input")
    found = []
    for ids in ([1], [2, 3]):
        spark.createDataFrame([(i, "some license") for i in ids], "doc_id long, text string").write.mode(
            "overwrite").parquet(f"{folder}/documents.parquet")
        spark.catalog.refreshByPath(f"{folder}/documents.parquet")
        found.append(sorted(r["doc_id"] for r in fixtures.document_index(spark, folder, True).term("licensing").collect()))
    assert found == [[1], [2, 3]]


def test_records_are_rendered_in_ranges(spark, sf_small):
    """No task sorts all records of a node; the files hold them in order."""
    order = ["grp", "puttime", "id", "sub"]
    recs = fixtures.render_records(spark, sf_small).collect()
    nodes = {r["node"] for r in recs}
    assert fixtures.ordered_records(spark, sf_small).select("node", "range").distinct().count() > 2 * len(nodes)
    for node in nodes:
        path = f"{fixtures.rendered_dir(spark, sf_small)}/{node}.txt"
        with open(path.removeprefix("file:"), encoding="utf-8") as f:
            text = f.read()
        own = sorted((r for r in recs if r["node"] == node), key=lambda r: [(r[c] is not None, r[c]) for c in order if c == "grp" or r["grp"]])
        assert text == "".join(r["line"] + "\n" for r in own)


def test_records_are_not_shuffled_by_file(spark, sf_small):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(old, ("-1", "false")):
        spark.conf.set(k, v)
    try:
        parsed = logtext.parse_records(logtext.scan_records(spark, fixtures.rendered_dir(spark, sf_small)))
        plan = logtext.check_files(parsed)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    top = plan[:plan.index("HashAggregate")]
    assert "BroadcastHashJoin" in top and "Exchange hashpartitioning" not in top.split("BroadcastExchange")[0]
