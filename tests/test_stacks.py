"""Call-stack operators against a plain Python model on random threads."""

import datetime as dt
import random

from fleetlog.operators import lenient, stacks


def _model(rows):
    """rows: (id, t, message, function, path) in order -> lenient spans / mismatches."""
    stack, spans, mism = [], {}, []
    for rid, t, msg, fn, path in rows:
        if msg == "BEG":
            stack.append((rid, fn, path))
            spans[rid] = [len(stack), None]
        elif stack and stack[-1][1] == fn and stack[-1][2] == path:
            spans[stack.pop()[0]][1] = rid
        else:
            mism.append(rid)
    return spans, mism


def _random_threads(seed, n_threads=6, n_rows=400):
    rnd = random.Random(seed)
    out = []
    rid = 0
    for th in range(n_threads):
        t = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rnd.randint(0, 100))
        stack = []
        for _ in range(n_rows):
            t += dt.timedelta(seconds=rnd.choice([0.5, 3, 20, 90, 400]))
            rid += 1
            if stack and rnd.random() < 0.45:
                fn = stack.pop() if rnd.random() > 0.08 else rnd.choice("fgh")
                out.append((f"n{th % 2}", th, rid, t, "END", fn, f"{fn}.cpp:1"))
            elif rnd.random() < 0.1:
                out.append((f"n{th % 2}", th, rid, t, "msg", "m", "m.cpp:1"))
            else:
                fn = rnd.choice("fghk")
                stack.append(fn)
                out.append((f"n{th % 2}", th, rid, t, "BEG", fn, f"{fn}.cpp:1"))
    return out


def _df(spark, rows):
    return spark.createDataFrame(
        [(n, i, "INFO", tid, t, fl, fn, msg) for n, tid, i, t, msg, fn, fl in rows],
        "node string, id long, level string, tid long, puttime timestamp_ntz, fileline string, "
        "function string, message string")


def test_lenient_fold_matches_model(spark):
    rows = _random_threads(7)
    df = _df(spark, rows)
    spans, mism = lenient.lenient_fold(df, bits=4)
    got = {r["id"]: [r["depth"], r["end_id"]] for r in spans.collect()}
    got_m = sorted(r["id"] for r in mism.collect())
    want, want_m = {}, []
    for th in {(r[0], r[1]) for r in rows}:
        sel = [(i, t, msg, fn, fl.split(":")[0]) for n, tid, i, t, msg, fn, fl in rows
               if (n, tid) == th and msg in ("BEG", "END")]
        s, m = _model(sel)
        want.update(s)
        want_m += m
    assert got == want
    assert got_m == sorted(want_m)


def test_strict_pairing_matches_model_on_clean_stacks(spark):
    rows = [r for r in _random_threads(11) if r[4] != "END" or True]
    # make stacks clean: rebuild ENDs to always match
    clean, stacks_ = [], {}
    for n, tid, i, t, msg, fn, fl in rows:
        st = stacks_.setdefault((n, tid), [])
        if msg == "END":
            if not st:
                continue
            fn = st.pop()
            fl = f"{fn}.cpp:1"
        elif msg == "BEG":
            st.append(fn)
        clean.append((n, tid, i, t, msg, fn, fl))
    df = _df(spark, clean)
    got = {r["id"]: (r["lvl"], r["end_time"]) for r in stacks.call_spans(df, bits=4).collect()}
    spans, mism = lenient.lenient_fold(df, bits=6)
    assert mism.count() == 0
    ends = {i: t for n, tid, i, t, msg, fn, fl in clean}
    for r in spans.collect():
        lvl, end_time = got[r["id"]]
        assert lvl == r["depth"]
        assert end_time == (ends[r["end_id"]] if r["end_id"] is not None else None)
    assert stacks.call_mismatches(df).count() == 0


def test_render_helpers(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1, "a\nb"), (0, "c")], "n int, s string")
    got = {r["n"]: r["t"] for r in df.select("n", stacks.indent(F.col("s"), F.col("n")).alias("t")).collect()}
    assert got == {1: "    | a\n    | b", 0: "c"}
    t = spark.createDataFrame([(dt.datetime(2024, 1, 1, 3, 4, 5, 100000),), (dt.datetime(2024, 1, 1, 3, 4, 5),)],
                              "t timestamp_ntz")
    assert [r[0] for r in t.select(stacks.short_time("t")).collect()] == ["03:04:05.1", "03:04:05."]
    m = spark.createDataFrame([(12345,), (5000,), (4999,), (0,)], "u long")
    assert [r[0] for r in m.select(stacks.seconds_2dp(F.col("u"))).collect()] == ["0.01", "0.01", "0.00", "0.00"]


def test_callstack_errors(spark, sf_small):
    import pytest
    from fleetlog.sources import fixtures
    lg = fixtures.logs(spark, sf_small, mismatched=True)
    with pytest.raises(ValueError, match="never enters"):
        stacks.callstack(lg, "node-2", 7, "NoSuchTask")
    # strict mode fails on the thread's first unlike END after the anchor
    bad = stacks.call_mismatches(lg).orderBy("id").first()
    if bad is not None:
        with pytest.raises(ValueError, match="meets the open call"):
            stacks.callstack(lg, bad["node"], bad["tid"], "CommitBatch",
                             str(lg.where(f"id = {bad['beg_id']}").first()["puttime"]), strict=True)


def test_nearest_entries_ties_against_brute_force(spark):
    from fleetlog.operators import select
    base = dt.datetime(2024, 1, 1)
    t = [base + dt.timedelta(seconds=s) for s in (10, 10, 50, 90, 90, 200)]
    rows = [("n", 1, "INFO", i + 1, ti, "a.cpp:1", "F", "BEG") for i, ti in enumerate(t)]
    logs = spark.createDataFrame(
        [(n, i, lv, tid, ts, fl, fn, m) for n, tid, lv, i, ts, fl, fn, m in rows],
        "node string, id long, level string, tid long, puttime timestamp_ntz, fileline string, "
        "function string, message string")
    probe_s = [0, 10, 30, 70, 90, 145, 500]
    probes = spark.createDataFrame([(k, "n", 1, "F", base + dt.timedelta(seconds=s)) for k, s in enumerate(probe_s)],
                                   "probe_id long, node string, tid long, task string, at timestamp_ntz")
    got = {r["probe_id"]: r["id"] for r in select.nearest_entries(logs, probes, chunk_seconds=40).collect()}
    for k, s in enumerate(probe_s):
        at = base + dt.timedelta(seconds=s)
        want = min(range(len(t)), key=lambda i: (abs((t[i] - at).total_seconds()), i + 1)) + 1
        assert got[k] == want, (s, got[k], want)


def _calls(spark, marks, start=dt.datetime(2024, 1, 1), steps=()):
    """One thread: marks like 'B f' and 'E f'; steps: seconds of each row."""
    rows = []
    for i, m in enumerate(marks):
        t = start + dt.timedelta(seconds=steps[i] if steps else i)
        kind, fn = m.split()
        rows.append(("n", 1, i + 1, t, {"B": "BEG", "E": "END"}[kind], fn, f"{fn}.cpp:1"))
    return _df(spark, rows)


def test_pairing_follows_the_file_not_the_clock(spark):
    df = _calls(spark, ["B a", "B b", "E b", "E a"], steps=(10, 11, 9, 12))
    got = {r["function"]: (r["end_function"], r["duration"], r["matched"]) for r in stacks.call_spans(df).collect()}
    assert got == {"a": ("a", 2.0, True), "b": ("b", -2.0, True)}


def test_names_that_recover_to_one_function_match(spark):
    from pyspark.sql import functions as F
    df = _calls(spark, ["B RunBatch", "E RunBatchA"]).withColumn("rec_function", F.lit("RunBatchAll")).withColumn(
        "rec_path", F.lit("src/run.cpp")).withColumn("rec_line", F.lit(1))
    assert stacks.call_mismatches(df).count() == 1
    assert stacks.call_mismatches(df, "rec_function", "rec_path").count() == 0
    assert stacks.call_spans(df, "rec_function", "rec_path").first()["matched"]
    text = [r["text"] for r in stacks.callstack_text(df, "n", 1, "RunBatch").orderBy("id").collect()]
    assert not any("Unmatched" in t for t in text) and text[1].startswith("END  RunBatchAll()")


def test_strict_stack_ends_with_its_task(spark):
    import pytest
    df = _calls(spark, ["B a", "E a", "B b", "E x"])
    rows = stacks.callstack(df, "n", 1, "a", "2024-01-01 00:00:00", strict=True)
    assert [(r["id"], r["depth"]) for r in rows.orderBy("id").collect()] == [(1, 1), (2, 0)]
    with pytest.raises(ValueError, match="meets the open call"):
        stacks.callstack(df, "n", 1, "b", "2024-01-01 00:00:02", strict=True)


def test_orphan_ends_do_not_meet_in_one_task(spark):
    """A thread whose BEGs were never logged: its ENDs are settled where they
    are, only chunk rows reach the composition."""
    from pyspark.sql import functions as F
    n = 100_000
    df = spark.range(n).select(
        F.lit("n").alias("node"), "id", F.lit("INFO").alias("level"), F.lit(1).cast("long").alias("tid"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("puttime"),
        F.lit("a.cpp:1").alias("fileline"), F.lit("f").alias("function"), F.lit("END").alias("message"))
    seen = []
    real = lenient._compose

    def counted(batches):
        def each():
            for b in batches:
                if (b["kind"] == "deferred").any():
                    raise AssertionError("a hopeless END reached the composition")
                yield b
        yield from real(each())

    lenient._compose = counted
    try:
        spans, mism = lenient.lenient_fold(df, bits=10)
        assert mism.count() == n and spans.count() == 0
    finally:
        lenient._compose = real
    assert not seen


def test_frames_against_brute_force_across_chunks(spark):
    rows = [r for r in _random_threads(23, n_threads=3, n_rows=300) if r[4] in ("BEG", "END")]
    got = {r["id"]: (r["depth"], r["lvl"], r["prev"] and r["prev"]["id"], r["next"] and r["next"]["id"])
           for r in stacks.frames(_df(spark, rows), bits=3).collect()}
    for th in {(r[0], r[1]) for r in rows}:
        depth, at = 0, {}
        for n, tid, i, t, msg, fn, fl in [r for r in rows if (r[0], r[1]) == th]:
            depth += 1 if msg == "BEG" else -1
            lvl = depth if msg == "BEG" else depth + 1
            before = at.get(lvl)
            assert got[i][:3] == (depth, lvl, before)
            if before is not None:
                assert got[before][3] == i
            at[lvl] = i
        for i in at.values():
            assert got[i][3] is None
