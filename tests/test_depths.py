import random

import pytest
from pyspark.sql import functions as F

from fleetlog.operators import depths, stacks
from fleetlog.session import scratch_path
from fleetlog.sources import store
from tests.test_stacks import _calls

BITS = 3


def _end(marks, start):
    """Index of the END that empties the lenient stack, and the unlike ENDs."""
    stack, unlike = [], set()
    for i in range(start, len(marks)):
        kind, fn = marks[i].split()
        if kind == "B":
            stack.append(fn)
        elif stack[-1] == fn:
            stack.pop()
            if not stack:
                return i, unlike
        else:
            unlike.add(i)
    return None, unlike


def _random_marks(rnd, n, odd):
    marks, stack = ["B task"], ["task"]
    while len(marks) < n:
        if not stack or rnd.random() < 0.45:
            stack.append(rnd.choice("abc"))
            marks.append(f"B {stack[-1]}")
        elif rnd.random() < odd:
            marks.append("E other")
        else:
            marks.append(f"E {stack.pop()}")
    return marks


@pytest.mark.parametrize("seed, odd", [(1, 0.0), (2, 0.0), (3, 0.15), (4, 0.5)])
def test_callstack_follows_the_lenient_stack(spark, seed, odd):
    marks = _random_marks(random.Random(seed), 90, odd)
    lg = _calls(spark, marks)
    root = scratch_path(spark, "depths")
    depths.write_depths(lg, root, BITS)
    end, unlike = _end(marks, 0)
    want = list(range(1, (len(marks) if end is None else end + 1) + 1))
    for known in (spark.read.parquet(root), None):
        rows = stacks.callstack(lg, "n", 1, "task", "2024-01-01 00:00:00", bits=BITS, depths=known).collect()
        assert sorted(r["id"] for r in rows) == want
        assert {r["id"] - 1 for r in rows if r["unmatched"]} == {i for i in unlike if i + 1 in want}


def test_first_at_every_level(spark):
    marks = [f"{'B' if random.Random(i).random() < 0.4 else 'E'} f" for i in range(60)]
    lg = _calls(spark, marks)
    known = depths.chunk_depths(lg, BITS)
    for start, level in [(0, 0), (0, -4), (5, -1), (17, -9), (30, 0), (30, -100)]:
        run, want = 0, None
        for i in range(start, len(marks)):
            run += 1 if marks[i][0] == "B" else -1
            if run <= level:
                want = i + 1
                break
        assert depths.first_at(lg, start + 1, level, known, BITS) == want, (start, level)


def test_a_call_reads_its_own_chunks_only(spark, monkeypatch):
    """A thread of 1,000 chunks: the summary is not made anew, two chunks are
    read for the end, and the rows are asked for by their key range."""
    short = ["B task", *["B a", "E a"] * 20, "E task"]
    marks = [*short, *["B b", "E b"] * ((8000 - len(short)) // 2)]
    root = scratch_path(spark, "thread")
    store.write_logs(_calls(spark, marks), root)
    lg = store.read_stored(spark, root)
    known = depths.chunk_depths(lg, BITS).cache()
    assert known.count() == 1001
    read = []
    inner = depths._in_chunk
    monkeypatch.setattr(depths, "_in_chunk", lambda t, a, b, room: read.append((a, b)) or inner(t, a, b, room))
    monkeypatch.setattr(depths, "chunk_depths", None)
    rows = stacks.callstack(lg, "n", 1, "task", "2024-01-01 00:00:00", bits=BITS, depths=known)
    known.unpersist()
    assert read == [(1, 7), (40, 47)]
    assert rows.agg(F.max("id"), F.count("id")).first() == (42, 42)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,1)" in plan and "LessThanOrEqual(id,42)" in plan


def test_no_markers_and_nulls(spark):
    lg = _calls(spark, ["B a"]).withColumn("tid", F.lit(None).cast("long"))
    assert depths.chunk_depths(lg).count() == 0
    assert depths.chunk_depths(_calls(spark, ["B a"]).limit(0)).count() == 0
