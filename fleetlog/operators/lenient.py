"""Lenient call-stack pairing: an END unlike the frame on top of the stack
is reported as a mismatch and does **not** pop it.

Threads whose every END closes an equal BEG pair the same either way: they
are taken from :func:`fleetlog.operators.stacks.frames`.  Only threads that
hold an unlike END go through the fold here, which is order-dependent state
(after the first mismatch a stale frame stays for good, and running sums no
longer tell the depth) -- but not one task per thread.  Two phases:

1. per (node, tid, chunk of arrival keys) the stack machine runs on the
   chunk's markers with a local stack.  Everything decided by local frames is
   final.  An END that arrives while the local stack is empty depends on
   frames of earlier chunks: it is *deferred*.  Frames still open at the
   chunk end are *residual*.  BEG rows keep their local depth and the number
   of deferred ENDs before them.
2. per (node, tid), the chunk summaries (deferred ENDs, residual frames, one
   row per chunk) are composed in chunk order, which settles the deferred
   ENDs and gives every chunk its incoming stack size.

A deferred END that no earlier chunk left a frame of its function open for is
a mismatch at once and does not reach phase 2, so a thread whose BEGs were
never logged sends no ENDs there.  What does is bounded by the frames left
open at chunk ends and the ENDs that name one of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BEGIN_MARK, END_MARK, ORDER
from ..session import ship, stored
from .ordered import CHUNK_BITS, id_chunk
from .stacks import THREAD, frames, is_marker, path_of, same_call

_P1_SCHEMA = ("kind string, node string, tid long, chunk long, k long, local_depth int, id long, "
              "puttime timestamp_ntz, function string, path string, end_id long, end_time timestamp_ntz, "
              "open_local boolean, stack_pos int")
_P2_SCHEMA = ("kind string, node string, tid long, chunk long, k long, base int, beg_id long, id long, "
              "puttime timestamp_ntz, function string")


_P1_COLS = [c.split()[0] for c in _P1_SCHEMA.split(", ")]
_P2_COLS = [c.split()[0] for c in _P2_SCHEMA.split(", ")]


def _frame(rows: list[dict], cols: list[str], times: Sequence[str], texts: Sequence[str]) -> pd.DataFrame:
    res = pd.DataFrame(rows, columns=cols)
    for c in times:
        res[c] = pd.to_datetime(res[c])
    # text columns stay objects even when a batch holds only nulls
    for c in texts:
        res[c] = res[c].astype(object).where(res[c].notna(), None)
    return res


def _group_runs(batches, keys: Sequence[str]):
    """Rows of a partition sorted by ``keys``: yield (key, rows, batch_end)
    per row, grouped runs spanning batch borders."""
    for pdf in batches:
        n = len(pdf)
        cols = [pdf[c].to_numpy() for c in pdf.columns]
        names = list(pdf.columns)
        kidx = [names.index(k) for k in keys]
        for i in range(n):
            row = {names[j]: cols[j][i] for j in range(len(names))}
            yield tuple(row[names[j]] for j in kidx), row, i == n - 1


def _local_fold(batches):
    """Phase 1 over a partition sorted by (node, tid, chunk, id)."""
    out: list[dict] = []
    cur = None
    stack: list[dict] = []
    begs: list[dict] = []
    k = 0

    def flush():
        for i, fr in enumerate(stack):
            fr["stack_pos"] = i
        out.extend(begs)
        node, tid, chunk = cur
        out.append({"kind": "chunk", "node": node, "tid": tid, "chunk": chunk, "k": k})

    for key, r, batch_end in _group_runs(batches, ("node", "tid", "chunk")):
        if key != cur:
            if cur is not None:
                flush()
            cur, stack, begs, k = key, [], [], 0
        base = {"node": key[0], "tid": key[1], "chunk": key[2]}
        if r["message"] == BEGIN_MARK:
            row = dict(base, kind="beg", k=k, local_depth=len(stack) + 1, id=r["id"], puttime=r["puttime"],
                       function=r["function"], path=r["path"], open_local=True)
            begs.append(row)
            stack.append(row)
        elif not stack:
            out.append(dict(base, kind="deferred", k=k, id=r["id"], puttime=r["puttime"],
                            function=r["function"], path=r["path"]))
            k += 1
        else:
            top = stack[-1]
            if top["function"] == r["function"] and top["path"] == r["path"]:
                top.update(end_id=r["id"], end_time=r["puttime"], open_local=False)
                stack.pop()
            else:
                out.append(dict(base, kind="mismatch", id=r["id"], puttime=r["puttime"],
                                function=r["function"], path=r["path"]))
        if batch_end and len(out) > 0:
            yield _frame(out, _P1_COLS, ("puttime", "end_time"), ("function", "path"))
            out = []
    if cur is not None:
        flush()
    if out:
        yield _frame(out, _P1_COLS, ("puttime", "end_time"), ("function", "path"))


def _compose(batches):
    """Phase 2 over chunk summaries sorted by (node, tid, chunk, order)."""
    out: list[dict] = []
    thread = None
    stack: list[tuple] = []
    chunk_open = None
    residual: list[dict] = []

    def close_chunk():
        for fr in sorted(residual, key=lambda f: f["stack_pos"]):
            stack.append((fr["id"], fr["function"], fr["path"]))

    for key, r, batch_end in _group_runs(batches, ("node", "tid", "chunk")):
        node, tid, chunk = key
        if (node, tid) != thread:
            thread, stack, chunk_open, residual = (node, tid), [], None, []
        if chunk != chunk_open:
            if chunk_open is not None:
                close_chunk()
            chunk_open, residual = chunk, []
            out.append({"kind": "chunk", "node": node, "tid": tid, "chunk": chunk, "k": 0, "base": len(stack)})
        if r["kind"] == "deferred":
            row = {"node": node, "tid": tid, "chunk": chunk, "k": int(r["k"]), "id": r["id"], "puttime": r["puttime"],
                   "function": r["function"]}
            if stack and stack[-1][1] == r["function"] and stack[-1][2] == r["path"]:
                out.append(dict(row, kind="close", beg_id=stack.pop()[0]))
            else:
                out.append(dict(row, kind="mismatch"))
        elif r["kind"] == "beg":
            residual.append(r)
        if batch_end and out:
            yield _frame(out, _P2_COLS, ("puttime",), ("function",))
            out = []
    if out:
        yield _frame(out, _P2_COLS, ("puttime",), ("function",))


def _fold(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, mismatches) of marker rows (node, tid, chunk, id, ...)."""
    ship(m.sparkSession)
    # Phase 1: every (thread, chunk) is a contiguous sorted run of one
    # partition.  Its result feeds phase 2 and the rows.
    p1 = stored(m.repartition("node", "tid", "chunk").sortWithinPartitions("node", "tid", "chunk", "id")
                .mapInPandas(_local_fold, _P1_SCHEMA), "lenient")
    residual = p1.where((F.col("kind") == "beg") & F.col("open_local"))
    deferred = p1.where(F.col("kind") == "deferred")
    first = residual.groupBy("node", "tid", "function", "path").agg(F.min("chunk").alias("__fl_from"))
    known = deferred.join(first, [deferred[c].eqNullSafe(first[c]) for c in ("node", "tid", "function", "path")], "left")
    able = F.coalesce(F.col("__fl_from") < deferred["chunk"], F.lit(False))
    known = known.select(*[deferred[c] for c in _P1_COLS], able.alias("__fl_able"))
    hopeless = known.where(~F.col("__fl_able"))
    summary = (p1.where(F.col("kind") == "chunk").unionByName(residual)
               .unionByName(known.where("__fl_able").drop("__fl_able")))
    # chunk row first, then deferred ENDs in order, then residual frames
    rank = F.when(F.col("kind") == "chunk", 0).when(F.col("kind") == "deferred", 1).otherwise(2)
    p2 = stored(summary.repartition("node", "tid")
                .sortWithinPartitions("node", "tid", "chunk", rank, "k", "stack_pos")
                .mapInPandas(_compose, _P2_SCHEMA), "lenient")

    # a chunk's incoming stack shrinks by the deferred ENDs that popped
    pops = p2.where(F.col("kind") == "close").groupBy("node", "tid", "chunk").agg(F.collect_list("k").alias("pops"))
    base = (p2.where(F.col("kind") == "chunk").select("node", "tid", "chunk", "base")
            .join(pops, ["node", "tid", "chunk"], "left"))
    closes = p2.where(F.col("kind") == "close").select(
        "node", "tid", F.col("beg_id").alias("id"), F.col("id").alias("c_id"), F.col("puttime").alias("c_time"))
    gone = F.expr("coalesce(size(filter(pops, x -> x < k)), 0)")
    spans = (p1.where(F.col("kind") == "beg").join(base, ["node", "tid", "chunk"])
             .join(closes, ["node", "tid", "id"], "left")
             .select("node", "tid", "id", "function",
                     (F.col("base") - gone + F.col("local_depth")).cast("int").alias("depth"),
                     F.coalesce("end_id", "c_id").alias("end_id"),
                     F.coalesce("end_time", "c_time").alias("end_time")))
    cols = ["node", "tid", "id", "puttime", "function"]
    mism = (p1.where(F.col("kind") == "mismatch").select(*cols).unionByName(hopeless.select(*cols))
            .unionByName(p2.where(F.col("kind") == "mismatch").select(*cols)))
    return spans, mism


def lenient_fold(logs: DataFrame, bits: int = CHUNK_BITS, function: str = "function",
                 path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(spans, mismatches) under the lenient rule.

    spans: one row per BEG -- node, tid, id, function, depth (stack size
    after the push), end_id, end_time (NULL while open).
    mismatches: ENDs that did not match the top -- node, tid, id, puttime,
    function.  ``function`` and ``path`` name the columns calls are compared
    by; the path defaults to that of ``fileline``.
    """
    f = frames(logs, function, path, bits)
    unlike = (F.col("message") == END_MARK) & ~F.coalesce((F.col("prev.message") == BEGIN_MARK) & same_call("prev"),
                                                         F.lit(False))
    odd = stored(f.where(unlike).select(*THREAD).distinct(), "lenient")
    clean = f.where(F.col("message") == BEGIN_MARK).join(odd, THREAD, "left_anti").select(
        "node", "tid", "id", F.col("name").alias("function"), F.col("lvl").alias("depth"),
        F.col("next.id").alias("end_id"), F.col("next.puttime").alias("end_time"))
    m = logs.where(is_marker()).select(
        "node", "tid", "id", "puttime", "message", F.col(function).alias("function"),
        (F.col(path) if path else path_of("fileline")).alias("path"), id_chunk(ORDER, bits).alias("chunk"))
    spans, mism = _fold(m.join(odd, THREAD, "left_semi"))
    return clean.unionByName(spans), mism
