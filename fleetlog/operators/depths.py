"""Where a call ends, found over chunk minima instead of over the thread.

Ingest keeps one row per (node, tid, chunk of arrival keys): ``total``, the sum of
+1 (BEG) / -1 (END) over the chunk, and ``least``, the least running sum after any of
its markers.  The first marker at which the stack opened by a call has shrunk to a
given size lies in the first chunk whose incoming depth plus ``least`` reaches it, so
only the call's first chunk and that one are read as rows; between them the
summary decides.  The arrival key is filtered by range, which prunes row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BEGIN_MARK, ORDER
from .ordered import CHUNK_BITS, id_chunk
from .stacks import THREAD, is_marker

_DEPTH = "__fl_depth"


def _delta() -> Column:
    return F.when(F.col("message") == BEGIN_MARK, F.lit(1)).otherwise(F.lit(-1))


def chunk_depths(logs: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """(node, tid, chunk, total, least) of every chunk that holds markers.
    Rows without a node, tid or arrival key belong to no thread."""
    keys = [*THREAD, "chunk"]
    m = logs.where(is_marker()).dropna(subset=[*THREAD, ORDER]).select(
        *THREAD, id_chunk(ORDER, bits).alias("chunk"), ORDER, _delta().alias("__fl_delta"))
    running = F.sum("__fl_delta").over(Window.partitionBy(*keys).orderBy(ORDER))
    return (m.withColumn(_DEPTH, running).groupBy(*keys)
            .agg(F.sum("__fl_delta").alias("total"), F.min(_DEPTH).alias("least")))


def write_depths(logs: DataFrame, root: str, bits: int = CHUNK_BITS) -> None:
    """Append the chunk summary of newly ingested logs, by node."""
    chunk_depths(logs, bits).sortWithinPartitions(*THREAD, "chunk").write.mode("append").partitionBy("node").parquet(root)


def _in_chunk(thread: DataFrame, first: int, last: int, room: int) -> tuple[int | None, int]:
    """Markers with arrival keys ``first`` to ``last`` (of one chunk): the first at
    which the running sum is ``room`` or less, and the whole sum."""
    m = thread.where(F.col(ORDER).between(first, last) & is_marker()).select(*THREAD, ORDER, _delta().alias("__fl_delta"))
    d = m.withColumn(_DEPTH, F.sum("__fl_delta").over(Window.partitionBy(*THREAD).orderBy(ORDER)))
    row = d.agg(F.min(F.when(F.col(_DEPTH) <= room, F.col(ORDER))), F.sum("__fl_delta")).first()
    return row[0], row[1] or 0


def first_at(thread: DataFrame, start: int, level: int = 0, depths: DataFrame | None = None,
             bits: int = CHUNK_BITS) -> int | None:
    """Arrival key of the first marker from ``start`` (a BEG) on that leaves at most
    ``level`` frames (0 or less; below 0 it has closed as many frames of
    before), None if there is none.  ``thread``: the rows of one thread;
    ``depths``: its stored chunk summary, made by :func:`chunk_depths` with the
    same ``bits``; without one, or where it does not know the first chunk, it is
    made here from the rows behind that chunk."""
    chunk = start >> bits
    found, total = _in_chunk(thread, start, ((chunk + 1) << bits) - 1, level)
    if found is not None:
        return found
    if depths is None or depths.where(F.col("chunk") == chunk).isEmpty():
        depths = chunk_depths(thread.where(F.col(ORDER) >= (chunk + 1) << bits), bits)
    before = Window.partitionBy(*THREAD).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    later = depths.where(F.col("chunk") > chunk).withColumn(
        "__fl_off", F.lit(total) + F.coalesce(F.sum("total").over(before), F.lit(0)))
    hit = (later.where(F.col("__fl_off") + F.col("least") <= level).orderBy("chunk")
           .select("chunk", "__fl_off").limit(1).collect())
    if not hit:
        return None
    c, off = hit[0]
    return _in_chunk(thread, c << bits, ((c + 1) << bits) - 1, level - off)[0]
