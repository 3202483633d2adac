"""Row selection: time ranges, user predicates, thread / task lookups, the
nearest entry of a task, and row rendering."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BEGIN_MARK, FUNCTION_WIDTH, ORDER
from .ordered import DEFAULT_CHUNK_SECONDS, epoch_micros, nearest_marked, ntz_literal, time_chunk
from .stacks import task_key

# The bounds of a range that names none.
DEFAULT_START = "1970-01-01"
DEFAULT_END = "now"


def bound_to_second(text: str | None, now: dt.datetime | None = None) -> dt.datetime | None:
    """A range bound as the log store reads it: any ISO-like date/time,
    ``now`` (UTC, evaluated once here), fraction dropped; None if unreadable."""
    if text is None:
        return None
    s = text.strip()
    if s.lower() == "now":
        t = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    else:
        try:
            t = dt.datetime.fromisoformat(s)
        except ValueError:
            return None
        if t.tzinfo is not None:
            t = t.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return t.replace(microsecond=0)


def _ntz(t: dt.datetime) -> Column:
    return F.lit(t.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def time_range(logs: DataFrame, start: str | None = DEFAULT_START, end: str | None = DEFAULT_END,
               now: dt.datetime | None = None) -> DataFrame:
    """Rows with ``trunc(start) <= puttime < trunc(end)`` (bounds cut to the
    second, end exclusive).  An unreadable bound selects nothing.  The
    bounds are literals, so the filter reaches the parquet scan."""
    s = bound_to_second(start if start is not None else DEFAULT_START, now)
    e = bound_to_second(end if end is not None else DEFAULT_END, now)
    if s is None or e is None:
        return logs.where(F.lit(False))
    return logs.where((F.col("puttime") >= _ntz(s)) & (F.col("puttime") < _ntz(e)))


def fleet_range(logs: DataFrame, start: str | None = DEFAULT_START, end: str | None = DEFAULT_END,
                now: dt.datetime | None = None) -> DataFrame:
    """What every node logged in a time range, in time order."""
    return time_range(logs, start, end, now).orderBy("puttime", "node", "id")


def where_expr(logs: DataFrame, predicate: str) -> DataFrame:
    """Rows matching a Spark SQL boolean expression."""
    return logs.where(F.expr(predicate))


def where_clause(logs: DataFrame, tail: str) -> DataFrame:
    """``SELECT * FROM logs WHERE <tail>``: the tail may carry ORDER BY,
    LIMIT, subqueries or UNION, as written by the user."""
    return logs.sparkSession.sql("SELECT * FROM {logs} WHERE " + tail, logs=logs)


def task_entries(logs: DataFrame, tid: int, task: str) -> DataFrame:
    """BEG rows of a task in one thread; the task name is cut as the
    logger cuts it."""
    return logs.where((F.col("tid") == F.lit(tid)) & (F.col("function") == F.lit(task_key(task)))
                      & (F.col("message") == BEGIN_MARK))


def nearest_entry(logs: DataFrame, node: str, tid: int, task: str, at: str | None = None,
                  now: dt.datetime | None = None) -> DataFrame:
    """The BEG of ``task`` in thread ``tid`` of ``node`` nearest in time to
    ``at`` (default now); ties go to the lowest id.  At most one row."""
    t = _at_literal(at, now)
    cand = task_entries(logs.where(F.col("node") == node), tid, task)
    dist = F.abs(epoch_micros("puttime") - epoch_micros(t))
    return cand.orderBy(dist, F.col("id")).limit(1)


def _at_literal(at: str | None, now: dt.datetime | None) -> Column:
    if at is None or at.strip().lower() == "now":
        t = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        return ntz_literal(t)
    return ntz_literal(at)


def nearest_entries(logs: DataFrame, probes: DataFrame,
                    chunk_seconds: int = DEFAULT_CHUNK_SECONDS) -> DataFrame:
    """For many probes ``(probe_id, node, tid, task, at)`` at once: the
    nearest BEG of the task in the thread (as-of join in both directions).

    Probes and entry instants (each with its lowest id) become one stream per
    (node, tid, function) sorted by time, an instant before a probe of the
    same time; each probe takes the last instant before it and the first
    after it and keeps the nearer one (lowest id on ties).  A probe without a
    node, thread, task or time gives no row.
    """
    cand = (logs.where(F.col("message") == BEGIN_MARK)
            .groupBy("node", "tid", "function", F.col("puttime").alias("t")).agg(F.min("id").alias("id"))
            .withColumn("probe_id", F.lit(None).cast("long")))
    pr = probes.select("node", F.col("tid").cast("long").alias("tid"),
                       F.lit(None).cast("long").alias("id"), F.col("probe_id").cast("long").alias("probe_id"),
                       F.substring("task", 1, FUNCTION_WIDTH).alias("function"),
                       F.col("at").cast("timestamp_ntz").alias("t"))
    u = cand.unionByName(pr).withColumn("__fl_kind", F.col("probe_id").isNotNull())
    keys = ["node", "tid", "function"]
    for c in (*keys, "t"):
        u = u.where(F.col(c).isNotNull())
    near = nearest_marked(u, keys, ["t", "__fl_kind"], ~F.col("__fl_kind"),
                          F.struct("id", "t"), time_chunk("t", chunk_seconds),
                          before="__fl_before", after="__fl_after")
    p = near.where(F.col("probe_id").isNotNull())
    db = epoch_micros("t") - epoch_micros(F.col("__fl_before.t"))
    da = epoch_micros(F.col("__fl_after.t")) - epoch_micros("t")
    take_after = (F.col("__fl_before").isNull()
                  | (F.col("__fl_after").isNotNull()
                     & ((da < db) | ((da == db) & (F.col("__fl_after.id") < F.col("__fl_before.id"))))))
    best = F.when(take_after, F.col("__fl_after")).otherwise(F.col("__fl_before"))
    return p.select("probe_id", "node", "tid", F.col("function").alias("task"),
                    best.getField("id").alias("id"), best.getField("t").alias("puttime"))


def rows_from(logs: DataFrame, node: str, tid: int, start_id: int) -> DataFrame:
    """Rows of one thread from a row on, by arrival."""
    return logs.where((F.col("node") == node) & (F.col("tid") == F.lit(tid)) & (F.col(ORDER) >= F.lit(start_id)))


def natural_order(rows: DataFrame) -> DataFrame:
    """Output order of row selections: by node, in arrival order."""
    return rows.orderBy("node", ORDER)


# ------------------------------------------------------------------ render

TEXT_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def render_rows(logs: DataFrame, recovered: DataFrame | None = None) -> DataFrame:
    """One text ``line`` per row: level, tid in 5 columns, time, fileline,
    function and message joined by two spaces.  With ``recovered`` (the
    output of :func:`fleetlog.operators.recover.recover_logs`) the function
    is padded to 40 and the location is ``path`` (50) ``:`` ``line`` (4)."""
    src = recovered if recovered is not None else logs
    if recovered is not None:
        fn = F.format_string("%-40s", F.col("rec_function"))
        fl = F.format_string("%-50s:%-4s", F.col("rec_path"), F.col("rec_line").cast("string"))
    else:
        fn, fl = F.col("function"), F.col("fileline")
    line = F.concat_ws("  ", F.col("level"), F.format_string("%5d", F.col("tid")),
                       F.date_format("puttime", TEXT_TIME), fl, fn, F.col("message"))
    return src.select("node", "id", line.alias("line"))
