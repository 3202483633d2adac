"""Ordered scans over key groups that may be arbitrarily large.

A plain ``Window.partitionBy(keys)`` puts every row of a key group into one
task.  A log thread is such a group and one thread may hold a large share of
all rows, so the scans here cut each group into *chunks* (a coarse,
order-preserving bucket of the order key: a run of arrival keys, or a minute
of time where the question is about time):

* the per-row work runs in windows partitioned by ``(keys, chunk)``, bounded
  by the chunk size rather than by the group size (arrival-key chunks hold
  at most 2**CHUNK_BITS rows);
* what crosses chunk borders (a running total, the first row of the next
  chunk) is computed on the per-chunk summary table, whose size is bounded
  by the time span of a group, not by its row count;
* the summary is joined back on ``(keys, chunk)`` -- the same clustering the
  per-row window already produced, so the big side is shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK = "__fl_chunk"

# Default chunk width.  A chunk must hold few enough rows of one group to
# be sorted in one task; one minute of one thread is far below that.
DEFAULT_CHUNK_SECONDS = 60


def epoch_micros(c: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ, independent of the
    session time zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def ntz_literal(value) -> Column:
    """A TIMESTAMP_NTZ literal from a Python datetime or text, without going
    through any time zone."""
    import datetime as _dt
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(value)).cast("timestamp_ntz")


def time_chunk(c: Column | str, seconds: int = DEFAULT_CHUNK_SECONDS) -> Column:
    """Order-preserving bucket of a timestamp, ``seconds`` wide."""
    return F.floor(epoch_micros(c) / F.lit(int(seconds) * 1_000_000)).cast("long")


# Arrival keys of one chunk: the keys of a split are consecutive.
CHUNK_BITS = 16


def id_chunk(c: Column | str = "id", bits: int = CHUNK_BITS) -> Column:
    """Order-preserving bucket of an arrival key, of at most 2**bits rows."""
    return F.shiftright(F.col(c) if isinstance(c, str) else c, bits)


def _with_chunk(df: DataFrame, chunk: Column | str) -> tuple[DataFrame, str, bool]:
    """Use an existing chunk column (by name) or add one.  Reusing the
    column of an earlier scan keeps Spark aware that the rows are already
    clustered by it, so chained scans share one shuffle."""
    if isinstance(chunk, str):
        return df, chunk, False
    return df.withColumn(_CHUNK, chunk), _CHUNK, True


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                value: Column, out: str, chunk: Column | str,
                inclusive: bool = True) -> DataFrame:
    """Add ``out`` = running sum of ``value`` within ``keys`` in ``order``.

    ``chunk`` must be non-decreasing in ``order`` inside every key group.
    ``inclusive`` includes the current row (ROWS UNBOUNDED PRECEDING TO
    CURRENT ROW), otherwise only the rows before it.
    """
    keys = list(keys)
    val = "__fl_val"
    d, ch, added = _with_chunk(df, chunk)
    d = d.withColumn(val, value)
    frame_end = 0 if inclusive else -1
    w_in = (Window.partitionBy(*keys, ch).orderBy(*_cols(order))
            .rowsBetween(Window.unboundedPreceding, frame_end))
    local = d.withColumn("__fl_local", F.coalesce(F.sum(val).over(w_in), F.lit(0)))

    # from the unwindowed rows: a narrow pass with partial sums
    totals = d.groupBy(*keys, ch).agg(F.sum(val).alias("__fl_tot"))
    w_c = Window.partitionBy(*keys).orderBy(ch).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, ch,
                            F.coalesce(F.sum("__fl_tot").over(w_c), F.lit(0)).alias("__fl_off"))

    out_df = (local.join(offsets, [*keys, ch])
              .withColumn(out, F.col("__fl_off") + F.col("__fl_local"))
              .drop(val, "__fl_local", "__fl_off"))
    return out_df.drop(ch) if added else out_df


def running_count(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                  out: str, chunk: Column) -> DataFrame:
    """1-based position of each row in its key group (``row_number``)."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), out, chunk)


def nearest_marked(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                   is_candidate: Column, payload: Column, chunk: Column | str,
                   before: str | None = None, after: str | None = None) -> DataFrame:
    """Add ``before`` / ``after`` = ``payload`` of the nearest candidate row on
    that side of each row of the same key group, not counting the row itself.
    The as-of building block: candidates and probes are one stream, sorted
    once for both sides; no pair of rows is ever formed."""
    keys = list(keys)
    pay = "__fl_pay"
    d, ch, added = _with_chunk(df, chunk)
    d = d.withColumn(pay, F.when(is_candidate, payload))
    ordc = _cols(order)
    by = F.when(F.col(pay).isNotNull(), F.struct(*ordc))
    # The side after a row is scanned backwards: a frame up to the end of the
    # group is computed anew for every row.
    rows_before = (Window.unboundedPreceding, -1)
    w_in, w_ch = Window.partitionBy(*keys, ch), Window.partitionBy(*keys)
    sides = []
    if before:
        sides.append((before, w_in.orderBy(*ordc).rowsBetween(*rows_before), F.max_by(pay, by),
                      w_ch.orderBy(ch).rowsBetween(*rows_before)))
    if after:
        sides.append((after, w_in.orderBy(*[c.desc() for c in ordc]).rowsBetween(*rows_before), F.min_by(pay, by),
                      w_ch.orderBy(F.col(ch).desc()).rowsBetween(*rows_before)))
    local = d.withColumns({f"__fl_loc{i}": F.last(pay, ignorenulls=True).over(w)
                           for i, (_, w, _, _) in enumerate(sides)})
    # The summary counts the remaining columns, so that it reads what the rows
    # read and the two share one shuffle of the input.
    rest = [c for c in df.columns if c not in keys]
    edges = local.groupBy(*keys, ch).agg(
        *[e.alias(f"__fl_edge{i}") for i, (_, _, e, _) in enumerate(sides)],
        *[F.count(c).alias(f"__fl_n{i}") for i, c in enumerate(rest)])
    edges = edges.where(" AND ".join(f"__fl_n{i} >= 0" for i in range(len(rest))))
    carry = edges.select(*keys, ch, *[F.last(f"__fl_edge{i}", ignorenulls=True).over(w).alias(f"__fl_carry{i}")
                                      for i, (_, _, _, w) in enumerate(sides)])
    j = local.join(carry, [*keys, ch], "left")
    j = j.withColumns({name: F.coalesce(F.col(f"__fl_loc{i}"), F.col(f"__fl_carry{i}"))
                       for i, (name, *_) in enumerate(sides)})
    j = j.drop(pay, *[f"__fl_{k}{i}" for i in range(len(sides)) for k in ("loc", "carry")])
    return j.drop(ch) if added else j
