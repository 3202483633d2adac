"""Call-stack analytics: pair BEG / END markers of a thread into timed spans.

Rows of a thread are taken in arrival order (the key ``id``), whatever their
clocks say.  Bulk form (every node and thread at once):

* ``depth``: running sum of +1 (BEG) / -1 (END) per (node, tid);
* ``lvl``: the depth a frame lives at -- ``depth`` for a BEG, ``depth + 1``
  for an END.  Between a BEG and its END every row has a higher ``lvl``, so
  the END of a BEG is simply the next row of the same (node, tid, lvl).

:func:`frames` finds depth, level and both neighbours at the level in one
sorted pass over (thread, chunk) groups; a summary of one row per (thread,
chunk, level) carries what crosses chunk borders.

Functions compare by the columns named ``function`` and ``path``: the logged
ones, or the recovered ones of :func:`fleetlog.operators.recover.recover_logs`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BEGIN_MARK, END_MARK, FUNCTION_WIDTH, ORDER
from .ordered import CHUNK_BITS, epoch_micros, id_chunk, nearest_marked, running_sum

THREAD = ["node", "tid"]
CHUNK = "__fl_chunk"


def is_marker() -> Column:
    return F.col("message").isin(BEGIN_MARK, END_MARK)


def path_of(fileline: Column | str) -> Column:
    fl = F.col(fileline) if isinstance(fileline, str) else fileline
    return F.split_part(fl, F.lit(":"), F.lit(1))


def seconds_between(a: Column | str, b: Column | str) -> Column:
    """(b - a) in seconds as a double."""
    return (epoch_micros(b) - epoch_micros(a)) / F.lit(1e6)


def frames(logs: DataFrame, function: str = "function", path: str | None = None,
           bits: int = CHUNK_BITS) -> DataFrame:
    """Marker rows with ``depth`` (stack size after the row), ``lvl``, and
    ``prev`` / ``next``: the neighbouring markers at that level.  ``name`` and
    ``path`` (of the row and in both structs) are what pairs are compared by."""
    base = ["id", "message", "puttime", "function", "fileline"]
    # the summary and the rows below come from one shuffle; stating what joins
    # and windows would infer on one side only keeps the two plans equal
    stated = [F.col(c).isNotNull() for c in (*THREAD, ORDER)]
    m = logs.where(is_marker() & stated[0] & stated[1] & stated[2]).select(
        *THREAD, *base, F.col(function).alias("name"), (F.col(path) if path else path_of("fileline")).alias("path"),
        id_chunk(ORDER, bits).alias(CHUNK))
    delta = F.when(F.col("message") == BEGIN_MARK, F.lit(1)).otherwise(F.lit(-1))
    here = Window.partitionBy(*THREAD, CHUNK).orderBy(ORDER)
    m = m.withColumn("__fl_depth", F.sum(delta).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    m = m.withColumn("__fl_lvl", F.col("__fl_depth") + F.when(F.col("message") == BEGIN_MARK, 0).otherwise(1))
    # levels relative to the chunk's start are enough to pair inside it
    at_level = Window.partitionBy(*THREAD, CHUNK, "__fl_lvl").orderBy(ORDER)
    row = F.struct(*base, "name", "path")
    local = m.withColumns({"__fl_next": F.lead(row).over(at_level), "__fl_prev": F.lag(row).over(at_level)})
    levels = local.groupBy(*THREAD, CHUNK, "__fl_lvl").agg(
        F.min_by(row, ORDER).alias("__fl_first"), F.max_by(row, ORDER).alias("__fl_last"), F.sum(delta).alias("__fl_sum"))
    before = Window.partitionBy(*THREAD).orderBy(CHUNK).rangeBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("__fl_off", F.coalesce(F.sum("__fl_sum").over(before), F.lit(0)))
    levels = levels.withColumn("lvl", (F.col("__fl_off") + F.col("__fl_lvl")).cast("int"))
    along = Window.partitionBy(*THREAD, "lvl").orderBy(CHUNK)
    levels = levels.select(*THREAD, CHUNK, "__fl_lvl", "__fl_off",
                           F.lead("__fl_first").over(along).alias("follow"),
                           F.lag("__fl_last").over(along).alias("lead"))
    # one row per (thread, chunk), so that the rows stay where they are
    chunks = levels.groupBy(*THREAD, CHUNK).agg(
        F.first("__fl_off").alias("__fl_off"),
        F.map_from_entries(F.collect_list(F.struct("__fl_lvl", F.struct("lead", "follow")))).alias("__fl_edge"))
    edge = F.col("__fl_edge")[F.col("__fl_lvl")]
    return local.join(chunks, [*THREAD, CHUNK], "left").select(
        *THREAD, *base, "name", "path", (F.col("__fl_off") + F.col("__fl_depth")).cast("int").alias("depth"),
        (F.col("__fl_off") + F.col("__fl_lvl")).cast("int").alias("lvl"),
        F.coalesce("__fl_prev", edge["lead"]).alias("prev"), F.coalesce("__fl_next", edge["follow"]).alias("next"))


def same_call(other: str) -> Column:
    """Whether the row and its neighbour name one function."""
    return F.col("name").eqNullSafe(F.col(f"{other}.name")) & F.col("path").eqNullSafe(F.col(f"{other}.path"))


def depth_all_rows(logs: DataFrame, bits: int = CHUNK_BITS, keep_chunk: bool = False) -> DataFrame:
    """Every row (markers and messages) with the stack size after it;
    a message row does not change the depth."""
    delta = (F.when(F.col("message") == BEGIN_MARK, F.lit(1))
             .when(F.col("message") == END_MARK, F.lit(-1)).otherwise(F.lit(0)))
    d = running_sum(logs.withColumn(CHUNK, id_chunk(ORDER, bits)), THREAD, [ORDER], delta, "depth", CHUNK)
    d = d.withColumn("depth", F.col("depth").cast("int"))
    return d if keep_chunk else d.drop(CHUNK)


def call_spans(logs: DataFrame, function: str = "function", path: str | None = None,
               bits: int = CHUNK_BITS) -> DataFrame:
    """One row per BEG with the time and function of its END (NULL while the
    call is still open), its ``duration`` in seconds and whether the END names
    the same function (``matched``)."""
    p = frames(logs, function, path, bits).where(F.col("message") == BEGIN_MARK)
    closed = F.col("next.id").isNotNull()
    return p.select("node", "tid", "function", "lvl", "id", "puttime", F.col("next.puttime").alias("end_time"),
                    F.col("next.function").alias("end_function"),
                    seconds_between("puttime", "next.puttime").alias("duration"),
                    F.when(closed, same_call("next")).alias("matched"))


def call_mismatches(logs: DataFrame, function: str = "function", path: str | None = None,
                    bits: int = CHUNK_BITS) -> DataFrame:
    """ENDs whose strict partner (the BEG on top of the stack) has another
    function or path.  Strict mode fails when this is not empty."""
    p = frames(logs, function, path, bits)
    return p.where((F.col("message") == END_MARK) & (F.col("prev.message") == BEGIN_MARK) & ~same_call("prev")).select(
        "node", "tid", "id", "puttime", "function", "fileline", "lvl",
        F.col("prev.id").alias("beg_id"), F.col("prev.function").alias("beg_function"),
        F.col("prev.fileline").alias("beg_fileline"), seconds_between("prev.puttime", "puttime").alias("duration"))


def assert_no_mismatch(logs: DataFrame, **kw) -> None:
    """Strict mode: raise on the first mismatched END (in arrival order)."""
    first = call_mismatches(logs, **kw).orderBy("node", "tid", ORDER).limit(1).collect()
    if first:
        r = first[0]
        raise ValueError(f"END of {r['function']} at {r['puttime']} (node {r['node']}, thread {r['tid']}) meets "
                         f"the open call of {r['beg_function']}")


def function_time(logs: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """Closed calls per (node, function): count, total and longest seconds."""
    s = call_spans(logs, bits=bits).where(F.col("end_time").isNotNull())
    return (s.groupBy("node", "function")
            .agg(F.count(F.lit(1)).alias("calls"),
                 F.round(F.sum("duration"), 6).alias("total_s"),
                 F.round(F.max("duration"), 6).alias("max_s")))


def task_key(task: str) -> str:
    """The logger cuts function names, so a task is looked up by its prefix."""
    return task[:FUNCTION_WIDTH]


# ------------------------------------------------------ one task's stack

def callstack(logs: DataFrame, node: str, tid: int, task: str, at: str | None = None,
              strict: bool = False, function: str = "function", path: str | None = None,
              bits: int = CHUNK_BITS, depths: DataFrame | None = None) -> DataFrame:
    """Rows of one task's call: from the BEG of ``task`` nearest to ``at``
    up to the END that empties the stack again (or to the end of the thread
    while the call stays open), with ``depth`` counted from the task (1 =
    the task's own frame) and ``unmatched`` for ENDs unlike the frame on
    top.  Lenient by default: an unmatched END does not pop.  ``strict``
    fails on the first unmatched END of the call instead.

    ``depths``: the stored chunk summary (:mod:`fleetlog.operators.depths`), by
    which only the call is read.  If every END pops, the call ends where its
    depth is first 0.  An unmatched END does not pop, so with n of them the
    stack empties where that depth is first -n: the stretch up to a depth is
    folded, and a lower depth taken until the call ends in its stretch.
    """
    from .depths import first_at
    from .lenient import lenient_fold
    from .select import nearest_entry

    of_thread = (F.col("node") == node) & (F.col("tid") == F.lit(tid))
    thread = logs.where(of_thread)
    anchor = nearest_entry(thread, node, tid, task, at).collect()
    if not anchor:
        raise ValueError(f"thread {tid} of node {node} never enters {task}")
    start = anchor[0]["id"]
    known = None if depths is None else depths.where(of_thread)

    def up_to(end: int | None) -> DataFrame:
        rows = thread.where(F.col(ORDER) >= F.lit(start))
        return rows if end is None else rows.where(F.col(ORDER) <= F.lit(end))

    end = first_at(thread, start, 0, known, bits)
    call = up_to(end)
    if strict:
        assert_no_mismatch(call, function=function, path=path, bits=bits)
        rows = call.withColumn("unmatched", F.lit(False))
    elif call_mismatches(call, function, path, bits).isEmpty():
        rows = call.withColumn("unmatched", F.lit(False))
    else:
        level = 0
        while True:
            spans, mism = lenient_fold(call, bits, function, path)
            closed = spans.where(F.col("id") == F.lit(start)).select("end_id").collect()[0]["end_id"]
            if closed is not None or end is None:
                break
            level = 16 * level - 16
            end = first_at(thread, start, level, known, bits)
            call = up_to(end)
        rows = up_to(closed).join(mism.select("id", F.lit(True).alias("unmatched")), "id", "left").withColumn(
            "unmatched", F.coalesce(F.col("unmatched"), F.lit(False)))
    delta = (F.when(F.col("message") == BEGIN_MARK, F.lit(1))
             .when((F.col("message") == END_MARK) & ~F.col("unmatched"), F.lit(-1)).otherwise(F.lit(0)))
    rows = running_sum(rows, THREAD, [ORDER], delta, "depth", id_chunk(ORDER, bits))
    return rows.withColumn("depth", F.col("depth").cast("int"))


def call_messages(logs: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """Every message row with the stack depth it is logged at and the
    innermost open call (the last BEG at that level before it)."""
    d = depth_all_rows(logs, bits, keep_chunk=True).where((F.col("message") == BEGIN_MARK) | ~is_marker())
    payload = F.struct(F.col("function"), F.col("id"))
    r = nearest_marked(d, [*THREAD, "depth"], [ORDER], F.col("message") == BEGIN_MARK, payload, CHUNK,
                       before="__fl_frame")
    return r.where(~is_marker()).select(
        "node", "tid", "id", "depth", F.col("__fl_frame.function").alias("frame_function"),
        F.col("__fl_frame.id").alias("frame_id"))


# ---------------------------------------------------------------- render

def indent(text: Column, n: Column) -> Column:
    """Four spaces per level, and ``| `` once the level is above 0, before
    every line of ``text``."""
    pad = F.concat(F.repeat(F.lit("    "), n), F.when(n > 0, F.lit("| ")).otherwise(F.lit("")))
    return F.regexp_replace(text, "(?m)^", F.replace(pad, F.lit("\\"), F.lit("\\\\")))


def short_time(t: Column | str) -> Column:
    """HH:MM:SS.ffffff without trailing zeros (a whole second keeps its dot)."""
    c = F.col(t) if isinstance(t, str) else t
    return F.rtrim(F.date_format(c, "HH:mm:ss.SSSSSS"), F.lit("0"))


def seconds_2dp(micros: Column) -> Column:
    """A non-negative duration in microseconds as seconds with two
    decimals, half up."""
    c = F.floor((micros + F.lit(5000)) / F.lit(10000)).cast("long")
    return F.concat((c / 100).cast("long").cast("string"), F.lit("."),
                    F.lpad((c % 100).cast("string"), 2, "0"))


def render_tree(logs: DataFrame, symbols: DataFrame | None = None, bits: int = CHUNK_BITS) -> DataFrame:
    """Call-tree text of every thread: a ``BEGIN f()`` line per BEG and an
    ``END f() [duration: ...]`` line per END that closes one, indented by
    level.  ``symbols`` supplies full names and locations; the calls are
    paired on the logged columns and the names joined last."""
    from .recover import recover_logs

    p = frames(logs, bits=bits).select("node", "tid", "id", "message", "puttime", "function", "fileline", "lvl",
                                       F.col("prev.message").alias("beg_message"),
                                       F.col("prev.puttime").alias("beg_time"))
    if symbols is not None:
        p = recover_logs(p, symbols, keys=logs.where(is_marker()))
    else:
        p = p.select("*", F.col("function").alias("rec_function"), path_of("fileline").alias("rec_path"),
                     F.split_part(F.col("fileline"), F.lit(":"), F.lit(2)).alias("rec_line"))
    loc = F.concat(F.lit("["), F.col("rec_path"), F.lit(":"), F.col("rec_line").cast("string"), F.lit("]"))
    fn = F.concat(F.col("rec_function"), F.lit("()"))
    begin = F.concat(F.lit("BEGIN  "), fn, F.lit("        ["), short_time("puttime"), F.lit("]  "), loc)
    dur = epoch_micros("puttime") - epoch_micros("beg_time")
    end = F.concat(F.lit("END  "), fn, F.lit("        [duration:"), seconds_2dp(dur), F.lit("s  "),
                   short_time("puttime"), F.lit("]  "), loc)
    is_beg = F.col("message") == BEGIN_MARK
    closes = (F.col("message") == END_MARK) & (F.col("beg_message") == BEGIN_MARK)
    return (p.where(is_beg | closes)
            .select("node", "tid", "id",
                    indent(F.when(is_beg, begin).otherwise(end), F.col("lvl") - 1).alias("text")))


def callstack_text(recovered: DataFrame, node: str, tid: int, task: str, at: str | None = None,
                   show_msg: bool = True, bits: int = CHUNK_BITS) -> DataFrame:
    """One task's call stack as text, one row per log row of the call:

    * BEG: ``BEGIN  f()        [time]  [path:line]`` at the frame's level
      (the task's own BEG is preceded by ``Start at <puttime>``);
    * END: ``END  f()        [duration:S.SSs  time]  [path:line]``;
    * with ``show_msg``, a message row: ``[LEVEL]  f()        [time]  [path:line]``
      followed by the message, both at the current depth.

    ``recovered`` is the log table with ``rec_function`` / ``rec_path`` /
    ``rec_line`` (see :func:`fleetlog.operators.recover.recover_logs`); calls
    are compared by these names.
    """
    rows = callstack(recovered, node, tid, task, at, function="rec_function", path="rec_path", bits=bits)
    if not show_msg:
        rows = rows.where(is_marker())
    is_beg = F.col("message") == BEGIN_MARK
    is_end = (F.col("message") == END_MARK) & ~F.col("unmatched")
    is_bad = (F.col("message") == END_MARK) & F.col("unmatched")
    # A frame lives at its BEG's depth; a matched END closes the last BEG at
    # depth + 1, an unmatched one is timed against the frame on top.
    level = F.when(is_beg, F.col("depth")).when(is_end, F.col("depth") + 1).when(is_bad, F.col("depth"))
    rows = rows.withColumn("lvl", level).withColumn(CHUNK, id_chunk(ORDER, bits))
    times = nearest_marked(rows.where(is_beg | is_end | is_bad), [*THREAD, "lvl"], [ORDER], is_beg, F.col("puttime"),
                           CHUNK, before="beg_time").select("id", "beg_time")
    r = rows.join(times, "id", "left")
    loc = F.concat(F.lit("["), F.col("rec_path"), F.lit(":"), F.col("rec_line").cast("string"), F.lit("]"))
    fn = F.concat(F.col("rec_function"), F.lit("()"))
    t = short_time("puttime")
    begin = F.concat(F.lit("BEGIN  "), fn, F.lit("        ["), t, F.lit("]  "), loc)
    dur = epoch_micros("puttime") - epoch_micros(F.col("beg_time"))
    end = F.concat(F.lit("END  "), fn, F.lit("        [duration:"), seconds_2dp(dur), F.lit("s  "), t,
                   F.lit("]  "), loc)
    msg_head = F.concat(F.lit("["), F.col("level"), F.lit("]  "), fn, F.lit("        ["), t, F.lit("]  "), loc)
    msg = F.concat(msg_head, F.lit("\n"), indent(F.col("message"), F.col("depth")))
    text = (F.when(is_beg, indent(begin, F.col("depth") - 1))
            .when(is_end, indent(end, F.col("depth")))
            .when(is_bad, indent(F.concat(F.lit("Unmatched function end:\n"), end), F.col("depth")))
            .otherwise(indent(msg, F.col("depth"))))
    start = F.when(is_beg & (F.col("depth") == 1),
                   F.concat(F.lit("Start at "), F.date_format("puttime", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("\n")))
    return r.select("node", "tid", "id", F.concat(F.coalesce(start, F.lit("")), text).alias("text"))
