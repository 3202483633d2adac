"""Log-shaped inputs derived from the driver tables.

No real fleet logs ship with the tests, so the log table is derived from
``events``: every user's events become one thread of one node, and the
events of a thread are laid out as nested calls (cycles of eight records:
BEG outer, BEG inner, message, END inner, BEG inner2, END inner2, message,
END outer).  The derivation is a Spark job over the whole ``events`` table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import running_count, time_chunk
from ..session import read_table


def _pos_case(pos: Column, mapping: list[tuple[tuple[int, ...], str]], default: str) -> Column:
    out = None
    for positions, value in mapping:
        cond = pos.isin(*positions)
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(F.lit(default))


def events_positions(events: DataFrame) -> DataFrame:
    """events + node, tid and the position ``k`` of each event in its thread
    (0-based, by (ts, event_id)), with ``pos = k % 8`` and ``cyc = k / 8``."""
    e = events.select(
        "event_id", "ts", "user_id", "event_type", "props",
        F.concat(F.lit("node-"), (F.col("user_id") % 5).cast("string")).alias("node"),
        (F.col("user_id") % 12).alias("tid"),
    )
    e = running_count(e, ["node", "tid"], ["ts", "event_id"], "__rn", time_chunk("ts"))
    k = F.col("__rn") - 1
    return (e.withColumn("k", k)
            .withColumn("pos", k % 8)
            .withColumn("cyc", F.floor(k / 8).cast("long"))
            .drop("__rn"))


# Fixed values of the log fixture: file paths, line base and function names
# per position in the eight-record cycle.
FIXTURE_PATHS = [((0, 7), "rder/Processing.cpp"), ((4, 5), "tils/Totals.h")]
FIXTURE_DEFAULT_PATH = "atch/Commit.cpp"
FIXTURE_LINE_BASE = 100
FIXTURE_FUNCTIONS = [((0, 6, 7), "ProcessOrderBatchFro"), ((1, 2, 3), "CommitBatch")]
FIXTURE_DEFAULT_FUNCTION = "ComputeTotals"
FIXTURE_BEG_POS = (0, 1, 4)
FIXTURE_END_POS = (3, 5, 7)
MISMATCH_FUNCTION = "LostTask"
SHORT_FUNCTION = "ProcessOrderBatchFr"


def logs_from_positions(p: DataFrame, mismatched: bool = False, hard: bool = False) -> DataFrame:
    """``mismatched``: some ENDs name a function that was never entered.
    ``hard``: besides, the clock of some cycles steps back by a day, and some
    ENDs log a shorter form of the name, which recovers to the same function."""
    pos = F.col("pos")
    mismatched = mismatched or hard
    level = (F.when(F.col("event_type") == "error", F.lit("WARNING"))
             .when(pos.isin(2, 6), F.lit("DEBUG")).otherwise(F.lit("INFO")))
    fileline = F.concat(_pos_case(pos, FIXTURE_PATHS, FIXTURE_DEFAULT_PATH), F.lit(":"),
                        (F.lit(FIXTURE_LINE_BASE) + pos).cast("string"))
    function = _pos_case(pos, FIXTURE_FUNCTIONS, FIXTURE_DEFAULT_FUNCTION)
    if mismatched:
        function = F.when((pos == 3) & (F.col("cyc") % 11 == 5), F.lit(MISMATCH_FUNCTION)).otherwise(function)
    time = F.col("ts")
    if hard:
        function = F.when((pos == 7) & (F.col("cyc") % 3 == 1), F.lit(SHORT_FUNCTION)).otherwise(function)
        time = F.when(pos.isin(4, 5) & (F.col("cyc") % 7 == 3), time - F.expr("INTERVAL 1 DAY")).otherwise(time)
    message = (F.when(pos.isin(*FIXTURE_BEG_POS), F.lit("BEG"))
               .when(pos.isin(*FIXTURE_END_POS), F.lit("END"))
               .otherwise(F.concat(F.col("event_type"), F.lit(" user "), F.col("user_id").cast("string"),
                                   F.lit(" props "), F.col("props"))))
    return p.select(
        F.col("event_id").alias("id"), "node", level.alias("level"), F.col("tid").cast("long").alias("tid"),
        time.alias("puttime"), fileline.alias("fileline"), function.alias("function"),
        message.alias("message"))


def derive_logs(spark: SparkSession, sf_dir: str, mismatched: bool = False, hard: bool = False) -> DataFrame:
    """The log table derived from ``events`` (see module doc), as a plan."""
    return logs_from_positions(events_positions(read_table(spark, sf_dir, "events")), mismatched, hard)


# Folders of this session's derived test tables, by application.
_STORED: dict[tuple, str] = {}


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _state(spark: SparkSession, folder: str) -> int:
    """A hash of the names, lengths and modification times of all files."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hash(tuple(sorted(seen)))


def _made(spark: SparkSession, key: tuple, write) -> str:
    """The folder of a derived test table (``key``: its name, its input folder,
    options), written once per application and state of the input files."""
    from ..session import scratch_path

    full = (spark.sparkContext.applicationId, *key, _state(spark, key[1]))
    path = _STORED.get(full)
    if path is None or not _exists(spark, path):
        path = scratch_path(spark, key[0])
        write(path)
        _STORED[full] = path
    return path


def logs(spark: SparkSession, sf_dir: str, mismatched: bool = False, hard: bool = False) -> DataFrame:
    """The log table derived from ``events``, stored once per session the
    way ingested logs are (node-partitioned parquet below the shared
    checkpoint folder) and read back from there."""
    from . import store

    path = _made(spark, ("logs-table", sf_dir, mismatched, hard), lambda p: store.write_logs(
        derive_logs(spark, sf_dir, mismatched, hard), p, range_partition=True))
    return store.read_stored(spark, path)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored items catalog of :func:`logs`, as ingest writes it."""
    from . import store

    return store.read_items(spark, _made(spark, ("log-items", sf_dir),
                                         lambda p: store.write_items(logs(spark, sf_dir), p)))


def depths(spark: SparkSession, sf_dir: str, mismatched: bool = False) -> DataFrame:
    """The stored chunk depths of :func:`logs`, as ingest writes them."""
    from ..operators.depths import write_depths

    return spark.read.parquet(_made(spark, ("log-depths", sf_dir, mismatched),
                                    lambda p: write_depths(logs(spark, sf_dir, mismatched), p)))


def log_index(spark: SparkSession, sf_dir: str):
    """The stored message index of :func:`logs`, as ingest writes it."""
    from ..operators import search
    from .ingest import INDEX_IDS

    path = _made(spark, ("log-index", sf_dir),
                 lambda p: search.write_index(logs(spark, sf_dir), INDEX_IDS, "message", p))
    return search.Index.read(spark, path, INDEX_IDS)


def document_index(spark: SparkSession, sf_dir: str, stem: bool):
    """A stored index of the texts of ``documents``."""
    from ..operators import search

    path = _made(spark, ("document-index", sf_dir, stem), lambda p: search.write_index(
        read_table(spark, sf_dir, "documents"), ["doc_id"], "text", p, stem))
    return search.Index.read(spark, path, ["doc_id"], stem)


# The symbol table used by the recovery tests, (name, path, line),
# in table order.
SYMBOLS = [
    ("CommitBatch", "app/src/batch/Commit.cpp", 101),
    ("CommitBatch", "app/test/CommitTest.cpp", 102),
    ("CommitBatchCore", "app/src/batch/Commit.cpp", 105),
    ("ComputeTotals", "app/src/other/Totals.cpp", 7),
    ("ProcessOrderBatchFromDisk", "app/src/order/Processing.cpp", 300),
    ("ProcessOrderBatchFromQueue", "app/src/order/Processing.cpp", 98),
]


def symbols(spark: SparkSession) -> DataFrame:
    rows = [(n, p, ln, i + 1) for i, (n, p, ln) in enumerate(SYMBOLS)]
    return spark.createDataFrame(rows, "name string, path string, line int, seq int")


# ------------------------------------------------------------ rendered text

# Fixed values of the rendered text fixture.
TEXT_TIME_FORMAT = "yy-MM-dd'T'HH:mm:ss.SSSSSS"
ORPHAN_AFTER_BAD = "  orphan line after a bad record"
# looks like a header that lost its first character
ORPHAN_AT_START = "INFO][    1][24-01-01T00:00:00.000000][a.cpp:1][Lost                ] tail of a record of "


def _multiline(logs: DataFrame) -> Column:
    """Message rows of CommitBatch carry two continuation lines."""
    cont = (F.col("function") == "CommitBatch") & ~F.col("message").isin("BEG", "END")
    return F.when(cont, F.concat(F.col("message"), F.lit("\n    at "), F.col("fileline"),
                                 F.lit("\n    tid "), F.col("tid").cast("string"))).otherwise(F.col("message"))


def text_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows the rendered text must parse back to."""
    lg = logs(spark, sf_dir)
    return lg.withColumn("message", _multiline(lg))


def _header(level: Column, tid_text: Column, time_text: Column, fileline: Column, function_text: Column) -> Column:
    return F.concat(F.lit("["), level, F.lit("]["), tid_text, F.lit("]["), time_text, F.lit("]["),
                    fileline, F.lit("]["), function_text)


def render_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, grp, puttime, id, sub, line) -- every record as text in file
    order, with bad records and orphan lines injected:

    * after each WARNING END row a bad record whose kind cycles with tid:
      too few fields, five fields, non-numeric tid -- each followed by an
      orphan line;
    * an orphan line at the start of every file.
    """
    lg = text_logs(spark, sf_dir)
    t = F.date_format("puttime", TEXT_TIME_FORMAT)
    good = lg.select(
        "node", F.lit(1).alias("grp"), "puttime", "id", F.lit(0).alias("sub"),
        F.concat(_header(F.col("level"), F.lpad(F.col("tid").cast("string"), 5, " "), t, F.col("fileline"),
                         F.format_string("%-20s", F.col("function"))),
                 F.lit("] "), F.col("message")).alias("line"))
    kind = F.col("tid") % 3
    bad_text = (F.when(kind == 0, F.concat(F.lit("[bad line "), F.col("function")))
                .when(kind == 1, F.concat(_header(F.col("level"), F.lpad(F.col("tid").cast("string"), 5, " "), t,
                                                  F.col("fileline"), F.col("function")),
                                          F.lit(" header cut short")))
                .otherwise(F.concat(_header(F.col("level"), F.concat(F.lit("t"), F.col("tid").cast("string")), t,
                                            F.col("fileline"), F.col("function")),
                                    F.lit("] tid is not a number"))))
    bad = lg.where((F.col("level") == "WARNING") & (F.col("message") == "END")).select(
        "node", F.lit(1).alias("grp"), "puttime", "id", F.lit(1).alias("sub"),
        F.concat(bad_text, F.lit("\n" + ORPHAN_AFTER_BAD)).alias("line"))
    starts = lg.select("node").distinct().select(
        "node", F.lit(0).alias("grp"), F.lit(None).cast("timestamp_ntz").alias("puttime"),
        F.lit(None).cast("long").alias("id"), F.lit(0).alias("sub"),
        F.concat(F.lit(ORPHAN_AT_START), F.col("node")).alias("line"))
    return good.unionByName(bad).unionByName(starts)


WRITERS = 8  # node files written at a time


def ordered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, range, line): :func:`render_records` in file order, a partition a
    range; more of them the more input there is (stored logs are a tenth of
    their text or less), so that the sort of one stays small."""
    order = ["node", "grp", "puttime", "id", "sub"]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * logs(spark, sf_dir).rdd.getNumPartitions())
    return (render_records(spark, sf_dir).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
            .select("node", F.spark_partition_id().alias("range"), "line"))


def render_log_files(spark: SparkSession, sf_dir: str, out_dir: str) -> list[str]:
    """Write one ``<node>.txt`` per node under ``out_dir``; returns the files.

    A node's file is one ordered stream, so each node is written by one task;
    this only builds test input and is not used by the operators.  The records
    are sorted before that, by ranges of (node, time) in many tasks, and the
    writing tasks only pass on what they read, range after range.
    """
    from concurrent.futures import ThreadPoolExecutor
    from functools import reduce

    from ..session import discard, scratch_path

    ranges = scratch_path(spark, "rendered-ranges")
    staging = out_dir.rstrip("/") + "/_staging"
    ordered_records(spark, sf_dir).write.partitionBy("node", "range").parquet(ranges)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    fs = Path(out_dir).getFileSystem(conf)
    stored = spark.read.parquet(ranges)
    runs: dict[str | None, list[int]] = {}
    for r in stored.select("node", "range").distinct().orderBy("range").collect():  # one row per folder
        runs.setdefault(r["node"], []).append(r["range"])

    def write(node: str | None) -> str:
        name = "__HIVE_DEFAULT_PARTITION__" if node is None else node
        parts = [stored.where(F.col("node").eqNullSafe(F.lit(node)) & (F.col("range") == k)).select("line").coalesce(1)
                 for k in runs[node]]
        reduce(DataFrame.union, parts).coalesce(1).write.text(f"{staging}/{name}")
        dst = Path(f"{out_dir.rstrip('/')}/{name}.txt")
        fs.rename(fs.globStatus(Path(f"{staging}/{name}/part-*"))[0].getPath(), dst)
        return dst.toString()

    with ThreadPoolExecutor(WRITERS) as pool:
        files = list(pool.map(write, runs))
    discard(spark, ranges)
    fs.delete(Path(staging), True)
    return sorted(files)


def rendered_dir(spark: SparkSession, sf_dir: str) -> str:
    """Directory of rendered ``<node>.txt`` files for ``sf_dir`` (made once
    per session, below the shared checkpoint folder)."""
    return _made(spark, ("rendered-logs", sf_dir), lambda p: render_log_files(spark, sf_dir, p))
