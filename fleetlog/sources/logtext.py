"""Text log scan: frame multi-line records, parse headers, quarantine bad ones.

Record grammar::

    [LEVEL][ tid][yy-mm-ddTHH:MM:SS.ffffff][fileline][function] message
    continuation line
    ...

A line whose first character is ``[`` starts a new record.  The text source
frames records with ``lineSep="\\n["``, which keeps records whole across
split boundaries, so a file is read by as many tasks as it has splits and no
UDF touches the text.  The header is parsed with Catalyst expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LOG_COLUMNS

RECORD_SEP = "\n["
# Python's str.strip() whitespace set; the header pieces are stripped of it.
_WS = " \t\n\r\x0b\x0c"
# Bits of monotonically_increasing_id() that count rows inside a partition.
_ROW_BITS = (1 << 33) - 1
# Split offsets are at least 2 MiB apart, so offset * 4096 leaves room for
# 2^33 rows of one split before the next split's keys start.
_OFFSET_SCALE = 4096

QUARANTINE_REASONS = ("node_already_stored", "node_in_two_files", "orphan", "too_few_fields", "five_fields",
                      "bad_tid", "bad_time")


def node_of(file_name: Column) -> Column:
    """Node = file base name without its last extension (whole name when it
    has no dot)."""
    return F.regexp_replace(file_name, r"\.[^.]*$", "")


def scan_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per framed record: node, file, arrival key ``id`` and the raw
    record ``text`` (first header ``[`` may be missing; the parse does not
    need it)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.option("lineSep", RECORD_SEP).text(paths)
    mid = F.monotonically_increasing_id()
    return raw.select(
        node_of(F.col("_metadata.file_name")).alias("node"),
        F.col("_metadata.file_path").alias("file"),
        (F.col("_metadata.file_block_start") * F.lit(_OFFSET_SCALE)
         + mid.bitwiseAND(F.lit(_ROW_BITS))).alias("id"),
        # The file's last record keeps the final line break.
        F.regexp_replace("value", r"\r?\n$", "").alias("text"),
    )


def _piece(parts: Column, i: int) -> Column:
    return F.btrim(F.ltrim(F.try_element_at(parts, F.lit(i)), F.lit("[")), F.lit(_WS))


def parse_records(records: DataFrame) -> DataFrame:
    """Typed columns of every framed record plus ``reason`` (NULL when the
    record is good)."""
    text = F.col("text")
    nl = F.instr(text, "\n")
    header = F.when(nl > 0, F.substring(text, F.lit(1), nl - 1)).otherwise(text)
    rest = F.when(nl > 0, F.substring(text, nl + 1, F.lit(1 << 30)))
    parts = F.split(header, r"\]", 6)
    tid = F.expr("try_cast(__fl_tid AS BIGINT)")
    puttime = F.expr("try_cast(__fl_time AS TIMESTAMP_NTZ)")
    first = _piece(parts, 6)
    df = records.select(
        "*",
        F.size(parts).alias("__fl_n"),
        _piece(parts, 1).alias("level"),
        _piece(parts, 2).alias("__fl_tid"),
        F.concat(F.lit("20"), F.replace(_piece(parts, 3), F.lit("T"), F.lit(" "))).alias("__fl_time"),
        _piece(parts, 4).alias("fileline"),
        _piece(parts, 5).alias("function"),
        F.when(rest.isNull(), first).otherwise(F.concat(first, F.lit("\n"), rest)).alias("message"),
    )
    df = df.withColumn("tid", tid).withColumn("puttime", puttime)
    reason = (F.when(F.col("__fl_n") < 5, F.lit("too_few_fields"))
              .when(F.col("__fl_n") == 5, F.lit("five_fields"))
              .when(F.col("tid").isNull(), F.lit("bad_tid"))
              .when(F.col("puttime").isNull(), F.lit("bad_time")))
    return df.withColumn("reason", reason).drop("__fl_n", "__fl_tid", "__fl_time")


def check_files(parsed: DataFrame, stored_nodes: DataFrame | None = None) -> DataFrame:
    """``parsed`` with the reasons that need more than the record itself:

    * ``node_already_stored``: the node is in ``stored_nodes`` (node);
    * ``node_in_two_files``: another file, first by path, has the same node;
    * ``orphan``: text before the first header of its file.

    One small row per file is aggregated and broadcast.
    """
    files = parsed.groupBy("node", "file").agg(F.min("id").alias("__fl_first_id"))
    per_node = files.groupBy("node").agg(F.min("file").alias("__fl_first_file"))
    if stored_nodes is not None:
        known = stored_nodes.select("node", F.lit(True).alias("__fl_known")).distinct()
        per_node = per_node.join(known, "node", "left")
    else:
        per_node = per_node.withColumn("__fl_known", F.lit(None).cast("boolean"))
    reason = (F.when(F.col("__fl_known"), F.lit("node_already_stored"))
              .when(F.col("file") != F.col("__fl_first_file"), F.lit("node_in_two_files"))
              .when((F.col("id") == F.col("__fl_first_id")) & ~F.col("text").startswith("["), F.lit("orphan"))
              .otherwise(F.col("reason")))
    # broadcast, as a shuffle of the records by file would put each into one task
    return (parsed.join(F.broadcast(files.join(per_node, "node")), ["node", "file"])
            .withColumn("reason", reason).select(*parsed.columns))


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).select(*LOG_COLUMNS)


def quarantine(parsed: DataFrame) -> DataFrame:
    """Records that cannot become log rows, with the reason and raw text."""
    return parsed.where(F.col("reason").isNotNull()).select("node", "file", "id", "reason", "text")


def read_logs(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(good log rows, quarantine) of the given files.  Both come from one
    parse; persist or write them together to read the text only once."""
    parsed = check_files(parse_records(scan_records(spark, paths)))
    return good_rows(parsed), quarantine(parsed)


def max_message(logs: DataFrame) -> DataFrame:
    """Longest message of every node."""
    return logs.groupBy("node").agg(F.max(F.length("message")).cast("long").alias("max_msg"))


def rows_per_node(logs: DataFrame) -> DataFrame:
    return logs.groupBy("node").agg(F.count(F.lit(1)).alias("rows"))
