"""Incremental ingest: the text scan as a Structured Streaming query.

New log files dropped into a directory are framed and parsed exactly like
the batch scan (:mod:`fleetlog.sources.logtext`) and appended to the node-
partitioned table, its items and its index.  Each file
is taken once (the file source tracks what it has read in the checkpoint; a
micro-batch is a committed batch of the ingest, named by the checkpoint and the
epoch, so one that is played again is passed over), and the records of a node that is stored already, or of a second file of one
node, go to the quarantine, as in the batch ingest.

The stream carries only the raw record and its file metadata; the arrival
key uses ``monotonically_increasing_id``, which streaming plans do not
allow, so the parse runs per micro-batch in ``foreachBatch``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import ingest, logtext


def record_stream(spark: SparkSession, src_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format("text").option("lineSep", logtext.RECORD_SEP)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(src_dir).select(
        "value",
        F.col("_metadata.file_name").alias("__fl_file_name"),
        F.col("_metadata.file_path").alias("__fl_file_path"),
        F.col("_metadata.file_block_start").alias("__fl_block"))


def _batch_records(batch: DataFrame) -> DataFrame:
    mid = F.monotonically_increasing_id()
    return batch.select(
        logtext.node_of(F.col("__fl_file_name")).alias("node"),
        F.col("__fl_file_path").alias("file"),
        (F.col("__fl_block") * F.lit(4096) + mid.bitwiseAND(F.lit((1 << 33) - 1))).alias("id"),
        F.regexp_replace("value", r"\r?\n$", "").alias("text"))


def start_ingest(spark: SparkSession, src_dir: str, root: str, checkpoint: str, available_now: bool = True,
                 max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the ingest stream into the tables of ``root``
    (:mod:`fleetlog.sources.ingest`); with ``available_now`` it processes what
    is there and stops (batch-like, restartable from the checkpoint)."""

    name = hashlib.md5(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, epoch: int) -> None:
        ingest.write_batch(_batch_records(batch), root, f"stream-{name}-{epoch}")

    w = record_stream(spark, src_dir, max_files_per_trigger).writeStream.foreachBatch(write).option(
        "checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
