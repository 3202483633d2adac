"""Stored log tables: node-partitioned parquet, the items catalog, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LOG_COLUMNS

# Columns equality lookups go to (tid, function, fileline); puttime is the
# sort key of every file, so its row-group statistics prune time ranges.
BLOOM_COLUMNS = ("tid", "function", "fileline")


def stored_nodes(spark: SparkSession, root: str) -> list[str]:
    """Nodes already present under ``root`` (from the partition directories,
    no data is read)."""
    from urllib.parse import unquote

    jvm = spark.sparkContext._jvm
    Path = jvm.org.apache.hadoop.fs.Path
    fs = Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(Path(root)):
        return []
    out = []
    for st in fs.listStatus(Path(root)):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("node="):
            out.append(unquote(name.split("=", 1)[1]))
    return sorted(out)


def nodes_frame(spark: SparkSession, root: str) -> DataFrame:
    """(node) of the nodes stored under ``root``."""
    return spark.createDataFrame([(n,) for n in stored_nodes(spark, root)], "node string")


def write_logs(logs: DataFrame, root: str, range_partition: bool = False,
               num_partitions: int | None = None, bloom: bool = True) -> list[str]:
    """Append ``logs`` to the table at ``root``, partitioned by node.

    Nodes already stored are refused: their rows are left out and the node
    names returned.  (:func:`fleetlog.sources.ingest.ingest_files` also keeps
    their records, in the quarantine.)  Every output file is sorted by
    puttime, so row-group statistics let time-range filters skip data; bloom
    filters serve equality lookups.  The job commits all-or-nothing.

    Rows from the text scan are already time-local (one split = a stretch
    of one node's log), so the default sorts inside each task and writes
    without a shuffle.  ``range_partition`` first range-partitions by
    (node, puttime) -- one extra sampling pass and a full shuffle -- for
    inputs whose tasks mix all times (e.g. the output of a join).
    """
    spark = logs.sparkSession
    skipped = stored_nodes(spark, root)
    if skipped:
        logs = logs.join(nodes_frame(spark, root), "node", "left_anti")
    out = logs.select(*LOG_COLUMNS)
    if range_partition:
        keys = ("node", "puttime")
        out = out.repartitionByRange(num_partitions, *keys) if num_partitions else out.repartitionByRange(*keys)
    w = out.sortWithinPartitions("node", "puttime", "id").write.mode("append").partitionBy("node")
    w = w.option("parquet.bloom.filter.enabled", "false")
    for c in BLOOM_COLUMNS if bloom else ():
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    w.parquet(root)
    return skipped


def read_stored(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root).select(*LOG_COLUMNS)


def write_items(logs: DataFrame, root: str) -> None:
    """Append the items catalog of newly ingested logs, by node."""
    (items_catalog(logs).repartition("node").sortWithinPartitions("node", "field", "value")
     .write.mode("append").partitionBy("node").parquet(root))


def read_items(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root).select("node", "field", "value")


def items_catalog(logs: DataFrame) -> DataFrame:
    """Distinct values of ``level`` and ``tid`` per node: (node, field, value)."""
    return (logs.select("node", F.expr("stack(2, 'level', level, 'tid', CAST(tid AS STRING)) AS (field, value)"))
            .where(F.col("value").isNotNull())
            .distinct())


def list_items(catalog: DataFrame, node: str, field: str) -> DataFrame:
    """Values of one field of one node, sorted as text (tid 10 before 2)."""
    return (catalog.where((F.col("node") == node) & (F.col("field") == field))
            .select("value").orderBy("value"))


def list_nodes(logs: DataFrame) -> DataFrame:
    return logs.select("node").distinct().orderBy("node")


def node_select(logs: DataFrame, node: str) -> DataFrame:
    """Rows of one node; a filter on the partition column, so only that
    node's files are read.  Unknown nodes are an error."""
    sel = logs.where(F.col("node") == node)
    if not sel.limit(1).collect():
        raise ValueError(f"no logs of node {node!r} are stored")
    return sel
