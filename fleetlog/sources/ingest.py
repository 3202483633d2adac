"""Ingest: log files into the stored tables of one root folder.

``logs/``        log rows, partitioned by node
``items/``       distinct levels and threads per node
``index/``       positional full-text index of the messages, by node and word
``depths/``      call depth of every chunk of a thread, by node
``quarantine/``  every record that is not a log row, with its reason: malformed
                 ones, and those of files whose node is stored already or has
                 another file in the same batch
``commits/``     one small file per committed batch, named by the batch; it
                 holds the name of the batch's folder in the tables

A record ends up in ``logs`` or in ``quarantine``, none is dropped.

A batch writes its rows of every table below ``batch=<folder>``, a folder that no
other attempt uses, and then renames its commit file into place.  That one rename
makes all its rows visible: readers take the folders of committed batches only.
What a failed attempt leaves behind is never read (``vacuum`` deletes it), so
a batch can be tried again, and one that is committed already is passed over.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators import depths, search
from ..schema import LOG_COLUMNS, LOG_SCHEMA
from ..session import discard, scratch_path
from . import logtext, store

INDEX_IDS = ("node", "id")
TABLES = ("logs", "items", "index", "depths", "quarantine")

# Read with their schemas: a batch may have no row of a table.
SCHEMAS = {
    "logs": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LOG_SCHEMA.fields),
    "items": "node string, field string, value string",
    "index": "node string, id long, word string, pos int",
    "depths": "node string, tid long, chunk long, total long, least long",
    "quarantine": "node string, file string, id long, reason string, text string",
}


def paths(root: str) -> dict[str, str]:
    return {k: f"{root.rstrip('/')}/{k}" for k in (*TABLES, "commits")}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def committed(spark: SparkSession, root: str) -> dict[str, str]:
    """Committed batches and their folders, from the commit files."""
    fs, p = _fs(spark, paths(root)["commits"])
    if not fs.exists(p):
        return {}
    out = {}
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if not name.startswith("_"):
            stream = fs.open(st.getPath())
            try:
                out[name] = stream.readUTF()
            finally:
                stream.close()
    return out


def _commit(spark: SparkSession, root: str, batch: str, folder: str) -> None:
    to = paths(root)["commits"]
    fs, temporary = _fs(spark, f"{to}/_{folder}")
    stream = fs.create(temporary, True)
    stream.writeUTF(folder)
    stream.close()
    final = _fs(spark, f"{to}/{batch}")[1]
    if fs.exists(final) or not fs.rename(temporary, final):
        fs.delete(temporary, False)
        raise RuntimeError(f"batch {batch!r} was committed by another attempt")


def _folders(spark: SparkSession, root: str, name: str) -> list[str]:
    out = []
    for folder in sorted(committed(spark, root).values()):
        path = f"{paths(root)[name]}/batch={folder}"
        fs, p = _fs(spark, path)
        if fs.exists(p):
            out.append(path)
    return out


def stored_nodes(spark: SparkSession, root: str) -> list[str]:
    """Nodes of the committed batches (from the folders, no data is read)."""
    return sorted({n for path in _folders(spark, root, "logs") for n in store.stored_nodes(spark, path)})


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the TABLES: the rows of all committed batches."""
    found = _folders(spark, root, name)
    schema = SCHEMAS[name]
    columns = LOG_COLUMNS if name == "logs" else [c.split()[0] for c in schema.split(", ")]
    if not found:
        return spark.createDataFrame([], schema).select(*columns)
    return (spark.read.option("basePath", paths(root)[name]).schema(f"{schema}, batch string")
            .parquet(*found).select(*columns))


def write_batch(records: DataFrame, root: str, batch: str | None = None) -> bool:
    """Framed records (``logtext.scan_records``) into the tables of ``root``, as
    the given batch (default: a new one).  False if it is committed already."""
    spark = records.sparkSession
    batch = batch or uuid.uuid4().hex
    if batch in committed(spark, root):
        return False
    folder = f"{batch}-{uuid.uuid4().hex[:12]}"
    to = {k: f"{p}/batch={folder}" for k, p in paths(root).items()}
    known = spark.createDataFrame([(n,) for n in stored_nodes(spark, root)], "node string")
    # parsed once, into the shared folder: the tables are made of it
    scratch = scratch_path(spark, "parsed")
    logtext.check_files(logtext.parse_records(records), known).write.parquet(scratch)
    parsed = spark.read.parquet(scratch)
    try:
        logtext.quarantine(parsed).write.partitionBy("node").parquet(to["quarantine"])
        good = logtext.good_rows(parsed)
        search.write_index(good, INDEX_IDS, "message", to["index"])
        depths.write_depths(good, to["depths"])
        store.write_items(good, to["items"])
        store.write_logs(good, to["logs"])
        _commit(spark, root, batch, folder)
    finally:
        discard(spark, scratch)
    return True


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete what failed attempts left (no other ingest may be running);
    returns the folders."""
    keep = {f"batch={f}" for f in committed(spark, root).values()}
    gone = []
    for name in TABLES:
        fs, p = _fs(spark, paths(root)[name])
        for st in fs.listStatus(p) if fs.exists(p) else ():
            if st.getPath().getName().startswith("batch=") and st.getPath().getName() not in keep:
                fs.delete(st.getPath(), True)
                gone.append(f"{name}/{st.getPath().getName()}")
    return sorted(gone)


def ingest_files(spark: SparkSession, files: str | Sequence[str], root: str, batch: str | None = None) -> bool:
    return write_batch(logtext.scan_records(spark, files), root, batch)


def read_index(spark: SparkSession, root: str) -> search.Index:
    return search.Index(read_table(spark, root, "index"), INDEX_IDS)
