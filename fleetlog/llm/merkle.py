"""Document fingerprints: Merkle trees over paragraphs and sections.

A text is cut at its line breaks into paragraphs and these at content-defined
word ends into pieces of LEAF_MIN to LEAF_MAX characters, the leaves.  A
paragraph's digest covers its leaves, a section's its paragraphs (a section
ends after a paragraph whose digest ends in two zero bits), the root its
sections.  Equal roots are equal texts; descending into differing children
only (``differences``) locates an edit.

The fingerprint is one string: the root, ``|``, and the tree with sections
separated by ``;``, paragraphs by ``,`` and eight hex digits per leaf.
Likeness compares two fingerprints alone: 1 for equal roots, else the shared
leaves (with repeats) over the mean number of leaves.

Neighbours in ascending doc_id are found without moving any text twice: the
ids are cut at quantiles into ranges, one shuffle deals the texts by range,
and the first document of each range also goes to the range before it.

Null text is an empty one.  Null ids come first; rows of one id are ordered by
text.  A lone document is its own successor.  An empty table gives no rows.
Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlog.llm.common import ship, shuffle_width, table

LEAF_MIN, LEAF_MAX = 24, 96
_LEAF = re.compile(rb"(?s).{%d,%d}?[aeint.]\s|.{1,%d}" % (LEAF_MIN, LEAF_MAX, LEAF_MAX))


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _paragraph(line: bytes) -> tuple[bytes, str]:
    pieces = [line] if len(line) <= LEAF_MIN else _LEAF.findall(line)
    leaves = [_digest(b"\0" + p) for p in pieces]
    return _digest(b"\1" + b"".join(leaves)), "".join([d[:4].hex() for d in leaves])


def fingerprint(text: bytes, known: dict | None = None) -> str:
    """Fingerprint of one text (UTF-8 bytes).  ``known`` keeps paragraphs that
    a related text may share."""
    known = {} if known is None else known
    sections, section, shown = [], [], []
    for line in text.split(b"\n"):
        p = known.get(line)
        if p is None:
            p = known[line] = _paragraph(line)
        section.append(p)
        if not p[0][-1] & 3:
            sections.append(section)
            section = []
    if section:
        sections.append(section)
    heads = [_digest(b"\2" + b"".join([d for d, _ in s])) for s in sections]
    for s in sections:
        shown.append(",".join([x for _, x in s]))
    return _digest(b"\3" + b"".join(heads)).hex() + "|" + ";".join(shown)


def _leaves(print_: str) -> list[str]:
    flat = print_[33:].replace(";", "").replace(",", "")
    return [flat[i:i + 8] for i in range(0, len(flat), 8)]


def likeness(a: str, b: str) -> float:
    """0 to 1, from two fingerprints."""
    if a[:32] == b[:32]:
        return 1.0
    x, y = Counter(_leaves(a)), Counter(_leaves(b))
    both = sum((x & y).values())
    total = sum(x.values()) + sum(y.values())
    # differing texts are never fully alike
    return min(2.0 * both / total, 1.0 - 1.0 / (total + 1)) if total else 0.0


def differences(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of the first text whose branch has no equal in the
    second; sections that the second holds are not descended into."""
    if a[:32] == b[:32]:
        return []
    other = b[33:].split(";")
    sections, paragraphs = set(other), {p for s in other for p in s.split(",")}
    return [(i, j) for i, s in enumerate(a[33:].split(";")) if s not in sections
            for j, p in enumerate(s.split(",")) if p not in paragraphs]


def edited_text(text: str, following: str) -> str:
    """The last quarter replaced by as much of the following text."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(owner, seat, doc_id, text) in partitions: each holds a range of ids in
    ascending order (seat 0), then the document that follows the range (seat 1,
    possibly several rows of one id, the first counts)."""
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
                      F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    n = shuffle_width(docs)
    cuts = src.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10 * n + 1000)).first()[0]
    bounds = np.unique(np.array(cuts or [], dtype=np.int64))  # at most one per partition

    @F.pandas_udf("int")
    def range_of(ids):
        import pandas as pd
        # a null id (-1 here) is before all ranges' first bound
        null = ids.isna().to_numpy()
        at = np.searchsorted(bounds, ids.fillna(0).to_numpy(dtype=np.int64), side="left") + 1
        return pd.Series(np.where(null, 0, at).astype(np.int32))

    ids = src.select("doc_id", range_of("doc_id").alias("owner"))
    firsts = {r["owner"]: r["first"] for r in  # one row per range
              ids.groupBy("owner").agg(F.min("doc_id").alias("first")).collect()}
    order = sorted(firsts)
    before = {b: a for a, b in zip(order, order[1:])}
    if order:
        before[order[0]] = order[-1]
    spec = spark.createDataFrame([(b, firsts[b], a) for b, a in before.items()],
                                 "owner int, first long, guest_of int")
    ranged = src.withColumn("owner", range_of("doc_id"))
    # one row per range: bounded by the number of partitions
    seats = ranged.join(F.broadcast(spec), "owner").select("doc_id", "text", F.explode(F.when(
        F.col("doc_id").eqNullSafe(F.col("first")),
        F.array(F.struct(F.col("owner").alias("owner"), F.lit(0).alias("seat")),
                F.struct(F.col("guest_of").alias("owner"), F.lit(1).alias("seat"))))
        .otherwise(F.array(F.struct(F.col("owner").alias("owner"), F.lit(0).alias("seat"))))).alias("s"))
    return (seats.select("s.owner", "s.seat", "doc_id", "text").repartitionById(n + 1, F.col("owner"))
            .sortWithinPartitions("owner", "seat", F.col("doc_id").asc_nulls_first(), "text"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document, see OUT."""

    def run(batches):
        held = None  # (owner, doc_id, text, fingerprint, paragraphs)
        out: list[tuple] = []
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                s = b.slice(lo, 1000)
                for owner, seat, did, t in zip(*(s.column(i).to_pylist() for i in range(4))):
                    if seat and held is None:
                        continue  # a second row of the following id
                    known: dict = {}
                    print_ = fingerprint(t.encode(), known)
                    if held is not None:
                        out.append(_row(held, t, print_))
                    held = None if seat else (owner, did, t, print_, known)
                if out:
                    yield _batch(out)
                    out = []
        if held is not None:
            raise AssertionError("a range without a following document")

    return with_next(docs, doc_id, text).mapInArrow(run, OUT)


def _row(held, following: str, next_print: str) -> tuple:
    _, did, t, print_, known = held
    new = edited_text(t, following).encode()
    new_print = fingerprint(new, known)
    return (did, len(t), hashlib.sha256(new).hexdigest(), print_, new_print,
            likeness(print_, new_print), likeness(print_, next_print))


def _batch(rows):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      names=[c.split()[0] for c in OUT.split(", ")])


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints(table(spark, sf_dir, "documents"))
