"""Benchmark decontamination with a positional inverted index of the corpus.

The corpus is cut into blocks of whole documents (about BLOCK_WORDS words).
Each block is one row of the stored index: its documents, and for every term
of the test set that occurs in it the sorted list of positions.  Positions run
through the block with a gap between documents wider than any match, so one
integer is document and position.  Corpus frequencies of the terms are summed
over the stored index.

A test window is looked up from its rarest term: that term's list, shifted by
its offset, is intersected with the shifted lists of the other terms in order
of frequency until it is empty.  What is left are exact phrase matches.  An
item's PROXIMITY_TERMS rarest terms within SPAN words of each other, in any
order, are a proximity match.

The test set is worked through in slices of at most SLICE_WORDS words, so what
a task holds of it is bounded however large it is; hits of all slices are
merged by document.

Null text has no words; neither has a blank one, and it is never contaminated.
Items without words have no window; null item texts neither.  Items with a
null item_id have windows like any other, their words are hit and can make a
document contaminated; only the lists of ids (items, near) and their counts
leave the null id out.  Rows of equal
doc_id (or null) are separate documents.  Repeated items are reported by each
of their ids, an id once.  An empty table on either side gives, respectively, no
rows or rows without hits.  Only the named columns are read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlog.llm.common import for_join, ship, stored, table

WINDOW = 13
SHARE = 20  # contaminated: hit words are at least 1/SHARE of the document's
BLOCK_WORDS = 400_000
SLICE_WORDS = 2_000_000
PROXIMITY_TERMS = 4
SPAN = 26
GAP = 32

# Word bytes: digits, letters and everything outside ASCII; A-Z lower-cased.
_TO_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORD).split()


INDEX = ("part int, block int, doc_ids array<bigint>, hashes array<bigint>, n_words array<int>, "
         "terms array<int>, counts array<int>, deltas binary")


def _index_row(part, block, docs, ids, keys):
    ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    order = np.argsort(ids, kind="stable")
    ids, keys = ids[order], keys[order]
    terms, first, counts = np.unique(ids, return_index=True, return_counts=True)
    deltas = np.diff(keys, prepend=0)
    deltas[first] = keys[first]
    col = lambda v, t: pa.array([v], t)
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([
        col(part, pa.int32()), col(block, pa.int32()), col([d[0] for d in docs], longs),
        col([d[1] for d in docs], longs), col([d[2] for d in docs], ints), col(terms, ints), col(counts, ints),
        col(deltas.astype("<u4").tobytes(), pa.binary())], names=[c.split()[0] for c in INDEX.split(", ")])


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings of the vocabulary's terms in every whole text, a row per block."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        get, part, block = shared.value.get, TaskContext.get().partitionId(), 0
        held, ids, keys, base = [], [], [], 0
        for b in batches:
            for did, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(),
                                 b.column(2).cast(pa.binary()).to_pylist()):
                words = words_of(t)
                term = np.fromiter(map(get, words, repeat(-1)), dtype=np.int32, count=len(words))
                at = np.flatnonzero(term >= 0)
                if len(at):
                    ids.append(term[at])
                    keys.append(at + base)
                held.append((did, h, len(words)))
                base += len(words) + GAP
                if base >= BLOCK_WORDS:
                    yield _index_row(part, block, held, ids, keys)
                    held, ids, keys, base, block = [], [], [], 0, block + 1
        if held:
            yield _index_row(part, block, held, ids, keys)

    src = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
                      F.xxhash64(f"`{text}`").alias("text_hash"), F.col(f"`{text}`").cast("string").alias("text"))
    return src.mapInArrow(run, INDEX)


def frequencies(index: DataFrame) -> DataFrame:
    """(term, df): postings of each term in the corpus."""
    return (index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t"))
            .groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("df")))


class Windows:
    """The windows of a slice of the test set, ready to be looked up."""

    def __init__(self, items: list[tuple[int | None, list[int]]], df: np.ndarray, window: int = WINDOW):
        self.by_rarest: dict[int, list[tuple]] = {}
        self.near: list[tuple] = []
        owners: dict[tuple, list[int]] = {}
        for item, terms in items:
            if not terms:
                continue
            for i in range(max(1, len(terms) - window + 1)):
                own = owners.setdefault(tuple(terms[i:i + window]), [])
                if item is not None and item not in own[-1:]:
                    own.append(item)
            rare = sorted(set(terms), key=lambda t: (df[t], t))[:PROXIMITY_TERMS]
            if item is not None and len(rare) == PROXIMITY_TERMS:
                self.near.append((item, rare))
        for w, own in owners.items():
            order = sorted(range(len(w)), key=lambda k: (df[w[k]], w[k], k))
            self.by_rarest.setdefault(w[order[0]], []).append((w, order, own))

    def search(self, lists: dict[int, np.ndarray], bases: np.ndarray, length: int):
        """(hit flags of all block positions, {(document, item)}, {(document, item)} of proximity)."""
        edge = np.zeros(length + 1, dtype=np.int32)
        exact, near = set(), set()

        def docs(keys):
            return np.unique(np.searchsorted(bases, keys, side="right") - 1).tolist()

        for term, windows in self.by_rarest.items():
            if term not in lists:
                continue
            for w, order, own in windows:
                cand = lists[term] - order[0]
                for k in order[1:]:
                    at = lists.get(w[k])
                    if at is None:
                        cand = cand[:0]
                    else:
                        want = cand + k
                        cand = cand[at[np.minimum(np.searchsorted(at, want), len(at) - 1)] == want]
                    if not len(cand):
                        break
                if len(cand):
                    np.add.at(edge, cand, 1)
                    np.add.at(edge, cand + len(w), -1)
                    exact.update((d, i) for d in docs(cand) for i in own)
        for item, rare in self.near:
            at = lists.get(rare[0])
            for t in rare[1:]:
                other = lists.get(t)
                if at is None or other is None or not len(at):
                    at = None
                    break
                right = np.searchsorted(other, at)
                after = other[np.minimum(right, len(other) - 1)]
                before = other[np.maximum(right - 1, 0)]
                at = at[(np.abs(after - at) <= SPAN) | (np.abs(at - before) <= SPAN)]
            if at is not None and len(at):
                near.update((d, item) for d in docs(at))
        return np.cumsum(edge[:-1]) > 0, exact, near


HITS = ("part int, block int, ordinal int, doc_id long, text_hash long, n_words long, "
        "hits array<struct<start:int,end:int>>, items array<bigint>, near array<bigint>")


def search_index(index: DataFrame, items: list[tuple[int | None, list[int]]], df: np.ndarray,
                 window: int = WINDOW) -> DataFrame:
    """A row per document: merged hit ranges (word positions), items with exact
    and with proximity matches."""
    spark = index.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((items, df))
    kept: list[Windows] = []

    def run(batches):
        if not kept:
            kept.append(Windows(*shared.value, window))
        for b in batches:
            for r in range(b.num_rows):
                part, block, doc_ids, hashes, n_words, terms, counts, deltas = (
                    b.column(i)[r].as_py() for i in range(8))
                keys = np.frombuffer(deltas, dtype="<u4").astype(np.int64)
                cuts = np.cumsum([0, *counts])
                lists = {t: np.cumsum(keys[lo:hi]) for t, lo, hi in zip(terms, cuts, cuts[1:])}
                sizes = np.array(n_words, dtype=np.int64)
                bases = np.concatenate(([0], np.cumsum(sizes + GAP)[:-1])).astype(np.int64)
                flags, exact, near = kept[0].search(lists, bases, int((sizes + GAP).sum()))
                turn = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
                ranges: dict[int, list] = {}
                for s, e in zip(turn[::2].tolist(), turn[1::2].tolist()):
                    d = int(np.searchsorted(bases, s, side="right")) - 1
                    ranges.setdefault(d, []).append({"start": s - int(bases[d]), "end": e - int(bases[d])})
                got, close = {}, {}
                for d, i in sorted(exact):
                    got.setdefault(d, []).append(i)
                for d, i in sorted(near - exact):
                    close.setdefault(d, []).append(i)
                n = len(doc_ids)
                pick = lambda m: [m.get(d, []) for d in range(n)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(range(n), pa.int32()),
                    pa.array(doc_ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(n_words, pa.int64()),
                    pa.array(pick(ranges), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array(pick(got), pa.list_(pa.int64())), pa.array(pick(close), pa.list_(pa.int64()))],
                    names=["part", "block", "ordinal", "doc_id", "text_hash", "n_words", "hits", "items", "near"])

    return index.mapInArrow(run, HITS)


def contamination(docs: DataFrame, benchmark: DataFrame, name: str = "decontaminate", window: int = WINDOW,
                  item_id: str = "item_id", item_text: str = "text", slice_words: int = SLICE_WORDS,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: (doc_id, text_hash, n_words, n_hit, n_items, items,
    near, contaminated)."""
    tests = benchmark.select(F.col(f"`{item_id}`").cast("bigint").alias("item_id"),
                             F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit("")).alias("text"))
    # every word takes at least two bytes with the gap after it
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-size // (2 * slice_words)))
    found = None
    for k in range(slices):
        part = tests.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == k)
        vocabulary: dict[bytes, int] = {}
        items = []
        for r in part.orderBy("item_id", "text").toLocalIterator():  # at most about slice_words words
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(r["text"].encode())]
            items.append((r["item_id"], ids))
        index = stored(build_index(docs, vocabulary, doc_id, text), f"{name}/index{k}")
        df = np.zeros(len(vocabulary), dtype=np.int64)
        for r in frequencies(index).toLocalIterator():  # a row per term of the slice
            df[r["term"]] = r["df"]
        got = search_index(index, items, df, window)
        found = got if found is None else found.unionByName(got)
    if slices > 1:
        found = (found.groupBy("part", "block", "ordinal", "doc_id", "text_hash", "n_words")
                 .agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("hits", "items", "near")]))
    found = found.withColumns({
        "hits": F.sort_array("hits"), "items": F.array_distinct("items"),
        "near": F.array_distinct(F.array_except("near", "items"))})
    covered = F.expr("aggregate(hits, named_struct('n', CAST(0 AS BIGINT), 'at', 0), (a, h) -> named_struct("
                     "'n', a.n + greatest(0, h.end - greatest(h.start, a.at)), 'at', greatest(a.at, h.end)), a -> a.n)")
    return (found.withColumn("n_hit", covered).withColumn("n_items", F.size("items").cast("long"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))
            .select("doc_id", "text_hash", "n_words", "n_hit", "n_items", "items", "near", "contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, name: str = "decontaminate", doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """``docs`` without its contaminated rows, all columns kept."""
    found = contamination(docs, benchmark, name, doc_id=doc_id, text=text)
    bad = for_join(stored(found.where("contaminated").select(
        F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct(), f"{name}/bad"))
    return docs.join(bad, docs[f"`{doc_id}`"].cast("bigint").eqNullSafe(bad["_bad_id"])
                     & (F.xxhash64(f"`{text}`") == bad["_bad_hash"]), "left_anti")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark's items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "op7")
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"),
                        "contaminated")


_SPLIT = r"list_filter(string_split_regex(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
         r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT.format(t="coalesce(text, '')")} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_SPLIT.format(t="coalesce(text, '')")} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
            FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
h AS (SELECT DISTINCT g.r, g.i, g.n, v.item_id FROM g JOIN v ON g.n = v.n AND g.g = v.g),
p AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM h) GROUP BY r),
q AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
      FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN q USING (r)
"""
