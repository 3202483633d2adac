"""Packing token sequences by cutting-stock column generation.

Documents longer than a sequence give full pieces; what remains of each is one
piece of 1..capacity ids.  The histogram of these exact lengths (at most
``capacity`` rows, whatever the input size) is all that reaches the driver:

1. Short pieces of one length are bundled, up to BUNDLE ids an item; items are
   rounded up to classes of ``quantum`` ids.
2. A linear program chooses how often to use each pattern (a multiset of classes
   that fits in a sequence).  It starts from first-fit-decreasing patterns, and a
   knapsack over smoothed dual prices adds columns until the program is within GAP
   of its bound; there is no other limit.
3. Rounded-down pattern counts are topped up by first-fit-decreasing patterns for
   the demand left over.
4. With exact lengths again, every pattern has a known free place.  The emptiest
   sequences are dissolved, and their pieces are cut into the free places of the
   others (those of at least MIN_FILL ids).

Every piece has a rank among those of its length (file part, then order in it);
length and rank alone decide its sequences, offsets and cuts, so no pieces are
shuffled by sequence.

Null text is an empty document (its end id alone).  Null and repeated
``doc_id`` values are separate documents.  Ties of length go by rank.  A very long
text is many full pieces.  An empty table gives no rows.  Only the named columns
are read, so further ones cannot clash.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlog.llm.common import encoder, for_join, ship, stored, table, tokenizer_json

CAPACITY = 4096
QUANTUM = 16
BUNDLE = 256
MIN_FILL = 16
GAP = 1e-2

PIECES = "part int, ordinal long, doc_id long, start long, length long, doc_tokens long, local_rank long, ids binary"
PACKED = ("part int, ordinal long, doc_id long, start long, length long, doc_tokens long, ids_crc32 long, "
          "sequence_id long, offset long")


# -- the linear program, on the histogram only ------------------------------

def best_pattern(prices: np.ndarray, slots: int) -> tuple[float, dict[int, int]]:
    """Unbounded knapsack: the most valuable multiset of classes (class k
    takes k of ``slots``; prices[k-1] each)."""
    # a class that is not dearer than a smaller one is never needed
    useful = np.flatnonzero(prices > np.maximum.accumulate(np.concatenate(([1e-12], prices[:-1])))) + 1
    if not len(useful):
        return 0.0, {}
    worth = prices[useful - 1]
    fits = np.searchsorted(useful, np.arange(slots + 1), side="right").tolist()
    value = np.zeros(slots + 1)
    take = [0] * (slots + 1)
    rest = slots - useful  # index of value, shifted with the room
    for room in range(int(useful[0]), slots + 1):
        k = fits[room]
        got = value[rest[:k] - (slots - room)]
        got += worth[:k]
        i = got.argmax()
        value[room], take[room] = got[i], i
    pattern: dict[int, int] = {}
    room = slots
    while room >= useful[0]:
        k = int(useful[take[room]])
        pattern[k] = pattern.get(k, 0) + 1
        room -= k
    return float(value[slots]), pattern


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination.  (A threaded library routine would fight the
    executors for the cores of a shared machine.)"""
    m = len(a)
    w = np.hstack((a, np.eye(m)))
    for k in range(m):
        p = k + int(np.abs(w[k:, k]).argmax())
        if p != k:
            w[[k, p]] = w[[p, k]]
        w[k] /= w[k, k]
        rows = np.flatnonzero(w[:, k])
        rows = rows[rows != k]
        w[rows] -= w[rows, k][:, None] * w[k]
    return w[:, m:]


def first_fit(left: dict[int, int], slots: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, times) pairs: largest classes first, each sequence filled with
    the largest that still fit, as often as the demand allows."""
    left = {k: n for k, n in left.items() if n > 0}
    out = []
    while left:
        pattern: dict[int, int] = {}
        room = slots
        for k in sorted(left, reverse=True):
            n = min(left[k], room // k)
            if n:
                pattern[k] = n
                room -= k * n
        times = min(left[k] // n for k, n in pattern.items())
        out.append((pattern, times))
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def column_generation(demand: dict[int, int], slots: int) -> list[tuple[dict[int, int], float]]:
    """(pattern, times) pairs of min sum(times) with every class's demand met,
    within GAP of the least possible sum: revised simplex, columns priced by
    ``best_pattern``.

    Prices are the middle between the current duals and the best feasible duals
    so far (which give the bound).  A column that does not pay at the current
    duals is followed by one priced at these alone."""
    classes = sorted(k for k, n in demand.items() if n > 0)
    if not classes:
        return []
    row = {k: i for i, k in enumerate(classes)}
    m = len(classes)
    # a slight perturbation, so that no two bases tie and the simplex cannot cycle
    d = np.array([demand[k] for k in classes], dtype=float) * (1 + 1e-7 * np.random.default_rng(1).random(m))
    basis = [{k: slots // k} for k in classes]
    inverse = np.diag([1.0 / (slots // k) for k in classes])
    x = inverse.diagonal() * d
    entered = 0

    def enter(pattern: dict[int, int]) -> None:
        nonlocal inverse, x, entered
        u = np.zeros(m)
        for k, n in pattern.items():
            u += inverse[:, row[k]] * n
        positive = np.flatnonzero(u > 1e-9)
        out = int(positive[np.argmin(x[positive] / u[positive])])
        t = x[out] / u[out]
        x = np.maximum(x - t * u, 0)
        x[out] = t
        pivot = inverse[out] / u[out]
        inverse -= np.outer(u, pivot)
        inverse[out] = pivot
        basis[out] = pattern
        entered += 1
        if entered % 400 == 0:  # rounding errors of the updates
            b = np.zeros((m, m))
            for j, p in enumerate(basis):
                for k, n in p.items():
                    b[row[k], j] = n
            inverse = _inverse(b)
            x = np.maximum((inverse * d).sum(axis=1), 0)

    def worth(pattern: dict[int, int], dual: np.ndarray) -> float:
        return sum(dual[row[k]] * n for k, n in pattern.items())

    for pattern, _ in first_fit(demand, slots):
        if worth(pattern, inverse.sum(axis=0)) > 1 + 1e-9:
            enter(pattern)
    at = np.array(classes) - 1
    bound = float((d * (at + 1)).sum() / slots)
    center = (at + 1) / slots  # feasible: no pattern holds more than the slots
    exact = False
    while x.sum() > (1 + GAP) * bound:
        dual = inverse.sum(axis=0)  # every column costs one sequence
        price = np.maximum(dual if exact else (dual + center) / 2, 0)
        prices = np.zeros(slots)
        prices[at] = price
        value, pattern = best_pattern(prices, slots)
        if price @ d / value > bound:
            bound, center = float(price @ d / value), price / value
        if worth(pattern, dual) > 1 + 1e-9:
            enter(pattern)
            exact = False
        elif exact:
            break  # optimal
        else:
            exact = True
    return [(p, float(t)) for p, t in zip(basis, x) if t > 1e-9]


def plan(demand: dict[int, int], slots: int) -> list[tuple[dict[int, int], int]]:
    """Integral (pattern, times) pairs that hold every piece exactly once."""
    left = {k: int(n) for k, n in demand.items() if n > 0}
    out: list[tuple[dict[int, int], int]] = []
    for pattern, times in sorted(column_generation(left, slots), key=lambda z: -z[1]):
        times = min([int(times + 1e-3), *(left[k] // n for k, n in pattern.items())])
        if times > 0:
            out.append((dict(pattern), times))
            for k, n in pattern.items():
                left[k] -= n * times
    return out + first_fit(left, slots)  # at most about one sequence per basis column


class Layout:
    """Where the pieces of a length histogram go, as runs of ranks.

    A run (length, first rank, per, sequence, offset, at) places its pieces
    ``per`` to a sequence, one after the other from ``offset`` on; with ``at``
    >= 0 they are instead cut: they follow each other in a stream from there on,
    which is laid over the free places (at, size, sequence, offset), each run of
    these being equal places of consecutive sequences.
    """

    def __init__(self, hist: dict[int, int], capacity: int = CAPACITY, quantum: int = QUANTUM):
        runs: list[tuple[int, int, int, int, int, int]] = []
        kinds: dict[int, list[tuple[int, int, int, int]]] = {}  # class: first item, length, per, first rank
        demand: dict[int, int] = {}
        loose = []  # length, first rank, pieces
        bundle = min(BUNDLE, capacity)
        for length in sorted(hist, reverse=True):
            per = max(1, bundle // length)
            items, rest = divmod(hist[length], per)
            if items:
                k = -(-length * per // quantum)
                kinds.setdefault(k, []).append((demand.get(k, 0), length, per, 0))
                demand[k] = demand.get(k, 0) + items
            if rest:
                loose.append((length, items * per, rest))
        # patterns over exact lengths: sequences, (length, per, first rank) of each slot
        segments: list[tuple[int, int, list[tuple[int, int, int]]]] = []
        taken = dict.fromkeys(demand, 0)
        for pattern, times in plan(demand, capacity // quantum):
            slots = []
            for k in sorted(pattern, reverse=True):
                slots += [(k, taken[k] + j * times) for j in range(pattern[k])]
                taken[k] += pattern[k] * times
            done = 0
            while done < times:
                step, own = times - done, []
                for k, first in slots:
                    item = first + done
                    j = bisect_right(kinds[k], item, key=lambda z: z[0]) - 1
                    start, length, per, rank = kinds[k][j]
                    end = kinds[k][j + 1][0] if j + 1 < len(kinds[k]) else demand[k]
                    step = min(step, end - item)
                    own.append((length, per, rank + (item - start) * per))
                segments.append((step, capacity - sum(length * per for length, per, _ in own), own))
                done += step
        segments.sort(key=lambda z: -z[1])
        free = sum(n * room for n, room, _ in segments if room >= MIN_FILL)
        cut = sum(length * n for length, _, n in loose)
        kept = []
        for n, room, own in segments:  # the emptiest first
            place = room if room >= MIN_FILL else 0
            gone = max(0, min(n, (free - cut) // (capacity - room + place)))
            free -= gone * place
            cut += gone * (capacity - room)
            loose += [(length, rank, gone * per) for length, per, rank in own if gone]
            if gone < n:
                kept.append((n - gone, room, [(length, per, rank + gone * per) for length, per, rank in own]))
        self.sequences = 0
        places: list[tuple[int, int, int, int]] = []
        at = 0
        for n, room, own in kept:
            offset = 0
            for length, per, rank in own:
                runs.append((length, rank, per, self.sequences, offset, -1))
                offset += length * per
            if room >= MIN_FILL:
                places.append((at, room, self.sequences, offset))
                at += n * room
            self.sequences += n
        if cut > at:
            places.append((at, capacity, self.sequences, 0))
            self.sequences += -(-(cut - at) // capacity)
        at = 0
        for length, rank, n in sorted(loose, key=lambda z: (-z[0], z[1])):
            runs.append((length, rank, 1, 0, 0, at))
            at += length * n
        runs.sort()
        self.runs = np.array(runs, dtype=np.int64).reshape(-1, 6)
        self.places = np.array(places, dtype=np.int64).reshape(-1, 4)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(piece, cut, size, sequence, offset) of every part of the pieces:
        the piece's number here, and where in it the part begins."""
        runs, places = self.runs, self.places
        j = np.searchsorted((runs[:, 0] << 45) + runs[:, 1], (length << 45) + rank, side="right") - 1
        d = rank - runs[j, 1]
        at = np.where(runs[j, 5] >= 0, runs[j, 5] + d * length, -1)
        whole = np.flatnonzero(at < 0)
        q, s = np.divmod(d[whole], runs[j[whole], 2])
        found = [(whole, np.zeros_like(whole), length[whole], runs[j[whole], 3] + q,
                  runs[j[whole], 4] + s * length[whole])]
        piece, lo = np.flatnonzero(at >= 0), at[at >= 0]
        end = lo + length[piece]
        while len(piece):  # one part of every piece a turn
            i = np.searchsorted(places[:, 0], lo, side="right") - 1
            e, inner = np.divmod(lo - places[i, 0], places[i, 1])
            size = np.minimum(end - lo, places[i, 1] - inner)
            found.append((piece, lo - at[piece], size, places[i, 2] + e, places[i, 3] + inner))
            lo = lo + size
            more = lo < end
            piece, lo, end = piece[more], lo[more], end[more]
        return tuple(np.concatenate(c) for c in zip(*found))


# -- Spark ------------------------------------------------------------------

def cut_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, capacity: int = CAPACITY,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every whole text with their rank among the pieces of the same
    length in the same file part."""
    spark = docs.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(tokenizer_json(tokenizer))
    tail = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc = encoder(spec.value)
        part = TaskContext.get().partitionId()
        ordinal = 0
        seen: dict[int, int] = {}
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                s = b.slice(lo, 1000)
                cols: list[list] = [[] for _ in range(7)]
                for did, ids in zip(s.column(0).to_pylist(), enc(s.column(1).cast(pa.binary()).to_pylist())):
                    ids += tail
                    n = len(ids) // 4
                    for at in range(0, n, capacity):
                        size = min(capacity, n - at)
                        rank = seen.get(size, 0)
                        seen[size] = rank + 1
                        for c, v in zip(cols, (ordinal, did, at, size, n, rank, ids[4 * at:4 * (at + size)])):
                            c.append(v)
                    ordinal += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(cols[0]), pa.int32()),
                     *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(),
                                                            pa.int64(), pa.int64(), pa.binary())))],
                    names=[c.split()[0] for c in PIECES.split(", ")])

    src = docs.selectExpr(f"CAST(`{doc_id}` AS BIGINT) AS doc_id", f"CAST(`{text}` AS STRING) AS text")
    return src.mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, quantum: int = QUANTUM, with_ids: bool = True) -> DataFrame:
    """Places stored pieces (``cut_documents``): rows of PACKED, one per piece
    after cutting, with their ``ids`` if asked for.

    ``pieces`` must be a stored table: it is read for the histogram and again
    for the assignment.
    """
    spark = pieces.sparkSession
    ship(spark)
    # ranks across parts: pieces of the length in earlier parts come first
    per_part = stored(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "pack/lengths")
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_part.select("length", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("earlier"))
    hist = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(Layout(hist, capacity, quantum))  # hist: at most ``capacity`` rows

    def run(batches):
        layout = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            part, ordinal, did, start, length, n, rank, ids = (b.column(i) for i in range(8))
            piece, cut, size, seq, offset = layout.place(length.to_numpy(), rank.to_numpy())
            raw = [memoryview(v) for v in ids.to_pylist()]
            own = [raw[i][4 * a:4 * (a + z)] for i, a, z in zip(piece.tolist(), cut.tolist(), size.tolist())]
            cols = [part.take(pa.array(piece)), ordinal.take(pa.array(piece)), did.take(pa.array(piece)),
                    pa.array(start.to_numpy()[piece] + cut), pa.array(size), n.take(pa.array(piece)),
                    pa.array([zlib.crc32(v) for v in own], pa.int64()), pa.array(seq), pa.array(offset)]
            if with_ids:
                cols.append(pa.array([bytes(v) for v in own], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = PACKED + (", ids binary" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    ranked = (pieces.join(for_join(before), ["length", "part"])
              .withColumn("rank", F.col("earlier") + F.col("local_rank"))
              .select("part", "ordinal", "doc_id", "start", "length", "doc_tokens", "rank", "ids"))
    return ranked.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the assembled sequences, unpadded."""
    return (packed.groupBy("sequence_id")
            .agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
            .select("sequence_id", F.expr("aggregate(p, X'', (a, e) -> a || e.ids)").alias("ids"),
                    F.col("p.doc_id").alias("doc_ids")))


def pack_documents(docs: DataFrame, name: str = "pack", with_ids: bool = True) -> DataFrame:
    return pack(stored(cut_documents(docs), f"{name}/pieces"), with_ids=with_ids)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset in it."""
    return digest(pack_documents(table(spark, sf_dir, "documents"), "op3", with_ids=False))
