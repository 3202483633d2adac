"""Token ids as static range asymmetric numeral systems (rANS).

File format (a folder below the shared checkpoint folder):

``freq/``    one Parquet row per token id that occurs: ``sym``, ``freq``; the
             frequencies sum to 2**SCALE and are shared by all blocks.
``blocks/``  one Parquet row per block, in ascending document order over
             (``part``, ``block``):

    part, block     file part and number of the block in it
    n_tokens        ids in the block
    lanes           interleaved coders; id t belongs to lane t mod lanes
    doc_ids, doc_tokens   documents of the block and their id counts
    checkpoints     per checkpoint the position in ``words`` (uint64) and all
                    lane states (uint64); number k stands before step
                    k * CHECK_STEPS, so decoding can begin at any of them
    words           32-bit renormalization words
    crc32           of the decoded ids as little-endian uint32

A block holds whole documents, at least BLOCK_TOKENS ids unless it is the last
of its part, and can be decoded without any other.  Lane states are 64 bits
in [2**31, 2**63), renormalized by 32-bit words.

Null text: an empty document (only its end id).  Null ``doc_id`` sorts first.
A very long text is one large block.  Repeated rows are separate documents.  An empty table gives an empty file and
no rows.  Only the two named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlog.llm.common import ship, shuffle_width, stored, token_rows

SCALE = 20
BLOCK_TOKENS = 1 << 18
LANES = 1024
CHECK_STEPS = 128
LOW = np.uint64(1 << 31)
SHIFT = np.uint64(SCALE)
MASK = np.uint64((1 << SCALE) - 1)
W32 = np.uint64(32)

BLOCK_SCHEMA = ("part int, block int, n_tokens long, lanes int, doc_ids array<bigint>, "
                "doc_tokens array<bigint>, checkpoints binary, words binary, crc32 long")


def normalized(syms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE, each at least 1."""
    total = 1 << SCALE
    if not len(counts):
        return np.zeros(0, dtype=np.int64)
    if len(counts) > total // 2:
        raise ValueError("alphabet too large for the scale")
    exact = counts / counts.sum() * (total - len(counts))
    freq = np.floor(exact).astype(np.int64) + 1
    spare = total - int(freq.sum())
    order = np.lexsort((syms, -(exact - np.floor(exact))))
    freq[order[:spare]] += 1
    return freq


class Coder:
    """Encoder and decoder of blocks under one frequency table."""

    def __init__(self, syms: np.ndarray, freq: np.ndarray):
        n = int(syms.max()) + 1 if len(syms) else 1
        self.freq = np.zeros(n, dtype=np.uint64)
        self.freq[syms] = freq.astype(np.uint64)
        self.cum = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self._slots = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            kind = np.uint16 if len(self.freq) <= 1 << 16 else np.uint32
            self._slots = np.repeat(np.arange(len(self.freq), dtype=kind), self.freq.astype(np.int64))
        return self._slots

    def encode(self, ids: np.ndarray, lanes: int = LANES) -> tuple[int, bytes, bytes]:
        """(lanes, checkpoints, words) of one block."""
        lanes = int(max(1, min(lanes, len(ids) // 32)))
        steps = -(-len(ids) // lanes)
        f_all, c_all = self.freq[ids], self.cum[ids]
        x = np.full(lanes, LOW, dtype=np.uint64)
        out: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        sent = 0
        for s in range(steps - 1, -1, -1):
            f, c = f_all[s * lanes:(s + 1) * lanes], c_all[s * lanes:(s + 1) * lanes]
            y = x[:len(f)]
            over = np.flatnonzero(y >= (f << np.uint64(63 - SCALE)))
            if len(over):
                out.append((y[over] & np.uint64(0xFFFFFFFF)).astype("<u4")[::-1])
                sent += len(over)
                y[over] >>= W32
            q = y // f
            y[:] = (q << SHIFT) + (y - q * f) + c
            if s % CHECK_STEPS == 0:
                marks.append((sent, x.copy()))
        words = np.concatenate(out)[::-1] if out else np.zeros(0, dtype="<u4")
        check = b"".join(np.uint64(sent - at).astype("<u8").tobytes() + st.astype("<u8").tobytes()
                         for at, st in reversed(marks))
        return lanes, check, words.tobytes()

    def decode(self, n: int, lanes: int, checkpoints: bytes, words: bytes,
               lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids lo..hi of a block of n, beginning at the checkpoint before lo."""
        hi = n if hi is None else hi
        if n == 0 or hi <= lo:
            return np.zeros(0, dtype="<u4")
        first = lo // lanes // CHECK_STEPS
        size = 8 * (lanes + 1)
        mark = np.frombuffer(checkpoints, dtype="<u8", count=lanes + 1, offset=first * size)
        at, x = int(mark[0]), mark[1:].astype(np.uint64)
        w = np.frombuffer(words, dtype="<u4").astype(np.uint64)
        start = first * CHECK_STEPS
        end = -(-hi // lanes)
        out = np.empty((end - start) * lanes, dtype="<u4")
        for s in range(start, end):
            m = min(lanes, n - s * lanes)
            y = x[:m]
            slot = y & MASK
            sym = self.slots[slot.astype(np.int64)]
            out[(s - start) * lanes:(s - start) * lanes + m] = sym
            y[:] = self.freq[sym] * (y >> SHIFT) + slot - self.cum[sym]
            low = np.flatnonzero(y < LOW)
            if len(low):
                y[low] = (y[low] << W32) | w[at:at + len(low)]
                at += len(low)
        return out[lo - start * lanes:hi - start * lanes]


def histogram(tokens: DataFrame) -> DataFrame:
    """(sym, n): how often each id occurs in all rows of a ``token_rows`` table,
    from the tasks' counts.  Every task sends at most one row per id of the
    vocabulary."""

    def run(batches):
        total = np.zeros(0, dtype=np.int64)
        for b in batches:
            for v in b.column(0).to_pylist():
                c = np.frombuffer(v, dtype="<i8").copy()
                if len(c) < len(total):
                    c, total = total, c
                c[:len(total)] += total
                total = c
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())],
                                         names=["sym", "n"])

    return (tokens.where(F.col("counts").isNotNull()).select("counts").mapInArrow(run, "sym long, n long")
            .groupBy("sym").agg(F.sum("n").alias("n")))


def _block_rows(coder: Coder, part: int, block: int, docs: list[tuple], width: int):
    ids = np.frombuffer(b"".join([d[1] for d in docs]), dtype=f"<u{width}").astype("<u4")
    lanes, check, words = coder.encode(ids)
    return pa.RecordBatch.from_arrays([
        pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()),
        pa.array([lanes], pa.int32()), pa.array([[d[0] for d in docs]], pa.list_(pa.int64())),
        pa.array([[len(d[1]) // width for d in docs]], pa.list_(pa.int64())), pa.array([check], pa.binary()),
        pa.array([words], pa.binary()), pa.array([zlib.crc32(ids)], pa.int64())],
        names=["part", "block", "n_tokens", "lanes", "doc_ids", "doc_tokens", "checkpoints", "words", "crc32"])


def encode_corpus(tokens: DataFrame, name: str = "rans", width: int = 4) -> tuple[DataFrame, DataFrame]:
    """Writes a stored ``token_rows`` table (ids of ``width`` bytes) in ascending
    doc_id order, rows of one doc_id by ``row``, in the format above; returns the
    frequency table and the blocks, both read back from the files.  The ranges
    are cut by both, so rows that share an id (or have none) are several tasks'."""
    ship(tokens.sparkSession)
    counts = histogram(tokens).orderBy("sym").toPandas()  # one row per vocabulary id at most
    syms, n = counts["sym"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    freq = normalized(syms, n)
    spark = tokens.sparkSession
    freq_table = stored(spark.createDataFrame(list(zip(syms.tolist(), freq.tolist())), "sym long, freq long")
                        .coalesce(1), f"{name}/freq")
    shared = spark.sparkContext.broadcast((syms, freq))

    def run(batches):
        coder = Coder(*shared.value)
        part = TaskContext.get().partitionId()
        docs, held, block = [], 0, 0
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                docs.append((doc_id, ids))
                held += len(ids) // width
                if held >= BLOCK_TOKENS:
                    yield _block_rows(coder, part, block, docs, width)
                    docs, held, block = [], 0, block + 1
        if docs:
            yield _block_rows(coder, part, block, docs, width)

    ordered = (tokens.where(F.col("counts").isNull()).select("doc_id", "ids", "row")
               .repartitionByRange(shuffle_width(tokens), F.col("doc_id").asc_nulls_first(), "row")
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row").select("doc_id", "ids"))
    blocks = stored(ordered.mapInArrow(run, BLOCK_SCHEMA), f"{name}/blocks", "uncompressed")
    return freq_table, blocks


def decode_corpus(freq_table: DataFrame, blocks: DataFrame, with_ids: bool = True) -> DataFrame:
    """(part, block, ordinal, doc_id, before, n_tokens, ids_crc32, ids) of every
    document, decoded from the files (``before``: the block's ids before it;
    ``ids`` only if asked for); raises if a block's checksum does not hold.
    Blocks are decoded independently, wherever they were read."""
    ship(blocks.sparkSession)
    table = freq_table.orderBy("sym").toPandas()  # one row per vocabulary id at most
    shared = blocks.sparkSession.sparkContext.broadcast(
        (table["sym"].to_numpy(np.int64), table["freq"].to_numpy(np.int64)))

    def run(batches):
        coder = Coder(*shared.value)
        for b in batches:
            cols = [b.column(i) for i in range(b.num_columns)]
            for r in range(b.num_rows):
                part, block, n, lanes, doc_ids, sizes, check, words, crc = (c[r].as_py() for c in cols)
                ids = coder.decode(n, lanes, check, words)
                if zlib.crc32(ids) != crc:
                    raise ValueError(f"checksum of block {part}/{block} does not hold")
                ends = np.cumsum(sizes)
                own = [ids[e - k:e] for e, k in zip(ends.tolist(), sizes)]
                made = [pa.array([part] * len(sizes), pa.int32()), pa.array([block] * len(sizes), pa.int32()),
                        pa.array(range(len(sizes)), pa.int32()), pa.array(doc_ids, pa.int64()),
                        pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()),
                        pa.array([zlib.crc32(x) for x in own], pa.int64())]
                if with_ids:
                    made.append(pa.array([x.tobytes() for x in own], pa.binary()))
                yield pa.RecordBatch.from_arrays(made, names=names)

    schema = "part int, block int, ordinal int, doc_id long, before long, n_tokens long, ids_crc32 long"
    schema += ", ids binary" if with_ids else ""
    names = [c.split()[0] for c in schema.split(", ")]
    return blocks.select(*[c.split()[0] for c in BLOCK_SCHEMA.split(", ")]).mapInArrow(run, schema)


def op1_token_ids(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    from fleetlog.llm.common import table
    tokens = stored(token_rows(table(spark, sf_dir, "documents"), end_id=1, width=2), "op1/tokens")
    freq_table, blocks = encode_corpus(tokens, "op1", width=2)
    # ids before each block: one narrow row per block
    index = blocks.select("part", "block", "n_tokens")
    per_part = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, at = {}, 0
    for r in per_part:  # one row per file part
        before[r["part"]] = at
        at += r["n"]
    starts = spark.createDataFrame([(k, v) for k, v in before.items()], "part int, part_start long")
    from pyspark.sql import Window
    w = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    block_start = (index.join(starts, "part")
                   .select("part", "block", (F.col("part_start") + F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
                           .alias("block_start")))
    docs = decode_corpus(freq_table, blocks, with_ids=False)
    return (docs.join(block_start, ["part", "block"])
            .select("doc_id", (F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"))
