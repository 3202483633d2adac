"""Helpers shared by the operators: tables, and word-level tokenizing with a
bounded cache."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlog.session import discard, scratch_path, ship, stored  # noqa: F401  (the operators take both from here)

TOKENIZER_FILE = "word_bpe_49k.json"
CACHE_WORDS = 1_000_000
LONG_WORD = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``stored`` with the table's path, for ``discard``."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def shuffle_width(df: DataFrame) -> int:
    """Partitions for a shuffle that carries texts or ids: as many as the input
    has splits, so that none grows with the input, and at least the session's."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


BROADCAST_ROWS = 500_000


def for_join(keys: DataFrame, rows: str = "1") -> DataFrame:
    """A stored table of narrow rows as one side of a join with texts: broadcast
    when it counts at most BROADCAST_ROWS (``rows``: what to sum), so that the
    texts stay where they are; otherwise left to a shuffle join."""
    n = keys.agg(F.expr(f"sum({rows})")).first()[0] or 0
    return F.broadcast(keys) if n <= BROADCAST_ROWS else keys


def tokenizer_json(path: str | None = None) -> str:
    """Text of the tokenizer file.  It is read on the driver and travels with
    the task (a vocabulary file has a fixed size), so workers need no path."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(TOKENIZER_FILE)
    with open(path, encoding="utf-8") as f:
        return f.read()


class WordEncoder:
    """Token ids of whole texts, looked up word by word.

    The tokenizer never joins characters across ASCII white space, so the ids
    of a text are those of its white-space-separated chunks one after the
    other.  Chunks are kept in a dictionary that is emptied when it holds
    ``CACHE_WORDS`` entries.  Text is lower-cased first, as the tokenizer
    does (but not where ``<|`` could begin a special token), and a chunk of
    letters followed by ASCII punctuation is looked up as these two
    parts, which are separate pre-tokens.  Everything else goes to the
    tokenizer unchanged.
    """

    def __init__(self, json_text: str, width: int = 4):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self._tok = Tokenizer.from_str(json_text)
        self._bpe = self._tok.model
        self._cache: dict[bytes, bytes] = {}
        self.width = width
        n = max(self._tok.get_vocab().values()) + 1
        if n > 1 << 8 * width:
            raise ValueError(f"ids up to {n - 1} need more than {width} bytes")
        self._id = [i.to_bytes(width, "little") for i in range(n)]

    def _raw(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of any chunks, by the whole tokenizer."""
        enc = self._tok.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)
        return [b"".join([self._id[i] for i in e.ids]) for e in enc]

    def _word(self, word: str) -> bytes:
        """Ids of one word of Latin letters.  It is one pre-token and normalized
        once in lower case, so only its bytes go to the merges."""
        if not word.isascii():
            word = word.lower().encode().decode("latin-1").translate(_BYTE_CHARS)
        ids = self._id
        return b"".join([ids[t.id] for t in self._bpe.tokenize(word)])

    def _learn(self, words) -> dict[bytes, bytes]:
        """Adds the words to the cache; returns those too long for it."""
        cache = self._cache
        other: list[bytes] = []
        parts: list[tuple[bytes, bytes, bytes]] = []
        for w in words:
            if w.isalpha() and w.islower() and len(w) <= LONG_WORD:
                cache[w] = self._word(w.decode())
                continue
            m = _WORD_AND_MARKS.fullmatch(w)
            t = m[1].decode(errors="replace") if m else ""
            if _LATIN.fullmatch(t) is None:
                other.append(w)
                continue
            word, marks = m.groups()
            if word not in cache:
                cache[word] = self._word(t)
            if marks:
                if marks not in cache:
                    cache[marks] = self._raw([marks])[0]
                parts.append((w, word, marks))
        if other:
            cache.update(zip(other, self._raw(other)))
        for w, word, marks in parts:
            cache[w] = cache[word] + cache[marks]
        return {w: cache.pop(w) for w in words if len(w) > LONG_WORD}

    def __call__(self, texts) -> list[bytes]:
        """Ids of each text (UTF-8 bytes or None) as little-endian unsigned
        integers of ``width`` bytes; a null text has none."""
        out = []
        cache = self._cache
        for text in texts:
            if not text:
                out.append(b"")
                continue
            words = (text if b"<|" in text else text.lower()).split()  # ASCII white space only
            new = set(words).difference(cache)
            long = {}
            if new:
                if len(cache) + 2 * len(new) > CACHE_WORDS:
                    cache.clear()
                    new = set(words)
                long = self._learn(new)
            if long:
                out.append(b"".join([cache[w] if w in cache else long[w] for w in words]))
            else:
                out.append(b"".join(map(cache.__getitem__, words)))
        return out


_WORD_AND_MARKS = re.compile(rb"([a-z\x80-\xff]+)([!-&(-/:;=?@\[-`{}~]{0,64})")
_LATIN = re.compile("[a-zÀ-ÖØ-öø-ÿ]{1,%d}" % LONG_WORD)


def byte_chars() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable Latin-1 characters as
    themselves, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 0x100 + k for k, b in enumerate(rest)}


_BYTE_CHARS = byte_chars()

_ENCODERS: dict[tuple[int, int], WordEncoder] = {}


def encoder(json_text: str, width: int = 4) -> WordEncoder:
    """One encoder per worker process, kept between its tasks."""
    key = (hash(json_text), width)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(json_text, width)
    return _ENCODERS[key]


def token_rows(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1,
               doc_id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, row, ids, counts): the ids of every whole text and ``end_id``
    after them, little-endian unsigned integers of ``width`` bytes (2 holds the
    ids of a vocabulary up to 65,536) in one binary value.  A null text is an
    empty one; every input row gives one row, numbered by ``row`` (task, then
    order in it).  One further row of each task, of null ``ids``, holds in ``counts``
    how often each id occurs in the task's rows (64-bit integers)."""
    spark = docs.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(tokenizer_json(tokenizer))
    tail = end_id.to_bytes(width, "little")

    def run(batches):
        enc = encoder(spec.value, width)
        row = TaskContext.get().partitionId() << 40
        total = np.zeros(1 << 8 * min(width, 2), dtype=np.int64)
        some = False
        for b in batches:
            n = b.num_rows
            for lo in range(0, n, 1000):
                part = b.slice(lo, 1000)
                ids = [x + tail for x in enc(part.column(1).cast(pa.binary()).to_pylist())]
                own = np.bincount(np.frombuffer(b"".join(ids), dtype=f"<u{width}"), minlength=len(total))
                own[:len(total)] += total
                total, some = own, True
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.arange(row, row + len(ids))), pa.array(ids, type=pa.binary()),
                     pa.nulls(len(ids), pa.binary())], names=["doc_id", "row", "ids", "counts"])
                row += len(ids)
        if some:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                 pa.array([total.astype("<i8").tobytes()])], names=["doc_id", "row", "ids", "counts"])

    src = docs.selectExpr(f"CAST(`{doc_id}` AS BIGINT) AS doc_id", f"CAST(`{text}` AS STRING) AS text")
    return src.mapInArrow(run, "doc_id bigint, row bigint, ids binary, counts binary")
