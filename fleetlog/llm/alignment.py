"""Alignment of two tokenizers by their spans.

A byte-level vocabulary (A) and a sentencepiece model (B) encode the same text
with one space before it.  Both report spans: A by characters, B by bytes.  The
ends of the spans are coarse cuts; where a token is a part of a character only
(a multibyte character over several byte-level tokens, a byte-fallback piece)
or its span disagrees with its own bytes, its end comes from the decoded bytes.
Byte offsets where tokens of both sides end cut them into groups; a link is a
pair of occurrences whose byte ranges overlap.

Work is done word by word: neither tokenizer joins a character that is not
white space with a space after it (checked against B's vocabulary; A splits
there by its pattern), so tokens of both sides end before every single space
between two such characters, and the alignment of a text is that of its words,
one after the other.  Words are kept in two dictionaries: when the younger one
is full it takes the place of the older, and words that are met again move back.
Both tokens also end between a run of Latin letters and ASCII punctuation up to the
word's end, and before a line break after a character that is not white space
(both are checked against the two vocabularies), so only the letters, the marks
and the parts of lines are aligned, and their words are put together from them.

Corpus counts (how many documents hold an id pair linked) are added up per
task, then by Spark.  The most frequent pairs, at most ``BROADCAST_PAIRS``, go
to the tasks of the second pass; links of all other pairs are joined with their
counts by a shuffle, on a key that has no more than a small share of the rows.

A null or empty text, and one whose tokens do not give its bytes back (a
literal U+2581), has no tokens: zeros and an empty ``groups``.  Repeated rows
are separate documents, each counts; a null ``doc_id`` stays null.  Very long
texts are cut into words like any other.  An empty table gives no rows.  Only
the two named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import gc
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlog.llm.common import byte_chars, ship, stored, table

BYTE_FILE = "byte_bpe_50k.json"
PIECE_FILE = "piece_bpe_32k.model"
CACHE_WORDS = 300_000
SLICE = 500  # documents whose new words are learned together
BATCH_WORDS = 512  # new words aligned in one go
LONG_WORD = 256
BROADCAST_PAIRS = 1_000_000
FLUSH_PAIRS = 500_000
SHIFT = 32  # a pair's key: A's id above, B's id below

_CUT = re.compile(r" (?<=\S )(?=\S)")  # begins with a plain character, which is searched fast
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
_ENDS_IN_LETTER = re.compile(f"(?s).*{_LETTER}")
_MIXED = re.compile(f"{_LETTER}[{re.escape(_MARKS)}]")
_LINES = re.compile(r"(.*\S)(\n.*\S)", re.S)

PAIR_ROWS = ("kind int, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
             "groups string, pairs binary, times binary, pair long, n long")
DOC_COLUMNS = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]


def read_files(byte_path: str | None = None, piece_path: str | None = None) -> tuple[str, bytes]:
    """Both vocabulary files, read on the driver; they travel with the task."""
    import public_tokenizers
    with open(byte_path or public_tokenizers.path(BYTE_FILE), encoding="utf-8") as f:
        a = f.read()
    with open(piece_path or public_tokenizers.path(PIECE_FILE), "rb") as f:
        return a, f.read()


class Aligner:
    """Alignment of texts, word by word."""

    def __init__(self, byte_json: str, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(byte_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        to_byte = {chr(c): b for b, c in byte_chars().items()}
        self.a_bytes = {}
        for entry, i in self.a.get_vocab().items():
            self.a_bytes[i] = (bytes([to_byte[c] for c in entry]) if all(c in to_byte for c in entry)
                               else entry.encode())
        self.b_bytes = []
        inner = marked = False  # does a piece hold a space after another character, or a mark after a letter?
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                inner |= "▁" in piece.lstrip("▁")
                if not (self.b.is_control(i) or self.b.is_unknown(i)):
                    marked |= "\n" in piece or _MIXED.search(piece) is not None
                self.b_bytes.append(piece.replace("▁", " ").encode())
        self.a_size = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        self.by_word = not inner
        split = [t for t, _ in self.a.pre_tokenizer.pre_tokenize_str("abé.,'\nc")] if self.a.pre_tokenizer else []
        self.by_part = (self.by_word and not marked and split == ["abÃ©", ".,'", "Ċ", "c"] and self.a.normalizer is None
                        and all(t.special for t in self.a.get_added_tokens_decoder().values()))
        # every id as text, by what follows it
        self.a_text = [np.array([f"{i}{end}" for i in range(len(self.a_size))], dtype=object) for end in ",|"]
        self.b_text = [np.array([f"{i}{end}" for i in range(len(self.b_size))], dtype=object) for end in ",;\n"]
        self.cache: dict[str, tuple | bool] = {}
        self.old: dict[str, tuple | bool] = {}

    def words(self, text: str) -> list[str]:
        """The text with a space before it, cut before every single space
        between two characters that are not white space; each without its first
        space."""
        if not self.by_word:
            return [text]
        return _CUT.split(text)

    def ends_a(self, text: str, coded) -> tuple[np.ndarray, np.ndarray]:
        """Ids and byte ends of A's tokens: span ends, refined by their bytes."""
        ids = np.array(coded.ids, dtype=np.int64)
        ends = np.array([e for _, e in coded.offsets], dtype=np.int64)
        if not text.isascii():  # characters to bytes
            c = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
            at = np.concatenate(([0], np.cumsum(1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))))
            ends = at[ends]
        return ids, refined(ends, self.a_size[ids])

    def ends_b(self, coded) -> tuple[np.ndarray, np.ndarray]:
        """Ids and byte ends of B's pieces; spans do not count the added space."""
        ids = np.array(coded["ids"], dtype=np.int64)
        ends = np.array([e for _, e in coded["offsets"]], dtype=np.int64)
        return ids, refined(ends + 1, self.b_size[ids])

    def align(self, words: list[str]) -> list:
        """(n_a, n_b, n_groups, groups, pairs) of each word, False where either
        side does not give the bytes back.  The words must be cuts of ``words``;
        both tokenizers see them joined by spaces."""
        joined = " ".join(words)
        text = " " + joined
        raw = text.encode()
        a, a_end = self.ends_a(text, self.a.encode(text, add_special_tokens=False))
        b, b_end = self.ends_b(self.b.encode(joined, return_type="offset_mapping", return_bytes=True))
        la, lb = a.tolist(), b.tolist()
        if b"".join([self.a_bytes[i] for i in la]) != raw or b"".join([self.b_bytes[i] for i in lb]) != raw:
            return [False] if len(words) == 1 else [self.align([w])[0] for w in words]
        common = a_end[b_end[np.minimum(np.searchsorted(b_end, a_end), len(b_end) - 1)] == a_end]
        stops = np.cumsum([len(w.encode()) + 1 for w in words])
        of_word = np.searchsorted(common, stops, "right")
        # A's ids of a group, then B's; a line for every word
        ia, ib = np.searchsorted(a_end, common, "right"), np.searchsorted(b_end, common, "right")
        text_a, text_b = self.a_text[0][a], self.b_text[0][b]
        text_a[ia - 1] = self.a_text[1][a[ia - 1]]
        text_b[ib - 1] = self.b_text[1][b[ib - 1]]
        last = ib[of_word - 1] - 1
        text_b[last] = self.b_text[2][b[last]]
        group_a, group_b = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        both = np.empty(len(a) + len(b), dtype=object)
        both[np.arange(len(a)) + np.concatenate(([0], ib))[group_a]] = text_a
        both[np.arange(len(b)) + ia[group_b]] = text_b
        groups = "".join(both.tolist()).split("\n")
        # every piece between neighbouring ends lies in one token of each side
        ends = np.sort(np.concatenate((a_end, b_end)), kind="stable")
        ends = ends[np.diff(ends, prepend=-1) > 0]
        pairs = (a[np.searchsorted(a_end, ends)] << SHIFT) | b[np.searchsorted(b_end, ends)]
        counts = [np.diff(x, prepend=0).tolist() for x in (ia[of_word - 1], ib[of_word - 1], of_word)]
        raw_pairs = pairs.astype(np.int64).tobytes()
        to = (8 * np.searchsorted(ends, stops, "right")).tolist()
        return list(zip(*counts, groups, [raw_pairs[x:y] for x, y in zip([0, *to], to)]))

    def parts(self, words: set[str]) -> dict[str, tuple[str, str]]:
        """(head, ``a`` + tail) of each word that is cut at its last marks or line,
        and of such heads themselves: a tail is aligned after a letter, not after
        a space."""
        cuts: dict[str, tuple[str, str]] = {}
        heads = words if self.by_part else set()
        while heads:
            found = {}
            for w in heads:
                if len(w) > LONG_WORD or not w or w[0].isspace():
                    continue
                if w[-1] in _MARKS:
                    head = w.rstrip(_MARKS)
                    if head != "a" and _ENDS_IN_LETTER.fullmatch(head):
                        found[w] = head, "a" + w[len(head):]
                elif "\n" in w:
                    m = _LINES.fullmatch(w)
                    if m and m[1] != "a":
                        found[w] = m[1], "a" + m[2]
            cuts |= found
            heads = {head for head, _ in found.values() if head not in cuts}
        return cuts

    def learn(self, words: list[str], to: dict) -> None:
        """Aligns words; those without white space at an end together."""
        plain = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()] if self.by_word else []
        for lo in range(0, len(plain), BATCH_WORDS):
            part = plain[lo:lo + BATCH_WORDS]
            to.update(zip(part, self.align(part)))
        for w in words:
            if w not in to:
                to[w] = self.align([w])[0]

    def recall(self, words: set[str]) -> None:
        """Afterwards all the words are in the younger dictionary."""
        new = words - self.cache.keys()
        if len(self.cache) + len(new) > CACHE_WORDS // 2:
            self.old, self.cache, new = self.cache, {}, words
        found = {w: self.old[w] for w in new if w in self.old}
        self.cache.update(found)
        self.learn([w for w in new if w not in found], self.cache)

    def aligned_words(self, words: set[str]) -> dict[str, tuple | bool]:
        """The alignment of every word.  Only parts are kept in the dictionaries."""
        cuts = self.parts(words - self.cache.keys())
        whole = words.union(*cuts.values(), "a" if cuts else "").difference(cuts)
        long = [w for w in whole if len(w) > LONG_WORD]
        whole.difference_update(long)
        self.recall(whole)
        now = dict(zip(whole, map(self.cache.__getitem__, whole)))
        self.learn(long, now)
        for w in sorted(cuts, key=len):  # a head is shorter than its word, a tail is not cut again
            head, tail = cuts[w]
            now[w] = joined(now[head], now[tail], now["a"])
        return now

    def prepare(self, texts: list[list[str] | None]) -> dict[str, tuple | bool] | None:
        """The alignments of the words of several cut texts, learned at once; none
        where they have too many words."""
        words = set().union(*filter(None, texts))
        return self.aligned_words(words) if len(words) <= CACHE_WORDS // 2 else None

    def __call__(self, text: str | None) -> tuple | None:
        """(n_a, n_b, n_groups, groups, pairs as int64) of a text."""
        return self.of_words(self.words(text)) if text else None

    def of_words(self, words: list[str], known: dict[str, tuple | bool] | None = None) -> tuple | None:
        if known is None:
            known = self.aligned_words(set(words))
        found = list(map(known.__getitem__, words))
        if not all(found):
            return None
        n_a, n_b, n_groups, groups, pairs = zip(*found)
        return sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), np.frombuffer(b"".join(pairs), dtype=np.int64)


def joined(head, tail, before):
    """Alignment of a word from its head's and that of its tail after ``before``."""
    if head is False or tail is False:
        return False
    return (head[0] + tail[0] - before[0], head[1] + tail[1] - before[1], head[2] + tail[2] - before[2],
            head[3] + tail[3][len(before[3]):], head[4] + tail[4][len(before[4]):])


def refined(ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Span ends, replaced by the ends of the decoded bytes where a span does
    not hold exactly its token's bytes."""
    exact = np.cumsum(sizes)
    if len(ends) != len(exact):
        return exact
    rough = ends != exact
    ends[rough] = exact[rough]
    return ends


_ALIGNERS: dict[int, Aligner] = {}


def _aligner(files) -> Aligner:
    """One per worker process, kept between its tasks."""
    key = hash(files)
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(*files)
    return _ALIGNERS[key]


def aligned(docs: DataFrame, name: str = "alignment", byte_path: str | None = None, piece_path: str | None = None,
            doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A stored table: a row per document (kind 0; ``pairs`` and ``times`` are its
    different id pairs and how often it holds them) and rows (kind 1) that say
    in how many documents of a task a pair is linked."""
    spark = docs.sparkSession
    ship(spark)
    files = spark.sparkContext.broadcast(read_files(byte_path, piece_path))

    def run(batches):
        gc.disable()  # nothing here makes cycles, and every collection walks the dictionaries
        try:
            yield from align(batches)
        finally:
            gc.enable()

    def align(batches):
        one = _aligner(files.value)
        row = TaskContext.get().partitionId() << 33
        held: list[np.ndarray] = []
        total = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        size = 0
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                s = b.slice(lo, SLICE)
                out: list[list] = [[] for _ in range(7)]
                texts = [one.words(t) if t else None for t in s.column(1).to_pylist()]
                known = one.prepare(texts)
                for t in texts:
                    got = one.of_words(t, known) if t else None
                    if got is None:
                        values = (0, 0, 0, 0, None, b"", b"")
                    else:
                        n_a, n_b, n_groups, groups, pairs = got
                        pair, times = np.unique(pairs, return_counts=True)
                        held.append(pair)
                        size += len(pair)
                        values = (n_a, n_b, n_groups, len(pairs), groups, packed(pair), times.astype("<u4").tobytes())
                    for c, v in zip(out, values):
                        c.append(v)
                n = len(out[0])
                yield _batch(0, row=pa.array(range(row, row + n), pa.int64()), doc_id=s.column(0),
                             n_a=out[0], n_b=out[1], n_groups=out[2], n_links=out[3], groups=out[4],
                             pairs=pa.array(out[5], pa.binary()), times=pa.array(out[6], pa.binary()))
                row += n
                if size > FLUSH_PAIRS:
                    total = _added(total, held)
                    held, size = [], len(total[0])
                    if size > FLUSH_PAIRS // 2:
                        yield _batch(1, pair=total[0], n=total[1])
                        total, size = (total[0][:0], total[1][:0]), 0
        total = _added(total, held)
        yield _batch(1, pair=total[0], n=total[1])

    src = docs.selectExpr(f"CAST(`{doc_id}` AS BIGINT) AS doc_id", f"CAST(`{text}` AS STRING) AS text")
    return stored(src.mapInArrow(run, PAIR_ROWS), f"{name}/aligned")


def packed(pair: np.ndarray) -> bytes:
    """All A ids, then all B ids: in ascending order of pairs they compress well."""
    return np.concatenate((pair >> SHIFT, pair & 0xFFFFFFFF)).astype("<u4").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    a, b = np.frombuffer(raw, dtype="<u4").reshape(2, -1).astype(np.int64)
    return (a << SHIFT) | b


def _added(total, held):
    keys, which = np.unique(np.concatenate([total[0], *held]), return_inverse=True)
    n = np.zeros(len(keys), dtype=np.int64)
    np.add.at(n, which[:len(total[0])], total[1])
    n += np.bincount(which[len(total[0]):], minlength=len(keys))
    return keys, n


_TYPES = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}


def _batch(kind: int, **columns):
    n = len(next(iter(columns.values())))
    names, arrays = [], []
    for c in PAIR_ROWS.split(", "):
        k, t = c.split()
        names.append(k)
        v = [kind] * n if k == "kind" else columns.get(k, [None] * n)
        arrays.append(v if isinstance(v, pa.Array) else pa.array(v, _TYPES[t]))
    return pa.RecordBatch.from_arrays(arrays, names=names)


def pair_counts(rows: DataFrame, name: str = "alignment") -> DataFrame:
    """(pair, n, best): documents that hold the pair linked, and whether no
    other pair of the same A id is held by more."""
    counts = stored(rows.where("kind = 1").groupBy("pair").agg(F.sum("n").alias("n")), f"{name}/counts")
    most = counts.groupBy(F.shiftright("pair", SHIFT).alias("a")).agg(F.max("n").alias("most"))  # a row per id of A
    return (counts.withColumn("a", F.shiftright("pair", SHIFT)).join(F.broadcast(most), "a")
            .select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def with_counts(rows: DataFrame, counts: DataFrame, most: int = BROADCAST_PAIRS, name: str = "alignment") -> DataFrame:
    """Documents of ``aligned`` with n_best and count_sum.  ``counts`` must be a
    stored table."""
    spark = rows.sparkSession
    total = counts.count()
    frequent = counts if total <= most else counts.orderBy(F.desc("n"), "pair").limit(most)
    top = frequent.toPandas().sort_values("pair")  # at most ``most`` rows
    shared = spark.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("pair", "n", "best")))

    def run(batches):
        _ALIGNERS.clear()  # the first pass is over: its words go from this process
        keys, n, best = shared.value
        for b in (whole.slice(lo, 500) for whole in batches for lo in range(0, whole.num_rows, 500)):
            sums, bests, rest = [], [], []
            for pair, times in zip(b.column(len(DOC_COLUMNS)), b.column(len(DOC_COLUMNS) + 1)):
                p, t = unpacked(pair.as_py()), np.frombuffer(times.as_py(), dtype="<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(keys, p), max(len(keys) - 1, 0))
                known = keys[at] == p if len(keys) else np.zeros(len(p), dtype=bool)
                sums.append(int((n[at[known]] * t[known]).sum()))
                bests.append(int(t[known][best[at[known]]].sum()))
                rest.append([{"pair": x, "times": y} for x, y in zip(p[~known].tolist(), t[~known].tolist())])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(DOC_COLUMNS)], pa.array(bests, pa.int64()), pa.array(sums, pa.int64()),
                 pa.array(rest, pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())])))],
                names=[*DOC_COLUMNS, "n_best", "count_sum", "rest"])

    docs = rows.where("kind = 0").select(*DOC_COLUMNS, "pairs", "times")
    schema = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
              "n_best long, count_sum long, rest array<struct<pair:bigint,times:bigint>>")
    done = docs.mapInArrow(run, schema)
    if total <= most:
        return done.drop("rest")
    done = stored(done, f"{name}/known")
    rare = (done.select("row", F.explode("rest").alias("r")).select("row", "r.pair", "r.times")
            .join(counts, "pair").groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
                 F.sum(F.col("n") * F.col("times")).alias("more_sum")))
    return done.drop("rest").join(rare, "row", "left").withColumns({
        "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
        "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).drop("more_best", "more_sum")


def align_documents(docs: DataFrame, name: str = "alignment", most: int = BROADCAST_PAIRS, **options) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (text), n_best, count_sum of
    every document."""
    rows = aligned(docs, name, **options)
    return with_counts(rows, stored(pair_counts(rows, name), f"{name}/pairs"), most, name).drop("row")


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    """Groups, links and their corpus counts of every document."""
    done = align_documents(table(spark, sf_dir, "documents"), "op13")
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                       F.coalesce(F.sha2("groups", 256), F.lit("")).alias("groups_sha256"))
