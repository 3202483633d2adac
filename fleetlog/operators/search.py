"""Full-text search: per-row predicates over token arrays, and a stored index.

Scan mode: add a ``tokens`` array (ordered, see :mod:`fleetlog.functions.text`)
and filter with Column predicates built here -- :func:`term`,
:func:`prefix`, :func:`phrase`, :func:`near` -- combined with ``&``, ``|``
and ``~``.  Each row is tested on its own: no shuffle, the filter runs in
the scan stage.  Token arrays are not stemmed.

Index mode: :func:`write_index` explodes (ids, word, pos) once at ingest and
stores it sorted by word; an :class:`Index` knows whether it is stemmed and
answers with hit ids, for which only the queried words' row groups are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import porter
from ..functions import text as tx
from ..schema import BEGIN_MARK, END_MARK
from ..session import discard, scratch_path

TOKENS = "tokens"
NEAR_DEFAULT = 10


def with_tokens(df: DataFrame, text: str, analyzer: str = "porter", out: str = TOKENS) -> DataFrame:
    """Add the ordered (unstemmed) token array of ``text``."""
    if analyzer == "porter":
        return df.withColumn(out, tx.porter_tokens(text))
    if analyzer == "words":
        return df.withColumn(out, tx.word_tokens(text))
    raise ValueError(f"unknown analyzer {analyzer}")


def query_term(word: str, analyzer: str = "porter") -> str:
    """A query word analyzed like the unstemmed tokens."""
    return tx.porter_query_term(word) if analyzer == "porter" else word.lower()


def _arr(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _seen(text: str | Column | None, needle: str, pred: Column) -> Column:
    """Guard ``pred`` with a substring test on the raw text.  AND evaluates
    left to right, so rows without the substring are never tokenized.  For
    an ASCII needle the JVM's ``lower`` (fast on ASCII) is a safe test;
    otherwise the text is case-folded like the analyzer does."""
    if text is None or not needle:
        return pred
    t = F.col(text) if isinstance(text, str) else text
    folded = F.lower(t) if needle.isascii() else tx.ascii_lower(t)
    return folded.contains(needle) & pred


def _certain(token: str) -> str:
    """What the text of a row with this token surely holds.  The copy rule
    makes tokens of exactly 6 (3 + 3) or 20 (10 + 10) characters out of longer
    ones, of which only the first part is certain; a token of any other length
    stands in the text as it is."""
    return token[:3] if len(token) == 6 else token[:10] if len(token) == 20 else token


def _certain_prefix(p: str) -> str:
    """The same for tokens that begin with ``p``: up to 3 characters they
    surely do so in the text; with 4 to 6 the token may be a cut one of 6;
    beyond that only one of 20, whose first 10 are certain."""
    return p[:3] if len(p) <= 6 else p[:10]


def term(word: str, col: str | Column = TOKENS, text: str | Column | None = None, **kw) -> Column:
    """Token equal to the analyzed word.  ``text``: the raw text column, to
    skip tokenizing rows that cannot match."""
    q = query_term(word, **kw)
    # coalesce: array_contains is null-intolerant, and Catalyst would infer
    # isnotnull(tokens) and test it before the guard, tokenizing every row.
    return _seen(text, _certain(q), F.coalesce(F.array_contains(_arr(col), F.lit(q)), F.lit(False)))


def all_terms(words: Sequence[str], col: str | Column = TOKENS, text: str | Column | None = None, **kw) -> Column:
    """Every one of the words (AND).  With ``text`` all substrings are asked
    for first, the longest one first, so few rows are tokenized, and those
    once for all words."""
    qs = list(dict.fromkeys(query_term(w, **kw) for w in words))
    found = F.coalesce(F.size(F.array_intersect(_arr(col), F.array(*[F.lit(q) for q in qs]))) == len(qs), F.lit(False))
    for needle in sorted(map(_certain, qs), key=len):
        found = _seen(text, needle, found)
    return found


def prefix(p: str, col: str | Column = TOKENS, text: str | Column | None = None, **kw) -> Column:
    """``p*``: any token starting with the analyzed ``p``."""
    q = query_term(p, **kw)
    return _seen(text, _certain_prefix(q), F.exists(_arr(col), lambda x: x.startswith(q)))


def phrase(words: Sequence[str], col: str | Column = TOKENS, text: str | Column | None = None,
           **kw) -> Column:
    """The words as consecutive tokens.  Tokens never hold an ASCII space,
    so this is a substring test on the space-joined token list (the token
    array is built once per row)."""
    qs = [query_term(w, **kw) for w in words]
    joined = F.concat(F.lit(" "), F.array_join(_arr(col), " "), F.lit(" "))
    needle = max((_certain(q) for q in qs), key=len)
    return _seen(text, needle, F.instr(joined, " " + " ".join(qs) + " ") > 0)


def positions(word: str, col: str | Column = TOKENS, **kw) -> Column:
    """1-based positions of the analyzed word in the token array."""
    q = query_term(word, **kw)
    idx = F.transform(_arr(col), lambda x, i: F.when(x == F.lit(q), i + 1))
    return F.filter(idx, lambda p: p.isNotNull())


def near(a_word: str, b_word: str, k: int = NEAR_DEFAULT, col: str | Column = TOKENS,
         text: str | Column | None = None, **kw) -> Column:
    """``a NEAR/k b``: an ``a`` and a ``b`` with at most k tokens between
    them, in either order."""
    if text is not None:
        guard = _seen(text, _certain(query_term(a_word, **kw)), F.lit(True))
        return guard & near(a_word, b_word, k, col, None, **kw)
    pa = positions(a_word, col, **kw)
    pb = positions(b_word, col, **kw)
    # every position within k+1 of an ``a`` (the ``a`` itself excluded)
    around = F.flatten(F.transform(pa, lambda i: F.concat(
        F.sequence(i - (k + 1), i - 1), F.sequence(i + 1, i + (k + 1)))))
    return F.arrays_overlap(around, pb) & (F.size(pa) > 0)


# ---------------------------------------------------------------- postings

def postings(df: DataFrame, ids: Sequence[str], text: str, analyzer: str = "porter",
             stem: bool = False) -> DataFrame:
    """Posting rows of ``df``, from one scan.

    porter: (ids..., pos, term) with 0-based token positions, stemmed on
    request; words: (ids..., term) -- the distinct analyzed set of each row
    (sub-tokens included), no positions; ``ids`` must be unique.
    """
    ids = list(ids)
    if analyzer == "porter":
        return _exploded(_token_lists(df, ids, text, stem), ids)
    if analyzer == "words" and not stem:
        tokens = df.select(*ids, tx.word_tokens(text).alias("__fl_tokens"))
        return tokens.select(*ids, F.explode(tx.expand_tokens(F.col("__fl_tokens"))).alias("term"))
    raise ValueError(f"unknown analyzer {analyzer}" + " with stemming" * stem)


def _token_lists(df: DataFrame, ids: list[str], text: str, stem: bool) -> DataFrame:
    lists = df.select(*ids, tx.porter_tokens(text).alias("__fl_tokens"))
    return porter.stem_lists(lists, "__fl_tokens") if stem else lists


def _exploded(lists: DataFrame, ids: list[str]) -> DataFrame:
    return lists.select(*ids, F.posexplode("__fl_tokens").alias("pos", "term"))


def log_postings(logs: DataFrame) -> DataFrame:
    """The inverted index of log messages: distinct (node, id, word, type=0),
    markers skipped."""
    msgs = logs.where(~F.col("message").isin(BEGIN_MARK, END_MARK))
    return (postings(msgs, ["node", "id"], "message", "words")
            .select("node", "id", F.col("term").alias("word"), F.lit(0).alias("type")))


# A hot word's postings are dealt over this many join keys.
LOOKUP_SALT = 16


def lookup(post: DataFrame, words: DataFrame, ids: Sequence[str], word_col: str = "word",
           salt: int = LOOKUP_SALT) -> DataFrame:
    """Postings of every query word (equi-join on the term).  A hot term holds
    a large share of the postings, so its rows are dealt by their ids and each
    query word meets every share."""
    w = (words.select(F.col(word_col).alias("term")).distinct()
         .withColumn("__fl_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))))
    p = post.withColumn("__fl_salt", F.pmod(F.xxhash64(*ids), F.lit(salt)).cast("int"))
    return p.join(w, ["term", "__fl_salt"]).drop("__fl_salt")


def semi(rows: DataFrame, hit_ids: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows whose ids are in the hit set (``id IN (SELECT docid ...)``)."""
    return rows.join(hit_ids, list(ids), "left_semi")


# ------------------------------------------------------------- stored index

def write_index(rows: DataFrame, ids: Sequence[str], text: str, root: str, stem: bool = True) -> None:
    """Append the positional index of ``rows`` to the table at ``root``:
    (ids..., word, pos), one folder per node when ``node`` is one of the ids,
    sorted by word, so that a lookup reads only the row groups of its word.  The
    ids belong to the range, so a frequent word is spread over several files.
    The rows are read for the bounds of the ranges and again for the ranges, so
    the analyzed tokens, a list per row, are stored for the time between."""
    spark, ids = rows.sparkSession, list(ids)
    passing = scratch_path(spark, "index-tokens")
    lists = _token_lists(rows, ids, text, stem)
    lists.write.option("compression", "zstd").parquet(passing)
    p = _exploded(spark.read.schema(lists.schema).parquet(passing), ids).withColumnRenamed("term", "word")
    if "node" in ids:
        key = ["node", "word", *[c for c in ids if c != "node"]]
        w = p.repartitionByRange(*key).sortWithinPartitions(*key, "pos").write.partitionBy("node")
    else:
        w = p.repartitionByRange("word", *ids).sortWithinPartitions("word", *ids, "pos").write
    w.mode("append").parquet(root)
    discard(spark, passing)


@dataclass(frozen=True)
class Index:
    """A stored index; queries return distinct ids."""

    frame: DataFrame
    ids: tuple[str, ...]
    stem: bool = True

    @classmethod
    def read(cls, spark: SparkSession, root: str, ids: Sequence[str], stem: bool = True) -> Index:
        return cls(spark.read.parquet(root), tuple(ids), stem)

    def within(self, condition: Column) -> Index:
        """The part of the index that satisfies a condition on the ids, e.g.
        one node (its folder only)."""
        return Index(self.frame.where(condition), self.ids, self.stem)

    def analyzed(self, words: Sequence[str]) -> dict[str, str]:
        """Every query word as the index holds it."""
        out = {w: query_term(w) for w in words}
        plain = [q for q in out.values() if q.isascii() and q.isalpha() and 3 <= len(q) <= 20] if self.stem else []
        stems = porter.stem_query_words(self.frame.sparkSession, plain)
        return {w: stems.get(q, q) for w, q in out.items()}

    def _analyzed(self, word: str) -> str:
        return self.analyzed([word])[word]

    def term(self, word: str) -> DataFrame:
        return self.frame.where(F.col("word") == F.lit(self._analyzed(word))).select(*self.ids).distinct()

    def prefix(self, p: str) -> DataFrame:
        return self.frame.where(F.col("word").startswith(self._analyzed(p))).select(*self.ids).distinct()

    def phrase(self, words: Sequence[str]) -> DataFrame:
        """Ids holding the words at consecutive positions."""
        cur = None
        for k, w in enumerate(words):
            at = self.frame.where(F.col("word") == F.lit(self._analyzed(w))).select(
                *self.ids, (F.col("pos") - k).alias("pos"))
            cur = at if cur is None else cur.join(at, [*self.ids, "pos"], "left_semi")
        return cur.select(*self.ids).distinct()

    def both(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, list(self.ids), "left_semi")

    def either(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b).distinct()

    def but_not(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, list(self.ids), "left_anti")


def node_rows(logs: DataFrame, hit_ids: DataFrame, node: str) -> DataFrame:
    """Log rows of one node whose (node, id) was hit."""
    on = F.col("node") == node
    return semi(logs.where(on), hit_ids.where(on), ["node", "id"])
