"""Bounded edit-distance matching of one word list against another.

Exact for any bound k, without comparing all pairs: a target is cut into k + 1
segments, and k edits leave at least one of them whole.  So a word within
distance k holds a segment of the target, at most k places from where it stood;
how far exactly depends on the segment's number and on the difference in length,
because the edits left of it and right of it share the bound.  Words and targets
meet on (target's length, number of the segment, segment), and only those pairs
are verified with ``levenshtein(a, b, k)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY = "array<struct<n:int,i:int,s:string>>"


def _cut(n: Column, i: Column, k: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 1) of k + 1 of a word of
    length n; the last segments take what does not divide."""
    short = F.floor(n / (k + 1)).cast("int")
    long_from = (k + 1) - n % (k + 1)  # segments after this one are longer by one
    start = (i - 1) * short + F.greatest(i - 1 - long_from, F.lit(0)) + 1
    return start, short + (i > long_from).cast("int")


def segments(target: Column, k: int) -> Column:
    """(n, i, s): length of the target and its k + 1 segments."""
    n = F.length(target)

    def one(i: Column) -> Column:
        start, size = _cut(n, i, k)
        return F.struct(n.alias("n"), i.alias("i"), F.substring(target, start, size).alias("s"))

    return F.transform(F.sequence(F.lit(1), F.lit(k + 1)), one)


def probes(word: Column, k: int) -> Column:
    """(n, i, s): the substrings of a word that can be segment i of a target of
    length n within distance k."""
    have = F.length(word)
    none = F.array().cast(_KEY)

    def of_segment(n: Column, i: Column) -> Column:
        start, size = _cut(n, i, k)
        more = have - n
        lo = F.greatest(F.lit(1), start - (i - 1), start + more - (k + 1 - i))
        hi = F.least(have - size + 1, start + (i - 1), start + more + (k + 1 - i))
        found = F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda at: F.struct(
            n.alias("n"), i.alias("i"), F.substring(word, at, size).alias("s")))
        return F.when(lo <= hi, found).otherwise(none)

    def of_length(n: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(k + 1)), lambda i: of_segment(n, i)))

    lengths = F.sequence(F.greatest(have - k, F.lit(0)), have + k)
    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))


def fuzzy_match(words: DataFrame, targets: DataFrame, k: int = 2,
                word_col: str = "word", target_col: str = "target") -> DataFrame:
    """(word, target, distance) for every pair within edit distance k."""
    if k < 0:
        raise ValueError("k must not be negative")
    a = words.select(F.col(word_col).alias("word")).where(F.col("word").isNotNull()).distinct()
    b = targets.select(F.col(target_col).alias("target")).where(F.col("target").isNotNull()).distinct()
    key = ["n", "i", "s"]
    # only target lengths that occur: a handful of rows, and most words go
    lengths = b.select(F.length("target").alias("n")).distinct()
    av = a.select("word", F.explode(probes(F.col("word"), k)).alias("p")).select("word", "p.*")
    bv = b.select("target", F.explode(segments(F.col("target"), k)).alias("p")).select("target", "p.*")
    cand = (av.join(lengths, "n", "left_semi").join(bv, key).select("word", "target").distinct())
    d = F.levenshtein(F.col("word"), F.col("target"), k)
    return cand.select("word", "target", d.cast("long").alias("distance")).where(F.col("distance") >= 0)
