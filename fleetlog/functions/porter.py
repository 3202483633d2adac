"""Porter stemming as column expressions, run on distinct words.

The published algorithm, each step one projection over a word column: letter
classes are regular expressions (``y`` is a vowel except at the start, where
it is written ``Y`` until the end), a measure test is a pattern on what is left
of the suffix.  :func:`stem_lists` stems token arrays where they are: the same
steps on one word (:func:`stem_word`), taken once per word and task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

# Letter runs and measure tests of the algorithm.
_C = "[^aeiou][^aeiouy]*"
_V = "[aeiouy][aeiou]*"
MEASURE_OVER_0 = f"^({_C})?{_V}{_C}"
MEASURE_IS_1 = f"^({_C})?{_V}{_C}({_V})?$"
MEASURE_OVER_1 = f"^({_C})?{_V}{_C}{_V}{_C}"
HAS_VOWEL = f"^({_C})?[aeiouy]"
SHORT_END = f"^{_C}[aeiouy][^aeiouwxy]$"

# Suffixes and replacements of steps 2 and 3, suffixes of step 4.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble",
          "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
          "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al",
          "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate",
          "iti", "ous", "ive", "ize"]


def ending(suffixes) -> str:
    """Pattern with the stem as group 1 and the longest of the suffixes as 2."""
    return "^(.+?)(" + "|".join(suffixes) + ")$"


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _double(w: Column) -> Column:
    return (F.substring(w, -1, 1) == F.substring(w, -2, 1)) & w.rlike("[^aeiouylsz]$")


def _restored(w: Column) -> Column:
    """After -ed and -ing: at, bl, iz and short stems regain their e, a double
    consonant loses one."""
    return (F.when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e")))
            .when(_double(w), _cut(w, 1))
            .when(w.rlike(SHORT_END), F.concat(w, F.lit("e"))).otherwise(w))


def _replaced(w: Column, table: dict[str, str]) -> Column:
    pattern = ending(table)
    stem, suffix = F.regexp_extract(w, pattern, 1), F.regexp_extract(w, pattern, 2)
    new = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), suffix)
    return F.when((suffix != "") & stem.rlike(MEASURE_OVER_0), F.concat(stem, new)).otherwise(w)


def stem_words(words: DataFrame, column: str = "word", out: str = "stem") -> DataFrame:
    """Adds the stem of every word (lower-case ASCII letters, three or more)."""
    w, stem = F.col(out), F.col("__fl_stem")
    d = words.withColumn(out, F.regexp_replace(column, "^y", "Y"))
    # plurals
    d = d.withColumn(out, F.when(w.rlike("^.*(ss|i)es$"), _cut(w, 2)).when(w.rlike("^.+[^s]s$"), _cut(w, 1)).otherwise(w))
    # -eed, -ed, -ing
    eed = w.rlike("^.*eed$")
    d = d.withColumn("__fl_stem", F.when(eed, F.lit("")).otherwise(F.regexp_extract(w, ending(["ed", "ing"]), 1)))
    d = d.withColumn(out, F.when(eed, F.when(_cut(w, 3).rlike(MEASURE_OVER_0), _cut(w, 1)).otherwise(w))
                     .when((stem != "") & stem.rlike(HAS_VOWEL), _restored(stem)).otherwise(w))
    # -y
    d = d.withColumn(out, F.when(w.rlike("^.+y$") & _cut(w, 1).rlike(HAS_VOWEL),
                                 F.concat(_cut(w, 1), F.lit("i"))).otherwise(w))
    d = d.withColumn(out, _replaced(w, STEP_2))
    d = d.withColumn(out, _replaced(w, STEP_3))
    # -al .. -ize, and -ion after s or t
    d = d.withColumn("__fl_stem", F.regexp_extract(w, ending(STEP_4), 1))
    ion = F.regexp_extract(w, "^(.+?[st])ion$", 1)
    d = d.withColumn(out, F.when(stem != "", F.when(stem.rlike(MEASURE_OVER_1), stem).otherwise(w))
                     .when((ion != "") & ion.rlike(MEASURE_OVER_1), ion).otherwise(w))
    # final -e, and -ll
    base = _cut(w, 1)
    d = d.withColumn(out, F.when(w.rlike("^.+e$") & (base.rlike(MEASURE_OVER_1) | (
        base.rlike(MEASURE_IS_1) & ~base.rlike(SHORT_END))), base).otherwise(w))
    d = d.withColumn(out, F.when(w.rlike("ll$") & w.rlike(MEASURE_OVER_1), _cut(w, 1)).otherwise(w))
    return d.withColumn(out, F.regexp_replace(w, "^Y", "y")).drop("__fl_stem")


def stem_vocabulary(words: DataFrame, column: str = "word") -> DataFrame:
    """(word, stem) for every distinct word of ``column``."""
    vocab = words.select(F.col(column).alias("word")).where(F.col("word").isNotNull()).distinct()
    return stem_words(vocab)


_matches = lru_cache(64)(lambda pattern: re.compile(pattern).match)


def _replaced_in(w: str, table: dict[str, str]) -> str:
    m = _matches(ending(table))(w)
    return m[1] + table[m[2]] if m and _matches(MEASURE_OVER_0)(m[1]) else w


def stem_word(word: str) -> str:
    """The steps of :func:`stem_words` on one word."""
    is_ = _matches
    w = "Y" + word[1:] if word[0] == "y" else word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif len(w) > 2 and w[-1] == "s" != w[-2]:
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if is_(MEASURE_OVER_0)(w[:-3]) else w
    elif (m := is_(ending(["ed", "ing"]))(w)) and is_(HAS_VOWEL)(m[1]):
        w = m[1]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-1:] == w[-2:-1] and w[-1] not in "aeiouylsz":
            w = w[:-1]
        elif is_(SHORT_END)(w):
            w += "e"
    if len(w) > 1 and w[-1] == "y" and is_(HAS_VOWEL)(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced_in(_replaced_in(w, STEP_2), STEP_3)
    m = is_(ending(STEP_4))(w)
    if m:
        w = m[1] if is_(MEASURE_OVER_1)(m[1]) else w
    elif w.endswith(("sion", "tion")) and len(w) > 4 and is_(MEASURE_OVER_1)(w[:-3]):
        w = w[:-3]
    base = w[:-1]
    if base and w[-1] == "e" and (is_(MEASURE_OVER_1)(base) or is_(MEASURE_IS_1)(base) and not is_(SHORT_END)(base)):
        w = base
    if w.endswith("ll") and is_(MEASURE_OVER_1)(w):
        w = w[:-1]
    return "y" + w[1:] if w[0] == "Y" else w


# Stems that a task keeps; when it has more, it starts anew.
KEPT_STEMS = 300_000
_STEMMABLE = re.compile("[a-z]{3,20}").fullmatch


def stem_lists(df: DataFrame, column: str) -> DataFrame:
    """Replace every token of the array ``column`` that is 3 to 20 lower-case
    ASCII letters by its stem.  No row leaves its task; the tokens of a batch are
    numbered, so only its different ones are looked up."""
    ship(df.sparkSession)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, str] = {}
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                lists = part.column(at)
                tokens = lists.flatten().dictionary_encode()
                words = tokens.dictionary.to_pylist()
                if len(kept) > KEPT_STEMS:
                    kept.clear()
                for w in words:
                    if w not in kept:
                        kept[w] = stem_word(w) if w and _STEMMABLE(w) else w
                stems = pa.array([kept[w] for w in words], pa.string()).take(tokens.indices)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                done = pa.ListArray.from_arrays(ends, stems, mask=lists.is_null())
                columns = [*part.columns[:at], done, *part.columns[at + 1:]]
                yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def stem_query_words(spark, words) -> dict[str, str]:
    """The stems of query words, by the same expressions, in one job."""
    rows = [(w,) for w in dict.fromkeys(words)]
    if not rows:
        return {}
    return {r["word"]: r["stem"] for r in stem_words(spark.createDataFrame(rows, "word string")).collect()}
