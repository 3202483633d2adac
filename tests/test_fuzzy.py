"""Fuzzy matching against brute force."""

import random

import pytest

from fleetlog.operators.fuzzy import fuzzy_match


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def _found(spark, words, targets, k):
    return {(r["word"], r["target"], r["distance"]) for r in fuzzy_match(
        spark.createDataFrame([(w,) for w in words], "word string"),
        spark.createDataFrame([(t,) for t in targets], "target string"), k).collect()}


def _want(words, targets, k):
    pairs = {(w, t, _lev(w, t)) for w in set(words) - {None} for t in set(targets) - {None}}
    return {p for p in pairs if p[2] <= k}


def test_matches_brute_force(spark):
    words = ["bolt", "ring", "gear", "a", "", "anvil", "é", "ab", None, "bolt"]
    targets = ["bolts", "bold", "rings", "gears", "x", "ax", "anviç", "ba", "b", "boltless", "gera", "éé", None, ""]
    assert _found(spark, words, targets, 2) == _want(words, targets, 2)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 4])
def test_any_bound(spark, k):
    rng = random.Random(k)
    base = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(60)]

    def edited(w):
        w = list(w)
        for _ in range(rng.randint(0, k + 1)):
            at = rng.randint(0, len(w))
            w[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "x"])
        return "".join(w)

    targets = [edited(w) for w in base]
    assert _found(spark, base, targets, k) == _want(base, targets, k)


def test_few_candidates_a_word(spark):
    """Keys grow with the bound, not with the length of the word."""
    from pyspark.sql import functions as F

    from fleetlog.operators.fuzzy import probes
    n = spark.createDataFrame([("abcdefghijklmnopqrst" * 3,)], "w string").select(F.size(probes(F.col("w"), 2))).first()[0]
    assert n <= 19


def test_a_negative_bound_is_an_error(spark):
    with pytest.raises(ValueError):
        _found(spark, ["a"], ["a"], -1)
