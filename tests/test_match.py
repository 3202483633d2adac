import random
import sqlite3

import pytest

from fleetlog.operators import search
from fleetlog.operators.match import match, near, phrase
from fleetlog.session import scratch_path

# (SQLite MATCH text, the same query here)
CASES = [
    ("alpha", phrase("alpha")),
    ("al*", phrase("al*")),
    ('"alpha beta"', phrase("alpha", "beta")),
    ('"al* beta gam*"', phrase("al*", "beta", "gam*")),
    ("alpha NEAR/0 beta", near("alpha", "beta", k=0)),
    ("alpha NEAR/2 gamma", near("alpha", "gamma", k=2)),
    ("alpha NEAR beta", near("alpha", "beta")),
    ("alpha NEAR/1 alpha", near("alpha", "alpha", k=1)),
    ('"alpha beta" NEAR/1 "beta gamma"', near(phrase("alpha", "beta"), phrase("beta", "gamma"), k=1)),
    ("alpha NEAR/1 beta NEAR/1 gamma", near("alpha", "beta", "gamma", k=1)),
    ("(alpha OR delta) AND (beta NOT gamma)",
     (phrase("alpha") | phrase("delta")) & (phrase("beta") - phrase("gamma"))),
    ('delta NOT (alpha NEAR/1 beta OR "gamma delta")',
     phrase("delta") - (near("alpha", "beta", k=1) | phrase("gamma", "delta"))),
    ("none AND alpha", phrase("none") & phrase("alpha")),
]


def _texts():
    rnd = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "albus", "gamut", "filler"]
    out = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 9)))) for i in range(400)]
    return [*out, (400, ""), (401, None), (402, out[0][1]), (403, "alpha " + "filler " * 3000 + "beta")]


def _index(spark, rows, name):
    root = scratch_path(spark, name)
    search.write_index(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], "text", root)
    return search.Index.read(spark, root, ["doc_id"])


def test_match_equals_sqlite(spark):
    rows = _texts()
    got = match(_index(spark, rows, "match"), {t: q for t, q in CASES}).collect()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts4(message, tokenize=porter)")
    db.executemany("INSERT INTO t(docid, message) VALUES (?, ?)", rows)
    for text, _ in CASES:
        want = sorted(d for (d,) in db.execute("SELECT docid FROM t WHERE t MATCH ?", (text,)))
        assert sorted(r["doc_id"] for r in got if r["query"] == text) == want, text


def test_match_reads_the_index_once(spark):
    index = _index(spark, _texts()[:20], "match-plan")
    plan = match(index, {t: q for t, q in CASES})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    # without positions the flags are pre-aggregated before the shuffle
    flat = match(index, {"q": phrase("alpha") & phrase("be*")})._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in flat and "Window" not in flat
    assert "PushedFilters: [Or(EqualTo(word,alpha),StringStartsWith(word,be))]" in flat


def test_match_empty_and_wrong(spark):
    index = _index(spark, [(1, "")], "match-empty")
    assert match(index, {"q": near("a", "b")}).collect() == []
    assert match(index, {}).collect() == []
    for wrong in (lambda: phrase(), lambda: phrase("*"), lambda: near("a"), lambda: near("a", near("b", "c")),
                  lambda: near("a", "b", k=-1)):
        with pytest.raises(ValueError):
            wrong()
