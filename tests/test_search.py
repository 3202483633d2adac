"""Analyzer and search checks (FIXTURES §9), porter analyzer vs SQLite."""

import re
import sqlite3

from fleetlog.functions import text as tx
from fleetlog.operators import search

ROWS = [(1, "processing epoch 12"), (2, "stored block epoch"), (3, "stored states of DS"), (4, "BEG")]


def _docs(spark):
    return search.with_tokens(spark.createDataFrame(ROWS, "doc_id long, text string"), "text")


def _index(spark, stem):
    from fleetlog.session import scratch_path
    root = scratch_path(spark, "index")
    search.write_index(spark.createDataFrame(ROWS, "doc_id long, text string"), ["doc_id"], "text", root, stem)
    return search.Index.read(spark, root, ["doc_id"], stem)


def _hit(df):
    return sorted(r["doc_id"] for r in df.collect())


def _ids(df, pred):
    return sorted(r["doc_id"] for r in df.where(pred).collect())


def test_fixture_queries_stemmed(spark):
    i = _index(spark, True)
    assert _hit(i.term("epoch")) == [1, 2]
    assert _hit(i.prefix("epo")) == [1, 2]
    assert _hit(i.term("epo")) == []
    assert _hit(i.both(i.term("stored"), i.term("epoch"))) == [2]
    assert _hit(i.either(i.term("stored"), i.term("processing"))) == [1, 2, 3]
    assert _hit(i.but_not(i.term("stored"), i.term("epoch"))) == [3]
    assert _hit(i.phrase(["block", "epoch"])) == [2]
    assert _hit(i.prefix("processing")) == [1]
    assert _hit(i.term("beg")) == [4]


def test_unstemmed_scan_and_index_agree(spark):
    d, i = _docs(spark), _index(spark, False)
    assert _ids(d, search.term("epoch")) == _hit(i.term("epoch"))
    assert _hit(i.phrase(["block", "epoch"])) == [2]
    assert _ids(d, search.near("stored", "epoch", 1)) == [2]
    assert _hit(i.term("process")) == [] and _hit(i.prefix("process")) == [1]


def test_scan_predicates_know_no_stemming(spark):
    import pytest
    with pytest.raises(TypeError):
        search.term("license", stem="porter")


def test_index_lookup_pushes_the_word(spark):
    plan = _index(spark, True).term("epoch")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(word,epoch)" in plan and "split(" not in plan


def test_log_index_reads_one_node(spark, sf_small):
    from pyspark.sql import functions as F
    from fleetlog.sources import fixtures
    hits = fixtures.log_index(spark, sf_small).within(F.col("node") == "node-1").term("error")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(word,error)" in plan and "PartitionFilters: [isnotnull(node" in plan


def test_porter_token_literals(spark):
    lits = {
        "order_key = c41e07b95d2264f8a0b7131d6e59": ["order_key", "c41e59"],
        "[10.7.0.214:8080] took=35": ["10", "7", "0", "214", "8080", "took", "35"],
        "internationalizationprocess abcdef1 abcdefg a1b2c3d": ["internatioionprocess",
                                                                "abcef1", "abcdefg", "a1bc3d"],
    }
    df = spark.createDataFrame([(k,) for k in lits], "text string")
    got = {r["text"]: r["t"] for r in df.select("text", tx.porter_tokens("text").alias("t")).collect()}
    for k, v in lits.items():
        assert got[k] == v, k


def test_porter_analyzer_matches_sqlite(spark, sf_small):
    """Token sequence (copy rule included, before stemming) equals SQLite's
    porter tokenizer on every stemmer-free token of the documents."""
    from fleetlog.functions import porter
    from fleetlog.session import read_table
    docs = read_table(spark, sf_small, "documents").select("doc_id", "text").orderBy("doc_id").limit(60).collect()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE tok USING fts3tokenize(porter)")
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in docs], "doc_id long, text string")
    ours = {r["doc_id"]: r["t"] for r in df.select("doc_id", tx.porter_tokens("text").alias("t")).collect()}
    words = sorted({t for v in ours.values() for t in v if re.fullmatch("[a-z]{3,20}", t)})
    stems = {r["word"]: r["stem"] for r in porter.stem_vocabulary(
        spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    checked = 0
    for r in docs:
        if not r["text"].isascii():
            continue  # the copy rule cuts bytes in SQLite and characters here
        theirs = [t for (t,) in db.execute("SELECT token FROM tok WHERE input = ?", (r["text"],))]
        mine = [stems.get(t, t) for t in ours[r["doc_id"]]]
        assert mine == theirs
        checked += 1
    assert checked > 10


def test_words_analyzer_literals(spark):
    text = "Order accepted [10.7.0.214:8080] part_key = 0x7C3F0B9E, x::y::zed BEG end qty=five,six"
    df = spark.createDataFrame([(text,)], "text string")
    main = df.select(tx.word_tokens("text").alias("t")).first()["t"]
    assert main == ["order", "accepted", "10.7.0.214:8080", "part_key", "0x7c3f0b9e",
                    "x::y::zed", "qty", "five", "six"]
    full = set(df.select(tx.expand_tokens(tx.word_tokens("text")).alias("t")).first()["t"])
    assert {"7c3f0b9e", "part_key", "part", "key", "8080", "214", ":zed"} <= full


def test_prefilter_keeps_cut_tokens(spark):
    """A cut token is not a substring of the text; the guard must not lose it."""
    df = search.with_tokens(spark.createDataFrame(
        [(1, "hash c41e07b95d2264f8a0b7131d6e59 here"),
         (2, "Internationalizationprocessing is long")], "doc_id long, text string"), "text")
    assert _ids(df, search.term("c41e07b95d2264f8a0b7131d6e59", text="text")) == [1]
    assert _ids(df, search.term("c41e59", text="text")) == [1]
    assert _ids(df, search.term("internationalizationprocessing", text="text")) == [2]
    assert _ids(df, search.phrase(["is", "long"], text="text")) == [2]
    assert _ids(df, ~search.term("here", text="text")) == [2]


def test_guard_never_loses_a_match(spark):
    """Tokens that the copy rule cut need not stand in the text."""
    df = search.with_tokens(spark.createDataFrame(
        [(1, "see abc9xyzdef here"), (2, "abcdefghijklmnopqrstuvwxyz"), (3, "see abcdef")],
        "doc_id long, text string"), "text")
    for kw in ({}, {"text": "text"}):
        assert _ids(df, search.term("abcdef", **kw)) == [1, 3]
        assert _ids(df, search.phrase(["see", "abcdef"], **kw)) == [1, 3]
        assert _ids(df, search.prefix("abcdefghijqrs", **kw)) == [2]
        assert _ids(df, search.prefix("abcde", **kw)) == [1, 2, 3]
        assert _ids(df, ~search.term("abcdef", **kw)) == [2]


PORTER_WORDS = ("caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled "
                "sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional "
                "rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli "
                "vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti "
                "sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness "
                "revival allowance inference airliner gyroscopic adjustable defensible irritant replacement "
                "adjustment dependent adoption homologou communism activate angulariti homologous effective "
                "bowdlerize probate rate cease controll roll generalization oscillators archaeology "
                "eed ies sses bed yes yelling toyed").split()


def test_porter_matches_sqlite(spark):
    from fleetlog.functions import porter
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE tok USING fts3tokenize(porter)")
    want = {w: db.execute("SELECT token FROM tok WHERE input = ?", (w,)).fetchone()[0] for w in PORTER_WORDS}
    got = porter.stem_vocabulary(spark.createDataFrame([(w,) for w in PORTER_WORDS], "word string")).collect()
    assert {r["word"]: r["stem"] for r in got} == want


def test_token_lists_are_stemmed_where_they_are(spark, monkeypatch):
    """The same stems as the column expressions, lists as they were, no shuffle."""
    from fleetlog.functions import porter
    from pyspark.sql import functions as F
    words = [w + s for w in PORTER_WORDS for s in ("", "s", "ing", "ed", "y", "ion", "ll", "e")]
    words = sorted({w for w in words if len(w) >= 3})
    want = {r["word"]: r["stem"] for r in porter.stem_words(
        spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert {w: porter.stem_word(w) for w in words} == want
    lists = [words[:50] + ["Sky", "running1", "été", "is"], [], None, ["running", None, "running"], words[50:]]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id long, t array<string>").coalesce(1)
    monkeypatch.setattr(porter, "KEPT_STEMS", 10)
    got = {r["doc_id"]: r["t"] for r in porter.stem_lists(df, "t").collect()}
    assert got == {i: t and [want.get(w, "run" if w == "running" else w) for w in t] for i, t in enumerate(lists)}
    p = search.postings(spark.createDataFrame(ROWS, "doc_id long, text string"), ["doc_id"], "text", "porter", True)
    assert "Exchange" not in p._jdf.queryExecution().executedPlan().toString()
    assert [r["term"] for r in p.where(F.col("doc_id") == 1).orderBy("pos").collect()] == ["process", "epoch", "12"]


def test_lookup_of_a_hot_word(spark):
    from pyspark.sql import functions as F
    post = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("the").alias("term"))
    words = spark.createDataFrame([("the",), ("the",), ("none",)], "word string")
    assert search.lookup(post, words, ["doc_id"]).count() == 1000


def test_a_frequent_word_is_spread_over_files(spark):
    from pyspark.sql import functions as F
    from fleetlog.session import scratch_path
    root = scratch_path(spark, "hot-word")
    rows = spark.range(40000).selectExpr("id AS doc_id", "concat('common word', id) AS text")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        search.write_index(rows, ["doc_id"], "text", root, False)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    hot = spark.read.parquet(root).where("word = 'common'")
    assert hot.count() == 40000 and hot.select(F.input_file_name()).distinct().count() >= 4
