"""The classifier chain: learning, out-of-fold features, awkward rows."""

import numpy as np

from fleetlog.llm import toxicity
from tests.llm.helpers import ROWS, docs


def test_logistic_model_separates():
    r = np.random.default_rng(0)
    x = np.column_stack((r.normal(size=(400, 3)), np.ones(400))).astype(np.float32)
    y = (x[:, 0] - x[:, 1] > 0).astype(np.float32)
    p = toxicity._probability(x, toxicity.fit_logistic(x, y))
    assert ((p > 0.5) == (y > 0)).mean() > 0.95
    assert toxicity._probability(x, toxicity.fit_logistic(x, np.ones(400, np.float32))).min() > 0.99


def test_later_models_see_out_of_fold_probabilities():
    r = np.random.default_rng(1)
    n = 600
    x = r.normal(size=(n, 30)).astype(np.float32)
    first = r.integers(0, 2, n)  # noise: in-sample fits look informative, out-of-fold ones do not
    labels = np.column_stack((first, first))
    folds = np.arange(n) % toxicity.FOLDS
    weights, out = toxicity.fit_chain(x, labels, folds)
    assert [len(w) for w in weights] == [31, 32]
    inside = toxicity._probability(toxicity._with(x, np.zeros((n, 0), np.float32)), weights[0])
    auc = lambda p: (p[first == 1][:, None] > p[first == 0][None, :]).mean()
    assert auc(inside) > 0.55 and abs(auc(out[:, 0]) - 0.5) < 0.06


def test_threshold_is_the_best_f1():
    p, y = np.array([0.9, 0.8, 0.7, 0.2, 0.1]), np.array([1, 1, 1, 0, 0])
    assert 0.2 < toxicity.best_threshold(p, y) < 0.7


def test_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op10_toxicity(spark, sf).collect()
    assert len(rows) == 10_000 and rows[0].asDict().keys() == {"doc_id", "toxic", "p_junk", "p_toxic", "p_severe"}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    said = {r["doc_id"]: r["toxic"] for r in rows}
    hit = sum(said[i] and t for i, t in labels.items())
    assert hit / sum(said[i] for i in labels) > 0.95 and hit / sum(labels.values()) > 0.9


def test_held_out_labels(spark, tmp_path):
    """Trained on half of the labels, judged on the other half."""
    sf = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.train_chain(documents, labels.where("doc_id % 2 = 0"), "t-tox")
    said = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(documents, chain).collect()}
    other = {r["doc_id"]: r["toxic"] for r in labels.where("doc_id % 2 = 1").collect()}
    hit = sum(said[i] and t for i, t in other.items())
    assert hit / sum(said[i] for i in other) > 0.95 and hit / sum(other.values()) > 0.9


def test_edge_documents(spark):
    words = [("you are a nasty wretch", 1), ("a calm sunny day", 0)]
    rows = [(i, words[i % 2][0] + f" word{i}", "en", "s", 0) for i in range(100, 160)]
    labels = spark.createDataFrame([(i, 1, words[i % 2][1]) for i in range(100, 160)] + [(100, 1, 1), (None, 1, 0), (105, None, 0), (106, 1, None), (999, 0, 1)],
                                   "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS text", "'y' AS junk")
    df = docs(spark, rows + ROWS[3:])
    chain = toxicity.train_chain(docs(spark, rows), labels, "t-tox")
    got = toxicity.toxicity(df, chain).collect()
    assert len(got) == len(rows) + len(ROWS) - 3
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    assert sum(by[i]["toxic"] == bool(words[i % 2][1]) for i in range(110, 160)) > 48
    assert not by[4]["toxic"] and by[4]["p_toxic"] == 0.0
    none = toxicity.train_chain(docs(spark, rows), labels.where("toxic = 0"), "t-tox")
    assert not any(r["toxic"] for r in toxicity.toxicity(df, none).collect())
    assert toxicity.toxicity(docs(spark, []), chain).count() == 0


def test_sample_is_bounded_in_documents(spark):
    rows = [(1, "copied text", "en", "s", 0)] * 500 + [(2, f"one id, text {i}", "en", "s", 0) for i in range(500)]
    rows += [(i, f"nasty wretch {i}", "en", "s", 0) for i in range(100, 160)]
    rows += [(i, f"calm day {i}", "en", "s", 0) for i in range(200, 260)]
    labels = spark.createDataFrame([(r[0], 1, int("nasty" in r[1])) for r in rows if r[0] > 2] + [(1, 1, 0)] * 3 + [(2, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = toxicity.sample(docs(spark, rows), labels, rows_per_class=40).collect()
    assert [sum(r["toxic"] == k for r in got) for k in (0, 1)] == [40, 40]
    assert len({(r["doc_id"], r["text"]) for r in got}) == 80
    whole = toxicity.sample(docs(spark, rows), labels).collect()
    assert len(whole) == len({(r["doc_id"], r["text"]) for r in whole}) == 621
