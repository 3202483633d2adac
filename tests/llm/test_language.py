"""The recurrent network: gradients, held-out accuracy, awkward rows."""

import numpy as np

from fleetlog.llm import language
from tests.llm.helpers import ROWS, docs


def test_gradients_by_differences():
    model = language.BiGRU(3, 4)
    model.p = {k: a.astype(np.float64) for k, a in model.p.items()}
    r = np.random.default_rng(0)
    w, y = r.integers(97, 103, (5, 7)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    _, g = model.gradients(w, y)
    for k, a in model.p.items():
        for n in range(8):
            at = tuple(r.integers(0, s) for s in a.shape)
            if k == "x":
                at = (at[0], int(w[n % 5, n % 7]), at[2])
            old, e = a[at], 1e-4
            a[at] = old + e
            up = model.gradients(w, y)[0]
            a[at] = old - e
            down = model.gradients(w, y)[0]
            a[at] = old
            assert abs((up - down) / (2 * e) - g[k][at]) < 1e-6, (k, at)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = language.op2_language(spark, sf).join(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    ours = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    import zlib
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in ours) / len(ours) > 0.96


def _identifier():
    r = np.random.default_rng(1)
    texts = {"aa": "abab baba abba ", "zz": "zyzy yzzy zzy "}
    w, y = [], []
    for k, (_, t) in enumerate(texts.items()):
        for _ in range(60):
            s = (t * 20)[int(r.integers(0, 40)):][:language.STEPS].encode()
            w.append(np.frombuffer(s, dtype=np.uint8))
            y.append(k)
    model = language.BiGRU(2)
    losses = model.train(np.stack(w), np.array(y), epochs=6, batch=20)
    assert losses[-1] < 0.1 < losses[0]
    return language.Identifier(model, list(texts))


def test_whole_texts_are_pooled_and_positions_labelled():
    who = _identifier()
    t = b"abab baba " * 30 + b"zyzy yzzy " * 12
    p = who.document_probabilities([t, b"a", t * 50])
    each = who.model.probabilities(who.model.states(language.windows_of([t])[0])).transpose(2, 0, 1).reshape(-1, 2)[:len(t)]
    assert np.allclose(p[0], each.mean(axis=0), atol=1e-5)
    labels = who.position_labels(t)
    assert len(labels) == len(t) and labels[:280].count("aa") > 270 and labels[-100:].count("zz") > 90
    assert who.position_labels(b"") == []


def test_edge_documents(spark):
    who = _identifier()
    df = docs(spark)
    got = language.predicted(df, who).collect()
    assert len(got) == len(ROWS)
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] in ("aa", "zz")) == letters and (letters or r["score"] == 0.0)
    kept = language.predicted(df, who, keep_from=0.0)
    assert kept.columns == df.columns and kept.dtypes == df.dtypes
    assert kept.count() == sum(any(c.isalpha() for c in r[1] or "") for r in ROWS)


def test_nothing_to_learn_and_nothing_to_predict(spark):
    none = language.train_identifier(docs(spark, []))
    assert none.languages == []
    got = language.predicted(docs(spark).select("doc_id", "text"), none).collect()
    assert {r["lang_pred"] for r in got} == {"und"}
    assert language.predicted(docs(spark, []).select("doc_id", "text"), _identifier()).count() == 0


def test_training_never_sees_held_out_rows(spark):
    from pyspark.sql import functions as F
    rows = [(i, "letters", "xx" if i % 2 else "yy", "s", 7) for i in range(400)]
    df = docs(spark, rows)
    marked = df.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "leak").otherwise(F.col("lang")))
    assert language.train_identifier(marked, per_language=40).languages == ["xx", "yy"]


def _sampled(monkeypatch):
    """What the network is given to learn: windows and classes."""
    got = {}
    monkeypatch.setattr(language.BiGRU, "train", lambda self, w, y, **_: got.update(w=w, y=y.tolist()))
    return got


def test_every_language_is_learned(spark, monkeypatch):
    got = _sampled(monkeypatch)
    rows = [(i, f"some letters {i}", f"l{i % 90:02}", "s", 7) for i in range(1800)]
    who = language.train_identifier(docs(spark, rows))
    assert who.languages == [f"l{k:02}" for k in range(90)] and set(got["y"]) == set(range(90))
    who = language.train_identifier(docs(spark, rows), in_all=180)
    assert len(who.languages) == 90
    assert [got["y"].count(k) for k in range(90)] == [2 * language.WINDOWS_PER_DOC] * 90
    p = who.document_probabilities([b"some letters", b"x" * 500])
    assert p.shape == (2, 90) and np.allclose(p.sum(axis=1), 1, atol=1e-4)


def test_repeated_ids_and_documents_leave_room_for_others(spark, monkeypatch):
    got = _sampled(monkeypatch)
    rows = [(1, "copied letters", "xx", "s", 7)] * 3000 + [(2, f"one id, text {i}", "xx", "s", 7) for i in range(50)]
    rows += [(i, f"some letters {i}", "yy" if i % 2 else "zz", "s", 7) for i in range(100, 300)]
    assert language.train_identifier(docs(spark, rows), per_language=20).languages == ["xx", "yy", "zz"]
    assert [got["y"].count(k) for k in range(3)] == [20 * language.WINDOWS_PER_DOC] * 3
    copied = sum(bytes(w).startswith(b"copied") for w in got["w"])
    assert copied <= language.WINDOWS_PER_DOC


def test_quantiles_of_all_scores(spark):
    r = np.random.default_rng(3)
    scores = {"a": r.random(5000), "b": np.round(r.random(300), 2), "c": np.array([0.25]), "d": np.array([1.0, 0.5]),
              "e": 1 - r.random(3000) * 1e-9, "f": np.full(700, 0.75), "g": np.array([0.0, 0.0, 1.0])}
    rows = [(k, float(x)) for k, v in scores.items() for x in v]
    df = spark.createDataFrame(rows, "l string, score double")
    for low in (0.01, 0.5, 0.0, 1.0):
        got = language.low_quantiles(df, low)
        assert got.keys() == scores.keys()
        for k, v in scores.items():
            assert abs(got[k] - np.quantile(v, low)) < 1e-12, (k, low)
    assert language.low_quantiles(df.where("l = ''")) == {}


def test_least_scores_take_all_held_out_documents(spark):
    """More held-out documents than a sample of DOCS_PER_LANGUAGE had."""
    from pyspark.sql import functions as F
    who = language.Identifier(None, ["xx", "yy", "zz"])
    df = (spark.range(8000).withColumns({
        "doc_id": F.col("id"), "text": F.concat(F.lit("letters "), "id"), "lang": F.expr("if(id % 2 = 0, 'xx', 'yy')"),
        "lang_pred": F.expr("if(id % 10 = 3, 'xx', lang)"), "score": F.expr("0.5 + pmod(xxhash64(id), 4999) / 10000D")}))
    rows = df.where(language.held_out(F.col("doc_id"))).where("lang = lang_pred").collect()
    own = {k: [r["score"] for r in rows if r["lang"] == k] for k in ("xx", "yy")}
    assert min(map(len, own.values())) > language.DOCS_PER_LANGUAGE
    own["zz"] = own["xx"] + own["yy"]  # no document of its own
    got = language.least_scores(df.union(df), who, name="test")
    for k, v in own.items():
        assert abs(got[k] - (1 / 3 + np.quantile(v, language.LOW)) / 2) < 1e-12
    kept = language.known(df, got).collect()
    assert {r["id"] for r in kept} == {r["id"] for r in df.collect() if r["score"] >= got[r["lang_pred"]]}
    assert language.known(df, {}).count() == 0
