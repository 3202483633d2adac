"""Decontamination against a plain search."""

import hashlib
import random

from fleetlog.llm import decontaminate
from tests.llm.helpers import docs, words13


def model(text, items):
    words = words13(text)
    hit, found = set(), set()
    for item, t in items:
        own = words13(t)
        if not own:
            continue
        for i in range(max(1, len(own) - 12)):
            w = own[i:i + 13]
            for at in range(len(words) - len(w) + 1):
                if words[at:at + len(w)] == w:
                    hit.update(range(at, at + len(w)))
                    if item is not None:  # its words are hit, there is no id to list
                        found.add(str(item))
    return (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
            bool(hit) and 20 * len(hit) >= len(words))


def _case(seed=1):
    r = random.Random(seed)
    vocab = ["the", "of", "Über", "x1", "9", "naïve", "end"] + [f"w{i}" for i in range(12)]
    sentence = lambda n: " ".join(r.choice(vocab) + r.choice(["", ",", ".", "!"]) for _ in range(n))
    items = [(i, sentence(n)) for i, n in enumerate([1, 2, 5, 12, 13, 14, 30, 60, 30])]
    items += [(9, items[6][1]), (9, items[6][1]), (10, ""), (11, None), (12, "!!"), (None, sentence(20)), (100, items[7][1].upper())]
    texts = [sentence(n) for n in (0, 1, 3, 50, 400)]
    for _, t in items[4:9]:
        texts += [sentence(20) + " " + t + " " + sentence(10), sentence(3) + "\n" + " ".join(t.split()[3:20]), t * 2,
                  t.split()[0], sentence(600) + " " + t]
    texts += [None, "", "---", sentence(5) + " " + items[-2][1]]
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(0, texts[3], None, None, None), (None, texts[6], "en", "s", 1)], items


def _bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS hits", "1 AS doc_id")


def _found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])
                   for r in df.collect()), key=str)


def test_query_against_the_model(spark, tmp_path):
    rows, items = _case()
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    _bench(spark, items).write.parquet(str(tmp_path / "benchmark.parquet"))
    small = decontaminate.BLOCK_WORDS
    decontaminate.BLOCK_WORDS = 700
    try:
        got = _found(decontaminate.op7_decontamination(spark, str(tmp_path)))
    finally:
        decontaminate.BLOCK_WORDS = small
    assert got == sorted(((r[0], *model(r[1], items)) for r in rows), key=str)


def test_slices_of_the_test_set_give_the_same(spark):
    rows, items = _case(2)
    keep = ["doc_id", "n_words", "n_hit", "n_items", "contaminated"]
    one = decontaminate.contamination(docs(spark, rows), _bench(spark, items), "t-dec")
    many = decontaminate.contamination(docs(spark, rows), _bench(spark, items), "t-dec", slice_words=60)
    a, b = (sorted((tuple(r[c] for c in keep) + (tuple(sorted(r["items"])),) for r in f.collect()), key=str) for f in (one, many))
    assert a == b


def test_proximity_without_the_phrase(spark):
    item = "alpha common beta common gamma common delta"
    rows = [(1, "delta x gamma y beta z alpha", "en", "s", 0), (2, "alpha " + "x " * 200 + "beta gamma delta", "en", "s", 0),
            (3, item, "en", "s", 0)] + [(10 + i, "common " * 30, "en", "s", 0) for i in range(3)]
    got = {r["doc_id"]: (r["near"], r["items"]) for r in decontaminate.contamination(
        docs(spark, rows), _bench(spark, [(7, item)]), "t-near").collect()}
    assert got[1] == ([7], []) and got[2] == ([], []) and got[3] == ([], [7]) and got[10] == ([], [])


def test_only_contaminated_rows_go(spark):
    rows, items = _case(3)
    kept = decontaminate.decontaminated(docs(spark, rows), _bench(spark, items), "t-keep")
    assert kept.columns == docs(spark, rows).columns
    assert (sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
            == sorted(((r[0], r[1]) for r in rows if not model(r[1], items)[-1]), key=str))


def test_empty_tables(spark):
    rows, items = _case(4)
    assert decontaminate.contamination(docs(spark, []), _bench(spark, items), "t-e").count() == 0
    got = decontaminate.contamination(docs(spark, rows), _bench(spark, []), "t-e").collect()
    assert len(got) == len(rows) and not any(r["contaminated"] or r["n_hit"] for r in got)


def test_words_of_items_without_an_id_are_hit(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, passage, "en", "s", 0), (2, "x " * 30 + passage, "en", "s", 0), (3, "x " * 30, "en", "s", 0)]
    items = [(None, passage), (5, " ".join(passage.split()[:13])), (None, None), (None, "!!")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    _bench(spark, items).write.parquet(str(tmp_path / "benchmark.parquet"))
    of = lambda *ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    assert _found(decontaminate.op7_decontamination(spark, str(tmp_path))) == [
        (1, 20, 20, 1, of("5"), True), (2, 50, 20, 1, of("5"), True), (3, 30, 0, 0, of(), False)]
    kept = decontaminate.decontaminated(docs(spark, rows), _bench(spark, [(None, passage)]), "t-null")
    assert [r["doc_id"] for r in kept.collect()] == [3]
