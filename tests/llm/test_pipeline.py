"""The pipeline's stages, each against a plain model of its decision."""

import random

import corpus_pipeline
from fleetlog.llm import language
from fleetlog.llm.common import stored
from tests.llm.helpers import CLASHING, ROWS, docs, token_ids, words13
from tests.llm.test_decontaminate import model as contamination
from tests.llm.test_packing import _check
from tests.llm.test_simhash import model_components, model_print


def _fixture(spark, path):
    r = random.Random(7)
    english = [f"{a}{b}" for a in ("th", "wo", "fri", "lan", "her") for b in ("ing", "ed", "er", "tion", "ness")]
    german = [f"{a}{b}" for a in ("sch", "ver", "zur", "gross") for b in ("ung", "keit", "lich", "stück", "über")]
    text = lambda vocab, n: " ".join(r.choice(vocab) for _ in range(n)).capitalize() + "."
    rows = [(i, text(english if i % 3 else german, r.randint(30, 120)), "en" if i % 3 else "de", f"s{i % 5}", 0) for i in range(120)]
    item = text(english, 40)
    rows += [(200, rows[1][1], "en", "s9", 0), (201, rows[1][1].upper(), "en", "s9", 0), (202, "12345 !!!", "en", "s1", 0),
             (203, item + " " + text(english, 30), "en", "s1", 0), (204, text(english, 60) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "en", "s2", 0)]
    rows = [(i, t, lang, s, len(t)) for i, t, lang, s, _ in rows] + ROWS
    docs(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, [(1, item)]


def test_stages(spark, tmp_path):
    rows, items = _fixture(spark, str(tmp_path))
    sf = str(tmp_path)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "secrets", "packing"]
    before = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, before, sf)
        assert df.columns == before.columns and set(CLASHING) <= set(df.columns)
        before = stored(df, f"t-pipeline/{name}")
        kept[name] = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in before.collect()), key=str)
    lettered = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert {x[0] for x in kept["language"]} <= {r[0] for r in lettered}
    # clean documents of either language stay
    assert {r[0] for r in rows if r[0] is not None and 10 <= r[0] < 120} <= {x[0] for x in kept["language"]}

    prints = {(i, t): model_print(t) for i, t, _ in kept["language"]}
    root = model_components(prints.values())
    assert len(kept["near_duplicates"]) == len(set(root.values()))
    assert 1 in {x[0] for x in kept["near_duplicates"]} and not {200, 201} & {x[0] for x in kept["near_duplicates"]}

    assert kept["decontamination"] == [x for x in kept["near_duplicates"] if not contamination(x[1], items)[-1]]
    assert 203 not in {x[0] for x in kept["decontamination"]}

    for (i, t, n), (j, was, _) in zip(kept["secrets"], kept["decontamination"]):
        assert i == j and (t == was) == (i != 204)
        assert i != 204 or n == len(t)
    masked = next(t for i, t, _ in kept["secrets"] if i == 204)
    assert masked.endswith(' [secret]"') and words13(masked)[:60] == words13(dict((i, t) for i, t, _ in kept["decontamination"])[204])[:60]

    pieces = corpus_pipeline.STAGES[-1][1](spark, before, sf).collect()
    _check(pieces, [t for _, t, _ in kept["secrets"]])
    assert token_ids(["a"], 2)[0][-1] == 2
    assert language.UNKNOWN == "und"


def test_run_gives_the_last_stage(spark, tmp_path):
    rows, _ = _fixture(spark, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert 0 < got.count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark, tmp_path):
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_least_score_follows_the_number_of_languages(spark):
    r = random.Random(3)
    own = {"aa": "abab baba abba baab", "nn": "nono onno noon onon", "zz": "zyzy yzzy zzyy yzyz"}
    text = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(own[k].split(), 40), k, "s", 0) for i, k in enumerate([*own] * 60)]
    mixed = [(1000 + i, text(" ".join(own.values()).split(), 90), None, "s", 0) for i in range(10)]
    kept = {x["doc_id"] for x in corpus_pipeline.known_language(spark, docs(spark, rows + mixed), "").collect()}
    assert kept == {x[0] for x in rows}
