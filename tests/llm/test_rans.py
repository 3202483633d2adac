"""Token files: exact round trip, parallel decoding, the query's digest."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from fleetlog.llm import rans
from fleetlog.llm.common import WordEncoder, stored, token_rows, tokenizer_json
from tests.llm.helpers import LONG, ROWS, docs, ids_crc, ordered, token_ids


def _coder(ids):
    syms, n = np.unique(ids, return_counts=True)
    return rans.Coder(syms.astype(np.int64), rans.normalized(syms.astype(np.int64), n))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 49407), min_size=1, max_size=400), st.integers(1, 64))
def test_block_round_trip(ids, lanes):
    ids = np.array(ids, dtype="<u4")
    c = _coder(ids)
    got_lanes, check, words = c.encode(ids, lanes)
    assert (c.decode(len(ids), got_lanes, check, words) == ids).all()


def test_decoding_begins_at_any_checkpoint():
    rng = np.random.default_rng(3)
    ids = (rng.zipf(1.3, 70_000) % 49_000).astype("<u4")
    c = _coder(ids)
    lanes, check, words = c.encode(ids, 16)
    assert len(check) // (8 * (lanes + 1)) == -(-len(ids) // lanes // rans.CHECK_STEPS)
    for lo, hi in ((0, 5), (1, 70_000), (33_000, 33_001), (69_999, 70_000), (20_000, 40_000)):
        assert (c.decode(len(ids), lanes, check, words, lo, hi) == ids[lo:hi]).all()
    p = np.bincount(ids) / len(ids)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * len(ids) / 8
    assert len(words) < 1.02 * entropy + 8 * lanes


def test_frequencies_are_exact():
    n = np.array([1, 1, 10**9, 5])
    f = rans.normalized(np.arange(4), n)
    assert f.sum() == 1 << rans.SCALE and f.min() >= 1
    assert len(rans.normalized(np.zeros(0), np.zeros(0))) == 0


def test_word_encoder_equals_the_tokenizer():
    import random
    r = random.Random(1)
    parts = ["the", "The", "THE", "don't", "I'LL", "'s", "x's.", "...", ".,", "<|endoftext|>", "<|ENDOFTEXT|>", "é", "É",
             "é", "́", "ﬁ", "ΣΑΣ", "İI", " ", "　", "12,34", "a.b", "word!!", "word***", "\x85",
             "\x1c", "日本語", "\U0001F600", "ß.", "thou.", "Thou,", "a" * 300]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", "\n", "\t", "  "]) for _ in range(r.randint(0, 30)))
             for _ in range(300)] + [r[1] for r in ROWS] + [LONG]
    enc = WordEncoder(tokenizer_json())
    got = enc([t.encode() if t is not None else None for t in texts])
    want = [np.asarray(ids[:-1], dtype="<u4").tobytes() for ids in token_ids(texts, 0)]
    assert got == want


def test_files_hold_what_was_written(spark):
    d = docs(spark)
    blocks_before = rans.BLOCK_TOKENS
    rans.BLOCK_TOKENS = 40
    try:
        freq, blocks = rans.encode_corpus(stored(token_rows(d, end_id=1, width=2), "t"), "t-rans", width=2)
    finally:
        rans.BLOCK_TOKENS = blocks_before
    got = rans.decode_corpus(freq, blocks).orderBy("part", "block", "ordinal").collect()
    want = ordered([(r[0], r[1] or "") for r in ROWS])
    ids = token_ids([t for _, t in want], 1)
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert (sorted(((r["doc_id"], bytes(r["ids"])) for r in got), key=key)
            == sorted(((i, np.asarray(x, "<u4").tobytes()) for (i, _), x in zip(want, ids)), key=key))
    assert len({(r["part"], r["block"]) for r in got}) > 1


def test_a_damaged_block_is_noticed(spark):
    from pyspark.sql import functions as F
    freq, blocks = rans.encode_corpus(stored(token_rows(docs(spark, ROWS[:1])), "t"), "t-rans")
    bad = blocks.withColumn("words", F.expr("concat(substring(words, 1, 3), X'5A', substring(words, 5))"))
    with pytest.raises(Exception, match="checksum"):
        rans.decode_corpus(freq, bad).collect()


def test_query_digest(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = rans.op1_token_ids(spark, str(tmp_path)).orderBy("start").collect()
    want = ordered([(r[0], r[1] or "") for r in ROWS])
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = token_ids([t for _, t in want], 1)
    assert (sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((len(x), ids_crc(x)) for x in ids))


def test_empty_table(spark, tmp_path):
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert rans.op1_token_ids(spark, str(tmp_path)).count() == 0
