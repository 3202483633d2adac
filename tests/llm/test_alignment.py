"""Cross-tokenizer alignment against whole texts, byte by byte."""

import hashlib
import random
from collections import Counter
from functools import lru_cache

import pytest

from fleetlog.llm import alignment
from tests.llm import helpers


@lru_cache(1)
def tools():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in plain]
    back = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}
    return a, b, back


def plain(text):
    """(n_a, n_b, n_groups, groups, linked id pairs): every byte of the whole
    text names its token on either side."""
    if not text:
        return None
    a, b, back = tools()
    raw = (" " + text).encode()
    code = a.encode(" " + text, add_special_tokens=False)
    a_bytes = [bytes(back[c] for c in t) for t in code.tokens]
    b_ids = b.encode(text, num_threads=1)
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
               for i, p in ((i, b.id_to_piece(i)) for i in b_ids)]
    if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return None
    owner_a = [k for k, t in enumerate(a_bytes) for _ in t]
    owner_b = [k for k, t in enumerate(b_bytes) for _ in t]
    links = sorted(set(zip(owner_a, owner_b)))
    groups, ga, gb = [], [], []
    for at in range(len(raw)):
        if owner_a[at] not in ga:
            ga.append(owner_a[at])
        if owner_b[at] not in gb:
            gb.append(owner_b[at])
        last = at + 1 == len(raw)
        if last or owner_a[at] != owner_a[at + 1] and owner_b[at] != owner_b[at + 1]:
            groups.append(",".join(str(code.ids[k]) for k in ga) + "|" + ",".join(str(b_ids[k]) for k in gb))
            ga, gb = [], []
    return (len(a_bytes), len(b_bytes), len(groups), ";".join(groups), [(code.ids[x], b_ids[y]) for x, y in links])


def model(rows):
    """The query's rows."""
    found = [(i, plain(t)) for i, t in rows]
    counts = Counter(p for _, f in found if f for p in set(f[4]))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((i, f[0], f[1], f[2], len(f[4]), sum(counts[p] == best[p[0]] for p in f[4]),
                        sum(counts[p] for p in f[4]), hashlib.sha256(f[3].encode()).hexdigest()))
    return sorted(out, key=repr)


AWKWARD = [
    "  two  spaces   and\ttabs \n lines \r\n\r\n end ", "▁ literal", " nbsp em 　wide", "a<|endoftext|>b <s> </s> <unk> <0x41>",
    "\U0001F600\U0001F468‍\U0001F469‍\U0001F467 faḿily", "\x00\x01 \x1c\x1d x\x85y", "don't we'll 's 't 123 4567", "x" * 5000,
    "你好，世界 대한민국 नमस्ते", "ﬁ ﷺ ａｂｃ", " ", "  ", "\n", "a", "é", "tail ",
]


def rows_of(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                                               "groups_sha256").collect()], key=repr)


def digest(df):
    from pyspark.sql import functions as F
    return df.withColumn("groups_sha256", F.coalesce(F.sha2("groups", 256), F.lit("")))


def test_words_give_what_whole_texts_give():
    one = alignment.Aligner(*alignment.read_files())
    assert one.by_word
    rng = random.Random(3)
    letters = "ab cd  \n\t.,'1é你\U0001F600  \x1c-"
    texts = AWKWARD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for t in texts:
        p, got = plain(t), one(t)
        if p is None:
            assert got is None, t
        else:
            assert got[:4] == p[:4], t
            assert sorted((k >> 32, k & 0xFFFFFFFF) for k in got[4].tolist()) == sorted(p[4]), t


def test_a_full_cache_is_emptied(monkeypatch):
    one = alignment.Aligner(*alignment.read_files())
    monkeypatch.setattr(alignment, "CACHE_WORDS", 3)
    for t in ("one two three four five", "six seven one two", "x" * 400):
        assert one(t)[:4] == plain(t)[:4]
    assert len(one.cache) <= 5


def test_words_met_again_outlive_a_full_cache(monkeypatch):
    one = alignment.Aligner(*alignment.read_files())
    monkeypatch.setattr(alignment, "CACHE_WORDS", 8)
    learned = []
    align = one.align
    monkeypatch.setattr(one, "align", lambda words: learned.extend(words) or align(words))
    for k in range(6):
        texts = [f"the and new{k} word{k}"]
        one.prepare([one.words(t) for t in texts])
        assert one(texts[0])[:4] == plain(texts[0])[:4]
    assert learned.count("the") == learned.count("and") == 1
    assert len(one.cache) + len(one.old) <= 8


def test_words_with_marks_and_lines_are_put_together(monkeypatch):
    one = alignment.Aligner(*alignment.read_files())
    assert one.by_part
    learned = []
    align = one.align
    monkeypatch.setattr(one, "align", lambda words: learned.extend(words) or align(words))
    texts = ["word word, word. other, Été!! word.\nother,", "a, a a.\nb. b,\n\nword's. don't... '',", "word\n other\n", "▁x, y.\n▁"]
    for t in texts + ["\n".join(texts), "x" * 300 + ", " + "y" * 300 + ".\nz."]:
        p, got = plain(t), one(t)
        assert (got and got[:4]) == (p and p[:4]), t
    assert learned.count("word") == learned.count("other") == learned.count("a,") == 1
    assert not {"word,", "word.", "other,", "word.\nother,"} & set(learned)


@pytest.mark.parametrize("most", [1_000_000, 20, 0])
def test_counts_match_the_model(spark, most):
    rows = [r[:2] for r in helpers.ROWS if r[0] != 7] + [(100 + i, t) for i, t in enumerate(AWKWARD)]
    rows += [(7, helpers.LONG[:3000])] * 3
    df = helpers.docs(spark, [(i, t, "en", "a", 0) for i, t in rows]).repartition(3)
    assert rows_of(digest(alignment.align_documents(df, most=most))) == model(rows)


def test_empty_table_and_long_text(spark):
    assert alignment.align_documents(helpers.docs(spark, [])).count() == 0
    one = alignment.Aligner(*alignment.read_files())
    got = one(helpers.LONG)
    assert got[0] >= 9000 * 9 and b"".join(one.a_bytes[int(x)] for g in got[3].split(";")
                                           for x in g.split("|")[0].split(",")) == (" " + helpers.LONG).encode()


def test_query_on_the_table(spark, sf_small):
    got = rows_of(alignment.op13_alignment(spark, sf_small))
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    assert got == model([tuple(r) for r in docs])
