"""Small inputs with every awkward case, and plain models of the contracts."""

import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use inside
CLASHING = ["ids", "fp", "text_hash", "part", "block", "value", "hits", "score", "lang_pred", "owner", "shard", "slot",
            "class", "row", "key", "n", "spans", "live", "repository"]
LONG = "The quick brown fox jumps over the lazy dog. " * 9000

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away.", "en", "a", 58),
    (2, "The quick brown fox jumps over the lazy dog and runs away.", "en", "b", 58),
    (2, "The quick brown fox jumps over the lazy dog and runs away.", "en", "b", 58),
    (3, "", "en", "a", 0),
    (4, None, None, None, None),
    (5, " \n\t ", "en", "", 4),
    (6, "x", "de", "a", 1),
    (None, "A document without an id, über alles.", "de", "c", 37),
    (None, None, None, None, None),
    (7, LONG, "en", "a", len(LONG)),
    (8, "12345 67890 !!!", "fr", "b", 15),
    (9, "Ünïcödé \U0001F600 text with odd\x1cspaces <|endoftext|> and don't", "fr", "b", 60),
    (9, "another text of the same id", "fr", "b", 27),
]


def docs(spark, rows=None, clash=True):
    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    if clash:
        df = df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHING])
    return df


def ordered(rows):
    """Ascending doc_id, null first, then by text."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def token_ids(texts, end_id):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [tok.encode(t or "", add_special_tokens=False).ids + [end_id] for t in texts]


def ids_crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def words13(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
