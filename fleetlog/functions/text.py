"""Text analyzers as Catalyst expressions (no UDF on the text).

``porter`` analyzer (what full-text search indexes):
  tokens are runs of ASCII letters, digits, ``_`` and any non-ASCII
  character; only ASCII letters are case-folded; no stop words.  Tokens of
  3..20 lower-case letters are stemmed (Porter, see :mod:`.stem`); every
  other token is kept as is, except that a token holding a digit and longer
  than 6 keeps its first 3 and last 3 characters, and one without a digit
  longer than 20 keeps its first and last 10.

``words`` analyzer (the hand-written inverted index):
  lower-case, split on whitespace and then on runs of ``=`` / ``,``, strip
  ASCII punctuation at both ends, drop tokens shorter than 3 and stop
  words; stem with the English (Porter2) stemmer; a token that is not
  alphanumeric also yields its sub-tokens, split at punctuation (a
  punctuation character ends a sub-token and is dropped, a second one in a
  row starts the next sub-token), filtered and stemmed the same way; an
  alphanumeric token starting with ``0x`` also yields itself without it.

``path`` analyzer: lower-case, ``\\`` -> ``/``, split on ``/``, drop empty parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that separate porter tokens are the ASCII
# characters other than letters, digits and underscore.
PORTER_TOKEN_RE = r"[^\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+"
PORTER_DELIM_RE = r"[\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
STEMMABLE_RE = "^[a-z]{3,20}$"

# Stop words of the words analyzer, in their original order.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "can",
              "for", "from", "have", "if", "in", "is", "it", "may",
              "not", "of", "on", "or", "tbd", "that", "the", "this",
              "to", "us", "we", "when", "will", "with", "yet",
              "you", "your", "beg", "end")
MIN_TOKEN_SIZE = 3
# Whitespace as Python's str.split() sees it.
WHITESPACE_RE = (r"[\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                 r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")
DELIMITER_RE = "[=,]+"
# Splitting on whitespace and then on runs of = and , gives the same
# non-empty pieces as one split on either.
WORD_SPLIT_RE = WHITESPACE_RE[:-2] + "=,]+"
# ASCII punctuation (Python's string.punctuation) as a character class.
PUNCT_CLASS = r"[!-/:-@\[-`{-~]"
PUNCT_CHARS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STRIP_PUNCT_RE = f"^{PUNCT_CLASS}+|{PUNCT_CLASS}+$"
ALNUM_RE = r"^[\p{L}\p{N}]+$"
SUBTOKEN_RE = r"(?s)(.\P{Punct}*)\p{Punct}?"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_lower(text: Column | str) -> Column:
    return F.translate(_c(text), ASCII_UPPER, ASCII_LOWER)


def _only_chars(tok: Column, chars: str) -> Column:
    """True when tok consists of the given characters only (no regex)."""
    return F.length(F.translate(tok, chars, "")) == 0


def _has_any(tok: Column, chars: str) -> Column:
    return F.length(F.translate(tok, chars, "")) < F.length(tok)


def is_stemmable(tok: Column) -> Column:
    """3..20 lower-case ASCII letters: the tokens Porter stems."""
    n = F.length(tok)
    return (n >= 3) & (n <= 20) & _only_chars(tok, ASCII_LOWER)


def porter_cut(tok: Column) -> Column:
    """The copy rule for tokens the Porter stemmer does not take: a token
    with a digit longer than 6 keeps its first and last 3 characters, one
    longer than 20 its first and last 10.  Tokens the stemmer takes (3..20
    letters) never meet either condition."""
    n = F.length(tok)
    digit = _has_any(tok, "0123456789")
    return (F.when(n <= 6, tok)
            .when(digit, F.concat(F.substring(tok, 1, 3), F.substring(tok, -3, 3)))
            .when(n > 20, F.concat(F.substring(tok, 1, 10), F.substring(tok, -10, 10)))
            .otherwise(tok))


def porter_tokens(text: Column | str) -> Column:
    """Ordered token array (positions matter for phrase / near), before
    stemming; the copy rule is already applied.  Tokens are the non-empty
    pieces between runs of delimiters."""
    raw = F.filter(F.split(ascii_lower(text), PORTER_DELIM_RE), lambda x: x != "")
    return F.transform(raw, porter_cut)


def porter_query_term(word: str) -> str:
    """Analyze one query word on the driver, the same way (unstemmed)."""
    import re
    toks = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+",
                      word.translate(str.maketrans(ASCII_UPPER, ASCII_LOWER)))
    if len(toks) != 1:
        raise ValueError(f"not a single token: {word!r}")
    t = toks[0]
    if re.fullmatch("[a-z]{3,20}", t):
        return t
    digit = any(ch.isdigit() and ch.isascii() for ch in t)
    if digit and len(t) > 6:
        return t[:3] + t[-3:]
    if not digit and len(t) > 20:
        return t[:10] + t[-10:]
    return t


def _keep(tok: Column) -> Column:
    return (F.length(tok) >= MIN_TOKEN_SIZE) & ~tok.isin(*STOP_WORDS)


def word_tokens(text: Column | str) -> Column:
    """Main tokens of the words analyzer, unstemmed, in order (may repeat)."""
    pieces = F.split(F.lower(_c(text)), WORD_SPLIT_RE)
    stripped = F.transform(pieces, lambda p: F.btrim(p, F.lit(PUNCT_CHARS)))
    return F.filter(stripped, _keep)


def is_alnum(tok: Column) -> Column:
    """Letters and digits only (Unicode).  ASCII tokens -- nearly all --
    are checked without a regex."""
    ascii_ = F.octet_length(tok) == F.length(tok)
    return (F.when(ascii_, (F.length(tok) > 0) & _only_chars(tok, ASCII_LOWER + ASCII_UPPER + "0123456789"))
            .otherwise(tok.rlike(ALNUM_RE)))


def sub_tokens(tok: Column) -> Column:
    """Sub-tokens of one token split at punctuation, size / stop filtered."""
    subs = F.regexp_extract_all(tok, F.lit(SUBTOKEN_RE), 1)
    return F.filter(subs, _keep)


def expand_tokens(tokens: Column) -> Column:
    """The set a token list indexes: the tokens, the sub-tokens of the
    non-alphanumeric ones and ``0x``-less forms of ``0x`` tokens."""
    extra = F.flatten(F.transform(tokens, lambda t: (
        F.when(~is_alnum(t), sub_tokens(t))
        .when(t.startswith("0x"), F.array(F.substring(t, 3, 1 << 30)))
        .otherwise(F.array().cast("array<string>")))))
    return F.array_distinct(F.concat(tokens, extra))


def path_tokens(path: Column | str) -> Column:
    parts = F.split(F.replace(F.lower(_c(path)), F.lit("\\"), F.lit("/")), "/")
    return F.array_distinct(F.filter(parts, lambda p: p != ""))
