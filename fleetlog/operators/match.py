"""Match queries over a stored index, any number of them in one pass.

A query is put together from Python values, there is no query text to parse:

    phrase("error", "user")          consecutive words; one word is a term
    phrase("sign*")                  a word ending in ``*`` is a prefix
    near("click", phrase("user", "9"), k=3)
                                     at most k words between neighbours of the chain, either way round
    a & b, a | b, a - b              AND, OR, AND NOT, nested at will

:func:`match` reads the postings of all words of all queries once (one filter that
reaches the row groups), shuffles them once by ids and tests every query there.
Terms and prefixes are flags, so queries without positions are pre-aggregated
before the shuffle.  Phrases and chains compare positions by range windows over
(ids, pos), whose frames hold at most as many words as the distance asked for: no
position lists and no pairs of occurrences are made, however long a text is.

A chain holds from left to right: an occurrence of a member counts if it ends
within reach of a counting occurrence of the member before.  Distances are taken
between the words that end the occurrences, and an occurrence is not near itself.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import NEAR_DEFAULT, Index


class Query:
    def __and__(self, other: Query) -> Query:
        return Both(self, other)

    def __or__(self, other: Query) -> Query:
        return Either(self, other)

    def __sub__(self, other: Query) -> Query:
        return ButNot(self, other)


@dataclass(frozen=True)
class Chain(Query):
    """Phrases, each within ``k`` words of the one before; a single phrase is
    a chain of one."""

    phrases: tuple[tuple[str, ...], ...]
    k: int = NEAR_DEFAULT

    @property
    def positional(self) -> bool:
        return len(self.phrases) > 1 or len(self.phrases[0]) > 1


@dataclass(frozen=True)
class Both(Query):
    a: Query
    b: Query


@dataclass(frozen=True)
class Either(Query):
    a: Query
    b: Query


@dataclass(frozen=True)
class ButNot(Query):
    a: Query
    b: Query


def phrase(*words: str) -> Chain:
    if not words or not all(w.rstrip("*") for w in words):
        raise ValueError("a phrase needs words")
    return Chain((words,))


def near(*members: str | Chain, k: int = NEAR_DEFAULT) -> Chain:
    """Members are words or phrases."""
    if len(members) < 2 or k < 0:
        raise ValueError("a chain needs two members and a distance of 0 or more")
    parts = [phrase(m) if isinstance(m, str) else m for m in members]
    if any(len(p.phrases) > 1 for p in parts):
        raise ValueError("the members of a chain are words and phrases")
    return Chain(tuple(p.phrases[0] for p in parts), k)


def _chains(q: Query) -> list[Chain]:
    return [q] if isinstance(q, Chain) else _chains(q.a) + _chains(q.b)


def _condition(q: Query, flag: Mapping[Chain, str]) -> Column:
    if isinstance(q, Chain):
        return F.col(flag[q])
    a, b = _condition(q.a, flag), _condition(q.b, flag)
    return a & b if isinstance(q, Both) else a | b if isinstance(q, Either) else a & ~b


def _tests(index: Index, chains: list[Chain]) -> dict[str, Column]:
    """A test on the ``word`` column for every different word asked for."""
    words = dict.fromkeys(w for c in chains for p in c.phrases for w in p)
    as_held = index.analyzed(list(dict.fromkeys(w.rstrip("*") for w in words)))
    out = {}
    for word in words:
        q = F.lit(as_held[word.rstrip("*")])
        out[word] = F.col("word").startswith(q) if word.endswith("*") else F.col("word") == q
    return out


def match(index: Index, queries: Mapping[str, Query]) -> DataFrame:
    """(query, ids...): the ids every named query hits, each once.  No query
    gives no rows."""
    ids = list(index.ids)
    if not queries:
        return index.frame.select(F.lit("").alias("query"), *ids).limit(0)
    chains = list(dict.fromkeys(c for q in queries.values() for c in _chains(q)))
    tests = _tests(index, chains)
    hits = index.frame.where(reduce(lambda a, b: a | b, tests.values()))
    col = {w: f"__fl_w{i}" for i, w in enumerate(tests)}
    hits = hits.select(*ids, "pos", *[t.alias(col[w]) for w, t in tests.items()])
    at = Window.partitionBy(*ids).orderBy("pos")

    def within(name: str, first: int, last: int) -> Column:
        return F.coalesce(F.max(name).over(at.rangeBetween(first, last)), F.lit(False))

    # where an occurrence of a phrase ends
    ends = {p: col[p[0]] if len(p) == 1 else f"__fl_p{i}" for i, p in enumerate(
        dict.fromkeys(p for c in chains for p in c.phrases))}
    hits = hits.withColumns({name: reduce(lambda a, b: a & b, [F.col(col[p[-1]])] + [
        within(col[w], -j, -j) for j, w in enumerate(reversed(p[:-1]), 1)]) for p, name in ends.items() if len(p) > 1})
    flag = {}
    for i, c in enumerate(chains):
        flag[c] = ends[c.phrases[0]]
        for j, (a, b) in enumerate(zip(c.phrases, c.phrases[1:])):
            reach = (within(flag[c], -(c.k + len(b)), -1) | within(flag[c], 1, c.k + len(a)))
            hits = hits.withColumn(f"__fl_c{i}_{j}", F.col(ends[b]) & reach)
            flag[c] = f"__fl_c{i}_{j}"
    seen = hits.groupBy(*ids).agg(*[F.max(f).alias(f) for f in dict.fromkeys(flag.values())])
    named = F.array_compact(F.array(*[F.when(_condition(q, flag), F.lit(n)) for n, q in queries.items()]))
    return seen.select(F.explode(named).alias("query"), *ids)
