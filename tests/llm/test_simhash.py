"""SimHash against plain models."""

import random
import re

import numpy as np
import xxhash

from fleetlog.llm import simhash
from fleetlog.llm.common import stored
from tests.llm.helpers import CLASHING, ROWS, docs


def model_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def model_components(codes, radius=3):
    codes = sorted(set(codes))
    up = {c: c for c in codes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    a = np.array(codes, dtype=np.uint64)
    for i, c in enumerate(codes):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= radius):
            x, y = find(c), find(codes[i + 1 + int(j)])
            up[max(x, y)] = min(x, y)
    return {c: find(c) for c in codes}


def _expect(rows):
    prints = [(r[0], model_print(r[1])) for r in rows]
    root = model_components([p for _, p in prints])
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return sorted(((i, f"{p:016x}", least.get(root[p])) for i, p in prints), key=str)


def test_edge_documents(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.op4_simhash(spark, str(tmp_path)).collect()), key=str)
    assert got == _expect(ROWS)


def test_table_against_the_model(spark, sf_small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.op4_simhash(spark, sf_small).collect()), key=str)
    assert got == _expect(rows)


def _codes(spark, codes):
    return stored(spark.createDataFrame([(i, 0, simhash._signed(c)) for i, c in enumerate(codes)],
                                        "doc_id long, text_hash long, fp long"), "t-codes")


def _components(spark, codes, **kw):
    prints = _codes(spark, codes)
    found = simhash.components(prints, name="t-simhash", **kw).collect()
    return {r["doc_id"]: r["component_id"] for r in found}


def _clusters(seed, n=400):
    r = random.Random(seed)
    out = []
    for _ in range(6):
        center = r.getrandbits(64)
        for _ in range(n // 6):
            c = center
            for b in r.sample(range(64), r.randint(0, 5)):
                c ^= 1 << b
            out.append(c)
    out += [r.getrandbits(64) for _ in range(n // 4)] + [0, 0, 1, (1 << 64) - 1]
    # a chain, each three bits from the one before
    c = r.getrandbits(64)
    for k in range(20):
        c ^= 0b111 << (3 * k)
        out.append(c)
    return out


def _model(codes):
    root = model_components(codes)
    least = {}
    for i, c in enumerate(codes):
        least[root[c]] = min(i, least.get(root[c], i))
    return {i: least[root[c]] for i, c in enumerate(codes)}


def test_dense_groups_and_chains(spark):
    codes = _clusters(1)
    assert _components(spark, codes) == _model(codes)


def test_full_shards_are_dealt_again_and_chunked(spark):
    """With a tiny limit every level and the chunk pairs are used."""
    codes = _clusters(2, 240)
    prints = _codes(spark, codes)
    edges = simhash.link_edges(prints.select("fp").distinct(), limit=6, name="t-links")
    up = {c: c for c in codes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for e in edges.collect():
        u, v = e["u"] & (1 << 64) - 1, e["v"] & (1 << 64) - 1
        assert (u ^ v).bit_count() <= 3
        up[find(u)] = find(v)
    want = model_components(codes)
    assert len({find(c) for c in codes}) == len(set(want.values()))
    for a in codes:
        assert find(a) == find(want[a])


def test_tree_search_meets_every_component():
    r = random.Random(4)
    for _ in range(20):
        codes = sorted({r.getrandbits(10) << 3 for _ in range(r.randint(1, 200))})
        r.shuffle(codes)
        edges = simhash.shard_edges([(0, c) for c in codes])
        assert len(edges) == len(codes) - len(set(model_components(codes).values()))
        cut = len(codes) // 2
        edges = simhash.shard_edges([(1, c) for c in codes[:cut]] + [(2, c) for c in codes[cut:]])
        assert all((a ^ b).bit_count() <= 3 for a, b in edges)


def test_one_row_of_each_component_stays(spark):
    kept = simhash.one_of_each(docs(spark), "t-one")
    assert kept.columns == docs(spark).columns and set(CLASHING) <= set(kept.columns)
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    prints = [(r[0], r[1], model_print(r[1])) for r in ROWS]
    root = model_components([p for *_, p in prints])
    groups = {}
    for i, t, p in prints:
        groups.setdefault(root[p], set()).add((i, t))
    assert len(got) == len(groups)
    for own in groups.values():
        ids = [i for i, _ in own if i is not None]
        chosen = [g for g in got if g in own]
        assert len(chosen) == 1 and chosen[0][0] == (min(ids) if ids else None)


def test_empty_table(spark, tmp_path):
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert simhash.op4_simhash(spark, str(tmp_path)).count() == 0
    assert simhash.one_of_each(docs(spark, []), "t-one").count() == 0
