"""Packing: every id in one piece, no gaps, little padding."""

import numpy as np
import pytest

from fleetlog.llm import packing
from tests.llm.helpers import LONG, ROWS, docs, ids_crc, token_ids


def _check(rows, texts, capacity=packing.CAPACITY):
    ids = token_ids(texts, 2)
    pieces = {}
    for r in rows:
        pieces.setdefault(r["sequence_id"], []).append(r)
    for own in pieces.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
    # every position of every text lies in one piece: texts of one length are told apart by their ids
    of_length, cover = {}, {}
    for x in ids:
        of_length.setdefault(len(x), []).append(x)
    for r in rows:
        lo, hi = r["start"], r["start"] + r["length"]
        same = {tuple(x) for x in of_length[r["doc_tokens"]] if ids_crc(x[lo:hi]) == r["ids_crc32"]}
        assert same
        cover.setdefault((r["doc_id"], r["doc_tokens"]), []).append((lo, hi))
    found = 0
    for (_, n), parts in cover.items():
        count = np.zeros(n, dtype=int)
        for lo, hi in parts:
            count[lo:hi] += 1
        assert (count == count[0]).all()
        found += count[0]
    assert found == len(ids) and sum(r["length"] for r in rows) == sum(map(len, ids))
    return pieces


def test_edge_documents(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = packing.op3_packing(spark, str(tmp_path)).collect()
    assert LONG and any(r["doc_tokens"] > 4096 for r in rows)
    _check(rows, [r[1] for r in ROWS])


def test_documents_of_the_table(spark, sf_small):
    df = packing.op3_packing(spark, sf_small)
    rows = df.collect()
    texts = [r["text"] for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("text").collect()]
    pieces = _check(rows, texts)
    used = sum(r["length"] for r in rows)
    assert len(pieces) <= -(-used // 4096) * 1.005 + 1


def test_sequences_are_assembled_in_order(spark):
    packed = packing.pack_documents(docs(spark), "t-pack")
    got = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    rows = packed.select("sequence_id", "offset", "ids").collect()
    for r in rows:
        assert got[r["sequence_id"]][4 * r["offset"]:4 * r["offset"] + len(r["ids"])] == bytes(r["ids"])
    assert sum(map(len, got.values())) == sum(len(r["ids"]) for r in rows)


def test_empty_table(spark, tmp_path):
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert packing.op3_packing(spark, str(tmp_path)).count() == 0


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(30):
        slots = int(rng.integers(3, 40))
        prices = np.where(rng.random(slots) < 0.5, rng.random(slots), 0)
        best = np.zeros(slots + 1)
        for room in range(1, slots + 1):
            best[room] = max([best[room - 1], *(best[room - k] + prices[k - 1] for k in range(1, room + 1))])
        value, pattern = packing.best_pattern(prices, slots)
        assert abs(value - best[slots]) < 1e-9
        assert sum(k * n for k, n in pattern.items()) <= slots
        assert abs(sum(prices[k - 1] * n for k, n in pattern.items()) - value) < 1e-9


def test_plan_meets_every_demand_near_the_bound():
    rng = np.random.default_rng(9)
    for slots in (16, 64):
        demand = {int(k): int(n) for k, n in zip(rng.choice(slots, 10, replace=False) + 1, rng.integers(1, 4000, 10))}
        made, sequences = {}, 0
        for pattern, times in packing.plan(demand, slots):
            assert sum(k * n for k, n in pattern.items()) <= slots
            sequences += times
            for k, n in pattern.items():
                made[k] = made.get(k, 0) + n * times
        assert made == demand
        program = sum(t for _, t in packing.column_generation(demand, slots))
        assert sequences <= program + len(demand) + 1
    assert packing.plan({}, 8) == []


def _histogram(lengths):
    return {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}


MIXES = {
    "uniform": lambda r: r.integers(1, 4097, 20_000), "uniform, more": lambda r: r.integers(1, 4097, 200_000),
    "one id": lambda r: np.ones(100_000, dtype=int), "very short": lambda r: r.integers(5, 16, 100_000),
    "short": lambda r: r.integers(9, 41, 100_000), "over a half": lambda r: np.full(20_000, 2049),
    "two thirds": lambda r: np.full(20_000, 2600), "third and more": lambda r: r.integers(1300, 2600, 30_000),
    "few": lambda r: r.integers(1, 4097, 3), "full": lambda r: np.full(7, 4096),
}


@pytest.mark.parametrize("mix", MIXES)
def test_little_padding_in_any_mix(mix):
    lengths = np.sort(MIXES[mix](np.random.default_rng(3))).astype(np.int64)
    layout = packing.Layout(_histogram(lengths))
    rank = np.arange(len(lengths)) - np.searchsorted(lengths, lengths)
    piece, cut, size, seq, offset = layout.place(lengths, rank)
    # pieces whole: their parts follow each other
    o = np.lexsort((cut, piece))
    first = np.r_[True, np.diff(piece[o]) > 0]
    assert (cut[o][first] == 0).all() and (cut[o][~first] == (cut + size)[o][:-1][~first[1:]]).all()
    assert (np.bincount(piece, size) == lengths).all()
    # sequences gapless and not over full
    o = np.lexsort((offset, seq))
    first = np.r_[True, np.diff(seq[o]) > 0]
    assert (offset[o][first] == 0).all() and (offset[o][~first] == (offset + size)[o][:-1][~first[1:]]).all()
    assert (offset + size).max() <= packing.CAPACITY and len(np.unique(seq)) == layout.sequences
    assert layout.sequences <= -(-lengths.sum() // packing.CAPACITY) * 1.01 + 1


@pytest.mark.parametrize("low,high", [(1000, 1400), (700, 2100), (1300, 2600)])
def test_the_program_comes_within_its_gap(low, high):
    """The bound is that of a run with a gap a hundred times smaller."""
    lengths = np.random.default_rng(4).integers(low, high, 30_000)
    demand = _histogram(-(-lengths // packing.QUANTUM))
    slots = packing.CAPACITY // packing.QUANTUM
    got = sum(t for _, t in packing.column_generation(demand, slots))
    gap = packing.GAP
    try:
        packing.GAP = gap / 100
        best = sum(t for _, t in packing.column_generation(demand, slots))
    finally:
        packing.GAP = gap
    assert best * (1 - 1e-4) <= got <= best * (1 + gap)
