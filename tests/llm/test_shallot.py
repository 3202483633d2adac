"""Shallot search against plain k-means in integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from fleetlog.llm import shallot


def model(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    h = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(kept, key=h)[:k]]
    for step in range(rounds + 1):
        own = [min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in kept]
        if step < rounds:
            for j in range(len(cents)):
                members = [v for (_, v), (_, o) in zip(kept, own) if o == j]
                if members:
                    cents[j] = [sum(col) // len(members) for col in zip(*members)]
    inertia = [sum(d for d, o in own if o == j) for j in range(len(cents))]
    return sorted([(i, j, d, inertia[j], sum(inertia), ",".join(map(str, cents[j])))
                   for (i, _), (d, j) in zip(kept, own)], key=repr)


def rows_of(df):
    return sorted([tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                               "centroid").collect()], key=repr)


def table(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return df.selectExpr("*", *[f"'x' AS {c}" for c in ("v", "cluster", "second", "upper", "n", "sums", "distance")])


def vectors(n, dims=64, seed=1, spread=1.0):
    rng = random.Random(seed)
    centers = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    return [(i, [float(np.float32(x + rng.gauss(0, spread))) for x in rng.choice(centers)]) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_plain_rounds(spark, seed):
    rows = vectors(300, seed=seed, spread=0.1 * seed)
    assert rows_of(shallot.cluster(table(spark, rows).repartition(3))) == model(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = vectors(30)
    rows = good + good[:5] + [(None, good[3][1]), (None, good[4][1]), (50, None), (51, []), (52, [0.0] * 63),
                              (53, [0.0] * 65), (54, [0.0] * 63 + [None]), (55, [nan] + [0.0] * 63),
                              (56, [0.0] * 63 + [-inf]), (57, [0.0] * 64), (57, [0.0] * 64), (58, [-0.0001] * 64)]
    assert rows_of(shallot.cluster(table(spark, rows))) == model(rows)


def test_ties_take_the_smaller_number(spark):
    rows = [(i, [float(i % 5)] + [0.0] * 63) for i in range(60)]
    assert rows_of(shallot.cluster(table(spark, rows))) == model(rows)


def test_few_or_no_vectors(spark):
    for rows in ([], [(1, None)], vectors(1), vectors(3)):
        assert rows_of(shallot.cluster(table(spark, rows))) == model(rows)


def test_large_components_stay_exact(spark):
    rows = [(i, [v[0] * 2.0 ** 17, *v[1:]]) for i, v in vectors(40)]
    assert rows_of(shallot.cluster(table(spark, rows, "double"))) == model(rows)


def test_distances_beyond_a_long_are_an_error(spark):
    rows = [(i, [x * 1e12 for x in v]) for i, v in vectors(20)]
    with pytest.raises(Exception):
        rows_of(shallot.cluster(table(spark, rows, "double")))


def test_bounds_hold_and_save_searches():
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(2000, 16)) * 300 + rng.integers(0, 5, size=(2000, 1)) * 1500).astype(np.int64)
    cents = shallot.Centroids(v[:12].tolist())
    cluster, second = np.zeros(2000, dtype=np.int64), np.ones(2000, dtype=np.int64)
    upper, lower = np.full(2000, np.inf), np.full(2000, -np.inf)
    searched = []
    for _ in range(8):
        searched.append(shallot.shallot(v, cents, cluster, second, upper, lower))
        far = ((v[:, None, :] - cents.exact[None]) ** 2).sum(axis=2)
        assert (cluster == far.argmin(axis=1)).all()
        own = np.sqrt(far[np.arange(2000), cluster])
        far[np.arange(2000), cluster] = np.iinfo(np.int64).max
        assert (upper >= own).all() and (lower <= np.sqrt(far.min(axis=1))).all()
        cents = shallot.Centroids([(v[cluster == j].sum(axis=0) // max((cluster == j).sum(), 1)).tolist()
                                   if (cluster == j).any() else cents.rows[j] for j in range(12)], cents)
    assert searched[0] > 1900 and min(searched) < 1000
