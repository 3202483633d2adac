"""Exact k-means by shallot search.

Every vector keeps its centroid, its second-nearest centroid, an upper bound of
its distance to the first and a lower bound of its distance to all others.  The
bounds move with the centroids; while the upper one is below the lower one, or
below half the way to the nearest other centroid, nothing is searched.  Else
the scan starts from the closer of the two remembered centroids and goes
through that centroid's neighbours in order of their distance from it.  The
search ball (distance to the start plus distance to the second-nearest found so
far) shrinks while the scan goes on, and the scan ends at the first neighbour
outside.  Centroids that survive are compared by exact integer squared
distances, ties by number; bounds are floats with a margin, so they only ever
pass over centroids that are farther.

A round is one job over the stored vectors: it writes them again with their new
bounds, and next to them the sums of every centroid's vectors, a row per task
and centroid.  Only those sums (added up by Spark) reach the driver.  A round's
table is deleted once the next one is written.

A vector is kept if it has exactly ``dims`` components, none null or
non-finite; component x counts as floor(1024 * x).  Starting centroids are the
kept vectors with the smallest sha256 of ``seed:vec_id``; a null id comes after
all others, and of equal ids the smaller components come first.  Fewer than
``k`` kept vectors give fewer centroids.  Repeated rows are separate vectors.
An empty table, or one without kept vectors, gives no rows.  Squared distances
that do not fit in a long end the job with an error.  Only the two named
columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlog.llm.common import discard, ship, stored_at, table

SCALE = 1024
UP, DOWN = 1 + 1e-9, 1 - 1e-9  # margins of the float bounds
SAFE = 1 << 27  # components below this: squared distances of 64 of them fit in 64 bits

STATE = ("vec_id long, v array<double>, cluster int, second int, upper double, lower double, distance long, "
         "n long, sums array<decimal(38,0)>, inertia decimal(38,0)")


class Centroids:
    """Centroids (exact integers) with their distances and neighbour orders."""

    def __init__(self, rows: list[list[int]], before: "Centroids | None" = None):
        self.rows = rows
        self.small = all(abs(x) < SAFE for r in rows for x in r)
        self.exact = np.array(rows, dtype=np.int64 if self.small else object)
        k = len(rows)
        far = np.array([[float(sum((x - y) ** 2 for x, y in zip(p, q))) ** 0.5 for q in rows] for p in rows])
        self.order = np.array([[j for j in np.argsort(far[i], kind="stable") if j != i] for i in range(k)],
                              dtype=np.int64).reshape(k, k - 1)
        self.far = np.take_along_axis(far, self.order, axis=1) * DOWN
        self.half = self.far[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        # how far each centroid moved, and the longest way of any other one
        moved = np.zeros(k)
        if before is not None:
            moved = np.array([float(sum((x - y) ** 2 for x, y in zip(p, q))) ** 0.5 * UP
                              for p, q in zip(before.rows, rows)])
        self.moved = moved
        self.others = np.array([max([0.0, *np.delete(moved, i)]) for i in range(k)])

    def __len__(self) -> int:
        return len(self.rows)

    def squared(self, v: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Exact squared distances of vectors to their given centroids."""
        c = self.exact
        if v.dtype != c.dtype:
            v, c = v.astype(object), c.astype(object)
        d = v - c[which]
        return (d * d).sum(axis=1) if d.dtype == object else np.einsum("ij,ij->i", d, d)


def _root(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64))


def shallot(v: np.ndarray, c: Centroids, cluster: np.ndarray, second: np.ndarray, upper: np.ndarray,
            lower: np.ndarray) -> int:
    """Assigns vectors (exact integers) to their nearest centroids, in place:
    ``cluster``, ``second`` and both bounds.  Returns how many vectors were
    searched."""
    k = len(c)
    if k < 2:
        cluster[:], second[:], upper[:], lower[:] = 0, 0, np.inf, np.inf
        return 0
    upper += c.moved[cluster]
    lower -= c.others[cluster]
    todo = np.flatnonzero(upper >= np.maximum(lower, c.half[cluster]))
    if not len(todo):
        return 0
    first = c.squared(v[todo], cluster[todo])
    upper[todo] = _root(first) * UP
    near = upper[todo] < np.maximum(lower[todo], c.half[cluster[todo]])
    todo, first = todo[~near], first[~near]
    if not len(todo):
        return 0
    rows = v[todo]
    a, b = cluster[todo].copy(), second[todo].copy()
    d1, d2 = first, c.squared(rows, b)
    swap = (d2 < d1) | ((d2 == d1) & (b < a))
    a[swap], b[swap] = b[swap], a[swap].copy()
    d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
    start, seen = a.copy(), b.copy()
    reach = _root(d1) * UP
    ball = reach + _root(d2) * UP
    alive = np.arange(len(todo))
    for step in range(k - 1):
        alive = alive[c.far[start[alive], step] <= ball[alive]]
        if not len(alive):
            break
        y = c.order[start[alive], step]
        new = y != seen[alive]
        i, y = alive[new], y[new]
        if not len(i):
            continue
        d = c.squared(rows[i], y)
        best = (d < d1[i]) | ((d == d1[i]) & (y < a[i]))
        next_best = ~best & ((d < d2[i]) | ((d == d2[i]) & (y < b[i])))
        j = i[best]
        d2[j], b[j] = d1[j], a[j]
        d1[j], a[j] = d[best], y[best]
        j = i[next_best]
        d2[j], b[j] = d[next_best], y[next_best]
        ball[i] = reach[i] + _root(d2[i]) * UP
    cluster[todo], second[todo] = a, b
    upper[todo], lower[todo] = _root(d1) * UP, _root(d2) * DOWN
    return len(todo)


def _integers(v: np.ndarray) -> np.ndarray:
    """Whole floats as exact integers."""
    return v.astype(np.int64) if not v.size or np.abs(v).max() < SAFE else np.array(
        [[int(x) for x in r] for r in v.tolist()], dtype=object)


def _round(vectors: DataFrame, centroids: Centroids, dims: int, fresh: bool) -> DataFrame:
    """One round over (vec_id, v, cluster, second, upper, lower): the same rows
    with new bounds, then the tasks' sums."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((centroids.rows, centroids))

    def run(batches):
        c = shared.value[1]
        k = len(c)
        n, sums, inertia = [0] * k, [[0] * dims for _ in range(k)], [0] * k
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                s = b.slice(lo, 4096)
                m = s.num_rows
                v = s.column(1).flatten().to_numpy(zero_copy_only=False).reshape(m, dims)
                exact = _integers(v)
                if fresh:
                    cluster, second = np.zeros(m, dtype=np.int64), np.full(m, min(1, k - 1), dtype=np.int64)
                    upper, lower = np.full(m, np.inf), np.full(m, -np.inf)
                else:
                    cluster, second = (s.column(i).to_numpy().astype(np.int64) for i in (2, 3))
                    upper, lower = (s.column(i).to_numpy().astype(np.float64) for i in (4, 5))
                shallot(exact, c, cluster, second, upper, lower)
                distance = c.squared(exact, cluster)
                if distance.dtype != object and distance.size and distance.min() < 0:
                    raise OverflowError("a squared distance does not fit in a long")
                for j in np.unique(cluster).tolist():
                    own = cluster == j
                    n[j] += int(own.sum())
                    sums[j] = [x + int(y) for x, y in zip(sums[j], exact[own].sum(axis=0))]
                    inertia[j] += sum(map(int, distance[own]))
                yield _state(s.column(0), s.column(1), cluster, second, upper, lower, distance)
        yield _sums(n, sums, inertia)

    columns = ["vec_id", "v"] if fresh else ["vec_id", "v", "cluster", "second", "upper", "lower"]
    return vectors.select(*columns).mapInArrow(run, STATE)


def _state(vec_id, v, cluster, second, upper, lower, distance):
    m = len(vec_id)
    dec = pa.decimal128(38, 0)
    return pa.RecordBatch.from_arrays(
        [vec_id, v, pa.array(cluster, pa.int32()), pa.array(second, pa.int32()), pa.array(upper), pa.array(lower),
         pa.array(distance.tolist(), pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(dec)), pa.nulls(m, dec)],
        names=[c.split()[0] for c in STATE.split(", ")])


def _sums(n, sums, inertia):
    dec = pa.decimal128(38, 0)
    own = [j for j in range(len(n)) if n[j]]
    m = len(own)
    return pa.RecordBatch.from_arrays(
        [pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.float64())), pa.array(own, pa.int32()), pa.nulls(m, pa.int32()),
         pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.int64()),
         pa.array([n[j] for j in own], pa.int64()),
         pa.array([[Decimal(x) for x in sums[j]] for j in own], pa.list_(dec)),
         pa.array([Decimal(inertia[j]) for j in own], dec)],
        names=[c.split()[0] for c in STATE.split(", ")])


def _totals(state: DataFrame) -> dict[int, tuple[int, list[int], int]]:
    """Per centroid: count, component sums, inertia.  One row per centroid and
    component reaches the driver."""
    part = state.where("n IS NOT NULL")
    plain = part.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia")).collect()
    sums = (part.select("cluster", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i")
            .agg(F.sum("x").alias("x")).collect())
    out = {r["cluster"]: (r["n"], {}, int(r["inertia"])) for r in plain}
    for r in sums:
        out[r["cluster"]][1][r["i"]] = int(r["x"])
    return {j: (n, [s[i] for i in range(len(s))], t) for j, (n, s, t) in out.items()}


def kept_vectors(vectors: DataFrame, dims: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): rows with ``dims`` finite components, as whole floats."""
    x = F.col(f"`{vector}`").cast("array<double>")
    whole = F.transform("x", lambda e: F.when(F.abs(e * SCALE) < 2.0 ** 52, F.floor(e * SCALE).cast("double"))
                        .otherwise(e * SCALE))
    return (vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), x.alias("x"))
            .where((F.size("x") == dims) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e)
                                                    & (F.abs(e) < float("inf"))))
            .select("vec_id", whole.alias("v")))


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: str = "3", name: str = "shallot",
            vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and
    centroid (its components as text) of every kept vector."""
    spark = vectors.sparkSession
    ship(spark)
    kept, path = stored_at(kept_vectors(vectors, dims, vec_id, vector), f"{name}/vectors")
    firsts = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(),
                          "v").limit(k).collect()
    if not firsts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
                                         "centroid string")
    now = Centroids([[int(x) for x in r["v"]] for r in firsts])
    state, fresh = kept, True
    for step in range(rounds + 1):
        after, after_path = stored_at(_round(state.where("v IS NOT NULL"), now, dims, fresh), f"{name}/round{step}")
        discard(spark, path)
        state, path, fresh = after, after_path, False
        totals = _totals(state)
        if step < rounds:
            rows = [[s // totals[j][0] for s in totals[j][1]] if j in totals else r for j, r in enumerate(now.rows)]
            now = Centroids(rows, now)
    inertia = sum(t for _, _, t in totals.values())
    per = spark.createDataFrame([(j, totals[j][2], inertia, ",".join(map(str, now.rows[j]))) for j in totals],
                                "cluster int, cluster_inertia long, inertia long, centroid string")
    return (state.where("v IS NOT NULL").select("vec_id", "cluster", "distance")
            .join(F.broadcast(per), "cluster")  # one row per centroid
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"))


def op11_clusters(spark, sf_dir: str) -> DataFrame:
    """Cluster and squared distance of every kept vector."""
    done = cluster(table(spark, sf_dir, "embeddings"), name="op11")
    return done.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                       F.sha2("centroid", 256).alias("centroid_sha256"))


def _sql(k: int = 8, rounds: int = 10, dims: int = 64, seed: str = "3") -> str:
    """Plain rounds over all pairs of vector and centroid."""
    out = [f"""WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings),
kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(x, lambda e: CAST(floor({SCALE} * e) AS BIGINT)) AS v
  FROM x WHERE len(x) = {dims} AND len(list_filter(x, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
parts AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v FROM (
  SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {k}))"""]
    for n in range(rounds + 1):
        out.append(f"""a{n} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT r, c, CAST(list_sum(list_transform(list_zip(kept.v, c{n}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
  FROM kept, c{n}) GROUP BY r)""")
        if n < rounds:
            out.append(f"""c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce(f.v, o.v) AS v FROM c{n} o LEFT JOIN (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
    SELECT c, i, sum(x) AS s, count(*) AS n FROM a{n} JOIN parts USING (r) GROUP BY c, i) GROUP BY c) f ON o.c = f.c)""")
    n = rounds
    return ",\n".join(out) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{n}.v, ',')) AS centroid_sha256
FROM a{n} a JOIN kept USING (r) JOIN c{n} ON a.c = c{n}.c"""


OP11_SQL = _sql()
