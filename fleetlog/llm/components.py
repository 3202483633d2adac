"""Connected components of an edge table by alternating star contraction.

Each round replaces the edges of a node by edges to its least neighbour, first
for greater neighbours, then for smaller ones, until every component is a star
around its least node: a number of rounds logarithmic in a component's size.
Every round is a written table in the shared folder, so a lost executor costs
a re-read.  Hub rows arrive as per-task minima; the join back on the hub is a
plain equi-join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlog.llm.common import stored

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(least, "u").where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).distinct())


def star_forest(edges: DataFrame, name: str) -> DataFrame:
    """(u, v): every node of ``edges`` (u, v) but the least of its component,
    with that least node."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .distinct(), f"{name}/edges")
    state = None
    for _ in range(MAX_ROUNDS):
        now = stored(_small_star(_large_star(now)), f"{name}/edges")
        seen = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("xxhash64(v, u) >> 20"))).first()
        if seen == state:
            return now
        state = seen
    raise RuntimeError("components did not settle")
