"""SimHash near-duplicates through BK-trees.

Fingerprints of 64 bits link at RADIUS or fewer differing bits.  Two such
fingerprints agree on at least one of RADIUS + 1 bit blocks, so every distinct
fingerprint goes to RADIUS + 1 shards, one per block value, and each shard's
fingerprints are searched in the BK-tree of that shard: children are keyed by
their integer distance to the parent, and a search at distance d follows only
the edges d - RADIUS .. d + RADIUS.  A shard of more than SHARD_LIMIT
fingerprints is dealt again by blocks of the bits it leaves open (twice at
most); beyond that it is cut into chunks, and every chunk's tree is sent to
the tasks of the other chunks.  No pair is lost by any of this.

A tree only has to find which fingerprints are connected, so it emits the
edges of a spanning forest, and a search passes over a subtree whose members
all belong to its own component already: a dense group of near copies costs
no more than its size.

Exact copies are one fingerprint before any search.  Null and blank texts have
fingerprint zero and link like any other.  A null doc_id is never the smallest
of its component unless all are null.  Repeated rows stay rows.  An empty
table gives no rows.  Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlog.llm.common import ship, stored, table
from fleetlog.llm.components import star_forest

SHINGLE = 3
RADIUS = 3
SEED = 42
BITS = 64
SHARD_LIMIT = 16_384

# byte -> eight 0/1 bytes in one 64-bit word, highest bit first
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text (UTF-8 bytes)."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) < shingle:
        hashed = [digest(b" ".join(words), SEED)]
    else:
        hashed = [digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle))))]
    n = len(hashed)
    spread = _SPREAD[np.frombuffer(b"".join(hashed), dtype=np.uint8)].reshape(n, 8)
    # sums of up to 255 zeros and ones per byte lane
    ones = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, n, 255 * 256):
        part = spread[lo:lo + 255 * 256]
        sums = np.add.reduceat(part, np.arange(0, len(part), 255), axis=0)
        ones += sums.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp as a signed 64-bit integer.
    ``text_hash`` tells rows of one doc_id apart."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                s = b.slice(lo, 2000)
                codes = [fingerprint(t, shingle) for t in s.column(2).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), s.column(1), pa.array(np.array(codes, dtype=np.uint64).view(np.int64))],
                    names=["doc_id", "text_hash", "fp"])

    src = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
                      F.xxhash64(f"`{text}`").alias("text_hash"), F.col(f"`{text}`").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, text_hash long, fp long")


class BKForest:
    """BK-tree of distinct codes with the components found so far."""

    def __init__(self, radius: int = RADIUS):
        self.radius = radius
        self.codes: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []
        self.tag: list[int] = []  # a member of the component all below belong to, or -1
        self.root: list[int] = []  # union-find
        self.retag_at = 64

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def search(self, code: int, own: int) -> list[int]:
        """Joins ``own`` to the components within the radius; one code of each
        component that is new to it."""
        out, stack = [], [0]
        codes, children, tag, find, radius = self.codes, self.children, self.tag, self.find, self.radius
        mine = find(own)
        while stack:
            i = stack.pop()
            d = (codes[i] ^ code).bit_count()
            if d <= radius and find(i) != mine:
                self.root[find(i)] = mine
                out.append(codes[i])
            kids = children[i]
            if kids:
                for e in range(d - radius, d + radius + 1):
                    c = kids.get(e)
                    if c is not None and (tag[c] < 0 or find(tag[c]) != mine):
                        stack.append(c)
        return out

    def node(self, code: int) -> int:
        """A new member, not yet in the tree."""
        i = len(self.codes)
        self.codes.append(code)
        self.children.append({})
        self.parent.append(-1)
        self.tag.append(i)
        self.root.append(i)
        return i

    def insert(self, i: int) -> None:
        code, mine, at = self.codes[i], self.find(i), 0
        while at != i:
            if self.tag[at] >= 0 and self.find(self.tag[at]) != mine:
                self.tag[at] = -1
            d = (self.codes[at] ^ code).bit_count()
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = i
                self.parent[i] = at
                break
            at = nxt
        if i >= self.retag_at:
            self.retag_at *= 2
            self._retag()

    def _retag(self) -> None:
        """Components merge after their members were inserted: tags anew, leaves
        first (a child always comes after its parent)."""
        n = len(self.codes)
        tag = [self.find(i) for i in range(n)]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if p >= 0 and (tag[i] < 0 or tag[p] != tag[i]):
                tag[p] = -1
        self.tag = tag


def shard_edges(rows, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning edges of one shard.  rows: (role, code): role 0 is searched and
    inserted, 1 only inserted, 2 only searched; in ascending role."""
    t = BKForest(radius)
    out = []
    for role, code in rows:
        i = t.node(code)
        if i and role != 1:
            out.extend((code, other) for other in t.search(code, i))
        if role != 2:
            t.insert(i)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    size = -(-len(bits) // n)
    return [bits[i * size:(i + 1) * size] for i in range(n)]


def _masks(radius: int, levels: int) -> list[list[int]]:
    """masks[l][p]: the fixed bits of path p at level l; path p has the paths
    p * (radius + 1) + j below it."""
    paths = [([], list(range(BITS)))]
    out = []
    for _ in range(levels):
        nxt = []
        for fixed, rest in paths:
            for block in _blocks(rest, radius + 1):
                nxt.append((fixed + block, [b for b in rest if b not in block]))
        paths = nxt
        out.append([sum(1 << b for b in fixed) for fixed, _ in paths])
    return out


def link_edges(codes: DataFrame, radius: int = RADIUS, limit: int = SHARD_LIMIT, name: str = "simhash") -> DataFrame:
    """(u, v): edges that connect exactly the codes (distinct, column ``fp``)
    which chains of links within ``radius`` connect."""
    spark = codes.sparkSession
    ship(spark)
    levels = 3
    masks = _masks(radius, levels)
    k = radius + 1

    def deal(df: DataFrame, level: int) -> DataFrame:
        lits = F.array(*[F.lit(_signed(m)) for m in masks[level]])
        path = F.col("path") * k if level else F.lit(0)
        kids = F.array(*[F.struct((path + j).cast("int").alias("path"),
                                  F.col("fp").bitwiseAND(F.element_at(lits, (path + j + 1).cast("int"))).alias("value"))
                         for j in range(k)])
        return df.select("fp", F.explode(kids).alias("s")).select("fp", F.lit(level).alias("level"), "s.path", "s.value")

    todo = stored(deal(codes, 0), f"{name}/shards0")
    small = []
    key = ["path", "value"]
    for level in range(levels):
        big = todo.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
        big = stored(big, f"{name}/big{level}")
        if big.isEmpty():
            small.append(todo.withColumns({"i": F.lit(0), "j": F.lit(0), "role": F.lit(0)}))
            todo = None
            break
        small.append(todo.join(big, key, "left_anti").withColumns({"i": F.lit(0), "j": F.lit(0), "role": F.lit(0)}))
        rest = todo.join(big, key)
        if level + 1 < levels:
            todo = stored(deal(rest, level + 1), f"{name}/shards{level + 1}")
        else:
            # chunks of at most about ``limit``; each meets every other once
            c = F.ceil(F.col("n") / limit).cast("int")
            own = rest.select("fp", "level", *key, c.alias("c"),
                              F.pmod(F.xxhash64("fp"), c.cast("bigint")).cast("int").alias("own"))
            meets = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda o: F.struct(
                F.least("own", o).alias("i"), F.greatest("own", o).alias("j"),
                F.when(F.col("own") == o, 0).when(F.col("own") < o, 1).otherwise(2).alias("role")))
            small.append(own.select("fp", "level", *key, F.explode(meets).alias("m"))
                         .select("fp", "level", *key, "m.i", "m.j", "m.role"))
            todo = None
    dealt = small[0]
    for s in small[1:]:
        dealt = dealt.unionByName(s)

    def run(batches):
        shard, rows = None, []
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(7)]
            edges = []
            for level, path, value, i, j, role, fp in zip(*cols):
                now = (level, path, value, i, j)
                if now != shard:
                    if len(rows) > 1:
                        edges += shard_edges(rows, radius)
                    shard, rows = now, []
                rows.append((role, fp & 0xFFFFFFFFFFFFFFFF))
            yield _edge_batch(edges)
        if len(rows) > 1:
            yield _edge_batch(shard_edges(rows, radius))

    parts = ["level", "path", "value", "i", "j"]
    return (dealt.select(*parts, "role", "fp").repartition(*parts).sortWithinPartitions(*parts, "role", "fp")
            .mapInArrow(run, "u long, v long"))


def _edge_batch(edges):
    return pa.RecordBatch.from_arrays(
        [pa.array([_signed(a) for a, _ in edges], pa.int64()), pa.array([_signed(b) for _, b in edges], pa.int64())],
        names=["u", "v"])


def components(prints: DataFrame, radius: int = RADIUS, name: str = "simhash") -> DataFrame:
    """(doc_id, text_hash, fp, component_id, root) of stored fingerprint rows;
    ``root`` is a fingerprint that names the component."""
    codes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{name}/codes")
    forest = star_forest(link_edges(codes.select("fp"), radius, name=name), name)
    # (fp, root) of all fingerprints that link to another
    member = forest.select(F.col("u").alias("fp"), F.col("v").alias("root")).union(
        forest.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    linked = member.join(codes, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    found = linked.join(least, "root").select("fp", "component_id", "root")
    label = codes.join(found, "fp", "left").select(
        "fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("root", "fp").alias("root"))
    return (prints.join(stored(label, f"{name}/labels"), "fp")
            .select("doc_id", "text_hash", "fp", "component_id", "root"))


def near_duplicates(docs: DataFrame, name: str = "simhash", radius: int = RADIUS, shingle: int = SHINGLE,
                    **columns) -> DataFrame:
    return components(stored(fingerprints(docs, shingle=shingle, **columns), f"{name}/prints"), radius, name)


def one_of_each(docs: DataFrame, name: str = "simhash", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id
    (a null one only if there is no other; of several rows of one id, the one
    with the smallest text hash; of equal rows, one).  All columns are kept."""
    found = near_duplicates(docs, name, doc_id=doc_id, text=text)
    best = found.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("b"))
    # keys without nulls, so that join and duplicates share one shuffle
    def keys(i, h):
        return {"_row_id": F.coalesce(i, F.lit(0).cast("bigint")), "_row_hash": F.when(i.isNull(), F.bitwise_not(h)).otherwise(h)}

    kept = best.select(*[c.alias(k) for k, c in keys(F.col("b.doc_id"), F.col("b.text_hash")).items()])
    keyed = docs.withColumns(keys(F.col(f"`{doc_id}`").cast("bigint"), F.xxhash64(f"`{text}`")))
    return (keyed.join(kept, ["_row_id", "_row_hash"], "left_semi")
            .dropDuplicates(["_row_id", "_row_hash"]).drop("_row_id", "_row_hash").select(*docs.columns))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"), "op4")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
