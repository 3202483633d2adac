"""Rendezvous hashing of stable record keys over weighted shards.

A record goes to the shard with the best score; a shard's score for a key is
-ln(u) / weight with u in (0, 1) taken from md5(key, shard).  A score depends
on nothing but key, shard and weight, so a further shard takes rows only into
itself and a removed one gives up only its own.

Only Spark functions are used.  A record's place in its shard (``slot``) is
counted by (shard, bucket): buckets are parts of the key's md5, so the sizes
of all (shard, bucket) groups come from the key column alone and no shard is
ever one task's work.

Null key: treated as the key '' (all such rows share a shard).  Null text has
no bytes: size 1, crc32 0.  Rows of one key keep a defined order by size and
crc32.  An empty table gives no rows.  Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlog.llm.common import table

BUCKETS = 4096


def _unit(text: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the text's md5."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def score(key: Column, shard: int, weight: float) -> Column:
    return -F.ln(_unit(F.concat(key, F.lit(f"#{shard}")))) / F.lit(float(weight))


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard with the least score; shards of weight 0 take nothing."""
    scored = [F.struct(score(key, i, w).alias("s"), F.lit(i).alias("i"))
              for i, w in enumerate(weights) if w > 0]
    if not scored:
        raise ValueError("no shard has a positive weight")
    return (scored[0] if len(scored) == 1 else F.least(*scored))["i"]


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def assign(docs: DataFrame, weights: list[float], doc_id: str = "doc_id", text: str = "text",
           buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, bucket, slot, grown_shard) of every
    row; ``grown_shard`` is its shard were there one more of mean weight."""
    keys = docs.select(F.col(f"`{doc_id}`").alias("doc_id"),
                       F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("key"),
                       F.col(f"`{text}`").cast("string").cast("binary").alias("bytes"))
    grown = [*weights, sum(weights) / len(weights)]
    placed = keys.select(
        "doc_id", (F.coalesce(F.length("bytes"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("bytes"), F.lit(0)).cast("long").alias("text_crc32"),
        shard_of(F.col("key"), weights).alias("shard"), bucket_of(F.col("key"), buckets).alias("bucket"),
        shard_of(F.col("key"), grown).alias("grown_shard"))
    counts = (keys.select(shard_of(F.col("key"), weights).alias("shard"),
                          bucket_of(F.col("key"), buckets).alias("bucket"))
              .groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    return (placed.withColumn("rn", F.row_number().over(within))
            .join(first, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", "shard", "bucket",
                    (F.col("first") + F.col("rn") - 1).cast("long").alias("slot"), "grown_shard"))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents over 16 equal shards, by key."""
    return (assign(table(spark, sf_dir, "documents"), [1.0] * 16)
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"))


def _duck_shard(n: int) -> tuple[str, str]:
    unit = "(('0x' || substr(md5(k || '#{i}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0"
    scores = ", ".join(f"-ln({unit.format(i=i)})" for i in range(n))
    return f"list_position(l{n}, list_min(l{n})) - 1", f"[{scores}] AS l{n}"


_S16, _L16 = _duck_shard(16)
_S17, _L17 = _duck_shard(17)


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


# DuckDB has no crc32: the usual table-driven one as a fold over the bytes.
OP5_SQL = f"""
WITH t AS (SELECT doc_id, text, coalesce(doc_id::VARCHAR, '') AS k, hex(encode(coalesce(text, ''))) AS h
           FROM documents),
l AS (SELECT doc_id, text, k, h, {_L16}, {_L17} FROM t),
s AS (SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, {_S16} AS shard, {_S17} AS grown_shard,
      (('0x' || substr(md5(k), 1, 8))::BIGINT % {BUCKETS}) AS bucket,
      xor(list_reduce(list_prepend(4294967295::BIGINT,
              list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
          lambda a, b: xor(a >> 8, {_crc_table()}[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM l)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id) - 1 AS slot,
       grown_shard::INTEGER AS grown_shard
FROM s
"""
