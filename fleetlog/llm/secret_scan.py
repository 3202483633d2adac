"""Secrets in texts, told apart by who owns them across the corpus.

Candidates are found row by row with regular expressions: the three base kinds
and, as the method's own kind ``owned``, long runs of letters and digits that
no base pattern names.  Each candidate's value is hashed; over the whole
corpus the hashes are aggregated by distinct repositories and owners.  A value
that EXAMPLE_OWNERS or more owners hold is a widely copied example; a value of
fewer owners is owner-specific and live-looking.  Base spans always stay;
``owned`` spans are reported where the value is owner-specific.

Only Spark functions are used.  Counting groups by (value, owner, repository)
before (value), so a value that a third of all rows hold arrives as one row
per owner and task.  Only spans and hashes are shuffled, never texts.

Null text is an empty one.  Null owners and repositories count as one owner or
repository of their own.  Rows of equal doc_id and text get equal results.  An
empty table gives no rows.  Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlog.llm.common import for_join, stored, table

# The base patterns of the contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "owned"]

MIN_VALUE = 6
# The method's own candidates: a run this long with letters and digits.
OWNED = r"[A-Za-z0-9_-]{20,}"
EXAMPLE_OWNERS = 3
# Matches of a text that are folded at a time.
CHUNK = 128

SPAN = "array<struct<kind:int,start:bigint,end:bigint,value:string>>"


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once: an expression that lambdas
    refer to is otherwise computed for each of their elements."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _in_chunks(parts: Column, reach, fold) -> Column:
    """Array of fold(chunk, value) over chunks of at most CHUNK parts, where
    value is reach(chunk, value) of the chunk before, 0 for the first.  An
    accumulator is copied at every step, so one that grows with all parts would
    cost their square."""
    def chunks(x):
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / CHUNK) - 1, F.lit(0)).cast("int")),
                           lambda i: F.slice(x, i * CHUNK + 1, CHUNK))

    def values(cs):
        return F.aggregate(
            cs, F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("CAST(array() AS array<bigint>)").alias("out")),
            lambda acc, c: F.struct(reach(c, acc["at"]).cast("bigint").alias("at"),
                                    F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    return _let(_let(parts, chunks), lambda cs: F.zip_with(cs, values(cs), fold))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping
    matches, in code points; ``value`` is the group, which ends the match.
    Positions are sums of the lengths of the matches and of what lies between."""
    hit = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    val = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.filter(F.arrays_zip(F.split(text, pattern).alias("gap"), hit.alias("hit"), val.alias("val")),
                     lambda p: p["hit"].isNotNull())
    none = F.expr("CAST(array() AS array<struct<start:bigint,end:bigint,value:string>>)")

    def step(acc, p):
        start = acc["pos"] + F.length(p["gap"])
        end = start + F.length(p["hit"])
        return F.struct(
            end.cast("bigint").alias("pos"),
            F.concat(acc["out"], F.array(F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"),
                                                  p["val"].alias("value")))).alias("out"))

    folded = F.flatten(_in_chunks(
        parts, lambda c, at: F.aggregate(c, at, lambda n, p: n + F.length(p["gap"]) + F.length(p["hit"])),
        lambda c, at: F.aggregate(c, F.struct(at.alias("pos"), none.alias("out")), step, lambda acc: acc["out"])))
    # most texts hold nothing: one scan decides
    return F.when(F.size(hit) > 0, folded).otherwise(none)


def _kind(spans: Column, name: str) -> Column:
    k = KINDS.index(name)
    return F.transform(spans, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"),
                                                 s["end"].alias("end"), s["value"].alias("value")))


def _joined(spans: Column) -> Column:
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), spans["kind"] + 1)
    return F.concat_ws(":", name, spans["start"].cast("string"), spans["end"].cast("string"))


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source",
               repository: str | None = None) -> DataFrame:
    """(doc_id, text_hash, owner, repository, base, owned) of every row; the
    last two are arrays of (kind, start, end, sha256 of the value)."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    repo = F.col(f"`{repository}`") if repository else F.col(f"`{owner}`")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), t.alias("t"),
                       F.col(f"`{owner}`").cast("string").alias("owner"), repo.cast("string").alias("repository"))
    rows = rows.select(
        "doc_id", F.xxhash64("t").alias("text_hash"), "owner", "repository",
        F.filter(_kind(found(F.col("t"), ASSIGN, 2), "assign"), lambda s: F.length(s["value"]) >= MIN_VALUE).alias("a"),
        _kind(found(F.col("t"), ACCESS), "access").alias("k"),
        _kind(found(F.col("t"), HEX), "hex").alias("h"),
        F.filter(_kind(found(F.col("t"), OWNED), "owned"),
                 lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")).alias("o"))
    hashed = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                                F.sha2(s["value"], 256).alias("value"))
    base = F.array_sort(F.concat("a", "k", "h"), lambda x, y: F.when(
        F.struct(x["start"], x["kind"]) < F.struct(y["start"], y["kind"]), -1).otherwise(1))
    return rows.select(
        "doc_id", "text_hash", "owner", "repository", F.transform(base, hashed).alias("base"),
        F.transform(F.filter("o", lambda s: ~F.exists(
            F.concat("a", "k", "h"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))), hashed)
        .alias("owned"))


def ownership(found_rows: DataFrame) -> DataFrame:
    """(value, n_owners, n_repositories) over all candidates of all rows."""
    each = found_rows.select(F.coalesce("owner", F.lit("")).alias("owner"),
                             F.coalesce("repository", F.lit("")).alias("repository"),
                             F.explode(F.concat("base", "owned")).alias("s"))
    pairs = each.select(F.col("s.value").alias("value"), "owner", "repository").distinct()
    return pairs.groupBy("value").agg(F.countDistinct("owner").alias("n_owners"),
                                      F.countDistinct("repository").alias("n_repositories"))


def scan(docs: DataFrame, name: str = "secrets", example_owners: int = EXAMPLE_OWNERS, **columns) -> DataFrame:
    """(doc_id, text_hash, base, owned, live): one row per input row.  ``base``
    are the base spans, ``owned`` the added ones, ``live`` all of either that
    are owner-specific; each an array of (kind, start, end, value hash)."""
    rows = stored(candidates(docs, **columns), f"{name}/candidates")
    few = ownership(rows).where(F.col("n_owners") < example_owners).select("value")
    spans = (rows.select("doc_id", "text_hash", F.explode(F.concat("base", "owned")).alias("s"))
             .select("doc_id", "text_hash", "s", F.col("s.value").alias("value")))
    live = (spans.join(few, "value", "left_semi").groupBy("doc_id", "text_hash")
            .agg(F.sort_array(F.collect_set(F.struct("s.start", "s.kind", "s.end", "s.value"))).alias("live"))
            .withColumnRenamed("doc_id", "d").withColumnRenamed("text_hash", "th"))
    return (rows.join(live, rows["doc_id"].eqNullSafe(live["d"]) & (rows["text_hash"] == live["th"]), "left")
            .select("doc_id", "text_hash", "base",
                    F.expr(f"filter(CAST(coalesce(transform(live, s -> named_struct('kind', s.kind, 'start', s.start, "
                           f"'end', s.end, 'value', s.value)), array()) AS {SPAN}), s -> s.kind = 3)").alias("owned"),
                    F.expr(f"CAST(coalesce(transform(live, s -> named_struct('kind', s.kind, 'start', s.start, "
                           f"'end', s.end, 'value', s.value)), array()) AS {SPAN})").alias("live")))


def digest(scanned: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    every = F.array_sort(F.concat("base", "owned"), lambda x, y: F.when(
        F.struct(x["start"], x["kind"]) < F.struct(y["start"], y["kind"]), -1).otherwise(1))
    return scanned.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform("base", _joined), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(every, _joined), ",").alias("spans"),
        F.size("live").cast("long").alias("n_live"))


def masked(docs: DataFrame, scanned: DataFrame, doc_id: str = "doc_id", text: str = "text",
           mark: str = "[secret]", length: str | None = None,
           name: str = "secrets/live") -> DataFrame:
    """``docs`` with the stretches of owner-specific spans replaced by ``mark``;
    overlapping spans are one stretch.  All columns of ``docs`` are kept;
    ``length`` names one that holds the text's length, renewed where masked."""
    hot = stored(scanned.where(F.size("live") > 0)
           .select(F.col("doc_id").alias("_secret_id"), F.col("text_hash").alias("_secret_hash"),
                   F.sort_array(F.transform("live", lambda s: F.struct(s["start"], s["end"]))).alias("_secret_spans"))
           .dropDuplicates(["_secret_id", "_secret_hash"]), name)
    hot = for_join(hot, "1 + size(_secret_spans)")
    t = F.col(f"`{text}`")
    joined = docs.join(hot, docs[f"`{doc_id}`"].eqNullSafe(hot["_secret_id"])
                       & (F.xxhash64(F.coalesce(t.cast("string"), F.lit(""))) == hot["_secret_hash"]), "left")

    def step(acc, s):
        # col1 start, col2 end; a span that begins in the last one extends it
        fresh = s["col1"] >= acc["pos"]
        gap = F.substr(t, (acc["pos"] + 1).cast("int"), (s["col1"] - acc["pos"]).cast("int"))
        return F.struct(F.greatest(acc["pos"], s["col2"]).alias("pos"),
                        F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    spans = F.expr("transform(_secret_spans, s -> named_struct('col1', s.start, 'col2', s.end))")
    pieces = _in_chunks(spans, lambda c, at: F.greatest(at, F.array_max(F.transform(c, lambda x: x["col2"]))),
                        lambda c, at: F.aggregate(c, F.struct(at.alias("pos"), F.lit("").alias("out")), step,
                                                  lambda acc: acc["out"]))
    rest = F.array_max(F.transform(spans, lambda x: x["col2"]))
    clean = F.concat(F.array_join(pieces, ""), F.substr(t, (rest + 1).cast("int")))
    hit = F.col("_secret_spans").isNotNull()
    done = joined.withColumn("_secret_text", F.when(hit, clean))
    changed = {text: F.col("_secret_text")}
    if length:
        changed[length] = F.length("_secret_text").cast(docs.schema[length].dataType)
    return done.select(*[
        F.when(hit, changed[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in changed else F.col(f"`{c}`")
        for c in docs.columns])


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """Secret spans of all documents; a source is an owner, a source's texts
    of one language one of its repositories."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "source", F.concat_ws("/", "source", "lang").alias("repository"))
    return digest(scan(docs, "op6", repository="repository"))


def _duck_found(col: str, pattern: str, group: int) -> str:
    p = pattern.replace("'", "''")
    return (f"list_transform(range(1, len(regexp_extract_all({col}, '{p}', 0)) + 1), lambda i: {{"
            f"'s': list_sum(list_transform(string_split_regex({col}, '{p}')[1:i], lambda x: length(x))) + "
            f"coalesce(list_sum(list_transform(regexp_extract_all({col}, '{p}', 0)[1:i-1], lambda x: length(x))), 0), "
            f"'n': length(regexp_extract_all({col}, '{p}', 0)[i]), 'v': regexp_extract_all({col}, '{p}', {group})[i]}})")


OP6_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
f AS (SELECT r, doc_id, source, 0 AS kind, unnest({_duck_found('t', ASSIGN, 2)}) AS m FROM t
      UNION ALL SELECT r, doc_id, source, 1, unnest({_duck_found('t', ACCESS, 0)}) FROM t
      UNION ALL SELECT r, doc_id, source, 2, unnest({_duck_found('t', HEX, 0)}) FROM t
      UNION ALL SELECT r, doc_id, source, 3, unnest({_duck_found('t', OWNED, 0)}) FROM t),
s AS (SELECT r, source, kind, m.s::BIGINT AS s, (m.s + m.n)::BIGINT AS e, m.v AS v FROM f
      WHERE (kind <> 0 OR length(m.v) >= {MIN_VALUE})
        AND (kind <> 3 OR (regexp_matches(m.v, '[0-9]') AND regexp_matches(m.v, '[A-Za-z]')))),
c AS (SELECT * FROM s WHERE kind < 3
      UNION ALL SELECT o.* FROM s o WHERE o.kind = 3 AND NOT EXISTS (
          SELECT 1 FROM s b WHERE b.kind < 3 AND b.r = o.r AND b.s < o.e AND o.s < b.e)),
few AS (SELECT v FROM c GROUP BY v HAVING count(DISTINCT coalesce(source, '')) < {EXAMPLE_OWNERS}),
j AS (SELECT *, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || s || ':' || e AS x,
             v IN (SELECT v FROM few) AS live FROM c),
g AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
             count(*) FILTER (kind = 2) AS n_hex,
             string_agg(x, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
             string_agg(x, ',' ORDER BY s, kind) FILTER (kind < 3 OR live) AS spans,
             count(*) FILTER (live) AS n_live FROM j GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM t LEFT JOIN g USING (r)
"""
