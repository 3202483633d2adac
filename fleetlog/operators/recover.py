"""Recovery of cut function names and file paths through a symbol table.

The logger cuts function names on the right and file paths on the left.
For a logged (function, fileline) the symbols whose name starts with the
function (trailing ``(`` / ``)`` removed) are the matches:

* no match: the logged values stay;
* one match: its name and path, without any path check;
* several: those whose path ends with the logged path, nearest line wins,
  the first in table order on ties; none left: the logged values stay.

The line returned is always the logged one.

``startswith`` as a join condition plans as a nested-loop join, and a prefix
join forms every matching pair of key and symbol.  Neither is needed: symbols
are cut to the prefix and suffix lengths that keys have and summed up by what is
left of them, so that a key meets one row per prefix, and the nearest line of
its (prefix, suffix) comes from an ordered scan over distinct lines.  Recovery
runs once per distinct (function, fileline) -- a small set bounded by the number
of log call sites -- and is joined back to the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import id_chunk, nearest_marked


def symbol_prefixes(symbols: DataFrame, sizes: DataFrame) -> DataFrame:
    """(prefix, path, line, name, seq, n) for every prefix length of ``sizes``
    (__fl_nf): of the n symbols of a (prefix, path, line) the first."""
    n = F.explode(F.sequence(F.lit(0), F.length("name"))).alias("__fl_nf")
    return (symbols.select("name", "path", "line", "seq", n).join(F.broadcast(sizes), "__fl_nf")
            .groupBy(F.substring("name", F.lit(1), F.col("__fl_nf")).alias("prefix"), "path", "line")
            .agg(F.min_by("name", "seq").alias("name"), F.min("seq").alias("seq"), F.count("name").alias("n")))


def resolve_keys(keys: DataFrame, symbols: DataFrame) -> DataFrame:
    """(function, fileline) -> (function, fileline, name, path, line)."""
    colon_count = F.size(F.split(F.col("fileline"), ":")) - 1
    k = keys.groupBy("function", "fileline").agg(F.count(F.lit(1)).alias("__fl_times")).select(
        "function", "fileline", "__fl_times",
        F.rtrim(F.col("function"), F.lit("()")).alias("__fl_f"),
        F.when(colon_count == 1, F.split_part(F.col("fileline"), F.lit(":"), F.lit(1)))
         .otherwise(F.col("fileline")).alias("__fl_path"),
        F.when(colon_count == 1, F.expr("try_cast(split_part(fileline, ':', 2) AS BIGINT)")).alias("__fl_line"),
    )
    # the lengths of logged names and paths: few, whatever the number of keys
    shapes = k.select(F.length("__fl_f").alias("__fl_nf"), F.length("__fl_path").alias("__fl_np")).distinct()
    pre = symbol_prefixes(symbols, shapes.select("__fl_nf").distinct())
    by_prefix = pre.groupBy(F.col("prefix").alias("__fl_f")).agg(
        F.sum("n").alias("__fl_n"), F.min_by(F.struct("name", "path"), F.col("seq")).alias("__fl_only"))

    # (prefix, path suffix, line) of the asked prefixes, and its first symbol
    asked = pre.where("n > 0").join(k.select(F.col("__fl_f").alias("prefix")).distinct(), "prefix", "left_semi")
    ends = (asked.withColumn("__fl_nf", F.length("prefix")).join(F.broadcast(shapes), "__fl_nf")
            .where(F.col("__fl_np") <= F.length("path"))
            .groupBy(F.col("prefix").alias("__fl_f"), F.expr("right(path, __fl_np)").alias("__fl_path"),
                     F.col("line").cast("bigint").alias("__fl_line"))
            .agg(F.min(F.struct("seq", "name", "path")).alias("__fl_sym")))
    # a symbol without a line counts as the nearest
    unlined = (ends.where(F.col("__fl_line").isNull())
               .select("__fl_f", "__fl_path", F.col("__fl_sym").alias("__fl_unlined")))

    near = nearest_marked(
        ends.where(F.col("__fl_line").isNotNull()).withColumn("__fl_key", F.lit(False)).unionByName(
            k.join(by_prefix, "__fl_f", "left").join(unlined, ["__fl_f", "__fl_path"], "left")
            .withColumn("__fl_key", F.lit(True)), allowMissingColumns=True),
        ["__fl_f", "__fl_path"], ["__fl_line", "__fl_key"], ~F.col("__fl_key"), F.struct("__fl_line", "__fl_sym"),
        F.coalesce(id_chunk("__fl_line"), F.lit(0).cast("bigint")), before="__fl_before", after="__fl_after")

    def at(side: str):
        return F.when(F.col(side).isNotNull(), F.struct(
            F.abs(F.col("__fl_line") - F.col(f"{side}.__fl_line")).alias("dist"), F.col(f"{side}.__fl_sym").alias("sym")))

    best = F.coalesce("__fl_unlined", F.least(at("__fl_before"), at("__fl_after")).getField("sym"))
    matches = F.col("__fl_n") * F.col("__fl_times")
    usable = F.col("__fl_line").isNotNull()
    pick = (F.when(usable & (matches == 1), F.col("__fl_only"))
            .when(usable & (matches > 1), F.struct(best.getField("name").alias("name"), best.getField("path").alias("path"))))
    return near.where("__fl_key").select(
        "function", "fileline",
        F.coalesce(pick.getField("name"), F.col("function")).alias("name"),
        F.coalesce(pick.getField("path"), F.col("__fl_path")).alias("path"),
        F.col("__fl_line").alias("line"),
    )


def recover_logs(logs: DataFrame, symbols: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Log rows plus ``rec_function``, ``rec_path``, ``rec_line``.

    Only the distinct (function, fileline) pairs are resolved (those of
    ``keys``, where reading them from ``logs`` would be dear); the answer
    is joined back on them.  That side is an aggregate, so adaptive
    execution sees its real size and broadcasts it when it is small.
    """
    keys = (logs if keys is None else keys).select("function", "fileline").distinct()
    res = resolve_keys(keys, symbols).select(
        F.col("function").alias("__fl_fn"), F.col("fileline").alias("__fl_fl"),
        F.col("name").alias("rec_function"), F.col("path").alias("rec_path"), F.col("line").alias("rec_line"))
    cond = (logs["function"].eqNullSafe(res["__fl_fn"])) & (logs["fileline"].eqNullSafe(res["__fl_fl"]))
    return logs.join(res, cond, "left").drop("__fl_fn", "__fl_fl")


def list_functions(logs: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Per node, every function entered (BEG rows), padded to 55, then its
    location.  With ``symbols`` the recovered name and ``path:line`` are
    shown, the name as its first 20 characters with the rest in brackets;
    without, the logged function and fileline."""
    beg = logs.where(F.col("message") == "BEG").select("node", "function", "fileline").distinct()
    if symbols is None:
        return beg.select("node", F.format_string("%-55s  %s", F.col("function"), F.col("fileline")).alias("line"))
    keys = beg.select("function", "fileline").distinct()
    res = resolve_keys(keys, symbols)
    j = beg.join(res, ["function", "fileline"])
    name = F.col("name")
    shown = F.when(F.length(name) > 20, F.concat(F.substring(name, 1, 20), F.lit("["),
                                                 F.substring(name, 21, 1 << 30), F.lit("]"))).otherwise(name)
    loc = F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"))
    return j.select("node", F.format_string("%-55s  %s", shown, loc).alias("line"))
