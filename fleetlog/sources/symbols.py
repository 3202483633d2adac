"""Symbol table source: ``ctags -x`` text -> (name, path, line, seq).

A line is cut at the first ``function``; the part before is the name (at
most two words, else the line is skipped), the part after holds the line
number (digits that fit 64 bits, else skipped), the path and the code.  ``seq`` keeps
the table order, which breaks ties in recovery.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Some rendered lines have a line number beyond 32 bits.
LONG_LINE = 10_000_000_000
_WS = " \t\n\r\x0b\x0c"


def parse_ctags(lines: DataFrame, seq: str | None = None) -> DataFrame:
    v = F.col("value")
    i = F.instr(v, "function")
    tag = F.btrim(F.substring(v, F.lit(1), i - 1), F.lit(_WS))
    rest = F.btrim(F.substring(v, i + 8, F.lit(1 << 30)), F.lit(_WS))
    words = F.size(F.filter(F.split(tag, r"\s+"), lambda w: w != ""))
    pcs = F.split(rest, r"\s+", 3)
    lineno = F.try_element_at(pcs, F.lit(1))
    keep = (i > 0) & (words <= 2) & (F.size(pcs) >= 3) & lineno.rlike("^[0-9]+$")
    order = F.col(seq) if seq else F.monotonically_increasing_id()
    return (lines.where(keep).withColumn("__fl_line", lineno)
            .select(tag.alias("name"), F.try_element_at(pcs, F.lit(2)).alias("path"),
                    F.expr("try_cast(__fl_line AS BIGINT)").alias("line"), order.alias("seq"))
            .where(F.col("line").isNotNull()))


def load_ctags(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Read ``ctags -x`` output files; ``seq`` follows file order."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.text(paths).select(
        "value",
        # file order: path, then split offset, then row inside the split
        F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                 F.monotonically_increasing_id()).alias("__fl_pos"))
    return parse_ctags(raw, "__fl_pos")


def render_ctags_from_parts(spark: SparkSession, sf_dir: str) -> str:
    """Write a ``ctags -x``-style listing built from the ``part`` table:
    SMALL parts get a three-word name and LARGE parts a non-numeric line
    number (both skipped by the loader), PROMO parts a one-word name."""
    from ..session import read_table, scratch_path

    p = read_table(spark, sf_dir, "part")
    name = (F.when(F.col("p_type") == "SMALL", F.concat_ws(" ", "p_name", F.lower("p_type")))
            .when(F.col("p_type") == "PROMO", F.split_part("p_name", F.lit(" "), F.lit(1)))
            .otherwise(F.col("p_name")))
    lineno = F.concat(F.when(F.col("p_type") == "LARGE", F.lit("L")).otherwise(F.lit("")),
                      (F.col("p_size") + F.when(F.col("p_size") % 10 == 7, F.lit(LONG_LINE)).otherwise(F.lit(0)))
                      .cast("string"))
    path = F.concat(F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/"),
                    F.lower("p_type"), F.lit(".cpp"))
    code = F.concat(F.lit("void "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("()"))
    out = scratch_path(spark, "ctags")
    p.orderBy("p_partkey").select(F.concat_ws(" ", name, F.lit("function"), lineno, path, code).alias("value")).write.text(out)
    return out
