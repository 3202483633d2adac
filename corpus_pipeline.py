"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; what it
returns is written as Parquet and read again as the next stage's documents.
All but the last keep the columns of ``documents``.  Each stage reads only the
columns it works on by name, so further columns pass through; nulls, empty and
repeated rows are treated as the operators' modules say, and empty documents
give an empty result.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetlog.llm import decontaminate, language, packing, secret_scan, simhash  # noqa: E402
from fleetlog.llm.common import stored, table  # noqa: E402


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network knows: those without a letter, and
    those whose best pooled probability is below its language's least score, go."""
    who = language.train_identifier(docs)
    out = {"lang_pred": "__lang_pred", "score": "__score"}  # columns of ``docs`` stay
    scored = stored(language.predicted(docs, who, **out), "pipeline/scored")
    return language.known(scored, language.least_scores(scored, who, name="pipeline", **out), **out)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the smallest doc_id."""
    return simhash.one_of_each(docs, "pipeline/simhash")


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark passages."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), "pipeline/decontaminate")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, owner-specific secrets masked; widely copied examples
    stay."""
    owned = docs.withColumn("_repository", F.concat_ws("/", "source", "lang"))
    scanned = secret_scan.scan(owned, "pipeline/secrets", repository="_repository")
    return secret_scan.masked(docs, scanned, length="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 4096 ids."""
    return packing.digest(packing.pack_documents(docs, "pipeline/pack"))


STAGES = [
    ("language", known_language),
    ("near_duplicates", distinct_documents),
    ("decontamination", uncontaminated),
    ("secrets", without_secrets),
    ("packing", packed),
]

# A recurrent network, XXH64 and a subword tokenizer are beyond SQL: tested
# against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
