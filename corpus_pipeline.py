"""A corpus from documents to packed sequences: each stage written as Parquet and read by the next.

language ID -> exact dedup -> near dedup -> mixing to target weights -> packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelgrid.llm.exact_dedup import drop_exact_copies
from reelgrid.llm.langid import accepted_documents
from reelgrid.llm.mixing import mix
from reelgrid.llm.packing import pack
from reelgrid.llm.scratch import Scratch
from reelgrid.llm.simhash import drop_near_copies

#: Whole documents that a Python worker gets at once in the stages.
DOCUMENTS_AT_ONCE = 1000


def _session(spark: SparkSession) -> None:
    """Sets the session for rows that hold whole texts; it stays so."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(DOCUMENTS_AT_ONCE))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go (null or letterless text among them)."""
    _session(spark)
    return accepted_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space one stays."""
    _session(spark)
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word Jaccard similarity of 0.8 or more, directly or over others) one stays."""
    _session(spark)
    return drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or twice."""
    _session(spark)
    return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token sequences with their ids."""
    _session(spark)
    return pack(docs)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixture), ("packing", packed)]

#: The language model, the fingerprints and the tokens are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
