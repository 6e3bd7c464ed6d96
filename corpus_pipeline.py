"""A corpus pipeline of the operators: quality classifier, exact dedup, near-dup groups, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. Documents come
through with the columns of the documents table; the last stage returns pieces of packed sequences.

Defined results: null texts are empty ones, and are scored, compared and packed as such; a null id is never linked with another
document; rows of one id that are left after a stage are all left, and are packed one by one; very long texts come through whole;
of equal texts the largest id stays, of near copies the smallest; an empty table gives an empty result; columns of any
name come through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cleanloom import on_workers
from cleanloom.llm import _shared as sh
from cleanloom.llm import dedup, near_dup, packing, quality
from cleanloom.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    on_workers(spark)
    return quality.keep_good(docs, quality.fit(docs, sh.table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    on_workers(spark)
    return dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    on_workers(spark)
    return near_dup.one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of all documents, in sequences."""
    on_workers(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality_trees", quality_stage), ("exact_dedup", exact_stage), ("lsh_forest", near_stage), ("vector_packing", packing_stage)]

#: Trees, signatures and packing have no form in SQL; tests hold the pipeline against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table; each one's rows are written before the next reads them."""
    docs = sh.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = sh.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
