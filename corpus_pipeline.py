"""The corpus pipeline: quality rules, toxicity, line deduplication, near duplicates, packing.

``run`` applies the stages to ``documents``; each stage's result is written as Parquet to the folder that all executors
share and read again as the next one's documents. Every stage but the last returns the columns of its input.

Defined results: each stage handles nulls, repeated rows, empty tables and further columns as its operator does; a
table without ``labels`` beside it has no toxic documents.

A task that reads or writes Parquet holds a whole row group, so the stages' results are written in groups of ROW_GROUP bytes:
with the usual 128 MB, a few tasks that read one stage's result and write the next fill a heap of 1 GB. A batch of 10,000
documents, as Spark sends them to Python, is 25 MB of text and more: it stands in Arrow's memory beside the heap, where each
column is moved to ever larger places as it grows, and again in the worker. So a batch ends at BATCH bytes. As the caller may
write a stage's result, a stage sets ``parquet.block.size`` and ``spark.sql.execution.arrow.maxBytesPerBatch`` in the session
unless they are set there; ``run`` takes them back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from recframe.llm import jaccard, line_dedup, packing, quality_rules, toxicity
from recframe.llm.common import SLICE_BYTES, SLICES_KEPT, removed, shared_dir, table, table_if_any

#: Bytes of a row group in what stages return, about, and the setting for it.
ROW_GROUP, GROUPS = 8 << 20, "parquet.block.size"
#: Bytes of an Arrow batch, about, and the setting for it: as many slices as a worker works on before it gives memory back.
BATCH, BATCHES = SLICES_KEPT * SLICE_BYTES, "spark.sql.execution.arrow.maxBytesPerBatch"
BOUNDS = {GROUPS: ROW_GROUP, BATCHES: BATCH}


def in_small_groups(stage: Callable) -> Callable:
    """``stage``, which works by batches of BATCH bytes, and whose result is written in row groups of ROW_GROUP bytes, unless
    the session says otherwise."""

    @wraps(stage)
    def own(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, most in BOUNDS.items():
            if spark.conf.get(key, None) is None:
                spark.conf.set(key, str(most))
        return stage(spark, docs, sf_dir)

    return own


@in_small_groups
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


@in_small_groups
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic. The model learns from the labelled documents of the source, outside its held-out fold."""
    model = toxicity.learn(table(spark, sf_dir, "documents"), table_if_any(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


@in_small_groups
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one holds; those of which no word is left go. n_chars follows the text."""
    return line_dedup.keep_rest(docs)


@in_small_groups
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id, and all documents without words or id."""
    gone = jaccard.near_duplicates(docs, percent=80, words=5, count_links=False).filter("doc_id <> component_id").select("doc_id").distinct().toDF("gone")
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


@in_small_groups
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents that are left."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("toxicity", toxic), ("line dedup", lines), ("n-gram Jaccard join", near), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each on what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    own = [key for key in BOUNDS if spark.conf.get(key, None) is None]
    try:
        for k, (_, stage) in enumerate(STAGES):
            path = f"{base}/{k}"
            stage(spark, docs, sf_dir).write.parquet(path)
            if k:
                removed(spark, f"{base}/{k - 1}")  # nothing reads it any more
            docs = spark.read.parquet(path)
    finally:
        for key in own:
            spark.conf.unset(key)
    return docs


#: No SQL: packing, alignment and the toxicity model can't be written in it; tests compare with brute force.
ORACLE_SQL = None
