"""A bounded, repeatable sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import documents

#: Labelled documents that a classifier is fitted on, at any size of the input.
ROWS = 8_000


def sample(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, rows: int = ROWS) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most ``rows`` labelled documents, those with the least hashes.

    ``learn_from`` is a condition on doc_id. Null labels are left out; of labels of one document the largest
    counts; of repeated documents the least text. The table of ids is bounded by ``rows`` and broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    chosen = known.where(learn_from).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(label)), "doc_id").limit(rows)
    found = documents(docs).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
