"""Bounded samples of labelled documents, drawn by a hash of the id (so alike at every size)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Labelled documents that a classifier is fitted on at most (documented bound).
SAMPLE = 8192


def draw(documents: DataFrame, labels: DataFrame, target: str, columns: list[str], sample: int = SAMPLE, seed: int = 3) -> DataFrame:
    """``columns`` of at most ``sample`` labelled training documents and target (0 or 1).

    One row for each id (the least by its columns). Rows of the held-out fold, null ids, labels other than 0 and 1, and ids with both labels are left out.
    """
    y = F.col(target).cast("int")
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & y.isin(0, 1))
    one = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(y).alias("target"), F.max(y).alias("most")).where("target = most")
    chosen = one.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample).select(F.col("doc_id").alias("id"), "target")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *columns)
    found = docs.join(F.broadcast(chosen), docs.doc_id == chosen.id).drop("id")  # at most ``sample`` rows of 12 bytes
    # of rows that share an id the least, so that ids bound the rows
    return found.groupBy("doc_id").agg(F.min(F.struct("target", *columns)).alias("row")).select("doc_id", "row.*")
