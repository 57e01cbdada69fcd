"""The TF-IDF index of chunks, in the scope of a document (or of any keys).

All counts are windows and aggregates over supersets of the scope's keys, so one shuffle on the keys serves them all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import content_stems, stem, tokens
from ..sources import files
from ..sources.store import materialize
from .chunking import chunk_documents


@dataclass
class Index:
    """Stored chunks (with their stems) and postings, read by every later step and by any number of questions."""

    chunks: DataFrame
    postings: DataFrame
    keys: tuple[str, ...] = ("doc_id",)
    #: Bytes of the chunks' texts; None: not counted yet.
    size: int | None = None


def build_index(docs: DataFrame, target: float = L.TARGET_CHARS, overlap: float = L.OVERLAP_CHARS, keys: tuple[str, ...] = ("doc_id",)) -> Index:
    """Chunks and postings of (keys, text), each computed once and written to the shared folder."""
    return index_chunks(chunk_documents(docs, target, overlap, keys), keys)


def index_chunks(chunks: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> Index:
    """The index of chunks, which are stored with their distinct stems in order: every question on a chunk reads them."""
    kept = materialize(with_stems(chunks), "chunks")
    size = files.text_bytes(kept)
    return Index(kept, materialize(postings(kept, keys, files.parts(kept.sparkSession, size, files.TASK_BYTES)), "postings"), keys, size)


def with_stems(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("stems", F.array_sort(F.array_distinct(content_stems(F.col("text")))))


def postings(chunks: DataFrame, keys: tuple[str, ...] = ("doc_id",), parts: int | None = None) -> DataFrame:
    """(keys, chunk_index, term, tf, n_tokens, n_chunks, df, idf, weight, norm); chunks without tokens have no rows but count.

    norm: of the chunk's weights. Chunks are dealt by ``keys`` to ``parts`` partitions (:func:`files.text_parts`), since a task holds
    several sorts of all its terms; None: to the session's number, 0: they are dealt already.
    """
    scope = Window.partitionBy(*keys)
    dealt = chunks.repartition(*keys) if parts is None else chunks.repartition(parts, *keys) if parts else chunks
    split = dealt.select(*keys, "chunk_index", tokens(F.col("text")).alias("ts"))
    split = split.withColumn("n_tokens", F.size("ts")).withColumn("n_chunks", F.count("*").over(scope))
    long = split.select(*keys, "chunk_index", "n_tokens", "n_chunks", F.explode("ts").alias("term"))
    tf = long.groupBy(*keys, "chunk_index", "term", "n_tokens", "n_chunks").agg(F.count("*").alias("tf"))
    counted = tf.withColumn("df", F.count("*").over(Window.partitionBy(*keys, "term")))
    counted = counted.withColumn("idf", F.ln((F.col("n_chunks") + 1) / (F.col("df") + 1)) + 1)
    weighted = counted.withColumn("weight", F.col("tf") / F.col("n_tokens") * F.col("idf"))
    return weighted.withColumn("norm", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(*keys, "chunk_index"))))


def terms(posts: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, term, df, idf): the vocabulary."""
    return posts.groupBy(*keys, "term").agg(F.first("df").alias("df"), F.first("idf").alias("idf"))


def norms(posts: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return posts.groupBy(*keys, "chunk_index").agg(F.first("norm").alias("norm"))


def stem_weights(posts: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, stem, weight): the largest idf of the terms with that stem."""
    return posts.groupBy(*keys, stem(F.col("term")).alias("stem")).agg(F.max("idf").alias("weight"))


def unseen_weight(weights: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The weight of a stem that the scope has not: its largest one, at least 1."""
    return weights.groupBy(*keys).agg(F.greatest(F.lit(1.0), F.max("weight")).alias("unseen"))
