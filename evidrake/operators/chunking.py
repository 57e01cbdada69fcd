"""Chunking: paragraphs packed greedily with overlap, and long single runs cut into windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import bound, trim


def clamp(target: float, overlap: float) -> tuple[int, int]:
    target = max(L.LEAST_TARGET, math.floor(target))
    return target, max(0, min(math.floor(overlap), target - 1))


def windows(text: Column, target: int, overlap: int) -> Column:
    """Trimmed windows of ``target`` characters, each ``target - overlap`` after the one before; the last ends the text.

    The text is cut into strides once and a window joins the few that it covers, so the cost is linear in the text.
    """
    step = target - overlap
    covered = -(-target // step)
    last = F.greatest(F.ceil((F.length(text) - target) / step).cast("int"), F.lit(0))
    strides = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % step), F.lit(0))
    window = lambda s, k: trim(F.left(F.array_join(F.slice(s, k + 1, covered), ""), F.lit(target)))
    return bound(strides, lambda s: F.transform(F.sequence(F.lit(0), last), lambda k: window(s, k)))


def packed(text: Column, target: int, overlap: int) -> Column:
    """Paragraphs gathered while they fit; each new chunk starts with the tail of the one before.

    With an overlap of 0 the tail is the whole chunk before, so chunks grow.
    """
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), trim), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))
    tail = (lambda b: F.right(b, F.lit(overlap))) if overlap else (lambda b: b)
    flush = lambda a: F.when(trim(a.held) != "", F.concat(a.out, F.array(trim(a.held)))).otherwise(a.out)

    def add(a: Column, p: Column) -> Column:
        full = (F.length(a.held) + F.length(p) > target) & (a.held != "")
        joined = F.when(full, F.concat(tail(a.held), F.lit("\n\n"), p)).when(a.held == "", p).otherwise(F.concat(a.held, F.lit("\n\n"), p))
        return F.struct(F.when(full, flush(a)).otherwise(a.out).alias("out"), joined.alias("held"))

    return F.aggregate(paragraphs, start, add, flush)


def chunks_of(text: Column, target: int, overlap: int) -> Column:
    """The chunks of a text as an array; null for null, empty for a blank text. Each step is computed once."""

    def cut(t: Column) -> Column:
        wraps = F.length(t) > L.WRAP_FACTOR * target
        return bound(packed(t, target, overlap), lambda parts: F.when((F.size(parts) == 1) & wraps, windows(t, target, overlap)).otherwise(parts))

    return bound(trim(F.replace(text, F.lit("\r\n"), F.lit("\n"))), cut)


def chunk_documents(docs: DataFrame, target: float = L.TARGET_CHARS, overlap: float = L.OVERLAP_CHARS, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, chunk_index, chunk_id, text) from (keys, text); null and blank texts have no chunks."""
    # outer: a generator that drops empty arrays gets a filter on its input, which would pack every text again
    parts = docs.select(*keys, F.posexplode_outer(chunks_of(F.col("text"), *clamp(target, overlap))).alias("chunk_index", "text")).where("chunk_index IS NOT NULL")
    return parts.select(*keys, "chunk_index", F.concat(F.lit("chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), "text")
