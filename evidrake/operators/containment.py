"""Which texts hold which passages word for word: a join on anchors, with no comparison of all with all.

A passage that a text holds shares its inner grams with it (grams of whole words, or of characters for passages of few words).
Both sides keep the smallest gram hash of every ``window`` consecutive ones; a window inside the passage is also one of the text, so
each of the passage's anchors is one of the text's. A passage is looked for by its rarest anchor among the texts only, so words
and phrases that many texts share bring no candidates, and a passage with an anchor that no text has is done. Candidates are
verified by ``contains``. Everything is an equality join; what is broadcast is the planner's choice by measured size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound
from ..sources.files import text_parts
from ..sources.store import materialize


@dataclass(frozen=True)
class Tier:
    """Passages with at least ``window`` grams of ``size`` words (or characters) that no smaller tier number takes."""

    words: bool
    size: int
    window: int

    def parts(self, text: Column) -> Column:
        return F.split(text, "[ \n]") if self.words else F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))

    def grams(self, parts: Column) -> Column:
        """Hashes of runs of ``size`` parts."""
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(parts) - self.size, F.lit(0))), lambda i: i + self.size <= F.size(parts))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(parts, i + k) for k in range(self.size)]))

    def anchors(self, grams: Column) -> Column:
        """The smallest hash of each window."""
        if self.window == 1:
            return F.array_distinct(grams)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(grams) - self.window + 1, F.lit(1))), lambda i: i + self.window - 1 <= F.size(grams))
        return F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(grams, i, self.window))))

    def of_text(self, text: Column) -> Column:
        return bound(self.parts(text), lambda p: bound(self.grams(p), self.anchors))

    def of_passage(self, text: Column) -> Column:
        """Anchors of the inner parts: the first and last word may be parts of longer ones in a text."""
        inner = (lambda p: F.slice(p, 2, F.greatest(F.size(p) - 2, F.lit(0)))) if self.words else (lambda p: p)
        return bound(self.parts(text), lambda p: bound(inner(p), lambda q: bound(self.grams(q), self.anchors)))


TIERS = (Tier(True, 2, 6), Tier(True, 2, 1), Tier(False, 3, 1), Tier(False, 1, 1))


def containment(passages: DataFrame, texts: DataFrame, passage_key: str, text_key: str, passage: str = "passage", text: str = "text") -> DataFrame:
    """(passage_key, text_key, passage, text) of the texts that hold a passage verbatim; ``passages`` (passage_key, passage).

    Null and empty passages are held by nothing, null texts hold nothing. Keys are taken to be distinct; rows that repeat a key with
    another text count for themselves. Other columns are not read.
    """
    asked = passages.select(passage_key, F.col(passage).alias("_passage")).where("_passage <> ''")
    sides = texts.select(text_key, F.col(text).alias("_text")).where("_text <> ''")
    tier = F.coalesce(*[F.when(F.size(t.of_passage(F.col("_passage"))) > 0, n) for n, t in enumerate(TIERS)])
    placed = materialize(asked.withColumn("_tier", tier).withColumn("_anchors", reduce(
        lambda rest, nt: F.when(F.col("_tier") == nt[0], nt[1].of_passage(F.col("_passage"))).otherwise(rest), enumerate(TIERS), F.lit(None).cast("array<bigint>"))), "passages")
    used = [r._tier for r in placed.select("_tier").distinct().collect()]  # four values at most
    if not used:
        return asked.join(sides.limit(0), F.lit(False)).select(passage_key, text_key, F.col("_passage").alias(passage), F.col("_text").alias(text))
    wanted = placed.select("_tier", F.explode("_anchors").alias("_anchor")).distinct()
    held = [sides.select(text_key, F.lit(n).alias("_tier"), F.explode(TIERS[n].of_text(F.col("_text"))).alias("_anchor")) for n in sorted(used)]
    hits = materialize(reduce(DataFrame.unionByName, held).join(wanted, ["_tier", "_anchor"]), "anchors")
    often = hits.groupBy("_tier", "_anchor").agg(F.count("*").alias("_n"))
    tried = placed.select(passage_key, "_passage", "_tier", F.explode("_anchors").alias("_anchor")).join(often, ["_tier", "_anchor"], "left")
    order = Window.partitionBy(passage_key, "_passage").orderBy(F.coalesce("_n", F.lit(0)), "_anchor")
    rarest = tried.withColumn("_r", F.row_number().over(order)).where("_r = 1 AND _n > 0").select(passage_key, "_passage", "_tier", "_anchor")
    tried = rarest.join(hits, ["_tier", "_anchor"]).select(passage_key, "_passage", text_key)
    # texts are dealt as the candidates are: a task that sorts them has no more than its bytes
    found = tried.repartition(text_parts(sides.select(F.col("_text").alias("text"))), text_key).distinct().join(sides, text_key)
    return found.where(F.col("_text").contains(F.col("_passage"))).select(passage_key, text_key, F.col("_passage").alias(passage), F.col("_text").alias(text))
