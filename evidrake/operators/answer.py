"""Answers from decisions: the supporting span or chunk with its citation, or a refusal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import content_stems, protected_sentences, restem, to_fixed, trim, wants_compact
from .gate import rounded, total_weight


def answer_span(question: Column, passage: Column, context: int = 0) -> Column:
    """One or two sentences with the most weight of the question's stems; the whole passage if none decides.

    Needs the columns weights and unseen. More sentences win a tie, then fewer characters, then the earlier one.
    """
    parts = F.transform(protected_sentences(passage), lambda s: F.struct(s.alias("text"), restem(content_stems(s)).alias("stems")))
    asked = restem(content_stems(question))
    # tokens never cross sentences, so the passage's stems are those of its sentences
    packed = F.struct(parts.alias("parts"), asked.alias("asked"))

    def choose(x: Column) -> Column:
        inside = F.array_distinct(F.flatten(F.transform(x.parts, lambda p: p.stems)))
        wanted = F.array_intersect(x.asked, inside)

        def window(i: Column, length: int) -> Column:
            some = F.slice(x.parts, i + 1, length)
            hit = F.array_intersect(wanted, F.flatten(F.transform(some, lambda p: p.stems)))
            chars = F.length(F.array_join(F.transform(some, lambda p: p.text), " "))
            return F.struct((-rounded(total_weight(hit))).alias("order"), F.lit(-length).alias("more"), chars.alias("chars"), i.alias("at"), F.lit(length).alias("length"))

        windows = F.flatten(F.transform(x.parts, lambda p, i: F.array(window(i, 1), window(i, 2))))
        return F.array_min(F.filter(windows, lambda w: w.at + w.length <= F.size(x.parts)))

    # one-element arrays bind a value, so that it is computed once
    best = F.transform(F.array(packed), lambda x: F.struct(x.parts.alias("parts"), choose(x).alias("w")))

    def span(b: Column) -> Column:
        first = F.greatest(b.w.at - context, F.lit(0))
        text = F.array_join(F.transform(F.slice(b.parts, first + 1, b.w.at + b.w.length + context - first), lambda p: p.text), " ")
        return F.when((F.size(b.parts) > 1) & (b.w.order < 0), text)

    return F.coalesce(F.get(F.transform(best, span), F.lit(0)), trim(passage))


def answer(decided: DataFrame) -> DataFrame:
    """decided with answer, cited_chunk_ids, mode and confidence. Confidence is the first rank's score, whichever is cited."""
    chosen = F.get("results", F.col("selected_rank") - 1)
    question = F.col("question")
    span = F.coalesce("support_span", F.when(wants_compact(question, chosen.text), answer_span(question, chosen.text)).otherwise(chosen.text))
    prefix = F.when(F.col("support_kind") == "explicit_negative", "No. ").when(F.col("support_kind") == "instruction_description", "The document says: ").otherwise("")
    cited = F.array(F.concat(F.lit("chunk_"), chosen.chunk_index.cast("string")))
    return (
        decided.withColumn("answer", F.when(F.col("answerable"), F.concat(prefix, span)).otherwise(L.REFUSAL))
        .withColumn("cited_chunk_ids", F.when(F.col("answerable"), cited).otherwise(F.array().cast("array<string>")))
        .withColumn("mode", F.lit("extractive"))
        .withColumn("confidence", F.col("top_score"))
    )


def answer_without_index(pairs: DataFrame) -> DataFrame:
    """For pairs (question_id, keys, question, results) with no index: only the relevance gate, and the whole first chunk."""
    top = F.get("results", F.lit(0))
    score = F.coalesce(top.score, F.lit(0.0))
    relevant = (F.size("results") > 0) & (rounded(score) >= L.RELEVANCE)
    cited = F.array(F.concat(F.lit("chunk_"), top.chunk_index.cast("string")))
    return (
        pairs.withColumn("answer", F.when(relevant, top.text).otherwise(L.REFUSAL))
        .withColumn("cited_chunk_ids", F.when(relevant, cited).otherwise(F.array().cast("array<string>")))
        .withColumn("mode", F.lit("extractive")).withColumn("confidence", score)
        .withColumn("reason", F.when(relevant, "supported").otherwise("no_relevant_chunk")).withColumn("evidence_coverage", F.lit(0.0))
    )


def selected_first() -> Column:
    """The results with the selected one in front, the others in their order."""
    chosen = F.col("selected_rank")
    return F.concat(F.filter("results", lambda r: r["rank"] == chosen), F.filter("results", lambda r: r["rank"] != chosen))


def response(answered: DataFrame, chunks: DataFrame, keys: tuple[str, ...] = ("doc_id",), provider_available: bool = False) -> DataFrame:
    """The projection that a caller gets: the answer, the number of chunks, and the retrieved ones by rank."""
    counts = chunks.groupBy(*keys).agg(F.count("*").alias("chunk_count"))
    retrieved = F.transform("results", lambda r: F.struct(F.concat(F.lit("chunk_"), r.chunk_index.cast("string")).alias("id"), to_fixed(r.score).alias("score")))
    return answered.join(counts, list(keys), "left").select(
        "question_id", *keys, "answer", "cited_chunk_ids", "mode", "confidence", "reason", "evidence_coverage",
        F.lit(provider_available).alias("provider_available"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), retrieved.alias("retrieved_chunks"),
    )
