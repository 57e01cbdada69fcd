"""Answerability: does the retrieved evidence support an answer, or is it merely about the subject?

One row for each question and scope holds its few retrieved chunks as an array and the weights of the question's
stems as a map; the rules are expressions over that row, so nothing is shuffled after retrieval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import (
    asks_about_instruction, content_stems, evidence_sentences, has_negation, is_instruction_evidence, is_positive_yes_no, restem, starts_with_negation, stem,
)
from ..sources import files
from ..sources.files import dealt
from ..sources.store import materialize
from .index import Index
from .retrieval import among, ranked, whole_k


def weight_of(stem: Column) -> Column:
    return F.coalesce(F.try_element_at("weights", stem), F.col("unseen"))


def total_weight(stems: Column) -> Column:
    return F.aggregate(stems, F.lit(0.0), lambda a, s: a + weight_of(s))


def coverage(stems: Column, evidence: Column) -> Column:
    """Share of the weight of ``stems`` (distinct) whose stems are in ``evidence``; 0 without stems."""
    hit = F.filter(stems, lambda s: F.array_contains(evidence, s))
    return F.coalesce(F.try_divide(total_weight(hit), total_weight(stems)), F.lit(0.0))


def rounded(x: Column) -> Column:
    return F.round(x, L.PLACES)


def gather(retrieved: DataFrame, questions: DataFrame, asks: DataFrame, posts: DataFrame, keys: tuple[str, ...], chunks: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(question_id, keys, question, results, weights, unseen, other columns of questions); pairs without chunks have an empty array.

    With ``chunks`` ``retrieved`` has ranks only: a chunk that several questions got is sent to its scope once, and meets the pairs last.
    Each step deals its rows to ``parts`` partitions (:func:`pair_parts`); None: to the session's number.
    """
    pair = ("question_id", *keys)
    stored = [c for c in ("text", "stems") if c in (retrieved if chunks is None else chunks).columns]
    fields = F.struct("rank", "chunk_index", "score", *(stored if chunks is None else []))
    results = dealt(retrieved, parts, *pair).groupBy(*pair).agg(F.array_sort(F.collect_list(fields)).alias("results"))
    stems = content_stems(F.col("question"))
    asked = questions.select("question_id", F.explode(F.array_distinct(F.concat(stems, restem(stems)))).alias("stem"))
    asked = materialize(asked, "question-stems")
    pairs = dealt(asks.select(*pair), parts, *pair).distinct()
    # only postings with a stem that is asked for are shuffled; the largest weight of a scope is its largest idf
    known = among(posts.select(*keys, stem(F.col("term")).alias("stem"), "idf"), asked.select("stem").distinct(), "stem")
    found = dealt(pairs.join(dealt(asked, parts, "question_id"), "question_id"), parts, *keys, "stem").join(known, [*keys, "stem"])
    found = dealt(found, parts, *pair).groupBy(*pair, "stem").agg(F.max("idf").alias("weight"))
    found = found.groupBy(*pair).agg(F.map_from_entries(F.collect_list(F.struct("stem", "weight"))).alias("weights"))
    rows = pairs.join(dealt(questions, parts, "question_id"), "question_id").join(results, [*pair], "left").join(found, [*pair], "left")
    scopes = dealt(posts.groupBy(*keys).agg(F.max("idf").alias("top")), parts, *keys)
    if chunks is not None:
        won = dealt(retrieved.select(*keys, "chunk_index"), parts, *keys).groupBy(*keys).agg(F.collect_set("chunk_index").alias("won"))
        winners = chunks.select(*keys, "chunk_index", *stored).join(won, list(keys)).where(F.array_contains("won", F.col("chunk_index")))
        scopes = dealt(winners, parts, *keys).groupBy(*keys).agg(F.collect_list(F.struct("chunk_index", *stored)).alias("held")).join(scopes, list(keys), "left")
    rows = dealt(rows, parts, *keys).join(scopes, list(keys), "left")
    if chunks is not None:
        with_texts = lambda r: F.transform(
            F.filter("held", lambda c: c.chunk_index == r.chunk_index), lambda c: F.struct(r["rank"].alias("rank"), r.chunk_index.alias("chunk_index"), r.score.alias("score"), *(c[x].alias(x) for x in stored)))
        rows = rows.withColumn("results", F.flatten(F.transform("results", with_texts)))
    # the weight of unseen stems matters only beside a known one: without one every share is 0
    unseen = F.when(F.col("weights").isNotNull(), F.greatest(F.lit(1.0), "top")).otherwise(1.0)
    return rows.select(
        *pair, *(c for c in questions.columns if c not in pair), F.coalesce("results", F.array().cast(rows.schema["results"].dataType)).alias("results"),
        F.coalesce("weights", F.create_map().cast("map<string,double>")).alias("weights"), unseen.alias("unseen"),
    )


def lines(wanted: Column) -> Column:
    """Of each relevant result: its rank, and its sentences with their stems; empty unless ``wanted``."""
    relevant = F.filter("results", lambda r: rounded(r.score) >= L.RELEVANCE)
    split = lambda r: F.transform(evidence_sentences(r.text), lambda s: F.struct(s.alias("text"), F.array_distinct(content_stems(s)).alias("stems")))
    return F.when(wanted, F.transform(relevant, lambda r: F.struct(r["rank"].alias("rank"), split(r).alias("parts"))))


def negative_support() -> Column:
    """The best sentence that denies a positive yes-or-no question, with the one after it; null if there is none.

    Needs the columns lines, denied_terms and denied_unique.
    """
    terms, unique = F.col("denied_terms"), F.col("denied_unique")
    least = F.when(F.size(terms) > 1, 2).otherwise(1)

    def judge(r: Column) -> Column:
        fits = F.transform(r.parts, lambda p, i: F.struct(i.alias("at"), F.when(has_negation(p.text) & (F.size(F.array_intersect(unique, p.stems)) >= least), coverage(unique, p.stems)).alias("coverage")))
        good = F.filter(fits, lambda x: rounded(x.coverage) >= L.NEGATIVE_COVERAGE)
        return F.transform(good, lambda x: F.struct(
            (~starts_with_negation(F.get(r.parts, x.at).text)).alias("indirect"), (-rounded(x.coverage)).alias("order"), r["rank"].alias("rank"), x.at.alias("at"), x.coverage.alias("coverage"),
            F.array_join(F.transform(F.slice(r.parts, x.at + 1, 2), lambda p: p.text), " ").alias("span")))

    return F.when(is_positive_yes_no(F.col("question")) & (F.size(terms) > 0), F.array_min(F.flatten(F.transform("lines", judge))))


def instruction_support() -> Column:
    """The best one or two sentences that a question about a text's instruction asks for; null if there are none.

    Needs the columns lines and told_terms.
    """
    terms = F.col("told_terms")

    def judge(r: Column) -> Column:
        def one(i: Column, length: int) -> Column:
            parts = F.slice(r.parts, i + 1, length)
            return F.struct(
                i.alias("at"), F.lit(length).alias("length"), F.array_join(F.transform(parts, lambda p: p.text), " ").alias("span"),
                F.array_distinct(F.flatten(F.transform(parts, lambda p: p.stems))).alias("stems"))

        spans = F.filter(F.flatten(F.transform(r.parts, lambda p, i: F.array(one(i, 1), one(i, 2)))), lambda x: (x.at + x.length <= F.size(r.parts)) & is_instruction_evidence(x.span))
        weighed = F.transform(spans, lambda x: F.struct(x.alias("x"), coverage(terms, x.stems).alias("coverage")))
        good = F.filter(weighed, lambda w: (F.size(terms) == 0) | (rounded(w.coverage) >= L.INSTRUCTION_COVERAGE))
        return F.transform(good, lambda w: F.struct(
            (-rounded(w.coverage)).alias("order"), F.length(w.x.span).alias("chars"), r["rank"].alias("rank"), w.x.at.alias("at"), w.x.length.alias("length"), w.coverage.alias("coverage"), w.x.span.alias("span")))

    return F.when(asks_about_instruction(F.col("question")), F.array_min(F.flatten(F.transform("lines", judge))))


def assess(pairs: DataFrame) -> DataFrame:
    """pairs with the signals and supports that a decision needs, whatever its threshold."""
    terms = pairs.withColumn("terms", F.array_distinct(content_stems(F.col("question"))))
    stored = "stems" in pairs.schema["results"].dataType.elementType.names
    passages = terms.withColumn("passages", F.transform("results", lambda r: r.stems if stored else F.array_distinct(content_stems(r.text))))
    judged = passages.withColumn("covered", F.transform("passages", lambda p: coverage(F.col("terms"), p)))
    judged = judged.withColumn("best", F.array_min(F.transform("covered", lambda c, i: F.struct((-rounded(c)).alias("order"), (i + 1).alias("rank"), c.alias("coverage")))))
    key = F.array_min(F.transform("terms", lambda s, i: F.struct((-rounded(weight_of(s))).alias("order"), i.alias("at"), s.alias("stem"))))
    top, second = F.get("results", F.lit(0)).score, F.get("results", F.lit(1)).score
    out = judged.withColumn("top_score", F.coalesce(top, F.lit(0.0))).withColumn("score_margin", F.coalesce(top, F.lit(0.0)) - F.coalesce(second, F.lit(0.0)))
    out = out.withColumn("relevant", (F.size("results") > 0) & (rounded(F.col("top_score")) >= L.RELEVANCE))
    out = out.withColumn("key_term", key.stem).withColumn("key_present", (F.size("terms") == 0) | F.array_contains(F.get("passages", F.col("best.rank") - 1), F.col("key_term")))
    question = F.col("question")
    special = is_positive_yes_no(question) | asks_about_instruction(question)
    out = out.withColumn("denied_terms", content_stems(question, L.FRAMING_TERMS)).withColumn("denied_unique", F.array_distinct("denied_terms"))
    out = out.withColumn("told_terms", F.array_distinct(content_stems(question, L.META_TERMS))).withColumn("lines", lines(F.col("relevant") & special))
    out = out.withColumn("negative", F.when(F.col("relevant"), negative_support()))
    out = out.withColumn("instruction", F.when(F.col("relevant") & F.col("negative").isNull(), instruction_support()))
    return out.drop("denied_terms", "denied_unique", "told_terms", "lines")


def decide(assessed: DataFrame, threshold: Column | float = L.COVERAGE) -> DataFrame:
    """assessed with answerable, reason, support_kind, support_span, selected_rank and evidence_coverage."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    best = F.coalesce("best.coverage", F.lit(0.0))
    special = F.coalesce("negative.rank", "instruction.rank")
    enough = (rounded(best) >= rounded(limit)) & F.col("key_present")
    out = assessed.withColumn("reason", F.when(~F.col("relevant"), "no_relevant_chunk").when(special.isNotNull() | enough, "supported").otherwise("insufficient_evidence"))
    return (
        out.withColumn("answerable", F.col("reason") == "supported")
        .withColumn("support_kind", F.when(F.col("negative").isNotNull(), "explicit_negative").when(F.col("instruction").isNotNull(), "instruction_description").otherwise("standard"))
        .withColumn("support_span", F.coalesce("negative.span", "instruction.span"))
        .withColumn("selected_rank", F.when(F.col("relevant"), F.coalesce(special, "best.rank")).otherwise(1))
        .withColumn("evidence_coverage", F.when(F.col("relevant"), F.greatest(best, F.coalesce("negative.coverage", "instruction.coverage", F.lit(0.0)))).otherwise(0.0))
    )


def pair_parts(index: Index, asks: DataFrame, k: float) -> int:
    """How many partitions the rows of ``asks``, with the texts of k chunks each, and the index need, so that a task's memory does not grow."""
    size = files.text_bytes(index.chunks) if index.size is None else index.size
    each = size / max(index.chunks.count(), 1)
    return files.parts(index.chunks.sparkSession, max(size, asks.count() * whole_k(k) * each), files.TASK_BYTES)


def assessed_pairs(index: Index, questions: DataFrame, asks: DataFrame, k: float = L.TOP_K, everywhere: bool = False) -> DataFrame:
    """``everywhere``: asks puts every question to every scope of the index, so retrieval need not meet it."""
    posts, keys, parts = index.postings, index.keys, pair_parts(index, asks, k)
    found = materialize(ranked(index.chunks, questions, None if everywhere else asks, k, posts, keys, parts=parts), "ranked")
    return assess(gather(found, questions, asks, posts, keys, index.chunks, parts))
