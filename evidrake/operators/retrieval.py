"""Ranking of chunks for questions by cosine of TF-IDF vectors, with a deterministic top-k."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import tokens
from ..sources import files
from ..sources.store import materialize
from .index import postings

#: Questions, put to every scope, whose terms may be broadcast, and the bytes of their texts; more are dealt by term.
QUESTIONS_AT_ONCE, QUESTION_BYTES = 4096, 8 << 20
#: Postings of a term beyond which it is split where postings are dealt by term.
HOT_TERM = 1_000_000


def whole_k(k: float) -> int:
    """Not finite or not positive: nothing is retrieved."""
    return max(0, math.floor(k)) if math.isfinite(k) else 0


#: Distinct terms (or stems) of questions, and their bytes, up to which the postings that have them are chosen before they are dealt.
TERMS_AT_ONCE, TERM_BYTES = 1 << 18, 8 << 20


def among(posts: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """``posts`` whose ``column`` is one of the distinct ``wanted`` where these are few enough to be broadcast; else all, which a join follows."""
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("bytes")).first()
    return posts.join(F.broadcast(wanted), column, "left_semi") if size.n <= TERMS_AT_ONCE and size.bytes <= TERM_BYTES else posts


def question_terms(questions: DataFrame, parts: int | None = None) -> DataFrame:
    """(question_id, term, share): of the question's tokens. Questions are dealt by id to ``parts`` partitions."""
    split = files.dealt(questions, parts, "question_id").select("question_id", tokens(F.col("question")).alias("ts"))
    long = split.select("question_id", F.size("ts").alias("n"), F.explode("ts").alias("term"))
    return long.groupBy("question_id", "n", "term").agg((F.count("*") / F.col("n")).alias("share")).drop("n")


def hot_terms(posts: DataFrame, most: int = HOT_TERM) -> DataFrame:
    """(term, parts) of the terms with more than ``most`` postings in all scopes: how many parts of that size they have."""
    counts = posts.groupBy("term").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > most).select("term", F.ceil(F.col("n") / most).cast("int").alias("parts"))


def by_term(found: DataFrame, q: DataFrame, hot: DataFrame) -> DataFrame:
    """``found`` and the questions' terms ``q`` joined by term, each part of a hot term by itself.

    Only hot terms that are asked for are joined to the postings, so the planner can broadcast them where they are few.
    """
    asked = q.join(hot, "term", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    split = hot.join(q.select("term").distinct(), "term", "left_semi")
    parts = found.join(split, "term", "left").withColumn("part", F.pmod(F.xxhash64(*[c for c in found.columns if c != "term"]), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    return parts.join(asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"), ["term", "part"]).drop("part")


def products(posts: DataFrame, questions: DataFrame, asked: DataFrame | None, keys: tuple[str, ...], hot: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(question_id, keys, chunk_index, share, idf, df, weight, norm): postings of the terms of each question, in the scopes that it asks.

    Without ``asked`` every scope is meant, and the questions' terms are dealt with ``hot`` (:func:`hot_terms`).
    """
    found = posts.select(*keys, "term", "chunk_index", "idf", "df", "weight", "norm")
    if asked is None:
        return by_term(found, question_terms(questions), hot).drop("term")
    q = materialize(question_terms(questions, parts), "question-terms")
    met = files.dealt(asked.join(files.dealt(q, parts, "question_id"), "question_id"), parts, *keys, "term")
    return met.join(among(found, q.select("term").distinct(), "term"), [*keys, "term"]).drop("term")


def scored(met: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(question_id, keys, chunk_index, score) from :func:`products`; rows without a weight only name their chunk (score 0)."""
    weighed = met.withColumn("wq", F.col("share") * F.col("idf"))
    # a term of the question has one row for each of the df chunks that hold it
    sums = weighed.groupBy("question_id", *keys, "chunk_index").agg(
        F.sum(F.col("wq") * F.col("weight")).alias("dot"), F.sum(F.col("wq") * F.col("wq") / F.col("df")).alias("square"), F.max("norm").alias("norm"))
    length = F.sqrt(F.sum("square").over(Window.partitionBy("question_id", *keys)))
    return sums.select("question_id", *keys, "chunk_index", F.coalesce(F.try_divide("dot", length * F.col("norm")), F.lit(0.0)).alias("score"))


def few(questions: DataFrame, at_once: int = QUESTIONS_AT_ONCE) -> bool:
    """Whether ``questions`` are few and short enough for their terms to be broadcast."""
    size = questions.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("question")), F.lit(0)).alias("bytes")).first()
    return size.n <= at_once and size.bytes <= QUESTION_BYTES


def first_chunks(chunks: DataFrame, k: float, keys: tuple[str, ...]) -> DataFrame:
    """(keys, chunk_index) of the first k chunks of each scope: of those that share no term, only they can win."""
    first = Window.partitionBy(*keys).orderBy("chunk_index")
    return chunks.select(*keys, "chunk_index").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= whole_k(k)).drop("_n")


def best(candidates: DataFrame, k: float, keys: tuple[str, ...]) -> DataFrame:
    order = Window.partitionBy("question_id", *keys).orderBy(F.round("score", L.PLACES).desc(), "chunk_index")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= whole_k(k))


def ranked_everywhere(chunks: DataFrame, questions: DataFrame, k: float, posts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(question_id, keys, rank, chunk_index, score) of few questions, each put to every scope.

    Only postings of the questions' terms are dealt, once and by scope, and all else is done where they lie: their products
    with the questions are summed up as they come and are never stored, sorted or sent. Partitions hold a bounded number of sums.
    """
    q = question_terms(questions)
    ids = questions.select("question_id").distinct()
    # tokens are never empty: a row under '' is a first chunk, which every question has with a score of 0
    q = q.select("question_id", "term", "share").unionByName(ids.select("question_id", F.lit("").alias("term"), F.lit(0.0).alias("share")))
    found = posts.join(F.broadcast(q.select("term").distinct()), "term", "left_semi").select(*keys, "term", "chunk_index", "idf", "df", "weight", "norm")
    rows = found.unionByName(first_chunks(chunks, k, keys).withColumn("term", F.lit("")), allowMissingColumns=True)
    parts = files.parts(posts.sparkSession, chunks.count() * ids.count(), files.TASK_ROWS)
    return best(scored(rows.repartition(parts, *keys).join(F.broadcast(q), "term"), keys), k, keys).select("question_id", *keys, "rank", "chunk_index", "score")


def ranked(
    chunks: DataFrame, questions: DataFrame, asks: DataFrame | None, k: float = L.TOP_K, posts: DataFrame | None = None, keys: tuple[str, ...] = ("doc_id",),
    at_once: int = QUESTIONS_AT_ONCE, hot: DataFrame | None = None, parts: int | None = None,
) -> DataFrame:
    """(question_id, keys, rank, chunk_index, score): as :func:`retrieve`, without the texts. ``asks`` are dealt to ``parts`` partitions."""
    posts = postings(chunks, keys) if posts is None else posts
    if asks is None and few(questions, at_once):
        return ranked_everywhere(chunks, questions, k, posts, keys)
    if asks is not None:
        hot = None
    elif hot is None:
        hot = materialize(hot_terms(posts), "hot-terms")
    asked = None if asks is None else files.dealt(asks.select("question_id", *keys), parts, "question_id", *keys).distinct()
    heads = first_chunks(files.dealt(chunks.select(*keys, "chunk_index"), parts, *keys), k, keys)
    every = heads.crossJoin(questions.select("question_id").distinct()) if asked is None else asked.join(heads, list(keys))
    both = products(posts, questions, asked, keys, hot, parts).unionByName(every, allowMissingColumns=True)
    together = both.repartition("question_id", *keys) if parts is None else files.dealt(both, parts, "question_id", *keys)
    return best(scored(together, keys), k, keys).select("question_id", *keys, "rank", "chunk_index", "score")


def retrieve(
    chunks: DataFrame, questions: DataFrame, asks: DataFrame | None, k: float = L.TOP_K, posts: DataFrame | None = None, keys: tuple[str, ...] = ("doc_id",),
    at_once: int = QUESTIONS_AT_ONCE, hot: DataFrame | None = None,
) -> DataFrame:
    """(question_id, keys, rank, chunk_index, score, text, and stems where chunks have them).

    Chunks that share no term stay candidates with a score of 0. ``asks``: (question_id, keys), or None where every
    question is put to every scope (k rows for each question and scope come out): up to ``at_once`` questions are
    broadcast (:func:`ranked_everywhere`); those of more are dealt with the postings, which are read once, and terms with many postings are split
    (``hot``, of the index, or counted here). Only terms of the questions meet the postings, and only the winners meet the texts: of
    the chunks without a shared term no more than the first k of a scope can win.
    """
    stored = ["text", *(c for c in ("stems",) if c in chunks.columns)]
    winners = ranked(chunks, questions, asks, k, posts, keys, at_once, hot)
    return winners.join(chunks.select(*keys, "chunk_index", *stored), [*keys, "chunk_index"]).select("question_id", *keys, "rank", "chunk_index", "score", *stored)
