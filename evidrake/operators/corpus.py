"""Retrieval with the whole corpus as one scope: block-max postings dealt by term, and an exact top-k in two phases.

The scope of an index is otherwise a document; here all chunks of all documents share one vocabulary. Postings are cut into
blocks of about ``BLOCK`` chunks, the same blocks for every term, and the summary of a term's block is its largest weight there (as a
share of the chunk's norm). A question first meets the summaries of its terms only. The sum of a block's largest weights
bounds the score of every chunk in it, and one of them alone is a score that some chunk of the block reaches; the k-th best of
those is a floor for the answer. Only blocks whose bound reaches the floor are opened and scored exactly. No scope is a window or a
group. Texts are dealt by block once, and the terms, norms and postings of a block are made where it lies, so postings are never
sent: the idf of the most common terms is broadcast, and the others' goes to the blocks that hold them. Of few questions
postings of their terms are dealt by block and scored there; ranks keep k rows of a question in every task before they meet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import tokens
from ..sources import files
from ..sources.store import materialize
from .chunking import chunk_documents
from .retrieval import few, question_terms, whole_k

#: Chunks of a block, on the average.
BLOCK = 1024
#: Terms whose idf is broadcast, the most common ones.
COMMON = 1 << 16
#: Scores are compared to nine places, so a bound this much below the floor still counts.
SLACK = 1e-8


@dataclass
class CorpusIndex:
    """chunks (doc_id, chunk_index, text); terms (term, idf); blocks (term, block, top, posts (doc_id, chunk_index, weight))."""

    chunks: DataFrame
    terms: DataFrame
    blocks: DataFrame


def build_corpus_index(docs: DataFrame, target: float = L.TARGET_CHARS, overlap: float = L.OVERLAP_CHARS, block: int = BLOCK) -> CorpusIndex:
    """The stored index of (doc_id, text). Null and blank texts have no chunks; weights are shares of their chunk's norm."""
    chunks = materialize(chunk_documents(docs, target, overlap), "corpus-chunks")
    n = chunks.count()
    # neighbouring chunks of a document share a block, a long document has many
    number = F.pmod(F.xxhash64("doc_id", F.floor(F.col("chunk_index") / 64)), F.lit(max(1, -(-n // block)))).cast("long")
    split = chunks.select(number.alias("block"), "doc_id", "chunk_index", tokens(F.col("text")).alias("ts"))
    held = split.select("block", "doc_id", "chunk_index", F.size("ts").alias("n_tokens"), F.explode(F.array_distinct("ts")).alias("term"))
    df = materialize(held.groupBy("term").agg(F.count("*").alias("df")), "corpus-df")
    terms = materialize(df.select("term", "df", (F.ln((F.lit(n) + 1) / (F.col("df") + 1)) + 1).alias("idf")), "corpus-idf")
    known = F.broadcast(terms.orderBy(F.desc("df"), "term").limit(COMMON).select("term", F.col("idf").alias("known")))
    rare = held.join(known, "term", "left_anti").join(terms.select("term", "idf"), "term")
    parts = files.text_parts(chunks)
    given = split.unionByName(rare, allowMissingColumns=True).repartition(parts, "block")
    own = F.when(F.col("ts").isNotNull(), F.col("ts")).otherwise(F.array("term"))
    long = given.select("block", "doc_id", "chunk_index", F.coalesce("n_tokens", F.size("ts")).alias("n_tokens"), F.when(F.col("ts").isNotNull(), 1).otherwise(0).alias("one"), "idf", F.explode(own).alias("word"))
    tf = long.groupBy("block", "doc_id", "chunk_index", "n_tokens", F.col("word").alias("term")).agg(F.sum("one").alias("tf"), F.max("idf").alias("idf"))
    weighted = tf.join(known, "term", "left").withColumn("w", F.col("tf") / F.col("n_tokens") * F.coalesce("known", "idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("block", "doc_id", "chunk_index")))
    shares = weighted.select("block", "term", "doc_id", "chunk_index", (F.col("w") / norm).alias("w"))
    posts = F.collect_list(F.struct("doc_id", "chunk_index", F.col("w").alias("weight")))
    blocks = shares.groupBy("term", "block").agg(F.max("w").alias("top"), posts.alias("posts"))
    terms = terms.select("term", "idf")
    return CorpusIndex(chunks, terms, materialize(blocks, "corpus-blocks"))


def retrieve_corpus(index: CorpusIndex, questions: DataFrame, k: float = L.TOP_K) -> DataFrame:
    """(question_id, rank, doc_id, chunk_index, score, text): the k best chunks of all documents for each question.

    Ties go by doc_id and chunk_index; chunks that share no term stay candidates with a score of 0, so each question has k
    rows where the corpus has as many chunks. A question that is null or has no terms has only those.
    """
    most = whole_k(k)
    near = F.broadcast if few(questions) else lambda df: df
    questions = questions.select(F.struct("question_id").alias("question_id"), "question")  # as a struct, a null id is equal to itself
    terms = near(question_terms(questions)).join(index.terms, "term").select("question_id", "term", (F.col("share") * F.col("idf")).alias("wq"))
    lengths = terms.groupBy("question_id").agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("length"))
    scaled = materialize(terms.join(lengths, "question_id").select("question_id", "term", (F.col("wq") / F.col("length")).alias("wq")), "corpus-asked")
    summaries = index.blocks.select("term", "block", "top")
    part = F.col("wq") * F.col("top")
    bounds = materialize(near(scaled).join(summaries, "term").groupBy("question_id", "block").agg(F.sum(part).alias("bound"), F.max(part).alias("reached")), "bounds")
    best = Window.partitionBy("question_id").orderBy(F.desc("reached"), "block")
    floor = bounds.withColumn("r", F.row_number().over(best)).where(F.col("r") <= most).groupBy("question_id").agg(F.count("*").alias("n"), F.min("reached").alias("least"))
    opened = bounds.join(floor, "question_id").where((F.col("n") < most) | (F.col("bound") >= F.col("least") - SLACK)).select("question_id", "block")

    posts = index.blocks.select("term", "block", "posts").join(near(scaled.select("term").distinct()), "term", "left_semi")
    parts = files.parts(index.chunks.sparkSession, index.chunks.count() * questions.count(), files.TASK_ROWS)
    if near is F.broadcast:
        # few: each block has a flag for every question, whether it is opened, and all else is done where it lies
        numbers = scaled.select("question_id").distinct().withColumn("q", F.row_number().over(Window.orderBy("question_id")) - 1)
        numbers = near(materialize(numbers, "corpus-numbers"))
        flags = opened.select("block").distinct().crossJoin(numbers).join(opened.withColumn("open", F.lit(True)), ["question_id", "block"], "left")
        flags = flags.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("q", F.coalesce("open", F.lit(False)).alias("open")))).open.alias("open"))
        met = posts.repartition(parts, "block").join(flags, "block").join(near(scaled.join(numbers, "question_id")), "term").where(F.get("open", F.col("q")))
    else:
        met = opened.join(scaled, "question_id").join(posts, ["term", "block"])
    postings = met.select("question_id", "block", "wq", F.explode("posts").alias("p"))
    scored = postings.groupBy("question_id", "block", "p.doc_id", "p.chunk_index").agg(F.sum(F.col("wq") * F.col("p.weight")).alias("score"))
    order = Window.partitionBy("question_id").orderBy(F.round("score", L.PLACES).desc(), "doc_id", "chunk_index")
    winners = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    first = index.chunks.select("doc_id", "chunk_index").orderBy("doc_id", "chunk_index").limit(most)  # k rows, which every question gets
    zeros = questions.select("question_id", F.lit(0.0).alias("score")).distinct().join(F.broadcast(first.withColumn("score", F.lit(0.0))), "score")
    every = winners(scored).drop("rank", "block").unionByName(zeros).groupBy("question_id", "doc_id", "chunk_index").agg(F.max("score").alias("score"))
    return near(winners(every)).join(index.chunks.select("doc_id", "chunk_index", "text"), ["doc_id", "chunk_index"]).select("question_id.question_id", "rank", "doc_id", "chunk_index", "score", "text")
