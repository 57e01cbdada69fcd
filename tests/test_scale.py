"""What a task holds does not grow with the table, and texts are not dealt more often than they must."""

import re

import pytest

from pyspark.sql import functions as F

from evidrake.operators import corpus
from evidrake.operators.gate import assess, assessed_pairs, decide, gather
from evidrake.operators.index import build_index
from evidrake.operators.retrieval import ranked, retrieve
from evidrake.plans import catalog
from evidrake.sources import files

from test_index import rows, texts


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(files, "TASK_BYTES", 500)
    monkeypatch.setattr(files, "TASK_ROWS", 40)


def table(spark, tmp_path, given):
    folder = "file://" + str(tmp_path)
    spark.createDataFrame(given, "doc_id long, text string").write.parquet(folder + "/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["doc_frequency", "vocabulary", "tfidf_norms", "normalized_idf"])
def test_terms_are_dealt_by_the_size_of_texts(spark, tmp_path, monkeypatch, name):
    folder = table(spark, tmp_path, [*enumerate(texts(60, 7)), (None, "bar cel. " * 300), (61, None), (62, " ")])
    want = rows(catalog.QUERIES[name](spark, folder))
    monkeypatch.setattr(files, "TASK_BYTES", 500)
    got = catalog.QUERIES[name](spark, folder)
    assert rows(got) == want and got.rdd.getNumPartitions() > 20


def test_stored_postings_are_dealt_by_the_size_of_texts(spark, small_tasks):
    docs = spark.createDataFrame(list(enumerate(texts(60, 7))), "doc_id long, text string")
    assert len(build_index(docs).postings.inputFiles()) > 20


def asked(spark):
    docs = spark.createDataFrame([*enumerate(texts(60, 8)), (60, None), (61, " "), (62, "No bar occurred there. It cels.")], "doc_id long, text string")
    questions = spark.createDataFrame([("a", "Did the bar occur?"), ("b", "Which bars and cels?"), ("c", "the of"), ("d", "unknown"), ("e", None)], "question_id string, question string")
    return docs, questions, build_index(docs, 100, 10)


def test_questions_to_every_scope_are_ranked_where_postings_lie(spark, small_tasks):
    docs, questions, index = asked(spark)
    pairs = docs.select("doc_id").crossJoin(questions.select("question_id"))
    got = ranked(index.chunks, questions, None, 3, index.postings)
    assert got.rdd.getNumPartitions() > 20
    assert rows(got) == rows(ranked(index.chunks, questions, pairs, 3, index.postings)) and got.count() > 600
    # postings and first chunks are dealt by scope; nothing is dealt after they met the questions
    assert not re.search(r"hashpartitioning\(question_id#\d+, doc_id", got._jdf.queryExecution().executedPlan().toString())


def test_a_text_is_sent_to_its_scope_once(spark):
    docs, questions, index = asked(spark)
    pairs = docs.select("doc_id").crossJoin(questions.select("question_id"))
    found = retrieve(index.chunks, questions, pairs, posts=index.postings)
    want = decide(assess(gather(found, questions, pairs, index.postings, ("doc_id",))))
    for everywhere in (False, True):
        got = decide(assessed_pairs(index, questions, pairs, everywhere=everywhere))
        assert rows(got) == rows(want)
    # the ranks that are gathered by question and scope come without texts
    ranks = ranked(index.chunks, questions, None, posts=index.postings)
    assert "text" not in ranks.columns and rows(decide(assess(gather(ranks, questions, pairs, index.postings, ("doc_id",), index.chunks)))) == rows(want)


def test_pairs_are_dealt_by_the_size_of_their_texts(spark, small_tasks):
    docs, questions, index = asked(spark)
    pairs = docs.select("doc_id").crossJoin(questions.select("question_id"))
    got = assessed_pairs(index, questions.withColumn("label", F.lit(1)), pairs)
    assert got.rdd.getNumPartitions() > 20 and got.where("label = 1").count() == pairs.count()


@pytest.mark.parametrize("name", ["eval_threshold_curve", "answer_context"])
def test_cases_are_assessed_once(spark, name):
    got = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    # what is filtered or read twice is stored: no rule of the assessment is left in the plan, where each use would apply it again
    assert got.count() > 0 and "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("common", [3, 1 << 16])
def test_postings_of_the_corpus_stay_where_their_block_lies(spark, small_tasks, monkeypatch, common):
    docs, questions, _ = asked(spark)
    monkeypatch.setattr(corpus, "COMMON", common)
    index = corpus.build_corpus_index(docs, 100, 10, block=8)
    whole = index.chunks.select(F.lit(0).alias("scope"), (F.col("doc_id") * 1000 + F.col("chunk_index")).alias("chunk_index"), "text")
    want = retrieve(whole, questions, None, 7, keys=("scope",)).select("question_id", "rank", "chunk_index", "score", "text")
    got = corpus.retrieve_corpus(index, questions, 7)
    assert rows(got.select("question_id", "rank", (F.col("doc_id") * 1000 + F.col("chunk_index")).alias("chunk_index"), "score", "text")) == rows(want) and got.count() == 35
    assert index.blocks.groupBy("block").agg(F.count_distinct("_metadata.file_path").alias("n")).where("n > 1").count() == 0
