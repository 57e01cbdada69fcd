"""Versions of an index, retrieval for many questions, and stored stems."""

import random

import pytest
from pyspark.sql import functions as F

from evidrake.operators.gate import assess, assessed_pairs, decide, gather
from evidrake.operators.index import build_index, index_chunks
from evidrake.operators.retrieval import hot_terms, retrieve
from evidrake.operators.versions import IndexStore
from evidrake.plans.ask import ask

WORDS = [f"{a}{b}" for a in "bcdfg" for b in ("ar", "el", "im", "on", "ut")]


def texts(n, seed):
    rng = random.Random(seed)
    return [". ".join(" ".join(rng.choices(WORDS, weights=range(25, 0, -1), k=rng.randint(1, 12))) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x for x in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def same(index, docs):
    want = build_index(docs)
    assert rows(index.chunks) == rows(want.chunks) and rows(index.postings) == rows(want.postings)


def test_versions(spark, tmp_path):
    first, later = texts(8, 1), texts(6, 2)
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "doc_id long, text string")
    store = IndexStore(spark, "file://" + str(tmp_path / "index"))
    with pytest.raises(ValueError, match="no such version"):
        store.open()
    docs = dict(enumerate(first))
    assert store.upsert(frame(docs)) == 1
    same(store.open(), frame(docs))
    changed = {2: later[0], 5: None, 7: " ", 20: later[1]}
    assert store.upsert(frame(changed), spark.createDataFrame([(0,), (99,)], "doc_id long")) == 2
    now = {k: v for k, v in {**docs, **changed}.items() if k != 0}
    same(store.open(), frame(now))
    same(store.open(1), frame(docs))
    assert store.upsert(frame({0: later[2], 5: later[3]})) == 3
    now |= {0: later[2], 5: later[3]}
    same(store.open(), frame(now))
    assert store.compact() == 4 and len(store.segments()) == 1
    same(store.open(), frame(now))
    assert store.clean() == 3 and store.versions() == [4]
    same(store.open(), frame(now))
    store.upsert(frame({}).where("false"), spark.createDataFrame([(k,) for k in now], "doc_id long"))
    assert store.open().chunks.count() == 0


def test_stream_sees_new_versions(spark, tmp_path):
    from evidrake.streaming.asks import answer_stream

    store = IndexStore(spark, "file://" + str(tmp_path / "index"))
    documents = spark.createDataFrame([(0, "Managers approve hotel stays."), (1, "Trains are preferred for travel.")], "doc_id long, text string")
    store.upsert(documents.where("doc_id = 0"))
    schema = "question_id string, question string, doc_id long"
    run = lambda: answer_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), documents, str(tmp_path / "out"), str(tmp_path / "cp"), index=store).awaitTermination()
    spark.createDataFrame([("a", "Which managers approve hotel stays?", 0), ("b", "Which trains are preferred?", 1)], schema).write.parquet(str(tmp_path / "in"))
    run()
    store.upsert(documents.where("doc_id = 1"))
    spark.createDataFrame([("c", "Which trains are preferred?", 1)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = {r.question_id: r.reason for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": "supported", "b": "no_relevant_chunk", "c": "supported"}


def test_many_questions_read_the_postings_once(spark):
    docs = spark.createDataFrame(list(enumerate(texts(12, 3))), "doc_id long, text string")
    rng = random.Random(4)
    questions = spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 3)))) for i in range(3000)] + [(None, "bar cel"), (-1, None), (-2, "the of")], "question_id long, question string")
    index = build_index(docs)
    few = retrieve(index.chunks, questions, None, 2, index.postings)
    hot = hot_terms(index.postings, 5)
    assert hot.count() > 3 and hot.agg(F.max("parts")).first()[0] > 2
    split = retrieve(index.chunks, questions, None, 2, index.postings, at_once=100, hot=hot)
    assert rows(split) == rows(few) and split.count() > 30_000
    many = retrieve(index.chunks, questions, None, 2, index.postings, at_once=100)
    assert rows(many) == rows(few)
    plan = many._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert sum("Relation" in line and "norm#" in line for line in plan) == 1


def test_stored_stems_change_nothing(spark):
    docs = spark.createDataFrame(list(enumerate(texts(6, 5) + ["No bar occurred there. It cels.", None])), "doc_id long, text string")
    questions = spark.createDataFrame([("a", "Did the bar occur?"), ("b", "Which bars and cels?"), ("c", "the of"), ("d", "unknown")], "question_id string, question string")
    asks = docs.select("doc_id").crossJoin(questions.select("question_id"))
    index = build_index(docs)
    assert "stems" in index.chunks.columns
    plain = index_chunks(index.chunks.drop("stems"))
    found = retrieve(plain.chunks.drop("stems"), questions, asks, posts=plain.postings)
    columns = ["question_id", "doc_id", "reason", "support_kind", "support_span", "selected_rank", "evidence_coverage", "key_term", "key_present"]
    want = decide(assess(gather(found, questions, asks, plain.postings, ("doc_id",)))).select(*columns)
    assert rows(decide(assessed_pairs(index, questions, asks)).select(*columns)) == rows(want)
    assert ask(docs, questions, asks, index=index).count() == asks.count()
