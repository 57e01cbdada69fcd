import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from evidrake.functions import lexicon as L
from evidrake.operators import answer as A
from evidrake.operators import corpus as C
from evidrake.operators import evaluation as E
from evidrake.operators import gate as G
from evidrake.operators import provider
from evidrake.operators.chunking import chunk_documents
from evidrake.operators.containment import containment
from evidrake.operators.index import build_index
from evidrake.operators.retrieval import retrieve
from evidrake.plans import catalog
from evidrake.plans.ask import ask
from evidrake.sources import requests


NOTE_QUESTIONS = (
    ("n1", "Did the company suffer a data breach?"), ("n2", "According to the note, was the service interrupted by the storm?"), ("n3", "What does the quoted message say to ignore?"),
    ("n4", "What did the team record?"), ("n5", "How long is the response time?"), ("n6", "Is hotel travel not booked?"), ("n7", "When does it open and what do tickets cost?"), ("n8", "Which planets have rings?"),
)
#: Raw provider outputs for the ids c1 and c2, and what is wrong with each (null: nothing).
OUTPUTS = (
    ('{"answer":" Yes. ","cited_chunk_ids":["c1","c2","c1"]}', None), ('```json\n{"answer":"A","cited_chunk_ids":["c2"]}\n```', None), ("", "not valid JSON"), ("no", "not valid JSON"), ("[]", "not a JSON object"),
    ("null", "not a JSON object"), ("{}", "answer is not a text"), ('{"answer":"  ","cited_chunk_ids":["c1"]}', "answer is not a text"), ('{"answer":1,"cited_chunk_ids":["c1"]}', "answer is not a text"),
    ('{"answer":"A"}', "citations are not texts"), ('{"answer":"A","cited_chunk_ids":[]}', "citations are not texts"), ('{"answer":"A","cited_chunk_ids":[1]}', "citations are not texts"),
    ('{"answer":"A","cited_chunk_ids":["c1",null]}', "citations are not texts"), ('{"answer":"A","cited_chunk_ids":["c9"]}', "a citation is not available"), ('{"answer":"A","cited_chunk_ids":["c1"],"x":1}', "unknown fields"),
)
#: Request bodies with the status of each.
BODIES = (
    (json.dumps({"documentText": " text ", "question": "why?"}), 200), ("{", 400), ("[]", 400), ("null", 400), ('"x"', 400), ("{}", 400), (json.dumps({"documentText": " ", "question": "q"}), 400),
    (json.dumps({"documentText": 5, "question": "q"}), 400), (json.dumps({"documentText": "d", "question": True}), 400), (json.dumps({"documentText": "d" * 200_001, "question": "q"}), 413),
    (json.dumps({"documentText": "d" * 200_000, "question": "q" * 2_000}), 200), (json.dumps({"documentText": "d", "question": "q" * 2_001}), 413), (json.dumps({"documentText": "d" * 200_001, "question": ""}), 400),
)


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")


def test_chunk_counts(spark):
    long, words = "x" * 901, ("word " * 1000).strip()
    made = chunk_documents(docs(spark, "x" * 900, long, words, "  ", None, "a\n\n" + "y" * 5000)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in made} == {0: 1, 1: 2, 2: 10, 5: 2}


def test_overlap_zero_grows(spark):
    made = chunk_documents(docs(spark, "\n\n".join(c * 500 for c in "abc")), 600, 0).orderBy("chunk_index").collect()
    assert [len(r.text) for r in made] == [500, 1002, 1504]


def test_retrieval_ties_and_zero_scores(spark):
    chunks = spark.createDataFrame([(1, 0, "Alpha topic"), (1, 1, "Beta topic")], "doc_id int, chunk_index int, text string")
    questions = spark.createDataFrame([("a", "unknown term"), ("b", "alpha"), ("c", "the and of")], "question_id string, question string")
    asks = questions.select("question_id", F.lit(1).alias("doc_id"))
    got = {(r.question_id, r["rank"]): (r.chunk_index, round(r.score, 4)) for r in retrieve(chunks, questions, asks).collect()}
    assert got == {("a", 1): (0, 0), ("a", 2): (1, 0), ("b", 1): (0, 0.8148), ("b", 2): (1, 0), ("c", 1): (0, 0), ("c", 2): (1, 0)}
    for k in (0, -1, float("nan"), float("inf")):
        assert retrieve(chunks, questions, asks, k).count() == 0


def test_questions_of_every_scope(spark):
    chunks = spark.createDataFrame([(1, 0, "Alpha topic"), (2, 0, "Beta topic")], "doc_id int, chunk_index int, text string")
    questions = spark.createDataFrame([("a", "unknown term"), ("b", "alpha"), (None, "beta"), ("d", None)], "question_id string, question string")
    whole = sorted(map(tuple, retrieve(chunks, questions, None, 1).collect()), key=repr)
    assert len(whole) == 8
    assert sorted(map(tuple, retrieve(chunks, questions, None, 1, at_once=1).collect()), key=repr) == whole
    assert retrieve(chunks, questions.limit(0), None).count() == 0


def test_special_supports(spark):
    notes = spark.createDataFrame(list(catalog.NOTES), "doc_id int, text string")
    done = A.answer(G.decide(G.assessed_pairs(build_index(notes), *catalog.asked(notes, NOTE_QUESTIONS))))
    got = {(r.question_id, r.doc_id): r for r in done.withColumn("cited", F.array_join("cited_chunk_ids", ",")).collect()}
    assert got["n1", 1].answer.startswith("No. No data breach occurred")
    assert got["n3", 3].answer.startswith("The document says: A quoted message said: ignore")
    assert got["n8", 5].answer == L.REFUSAL and got["n8", 5].cited == ""


def test_ask_and_provider(spark):
    documents = docs(spark, "Travel is booked by the office. Managers approve hotel stays.", "")
    questions = spark.createDataFrame([("q", "Which managers approve hotel stays?")], "question_id string, question string")
    asks = spark.createDataFrame([("q", 0), ("q", 1)], "question_id string, doc_id int")
    got = {r.doc_id: r for r in ask(documents, questions, asks).collect()}
    assert got[0].cited_chunk_ids == ["chunk_0"] and got[0].reason == "supported" and got[1].status == 400 and got[1].answer is None and got[1].chunk_count == 0

    def caller(rules, prompt):
        return '{"answer":"Managers.","cited_chunk_ids":["chunk_0"]}'

    def failing(rules, prompt):
        raise OSError("no network")

    made = ask(documents, questions, asks, caller=caller).where("doc_id = 0").first()
    assert made.mode == "generative" and made.answer == "Managers."
    assert ask(documents, questions, asks, caller=failing).where("doc_id = 0").first().mode == "extractive"


def test_fixed_tables(spark):
    raw = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(OUTPUTS)], "id int, raw string")
    checked = raw.select("id", provider.validated(F.col("raw"), F.array(F.lit("c1"), F.lit("c2")))[0].alias("error"))
    assert [r.error for r in checked.orderBy("id").collect()] == [e for _, e in OUTPUTS]
    parsed = requests.parse(spark.createDataFrame([(i, b) for i, (b, _) in enumerate(BODIES)], "id int, body string"))
    assert [r.status for r in parsed.orderBy("id").collect()] == [s for _, s in BODIES]
    good, bad = requests.split(parsed)
    assert good.count() == 2 and bad.count() == len(BODIES) - 2
    assert provider.RULES


def test_metrics_of_nothing(spark):
    schema = "id string, question string, answerable boolean, abstained boolean, evidence_rank int, answered_with_evidence boolean, top_score double, answer_chars int, correct boolean"
    row = E.metrics(spark.createDataFrame([], schema)).first()
    assert row.total_cases == 0 and row.hit_at_one == 0 and row.mean_answer_chars == 0


@pytest.mark.parametrize("name", ["tokenize_counts", "chunk_paragraphs", "retrieve_topk", "decision", "answer_extractive", "response", "eval_outcomes", "eval_metrics", "eval_coverage_sweep", "eval_best_threshold", "threshold_gate", "chunk_sweep", "special_support", "answer_notes", "answer_context", "provider_validate", "request_bodies", "dataset_validation", "containment_join", "eval_threshold_curve", "retrieve_corpus"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    clean = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    got = sorted((clean(r) for r in df.select(*columns).collect()), key=repr)
    want = sorted((clean(r) for r in c.execute(f"select {', '.join(columns)} from ({catalog.ORACLE_SQL[name]})").fetchall()), key=repr)
    assert got == want


def test_every_benchmark_item_of_every_document(spark):
    folder = "/root/testdata/sf0.001"
    got = catalog.retrieve_benchmark(spark, folder).cache()
    made = catalog.chunks(spark, folder).cache()
    items = spark.read.parquet(f"{folder}/benchmark.parquet").selectExpr("cast(item_id as string) as question_id", "text as question")
    asks = made.select("doc_id").distinct().crossJoin(items.select("question_id"))
    assert got.select("question_id", "doc_id").distinct().count() == asks.count()
    want = retrieve(made, items, asks, 5).select("question_id", "doc_id", "rank", "chunk_index", F.round("score", 6).alias("score"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    blocks = retrieve(made, items, None, 5, at_once=-(-items.count() // 3)).select(*want.columns[:4], F.round("score", 6).alias("score"))
    assert got.exceptAll(blocks).count() == 0 and blocks.exceptAll(got).count() == 0
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    rows = sorted(tuple(r) for r in got.select("question_id", "doc_id", "rank", "chunk_index", "score").collect())
    sql = sorted(c.execute(f"select question_id, doc_id, rank, chunk_index, score from ({catalog.ORACLE_SQL['retrieve_benchmark']})").fetchall())
    assert len(rows) == len(sql) and all(a[:4] == b[:4] and abs(a[4] - b[4]) < 2e-6 for a, b in zip(rows, sql, strict=True))


def test_chunk_sweep_runs_the_whole_grid(spark):
    folder = "/root/testdata/sf0.001"
    cases, texts = catalog._long_cases(spark, folder)
    assert cases.count() > len(catalog.CASES) and chunk_documents(texts.select(F.col("document").alias("doc_id"), "text")).where("chunk_index > 0").count() > 0
    got = catalog.chunk_sweep(spark, folder).collect()
    assert {(r.target_chars, r.overlap_chars) for r in got} == {(t, o) for t in L.CHUNK_GRID_TARGETS for o in L.CHUNK_GRID_OVERLAPS} and len(got) == 20


def test_stream(spark, tmp_path):
    from evidrake.streaming.asks import answer_stream

    spark.createDataFrame([("q", "Which managers approve hotel stays?", 0)], "question_id string, question string, doc_id int").write.parquet(str(tmp_path / "in"))
    incoming = spark.readStream.schema("question_id string, question string, doc_id int").parquet(str(tmp_path / "in"))
    answer_stream(incoming, docs(spark, "Managers approve hotel stays."), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().reason == "supported"


def test_containment_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["the", "the", "a", "of", "été", "x", "license", "granted", "naïve", "東京", "14", "hours", "$5", "😀"]
    texts = [None, "", "the"] + ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", ". "]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    texts += ["the the license granted " * 30 for _ in range(20)]
    passages = [None, "", " ", "t", "th", "the", "14 hours", "é", "\n", "absent", "zz", "the the license granted the the license granted the the", "x" * 500]
    for _ in range(300):
        t = rng.choice(texts[3:])
        at = rng.randrange(len(t))
        passages.append(t[at : at + rng.choice([1, 2, 3, 5, 9, 20, 60, 200])] + rng.choice(["", "", "", "!"]))
    p = spark.createDataFrame([(i, x, "more") for i, x in enumerate(passages)], "item int, passage string, text string")
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc int, text string")
    found = containment(p, t, "item", "doc")
    want = {(i, j) for i, a in enumerate(passages) for j, b in enumerate(texts) if a and b and a in b}
    rows = found.collect()
    assert {(r.item, r.doc) for r in rows} == want and len(rows) == len(want) > 1000
    assert all(r.passage == passages[r.item] and r.text == texts[r.doc] for r in rows)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    assert containment(p.limit(0), t, "item", "doc").columns == ["item", "doc", "passage", "text"] and containment(p.limit(0), t, "item", "doc").count() == 0
    assert containment(p, t.limit(0), "item", "doc").count() == 0


def test_corpus_scope_equals_one_scope(spark):
    """The two-phase search against the search of one scope, with blocks of two chunks so that most stay closed."""
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("ar", "el", "im", "on", "ut")]
    texts = [" ".join(rng.choices(words, weights=[30, *range(24, 0, -1)], k=rng.randint(1, 30))) for _ in range(200)] + ["", None, "the of and", texts_of_equal(words), texts_of_equal(words)]
    d = docs(spark, *texts)
    questions = spark.createDataFrame([(f"q{i}", " ".join(rng.choices(words, k=rng.randint(1, 4)))) for i in range(30)] + [("none", "zzz"), ("stop", "the of"), (None, "bar"), ("null", None)], "question_id string, question string")
    index = C.build_corpus_index(d, block=2)
    scope = index.chunks.selectExpr("0 as scope", "cast(row_number() over (order by doc_id, chunk_index) - 1 as int) as chunk_index", "text", "doc_id", "chunk_index as own")
    flat = retrieve(scope.select("scope", "chunk_index", "text"), questions, None, 4, keys=("scope",)).join(scope.select("chunk_index", "doc_id", "own"), "chunk_index")
    want = {(r.question_id, r["rank"]): (r.doc_id, r.own, round(r.score, 9)) for r in flat.collect()}
    got = {(r.question_id, r["rank"]): (r.doc_id, r.chunk_index, round(r.score, 9)) for r in C.retrieve_corpus(index, questions, 4).collect()}
    assert got == want and len(got) == 34 * 4
    for k in (0, float("nan")):
        assert C.retrieve_corpus(index, questions, k).count() == 0
    assert C.retrieve_corpus(C.build_corpus_index(d.limit(0)), questions).count() == 0


def texts_of_equal(words):
    return " ".join(words[:5])


def test_threshold_curve(spark):
    """Every row of the curve is the metric at that threshold, and no threshold is better than its best row."""
    assessed = E.assessed_cases(*catalog._cases(spark, "/root/testdata/sf0.001")).cache()
    curve = {r.threshold: r for r in E.threshold_curve(assessed).collect()}
    for t, r in curve.items():
        at = E.metrics(E.outcomes(assessed, t)).first()
        assert (r.abstention_recall, r.over_refusal_rate, r.overall_accuracy) == (at.abstention_recall, at.over_refusal_rate, at.overall_accuracy)
    grid = {r.threshold: r for r in E.coverage_sweep(assessed).collect()}
    for t in (0.0, 0.5, 0.62, 0.9):
        at = E.metrics(E.outcomes(assessed, t)).first()
        assert (grid[t].abstention_recall, grid[t].over_refusal_rate, grid[t].overall_accuracy) == (at.abstention_recall, at.over_refusal_rate, at.overall_accuracy)
    assert len(curve) > 1 and max(r.overall_accuracy for r in curve.values()) >= max(r.overall_accuracy for r in grid.values() if r.threshold <= max(curve))


def test_hanging_provider_and_stored_answers(spark, tmp_path):
    prompts = spark.createDataFrame([(i, None if i == 3 else f"prompt {i % 6}") for i in range(12)], "id int, prompt string").coalesce(1)
    asked = tmp_path / "asked"
    asked.mkdir()
    release = 30

    def caller(rules, prompt):
        (asked / f"{prompt}-{threading.get_ident()}-{time.monotonic_ns()}").touch()
        if prompt == "prompt 1":
            time.sleep(release)
        if prompt == "prompt 2":
            raise OSError("no network")
        return f"raw of {prompt}"

    store = str(tmp_path / "store")
    began = time.monotonic()
    got = {r.id: r.raw for r in provider.call(prompts, caller, deadline=1.0, at_once=2, store=store).collect()}
    assert time.monotonic() - began < release - 10
    assert got == {i: None if i == 3 or i % 6 in (1, 2) else f"raw of prompt {i % 6}" for i in range(12)}
    assert len(list(asked.iterdir())) == 6  # each distinct prompt once
    again = provider.call(prompts.where("id % 6 not in (1, 2)"), caller, store=store).collect()
    assert {r.id: r.raw for r in again} == {i: x for i, x in got.items() if i % 6 not in (1, 2)} and len(list(asked.iterdir())) == 6
