"""Evaluation of labelled cases: outcomes, metrics, sweeps and gates, each in one pass over all cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..sources.store import materialize
from .answer import answer
from .chunking import chunk_documents, clamp
from .gate import assessed_pairs, decide, rounded
from .index import build_index, index_chunks


def dataset_problems(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, problem) for unsound cases (id, document, question, answerable, expected_evidence); documents (document, text)."""
    e = F.col("expected_evidence")
    given = F.coalesce(e, F.lit("")) != ""
    joined = cases.join(documents.select("document", F.col("text").alias("_text")), "document", "left")
    problem = (
        F.when(F.coalesce(F.col("_text"), F.lit("")) == "", F.concat(F.lit("unknown document "), F.coalesce("document", F.lit("null"))))
        .when(F.col("answerable") & ~given, "answerable without evidence")
        .when(F.col("answerable") & ~F.col("_text").contains(e), "evidence is not in the document")
        .when(~F.col("answerable") & given, "not answerable but with evidence")
    )
    return joined.select("id", problem.alias("problem")).where("problem is not null")


def assessed_cases(cases: DataFrame, documents: DataFrame, target: float = L.TARGET_CHARS, overlap: float = L.OVERLAP_CHARS) -> DataFrame:
    """cases with their assessed pairs; each document is chunked and indexed once."""
    docs = documents.select(F.col("document").alias("doc_id"), "text")
    kept = materialize(labelled_questions(cases), "cases")
    return assessed_pairs(build_index(docs, target, overlap), kept.drop("document"), kept.select("question_id", F.col("document").alias("doc_id")))


def labelled_questions(cases: DataFrame) -> DataFrame:
    """Questions with their labels, which go with them: an assessed pair with its texts is not sent to meet them."""
    return cases.select(F.col("id").alias("question_id"), "question", F.col("answerable").alias("is_answerable"), "expected_evidence", "document")


def evaluate(cases: DataFrame, documents: DataFrame, target: float = L.TARGET_CHARS, overlap: float = L.OVERLAP_CHARS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics, outcomes, failed outcomes) of sound cases; raises with the first problems of an unsound set."""
    problems = [f"{r.id}: {r.problem}" for r in dataset_problems(cases, documents).orderBy("id").limit(20).collect()]
    if problems:
        raise ValueError("unsound cases: " + "; ".join(problems))
    done = materialize(outcomes(assessed_cases(cases, documents, target, overlap)), "outcomes")
    return metrics(done), done, done.where("NOT correct")


def outcomes(assessed: DataFrame, threshold: Column | float = L.COVERAGE) -> DataFrame:
    """(id, question, answerable, abstained, evidence_rank, answered_with_evidence, top_score, answer_chars, correct)."""
    done = answer(decide(assessed, threshold))
    e = F.col("expected_evidence")
    holding = F.filter("results", lambda r: r.text.contains(e))
    abstained = F.size("cited_chunk_ids") == 0
    with_evidence = F.coalesce(F.col("is_answerable") & ~abstained & (e != "") & F.col("answer").contains(e), F.lit(False))
    rest = [c for c in assessed.columns if c in ("threshold", "target_chars", "overlap_chars")]
    return done.select(
        *rest, F.col("question_id").alias("id"), "question", F.col("is_answerable").alias("answerable"), abstained.alias("abstained"),
        F.when(F.coalesce(e, F.lit("")) != "", F.coalesce(F.get(holding, F.lit(0))["rank"], F.lit(0))).otherwise(0).alias("evidence_rank"),
        with_evidence.alias("answered_with_evidence"), F.round("top_score", 4).alias("top_score"),
        F.when(abstained, 0).otherwise(F.length("answer")).alias("answer_chars"),
        F.when(F.col("is_answerable"), with_evidence).otherwise(abstained).alias("correct"),
    )


def ratio(a: Column, b: Column, places: int = 4) -> Column:
    return F.coalesce(F.round(F.try_divide(a.cast("double"), b.cast("double")), places), F.lit(0.0))


def metrics(done: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The metrics of outcomes, in one aggregate."""
    yes, off, rank = F.col("answerable"), F.col("abstained"), F.col("evidence_rank")
    n_yes, n_no, n_off = F.count_if(yes), F.count_if(~yes), F.count_if(off)
    return done.groupBy(*by).agg(
        F.count("*").alias("total_cases"), n_yes.alias("answerable_cases"), n_no.alias("unanswerable_cases"),
        ratio(F.count_if(yes & (rank == 1)), n_yes).alias("hit_at_one"), ratio(F.count_if(yes & rank.between(1, 3)), n_yes).alias("hit_at_three"),
        ratio(F.sum(F.when(yes & (rank > 0), 1 / F.greatest(rank, F.lit(1))).otherwise(0.0)), n_yes).alias("mrr"),
        ratio(F.count_if(yes & F.col("answered_with_evidence")), n_yes).alias("answer_accuracy"), ratio(F.count_if(yes & off), n_yes).alias("over_refusal_rate"),
        ratio(F.count_if(~yes & off), n_no).alias("abstention_recall"), ratio(F.count_if(~yes & off), n_off).alias("abstention_precision"),
        ratio(F.count_if(~yes & ~off), n_no).alias("false_answer_rate"), ratio(F.count_if("correct"), F.count("*")).alias("overall_accuracy"),
        F.round(ratio(F.sum(F.when(~off, F.col("answer_chars")).otherwise(0)), F.count_if(~off))).cast("long").alias("mean_answer_chars"),
    )


def critical() -> Column:
    """The highest coverage threshold at which an assessed pair is answered: null for none, infinite for a special support."""
    special = F.col("negative").isNotNull() | F.col("instruction").isNotNull()
    standard = F.when(F.col("key_present"), rounded(F.coalesce("best.coverage", F.lit(0.0))))
    return F.when(F.col("relevant"), F.when(special, F.lit(float("inf"))).otherwise(standard))


def threshold_counts(assessed: DataFrame) -> DataFrame:
    """(critical, answerable, holds, n): how many cases change at each coverage, and whether their answers hold the evidence.

    A case is answered at every threshold up to its critical one, always with the same answer, so each is answered once.
    """
    done = answer(decide(assessed.withColumn("critical", critical()), 0.0))
    e = F.col("expected_evidence")
    holds = F.coalesce(F.col("is_answerable") & (e != "") & F.col("answer").contains(e) & F.col("critical").isNotNull(), F.lit(False))
    return done.select("critical", F.col("is_answerable").alias("answerable"), holds.alias("holds")).groupBy("critical", "answerable", "holds").agg(F.count("*").alias("n"))


def coverage_sweep(assessed: DataFrame, thresholds: tuple[float, ...] = L.COVERAGE_GRID) -> DataFrame:
    """(threshold, abstention_recall, over_refusal_rate, overall_accuracy) for each threshold, from the counts of all cases."""
    return _swept(threshold_counts(assessed).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))))


def _swept(counts: DataFrame) -> DataFrame:
    yes, n = F.col("answerable"), F.col("n")
    off = ~F.coalesce(F.col("critical") >= rounded(F.col("threshold")), F.lit(False))
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    return counts.groupBy("threshold").agg(
        ratio(total(~yes & off), total(~yes)).alias("abstention_recall"), ratio(total(yes & off), total(yes)).alias("over_refusal_rate"),
        ratio(total(F.when(yes, ~off & F.col("holds")).otherwise(off)), F.sum(n)).alias("overall_accuracy"))


#: Parts of the range of coverage whose running sums are taken apart, so that no task has all values.
CURVE_PARTS = 1000


def threshold_curve(assessed: DataFrame) -> DataFrame:
    """The sweep at every coverage at which some case changes: (threshold, abstention_recall, over_refusal_rate, overall_accuracy).

    Between two neighbouring thresholds nothing changes, so the best row is the best threshold there is. Differences at
    each value are summed from the highest down: over the parts of the range, and within each part.
    """
    # stored: the parts and the steps both read them, and each would assess all cases again
    counts = materialize(threshold_counts(assessed), "threshold-counts")
    yes, n = F.col("answerable"), F.col("n")
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    # every value is a threshold; those above 1 (always answered) count in all of them, those without (never) stand below all
    at = F.when(F.col("critical").isNull(), -1.0).otherwise(F.least(F.col("critical"), F.lit(1.0)))
    step = counts.groupBy(at.alias("threshold")).agg(total(yes).alias("y"), total(~yes).alias("w"), total(F.col("holds")).alias("h"))
    step = step.withColumn("part", F.floor(F.col("threshold") * CURVE_PARTS).cast("int"))
    parts = step.groupBy("part").agg(*(F.sum(c).alias(c) for c in "ywh"))
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # at most CURVE_PARTS + 2 rows
    parts = parts.select(
        "part", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c + "_above") for c in "ywh"),
        F.sum("y").over(Window.partitionBy()).alias("yes"), F.sum("w").over(Window.partitionBy()).alias("no"))
    within = Window.partitionBy("part").orderBy(F.desc("threshold"))
    run = step.join(parts, "part").select("threshold", "yes", "no", *((F.sum(c).over(within) + F.col(c + "_above")).alias(c) for c in "ywh"))
    return run.where("threshold >= 0").select(
        "threshold", ratio(F.col("no") - F.col("w"), F.col("no")).alias("abstention_recall"), ratio(F.col("yes") - F.col("y"), F.col("yes")).alias("over_refusal_rate"),
        ratio(F.col("h") + F.col("no") - F.col("w"), F.col("yes") + F.col("no")).alias("overall_accuracy"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    return sweep.agg(F.max_by(F.struct(*sweep.columns), F.struct("overall_accuracy", -F.col("threshold"))).alias("best")).select("best.*")


def chunking_sweep(cases: DataFrame, documents: DataFrame, targets: tuple[int, ...] = L.CHUNK_GRID_TARGETS, overlaps: tuple[int, ...] = L.CHUNK_GRID_OVERLAPS) -> DataFrame:
    """Metrics for each chunking, which is a part of the scope's key: one job for all."""
    keys = ("target_chars", "overlap_chars", "doc_id")
    docs = materialize(documents.select(F.col("document").alias("doc_id"), "text"), "documents")
    kept = materialize(labelled_questions(cases), "cases")
    grid = [(t, o) for t in targets for o in overlaps if o < t]
    chunks = None
    for t, o in grid:
        one = chunk_documents(docs, *clamp(t, o)).withColumn("target_chars", F.lit(t)).withColumn("overlap_chars", F.lit(o))
        chunks = one if chunks is None else chunks.unionByName(one)
    configurations = F.explode(F.array(*[F.struct(F.lit(t).alias("target_chars"), F.lit(o).alias("overlap_chars")) for t, o in grid]))
    asks = kept.select("question_id", F.col("document").alias("doc_id"), configurations.alias("c")).select("question_id", "doc_id", "c.*")
    labelled = assessed_pairs(index_chunks(chunks, keys), kept.drop("document"), asks)
    return metrics(outcomes(labelled), ("target_chars", "overlap_chars")).select("target_chars", "overlap_chars", "overall_accuracy")


def within_tolerance(sweep: DataFrame, target: int = L.TARGET_CHARS, overlap: int = L.OVERLAP_CHARS, tolerance: float = L.CHUNK_TOLERANCE) -> DataFrame:
    """(accuracy, best, ok): whether the default chunking is near the best of the sweep."""
    default = F.max(F.when((F.col("target_chars") == target) & (F.col("overlap_chars") == overlap), F.col("overall_accuracy")))
    row = sweep.agg(default.alias("accuracy"), F.max("overall_accuracy").alias("best"))
    return row.withColumn("ok", F.coalesce(F.round(F.col("best") - F.col("accuracy"), L.PLACES) <= tolerance, F.lit(False)))


def gate_failures(report: DataFrame, minimums: dict[str, float], maximums: dict[str, float]) -> DataFrame:
    """(metric, value, floor, ceiling) of each metric outside its limits."""
    spark: SparkSession = report.sparkSession
    limits = spark.createDataFrame([(k, *(None if (v := m.get(k)) is None else float(v) for m in (minimums, maximums))) for k in sorted({*minimums, *maximums})], "metric string, floor double, ceiling double")
    names = [c for c in report.columns if c in minimums or c in maximums]
    long = report.select(F.explode(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("double"))])).alias("metric", "value"))
    joined = limits.join(long, "metric", "left")
    return joined.where(F.col("value").isNull() | (F.col("value") < F.col("floor")) | (F.col("value") > F.col("ceiling"))).select("metric", "value", "floor", "ceiling")


#: What each metric is called in a report, in the order of its lines.
LINES = (
    ("hit_at_one", "first chunk holds the evidence"), ("hit_at_three", "one of three holds it"), ("mrr", "mean reciprocal rank"), ("answer_accuracy", "answers with the evidence"),
    ("over_refusal_rate", "refused though answerable"), ("abstention_recall", "rightly refused, of those to refuse"), ("abstention_precision", "rightly refused, of the refused"),
    ("false_answer_rate", "answered though not answerable"), ("overall_accuracy", "all cases right"),
)


def format_report(report: DataFrame, failed: DataFrame | None = None, most: int = 20) -> str:
    """A one-row report as text lines: shares as percentages, then up to ``most`` failed cases with what went wrong."""
    row = report.first()
    if row is None:
        return "no cases"
    out = [f"cases {row.total_cases}: {row.answerable_cases} answerable, {row.unanswerable_cases} not"]
    out += [f"{text:<38} {100 * row[name]:6.1f} %" for name, text in LINES]
    out.append(f"{'mean characters of an answer':<38} {row.mean_answer_chars:6d}")
    if failed is not None:
        bad = failed.orderBy("id").limit(most + 1).collect()
        out += [f"failed {r.id}: {_what(r)} | {r.question}" for r in bad[:most]] + (["more failed"] if len(bad) > most else [])
    return "\n".join(out)


def _what(r: Row) -> str:
    if not r.answerable:
        return "answered, though nothing supports an answer"
    found = f"evidence at rank {r.evidence_rank}" if r.evidence_rank else "evidence not retrieved"
    return f"{'refused' if r.abstained else 'answered without the evidence'}, {found}, top score {r.top_score:.4f}"


def format_sweep(sweep: DataFrame) -> str:
    """A sweep as a table of text lines, in order of its first columns; shares as percentages."""
    names = sweep.columns
    show = lambda n, v: f"{100 * v:.1f} %" if n.endswith(("_recall", "_rate", "_accuracy")) else str(v)
    rows = [names, *[[show(n, r[n]) for n in names] for r in sweep.orderBy(*names[:2]).collect()]]
    wide = [max(len(r[i]) for r in rows) for i in range(len(names))]
    return "\n".join("  ".join(x.rjust(w) for x, w in zip(r, wide, strict=True)) for r in rows)
