"""Requests: raw JSON or columns in, valid questions and a quarantine out. No row ever fails the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import trim


def parse(raw: DataFrame, column: str = "body") -> DataFrame:
    """``raw`` with document_text, question (trimmed), error and status from a JSON body; types are checked, not coerced.

    Checked in order: JSON, object, document, question, size of the document, size of the question. The first failure
    counts. Null is no JSON; a null or blank field is missing; sizes are code points after trimming.
    """
    value = F.try_parse_json(F.col(column))
    kind = lambda p: F.schema_of_variant(F.try_variant_get(value, p, "variant"))
    field = lambda p: F.when(kind(p) == "STRING", trim(F.try_variant_get(value, p, "string")))
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    shaped = raw.select("*", value.isNull().alias("_bad"), is_object.alias("_object"), F.when(is_object, field("$.documentText")).alias("document_text"), F.when(is_object, field("$.question")).alias("question"))
    return _checked(shaped, F.when(F.col("_bad"), "body is not valid JSON").when(~F.col("_object"), "body is not a JSON object")).drop("_bad", "_object")


def validate(asked: DataFrame) -> DataFrame:
    """Columns document_text and question trimmed and checked, with error and status."""
    return _checked(asked.withColumn("document_text", trim(F.col("document_text"))).withColumn("question", trim(F.col("question"))), F.when(F.lit(False), ""))


def _problem(document: Column, question: Column) -> Column:
    """By the lengths of both; the first that holds counts."""
    return (
        F.when(document == 0, "documentText must be a text that is not blank")
        .when(question == 0, "question must be a text that is not blank")
        .when(document > L.DOCUMENT_LIMIT, "document is too long")
        .when(question > L.QUESTION_LIMIT, "question is too long")
    )


def _with_status(df: DataFrame, error: Column) -> DataFrame:
    out = df.withColumn("error", error)
    return out.withColumn("status", F.when(F.col("error").isNull(), 200).when(F.col("error").endswith("too long"), 413).otherwise(400))


def _checked(df: DataFrame, before: Column) -> DataFrame:
    length = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    return _with_status(df, F.coalesce(before, _problem(length("document_text"), length("question"))))


def checked_asks(asks: DataFrame, questions: DataFrame, documents: DataFrame) -> DataFrame:
    """asks (question_id, doc_id) with error and status: unknown or blank documents and questions 400, too long ones 413.

    Only lengths meet the asks, not texts; of rows that share an id the longest counts.
    """
    size = lambda df, key, text, name: df.groupBy(key).agg(F.max(F.length(trim(F.col(text)))).alias(name))
    rows = asks.select("question_id", "doc_id").distinct().join(size(documents, "doc_id", "text", "_document"), "doc_id", "left")
    rows = rows.join(size(questions, "question_id", "question", "_question"), "question_id", "left")
    return _with_status(rows, _problem(F.coalesce("_document", F.lit(0)), F.coalesce("_question", F.lit(0)))).drop("_document", "_question")


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined)"""
    return checked.where("error IS NULL"), checked.where("error IS NOT NULL")
