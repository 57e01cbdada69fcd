"""The whole flow: chunk, index, retrieve, decide, answer or refuse, for many questions over many documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import answer as A
from ..operators import provider
from ..operators.gate import assessed_pairs, decide
from ..operators.index import Index, build_index
from ..sources.requests import checked_asks


def ask(
    documents: DataFrame, questions: DataFrame, asks: DataFrame, k: float = L.TOP_K, threshold: float = L.COVERAGE,
    target: float = L.TARGET_CHARS, overlap: float = L.OVERLAP_CHARS, caller: Callable[[str, str], str | None] | None = None, index: Index | None = None,
    deadline: float = provider.DEADLINE, answer_store: str | None = None,
) -> DataFrame:
    """One response for each row of asks (question_id, doc_id); documents (doc_id, text), questions (question_id, question).

    status and error tell of asks that are not valid (no or blank text 400, too long 413); those get no answer. ``index``: of
    the documents, where it is built already (:func:`build_index`); else only the asked documents are indexed.
    ``caller`` asks an external provider and is off by default; a call that takes longer than ``deadline`` seconds falls back
    to the extractive answer, and ``answer_store`` (a shared folder) keeps answers from being asked for twice. Repeated asks count once.
    """
    checked = checked_asks(asks, questions, documents)
    valid = checked.where("error IS NULL").select("question_id", "doc_id")
    index = index or build_index(documents.join(valid.select("doc_id").distinct(), "doc_id", "left_semi"), target, overlap)
    done = A.answer(decide(assessed_pairs(index, questions.select("question_id", "question"), valid, k), threshold))
    if caller is not None:
        done = provider.with_fallback(provider.call(provider.prompts(done), caller, deadline, store=answer_store))
    told = A.response(done, index.chunks, provider_available=caller is not None)
    return checked.join(told, ["question_id", "doc_id"], "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
