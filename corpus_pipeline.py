"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's documents.

Stages: quality classifier (rejected documents go), toxicity (rejected documents go), n-gram Jaccard join (one document
of each group stays), personal data (spans are replaced by their kind), best-fit packing (pieces with their places).
All rows of an id go or stay together; rows with a null id are judged by their text and never count as copies. Null
texts are empty ones. Columns beyond those of documents are passed on up to the last stage. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrake.llm import packing, pii, quality, shingle_join, toxicity
from evidrake.llm.common import keep_rows, materialize, table
from evidrake.llm.queries import WORD_BPE

#: Ids of removed copies up to which their list (8 bytes each) is broadcast; beyond it the documents are shuffled.
BROADCAST_IDS = 1_000_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    meta = quality.known_metadata(docs)
    machine = quality.train(docs, table(spark, sf_dir, "labels"), metadata=meta)
    return keep_rows(docs, ["text", *meta], lambda c: [x >= 0.3 for x in quality.scores(machine, c, meta)])


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return keep_rows(docs, ["text"], lambda c: [model.score(t)[0] < 0.5 for t in c["text"]])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = materialize(shingle_join.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "copies")
    small = copies.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(copies) if small else copies, "doc_id", "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redacted(docs, pii.train(docs))
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.query(docs, WORD_BPE)


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", keep_civil),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("personal data", redact_personal_data),
    ("best-fit packing", pack),
]

#: Models are trained and texts are tokenised, which SQL cannot express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
