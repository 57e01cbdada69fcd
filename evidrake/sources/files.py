"""File sources and sinks: golden sets, text documents, tables and reports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = "struct<id: string, document: string, question: string, answerable: boolean, expectedEvidence: string, note: string>"
GOLDEN_SET = f"version string, description string, documents map<string, string>, cases array<{CASES}>"


def golden_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, document paths) of a JSON golden set."""
    data = spark.read.schema(GOLDEN_SET).json(path, multiLine=True)
    c = "c.id c.document c.question c.answerable c.expectedEvidence c.note".split()
    cases = data.select(F.explode("cases").alias("c")).select(*c).withColumnRenamed("expectedEvidence", "expected_evidence")
    return cases, data.select(F.explode("documents").alias("document", "path"))


#: Paths up to which only the listed files are read; more are matched to all files below the root.
MOST_LISTED = 10_000


def text_documents(spark: SparkSession, paths: DataFrame, root: str) -> DataFrame:
    """(document, text): whole files below ``root``, matched to (document, path) by their path relative to it.

    Only listed files are read, and missing ones have no row. Beyond MOST_LISTED paths, or where a name holds signs of a
    pattern, the whole folder is read and matched.
    """
    wanted = paths.select("document", F.regexp_replace("path", r"^(\./)+", "").alias("path")).where("path IS NOT NULL")
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    start = len(system.makeQualified(at).toUri().getPath().rstrip("/")) + 2
    listed = [r.path for r in wanted.select("path").distinct().limit(MOST_LISTED + 1).collect()]
    if len(listed) <= MOST_LISTED and not any(set(p) & set("*?[]{}\\") for p in listed):
        known = [f"{root.rstrip('/')}/{p}" for p in listed if p and system.isFile(spark._jvm.org.apache.hadoop.fs.Path(at, spark._jvm.org.apache.hadoop.fs.Path(None, None, p)))]
        if not known:
            return wanted.select("document", F.lit("").alias("text")).limit(0)
        files = spark.read.text(known, wholetext=True)
    else:
        files = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    file = F.url_decode(F.regexp_replace(F.regexp_replace("_metadata.file_path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), r"\+", "%2B"))
    return wanted.join(files.select(F.col("value").alias("text"), F.substr(file, F.lit(start)).alias("path")), "path").select("document", "text")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer partitions (a small file is one task, however long its texts).

    A table of many files stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Bytes of text, or rows, of one task where they are cut into terms or ranked: sorts and hash tables of some hundred MB.
TASK_BYTES, TASK_ROWS = 8 << 20, 1 << 20


def parts(spark: SparkSession, size: float, most: int) -> int:
    """How many partitions a ``size`` needs with ``most`` in each, so that a task's memory does not grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / most))


def text_bytes(texts: DataFrame) -> int:
    """Bytes of the texts of (text); one pass over their lengths."""
    return texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def text_parts(texts: DataFrame) -> int:
    """The same as :func:`parts` for the texts of (text)."""
    return parts(texts.sparkSession, text_bytes(texts), TASK_BYTES)


def dealt(df: DataFrame, number: int | None, *by: str) -> DataFrame:
    """``df`` dealt by ``by`` to ``number`` partitions, which the other side of a join on the same columns takes over; None: as it is."""
    return df if number is None else df.repartition(number, *by)


def write_report(report: DataFrame, path: str) -> None:
    """A report or a sweep, a few rows, as one JSON file in the folder ``path``, which is replaced."""
    report.coalesce(1).write.mode("overwrite").json(path)
