"""Tables in the folder that driver and executors share, so that what several steps read is computed once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only where the session has none (tests, a local master) is a temporary folder made
    and set, which goes when the program ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="evidrake-")
        atexit.register(shutil.rmtree, made, True)
        root = "file://" + made
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder; :func:`clear` removes it."""
    path = f"{shared_root(spark)}/evidrake-{label}-{uuid.uuid4().hex[:12]}"
    spark.sparkContext.__dict__.setdefault("_evidrake_folders", set()).add(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._evidrake_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_evidrake_path", None)
    if path:
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> int:
    """Delete every folder that this session has made here, once no result is read any more; how many there were."""
    folders = sorted(spark.sparkContext.__dict__.get("_evidrake_folders", ()))
    for path in folders:
        _delete(spark, path)
    return len(folders)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
    spark.sparkContext.__dict__.get("_evidrake_folders", set()).discard(path)
