"""Shared helpers: session defaults, shared folders, materialised tables, run-wise groups."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.store import materialize, release, shared_dir, shared_root  # noqa: F401  (also for the operators here)

#: Rows and bytes of an Arrow batch sent to Python; whole texts are long, so Spark's defaults are too much.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Send this package to the Python workers, and bound the Arrow batches (rows only; results do not depend on it)."""
    context = spark.sparkContext
    if getattr(context, "_evidrake_sent", None) is None:
        root = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="evidrake-code-")) / "evidrake_code.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(target))
        context._evidrake_sent = True
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> F.Column:
    """The fold rule of the labelled operators: crc32 of the id as text, modulo 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def map_rows(df: DataFrame, fn: Callable[[dict], dict], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with ``fn(columns: dict of lists) -> dict of lists`` on each batch."""
    prepare(df.sparkSession)
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def extended(df: DataFrame, more: str) -> StructType:
    """The schema of ``df`` and further columns; these replace columns of the same name (in any case)."""
    new = StructType.fromDDL(more)
    taken = {c.lower() for c in new.names}
    return StructType([*[f for f in df.schema.fields if f.name.lower() not in taken], *new.fields])


def keep_rows(df: DataFrame, columns: list[str], test: Callable[[dict], list[bool]]) -> DataFrame:
    """Rows for which the test of ``columns`` (a dict of lists) holds, batch by batch; all columns are passed on untouched."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(test({c: b.column(c).to_pylist() for c in columns}), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def map_column(df: DataFrame, column: str, fn: Callable[[list], list]) -> DataFrame:
    """``column`` replaced by ``fn`` of it, batch by batch; other columns are passed on untouched."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = b.schema.get_field_index(column)
                new = pa.array(fn(b.column(at).to_pylist()), b.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)

    return df.mapInArrow(run, df.schema)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal ``keys`` in key-sorted batches, one table each; holds one run at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        ks = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for i in range(1, len(ks) + 1):
            if i == len(ks) or ks[i] != ks[start]:
                if held and last != ks[start]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(b.slice(start, i - start))
                last = ks[start]
                start = i
    if held:
        yield pa.Table.from_batches(held)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
