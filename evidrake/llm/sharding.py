"""Shards of near equal bytes by Karmarkar-Karp differencing, with groups that no cut may part.

Rows of equal text are one group, which goes to one shard whole. Differencing starts with a partial partition for each item
(its size and zeros) and repeatedly combines the two with the largest spread, one's largest part with the other's smallest, until
one is left: the shards. What it is told about the table is bounded: a group with more than a share of 1 / ``items`` of
all bytes is an item of its own (there are fewer than ``items`` of them), all smaller groups are dealt by hash to ``items``
bundles, and a bundle is an item. So at most 2 ``items`` sizes come to the driver, whatever the input, and the map from items to
shards, as small, is broadcast; rows find their shard without a shuffle, however many share a text.

Every row is written to the files of its shard (Parquet, all columns) with its place among its task's rows of that shard; the
slot is that place and the rows of the tasks before, so no task or window holds a shard.

Null text counts as an empty one without bytes; a size is at least 1. Repeated rows and ids are rows of their own; ids are not
read; a group larger than an equal share makes its shard larger than the others; columns named shard, part, place or slot (in any
case) are replaced; with fewer groups than shards some shards stay empty; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, extended, materialize, prepare, shared_dir

#: Most heavy groups, and the number of bundles of lighter ones.
ITEMS = 32_768
_PLACED = "shard int, part int, place long"


def difference(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item. Ties go by the order of the items."""
    if not sizes:
        return []
    parts: list[tuple[int, ...]] = [(s,) + (0,) * (shards - 1) for s in sizes]  # sums, largest first, the smallest taken off all
    merged: list[tuple[int, int, list[int]]] = []  # two partial partitions, and in what order their parts came together
    heap = [(-s if shards > 1 else 0, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        i, j = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        sums = [x + y for x, y in zip(parts[i], reversed(parts[j]), strict=True)]
        order = sorted(range(shards), key=sums.__getitem__, reverse=True)
        least = sums[order[-1]]
        parts.append(tuple(sums[k] - least for k in order))
        merged.append((i, j, order))
        heapq.heappush(heap, (-parts[-1][0], len(parts) - 1))
    names: dict[int, list[int]] = {len(parts) - 1: list(range(shards))}
    for at in range(len(parts) - 1, len(sizes) - 1, -1):
        own, (i, j, order) = names.pop(at), merged[at - len(sizes)]
        left, right = [0] * shards, [0] * shards
        for name, k in zip(own, order, strict=True):
            left[k] = right[shards - 1 - k] = name
        names[i], names[j] = left, right
    return [names[i][0] for i in range(len(sizes))]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _key (of the text), _bundle and _size."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("_key", F.unhex(F.sha2(text, 256))).withColumn("_size", (F.octet_length(text) + 1).cast("long"))
    return rows


def bundle(items: int) -> F.Column:
    return F.pmod(F.xxhash64("_key"), F.lit(items)).cast("int")


def assigned(docs: DataFrame, shards: int = 8, items: int = ITEMS) -> DataFrame:
    """docs with _key, _size and shard."""
    spark = docs.sparkSession
    rows = keyed(docs)
    groups = materialize(rows.groupBy("_key").agg(F.sum("_size").alias("size")).withColumn("_bundle", bundle(items)), "shard-groups")
    total = groups.agg(F.sum("size").cast("decimal(38,0)").alias("n")).first().n or 0
    heavy = F.col("size") * F.lit(items).cast("decimal(10,0)") > F.lit(total).cast("decimal(38,0)")
    own = groups.where(heavy).select("_key", "_bundle", "size")
    rest = groups.where(~heavy).groupBy("_bundle").agg(F.sum("size").alias("size")).select(F.lit(None).cast("binary").alias("_key"), "_bundle", "size")
    found = sorted(map(tuple, own.unionByName(rest).collect()), key=lambda r: (-r[2], r[1], r[0] or b""))
    placed = difference([r[2] for r in found], shards)
    heavies = spark.createDataFrame([(bytes(k), s) for (k, _, _), s in zip(found, placed, strict=True) if k is not None], "_key binary, _heavy int")
    bundles = spark.createDataFrame([(b, s) for (k, b, _), s in zip(found, placed, strict=True) if k is None], "_bundle int, _light int")
    # bounded: at most ``items`` rows each
    out = rows.withColumn("_bundle", bundle(items)).join(F.broadcast(heavies), "_key", "left").join(F.broadcast(bundles), "_bundle", "left")
    return out.withColumn("shard", F.coalesce("_heavy", "_light")).drop("_heavy", "_light", "_bundle")


def write_shards(docs: DataFrame, folder: str, shards: int = 8, items: int = ITEMS) -> None:
    """Write ``docs`` (text and any other columns) to ``folder`` as Parquet, a folder for each shard."""
    prepare(docs.sparkSession)
    own = docs.drop(*[c for c in docs.columns if c.lower() in ("shard", "part", "place", "slot", "_key", "_size", "_bundle", "_heavy", "_light")])
    rows = assigned(own, shards, items).drop("_key", "_size")
    schema = extended(rows, _PLACED)
    arrow = arrow_schema(docs.sparkSession, schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, met = TaskContext.get().partitionId(), [0] * shards
        for b in batches:
            shard, places = b.column("shard").to_pylist(), []
            for s in shard:
                places.append(met[s])
                met[s] += 1
            columns = {**{n: b.column(i) for i, n in enumerate(b.schema.names)}, "part": pa.array([part] * len(shard), pa.int32()), "place": pa.array(places, pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in arrow], schema=arrow)

    rows.mapInArrow(place, schema).write.partitionBy("shard").parquet(folder)


def stored(docs: DataFrame, folder: str) -> DataFrame:
    """The rows of :func:`write_shards` with shard, part and place; ``docs``: for the columns."""
    own = docs.drop(*[c for c in docs.columns if c.lower() in ("shard", "part", "place", "slot")])
    return docs.sparkSession.read.schema(extended(own, "part int, place long, shard int")).parquet(folder)


def with_slots(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows with slot for part and place; ``counts``: the stored rows that are counted, all of them."""
    tasks = counts.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = tasks.select("shard", "part", F.coalesce(before, F.lit(0)).alias("_start"))
    return rows.join(starts, ["shard", "part"]).withColumn("slot", F.col("_start") + F.col("place")).drop("_start", "part", "place")


def read_shards(docs: DataFrame, folder: str) -> DataFrame:
    """The rows of :func:`write_shards` with shard and slot; ``docs``: for the columns."""
    rows = stored(docs, folder)
    return with_slots(rows, rows)


def query(docs: DataFrame, shards: int = 8, items: int = ITEMS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of ``docs`` (doc_id, text), from the shards' files."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folder = shared_dir(docs.sparkSession, "shards")
    write_shards(docs, folder, shards, items)
    rows, text = stored(docs, folder), F.coalesce("text", F.lit(""))
    # digests before slots, so that no text is shuffled
    digests = rows.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "shard", "part", "place")
    return with_slots(digests, rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
