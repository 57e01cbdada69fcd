"""Token ids in directly addressable codes (Brisaboa, Ladra and Navarro): any token without decoding a block.

Each id is cut into bytes, lowest first. Level k holds byte k of the ids that have one, a continuation bitmap that
says which of them go on to level k+1, and a rank directory (ones before every 512th bit). Token i is read by one
byte on each level; the place on the next level is the rank of the bit. Files hold whole documents in ascending
order of doc_id and a directory of documents.

``write_tokens``: nulls in text count as empty, a null doc_id sorts first and comes back null, repeated ids are kept
in the order of their texts' hashes, then their texts, an empty table gives no files and no rows, other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunk_encoding import ChunkEncoder
from .common import arrow_schema, map_rows, materialize, partitions, prepare, shared_dir
from .shared_files import make_dir, open_file, write_file

MAGIC, STEP = b"EDAC0002", 512
#: Tokens after which a task starts another file.
FILE_TOKENS = 4_000_000
_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def pack(ids: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray, nulls: int = 0) -> bytes:
    """The file of ``ids``; ``ends``: for each document the number of ids up to its end. The first ``nulls`` have no id."""
    parts, rest = [], ids.astype(np.uint32)
    levels = []
    while True:
        low, more = (rest & 255).astype(np.uint8), rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (STEP // 8)))
        ones = _POP[bits].reshape(-1, STEP // 8).sum(axis=1, dtype=np.uint32) if len(bits) else np.zeros(0, np.uint32)
        rank = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        levels.append((len(low), len(bits), len(rank)))
        parts += [low.tobytes(), bits.tobytes(), rank.tobytes()]
        rest = rest[more] >> 8
        if not len(rest):
            break
    head = MAGIC + struct.pack("<QQQI", len(ids), len(doc_ids), nulls, len(levels)) + b"".join(struct.pack("<QQQ", *x) for x in levels)
    return head + doc_ids.astype("<i8").tobytes() + ends.astype("<u8").tobytes() + b"".join(parts)


class TokenFile:
    """Reads a file of :func:`pack`; ``tokens(places)`` looks each token up by itself."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.n, self.docs, self.nulls, levels = struct.unpack_from("<QQQI", data, 8)
        sizes = [struct.unpack_from("<QQQ", data, 36 + 24 * k) for k in range(levels)]
        at = 36 + 24 * levels
        self.doc_ids = np.frombuffer(data, "<i8", self.docs, at)
        self.ends = np.frombuffer(data, "<u8", self.docs, at + 8 * self.docs).astype(np.int64)
        at += 16 * self.docs
        self.levels = []
        for n, bits, rank in sizes:
            self.levels.append((np.frombuffer(data, np.uint8, n, at), np.frombuffer(data, np.uint8, bits, at + n), np.frombuffer(data, "<u4", rank, at + n + bits)))
            at += n + bits + 4 * rank

    def token(self, place: int) -> int:
        return int(self.tokens(np.array([place], dtype=np.int64))[0])

    def tokens(self, places: np.ndarray) -> np.ndarray:
        """Random access: one byte, one bit and one rank for each level."""
        if len(places) and (places.min() < 0 or places.max() >= self.n):
            raise IndexError("no such token")
        out, at, live = np.zeros(len(places), np.uint32), np.asarray(places, np.int64), np.arange(len(places))
        for k, (low, bits, rank) in enumerate(self.levels):
            out[live] |= low[at].astype(np.uint32) << (8 * k)
            more = (bits[at >> 3] >> (at & 7)) & 1 == 1
            at, live = at[more], live[more]
            if not len(at):
                break
            first = at // STEP
            within = bits.reshape(-1, STEP // 8)[first]
            whole = np.arange(STEP // 8)[None, :] < ((at >> 3) % (STEP // 8))[:, None]
            before = (_POP[within] * whole).sum(axis=1, dtype=np.int64)
            last = _POP[bits[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8)]
            at = rank[first].astype(np.int64) + before + last
        return out

    def span(self, start: int, end: int) -> np.ndarray:
        """Tokens of a range: the first by rank on each level, the following ones are neighbours."""
        parts, lo, hi = [], start, end
        for low, bits, rank in self.levels:
            more = np.unpackbits(bits[lo >> 3 : (hi + 7) >> 3], bitorder="little")[lo & 7 : (lo & 7) + hi - lo].astype(bool)
            parts.append((low[lo:hi], more))
            count = int(more.sum())
            if not count:
                break
            block = lo // STEP
            data = bits[block * (STEP // 8) : lo >> 3]
            before = int(rank[block]) + int(_POP[data].sum(dtype=np.int64)) + int(_POP[bits[lo >> 3] & ((1 << (lo & 7)) - 1)])
            lo, hi = before, before + count
        out = np.zeros(end - start, np.uint32)
        live = np.arange(end - start)
        for k, (low, more) in enumerate(parts):
            out[live] |= low.astype(np.uint32) << (8 * k)
            live = live[more]
        return out

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


_MANIFEST = "part int, seq int, file string, n_docs long, n_tokens long"


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int | None = 2, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write token files to ``folder``; returns the manifest, one row for a file.

    The manifest has base: the tokens of all files before. A file ends with the batch (some MB of text) that reaches
    ``file_tokens``.
    """
    spark = docs.sparkSession
    prepare(spark)
    make_dir(folder)
    arrow = arrow_schema(spark, _MANIFEST)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = ChunkEncoder.of(vocabulary), TaskContext.get().partitionId(), 0
        ids, names, ends, total, nulls = [], [], [], 0, 0
        rows: list[tuple] = []

        def flush() -> None:
            nonlocal ids, names, ends, total, nulls, seq
            if names:
                file, docs_here = f"tokens-{part:06d}-{seq:05d}.dac", np.concatenate(names)
                write_file(folder, file, pack(np.concatenate(ids), docs_here, np.concatenate(ends), nulls))
                rows.append((part, seq, file, len(docs_here), total))
                ids, names, ends, total, nulls, seq = [], [], [], 0, 0, seq + 1

        for b in batches:
            if not b.num_rows:
                continue
            got, offsets = encoder.with_end(b.column("text"), end_id)
            ids.append(got)
            names.append(pc.fill_null(b.column("doc_id"), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            nulls += b.column("doc_id").null_count
            ends.append(offsets[1:] + total)
            total += len(got)
            if total >= file_tokens:
                flush()
        flush()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    # rows of one id (or without one) are dealt by their text's hash as well, so that many of them are not one task
    in_order = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    in_order = in_order.repartitionByRange(partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    files = materialize(in_order.mapInArrow(write, _MANIFEST), "token-manifest")
    # two levels: the one ordered window has a row for each part, not for each file
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("within", within).join(parts, "part").select(*files.columns, (F.col("before") + F.col("within")).alias("base"))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""

    def read(c: dict) -> dict:
        out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
        for file, base in zip(c["file"], c["base"], strict=True):
            with open_file(folder, file) as f:
                t = TokenFile(f.read())
            at = 0
            for k, end in enumerate(t.ends.tolist()):
                out["doc_id"].append(None if k < t.nulls else int(t.doc_ids[k]))
                out["start"].append(base + at)
                out["n_tokens"].append(end - at)
                out["ids_crc32"].append(zlib.crc32(t.span(at, end).astype("<u4").tobytes()))
                at = end
        return out

    spread = manifest.select("file", "base").repartition(partitions(manifest.sparkSession))
    return map_rows(spread, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, documents: DataFrame, vocabulary: str) -> DataFrame:
    folder = shared_dir(spark, "tokens")
    return read_tokens(write_tokens(documents, folder, vocabulary), folder)
