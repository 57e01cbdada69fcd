"""Web archive bundles of independent Zstandard frames with a footer seek table.

Records are grouped into frames; each frame is compressed by itself. A skippable frame at the end (the published
seekable format) lists the compressed and plain size of every frame. The record index maps a record's id to its file,
frame and offset inside the plain frame, so one record costs one frame.

Of pages with equal payloads of at least ``least`` bytes the one with the smallest page_id is a response and the
others are revisits that refer to it. Null html is an empty payload; a null page_id is never a referred one unless all
are null, and comes back null; rows that repeat the response's id with the same payload are responses too; an empty
table gives no files. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, map_rows, materialize, partitions, prepare, shared_dir
from .shared_files import make_dir, open_file, write_file

#: Plain bytes after which a frame, and compressed bytes after which a bundle, ends.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 32 << 20
#: Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> tuple[str, bytes]:
    """Record id and bytes of a WARC record; the block of a revisit has the HTTP head only."""
    name = f"urn:evidrake:{'null' if page_id is None else page_id}:{digest[:16]}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(url.split()))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:evidrake:{'null' if refers_to is None else refers_to}:{digest[:16]}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Head fields and block of the record at ``at``, and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    stop = end + 4 + int(head["Content-Length"])
    return head, data[end + 4 : stop], stop + 4


class BundleWriter:
    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.press = frame_bytes, zstandard.ZstdCompressor(level=3)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.held = self.written = 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Frame, offset in its plain bytes, and length."""
        place = (len(self.frames), self.held, len(data))
        self.open.append(data)
        self.held += len(data)
        if self.held >= self.frame_bytes:
            self.close_frame()
        return place

    def close_frame(self) -> None:
        if self.open:
            self.frames.append(self.press.compress(b"".join(self.open)))
            self.sizes.append((len(self.frames[-1]), self.held))
            self.written += len(self.frames[-1])
            self.open, self.held = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


class BundleReader:
    """Reads frames of a bundle through its seek table; ``file``: a seekable handle."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        file.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        file.seek(size - 9 - 8 * count)
        table = file.read(8 * count)
        self.sizes = [struct.unpack_from("<II", table, 8 * i) for i in range(count)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, k: int) -> bytes:
        self.file.seek(self.starts[k])
        return zstandard.ZstdDecompressor().decompress(self.file.read(self.sizes[k][0]), max_output_size=self.sizes[k][1])

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(frame), offset)[:2]


def plan(pages: DataFrame, least: int = 100) -> DataFrame:
    """Pages with digest, revisit and refers_to. Only ids and digests are grouped; each html is shuffled once."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    digests = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= least)
    first = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    again = digests.join(first.select("digest", "first"), "digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
    again = again.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first").distinct()
    full = pages.withColumn("digest", F.sha2(payload, 256))
    joined = full.join(again, full.page_id.eqNullSafe(again.p) & (full.digest == again.d), "left")
    return joined.select("page_id", "url", "html", "digest", F.col("d").isNotNull().alias("revisit"), F.col("first").alias("refers_to"))


_INDEX = "file string, record_id string, frame int, offset long, length long"


def write_bundles(planned: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write the bundles to ``folder``; returns the record index (a table in the shared folder)."""
    spark = planned.sparkSession
    prepare(spark)
    make_dir(folder)
    arrow = arrow_schema(spark, _INDEX)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, bundle, rows = TaskContext.get().partitionId(), 0, BundleWriter(frame_bytes), []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq, bundle, rows
            if rows:
                file = f"pages-{part:06d}-{seq:05d}.warc.zst"
                write_file(folder, file, bundle.finish())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(([file] * len(rows), *zip(*rows, strict=True)), arrow, strict=True)], schema=arrow)
                seq, bundle, rows = seq + 1, BundleWriter(frame_bytes), []

        for b in batches:
            c = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            for page, url, html, digest, revisit, refers in zip(*(c[n] for n in ("page_id", "url", "html", "digest", "revisit", "refers_to")), strict=True):
                name, data = record(page, url, (html or "").encode(), digest, refers, revisit)
                rows.append((name, *bundle.add(data)))
                if bundle.written >= bundle_bytes:
                    yield from flush()
        yield from flush()

    return materialize(planned.mapInArrow(write, _INDEX), "warc-index")


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """One row for each record, from the archives; the digest of a response is computed from its payload again."""

    def page(name: str) -> int | None:
        x = name.strip("<>").split(":")[2]
        return None if x == "null" else int(x)

    def read(c: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
        for file in c["file"]:
            with open_file(folder, file) as f:
                bundle = BundleReader(f)
                for k in range(len(bundle.sizes)):
                    data, at = bundle.frame(k), 0
                    while at < len(data):
                        head, block, at = parse(data, at)
                        http, _, body = block.partition(b"\r\n\r\n")
                        size = int(http.rsplit(b"Content-Length: ", 1)[1])
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if head["WARC-Type"] == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                            raise ValueError(f"{file}: a payload does not match its digest")
                        out["page_id"].append(page(head["WARC-Record-ID"]))
                        out["payload_bytes"].append(size)
                        out["payload_digest"].append(digest)
                        out["record_type"].append(head["WARC-Type"])
                        out["refers_to"].append(page(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None)
        return out

    files = index.select("file").distinct().repartition(partitions(index.sparkSession))
    return map_rows(files, read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def fetch(index: DataFrame, folder: str) -> DataFrame:
    """Records of (a part of) the index by seeking: file, record_id, record."""

    def read(c: dict) -> dict:
        got = []
        for file, frame, offset, length in zip(c["file"], c["frame"], c["offset"], c["length"], strict=True):
            with open_file(folder, file) as f:
                got.append(BundleReader(f).frame(frame)[offset : offset + length])
        return {"record_id": c["record_id"], "record": got}

    return map_rows(index, read, "record_id string, record binary")


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    folder = shared_dir(spark, "warc")
    return read_bundles(write_bundles(plan(pages), folder), folder)
