"""Byte-level BPE with tiktoken and a local rank file; long texts are cut at safe boundaries first.

No match of the splitting pattern holds a space after a non-space, so a text may be cut before a space that follows
a letter, digit or mark in ASCII; texts without such a place stay whole. Decoding joins raw bytes.

Nulls count as empty texts; an empty text has no ids. Rows are independent: repeated rows and null ids come back as
they are, other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, map_rows, prepare

#: Code points above which a text is cut.
LONG = 50_000
SAFE = re.compile(r"(?<=[A-Za-z0-9.,;!?])(?= )")
_codecs: dict[tuple[str, str], "ByteCodec"] = {}


class ByteCodec:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.digits = [str(i) for i in range(max(ranks.values()) + 1)]

    @classmethod
    def of(cls, path: str, pattern: str) -> "ByteCodec":
        """One for each worker process."""
        if (path, pattern) not in _codecs:
            _codecs[path, pattern] = cls(path, pattern)
        return _codecs[path, pattern]

    def pieces(self, text: str, long: int = LONG) -> list[str]:
        out, at = [], 0
        while len(text) - at > long and (m := SAFE.search(text, at + long)):
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]]

    def encode(self, text: str, long: int = LONG) -> list[int]:
        if len(text) <= long:
            return self.coding.encode_ordinary(text)
        return [i for piece in self.pieces(text, long) for i in self.coding.encode_ordinary(piece)]

    def decode(self, ids: list[int]) -> bytes:
        return self.coding.decode_bytes(ids)

    def line(self, ids: list[int]) -> str:
        return ",".join(map(self.digits.__getitem__, ids))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` and ``ids``; a column of that name is replaced."""
    fields = extended(docs, f"{ids} array<int>")

    def run(c: dict) -> dict:
        codec = ByteCodec.of(path, pattern)
        return c | {ids: [codec.encode(t or "") for t in c[text]]}

    return map_rows(docs, run, fields)


def query(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    prepare(documents.sparkSession)

    def run(c: dict) -> dict:
        codec = ByteCodec.of(path, pattern)
        ids = [codec.encode(t or "") for t in c["text"]]
        return {
            "doc_id": c["doc_id"],
            "n_tokens": list(map(len, ids)),
            "ids_sha256": [hashlib.sha256(codec.line(x).encode()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids],
        }

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(docs, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
