"""Token files, byte-level codec, archives and packing: round trips and brute force."""

import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evidrake.llm import byte_codec, packing, token_files, warc
from evidrake.llm.chunk_encoding import ChunkEncoder
from evidrake.llm.common import shared_dir
from evidrake.llm.queries import BYTE_BPE, MULTI_RANKS, WORD_BPE

ODD = [
    None, "", "a", "  b", " a\n\n b", "x   y\tz \n q", "é́ á b", "'s it's  !!  \n", "a<|endoftext|> b", "\n", "\n\na", "a \nb\n c  ", "a　b c  d", "İstanbul ΑΣ ΣΑ", "123 456\n789  0",
    "a\x1cb !\x1c! c", "\x00 a \x00b", "a \x01 b \x01c", "<|startoftext|> x<|endoftext|>y", "don't  it's\n'll", "  ", "😀 😀😀", "x\t y\t\t z", "word " * 3000, "ab" * 4000, "　 　a",
]
ROWS = [(i * 3, t, "extra") for i, t in enumerate(ODD)] + [(None, "null id", "x"), (6, "a", "again"), (6, "a", "again")]
SCHEMA = "doc_id long, text string, score string"


@pytest.mark.parametrize(("path", "dropped"), [(BYTE_BPE, False), (WORD_BPE, True)])
def test_chunks_encode_as_the_whole(path, dropped):
    whole = Tokenizer.from_file(path)
    encoder, rng = ChunkEncoder(path, dropped, memo_entries=50), random.Random(4)
    texts = [*ODD, *["".join(rng.choice(["a", "The", " ", " ", "\n", "\t", "é", "!", "9", "'s", "\x1c", " ", "ing"]) for _ in range(rng.randint(0, 30))) for _ in range(1500)]]
    for at in range(0, len(texts), 100):
        for t, data in zip(texts[at : at + 100], encoder.encode(texts[at : at + 100]), strict=True):
            assert np.frombuffer(data, "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids, t


def test_token_file_random_access():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), rng.integers(0, 300, 5000).astype(np.uint32), rng.integers(0, 2**32, 3000).astype(np.uint32)):
        f = token_files.TokenFile(token_files.pack(ids, np.array([7, 9]), np.array([len(ids) // 3, len(ids)])))
        places = rng.integers(0, max(1, len(ids)), 200) if len(ids) else np.zeros(0, np.int64)
        assert (f.tokens(places) == ids[places]).all()
        assert (f.document(0) == ids[: len(ids) // 3]).all() and (f.document(1) == ids[len(ids) // 3 :]).all()
        with pytest.raises(IndexError):
            f.token(len(ids))


def test_token_files(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    folder = shared_dir(spark, "test")
    got = token_files.read_tokens(token_files.write_tokens(docs, folder, BYTE_BPE, file_tokens=500), folder).collect()
    whole, at, want = Tokenizer.from_file(BYTE_BPE), 0, []
    for i, t, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.query(spark, docs.limit(0), BYTE_BPE).count() == 0


def test_byte_codec(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    codec = byte_codec.ByteCodec.of(MULTI_RANKS, public_tokenizers.PATTERN)
    got = byte_codec.query(docs, MULTI_RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for i, t, _ in ROWS:
        ids = codec.coding.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    for t in ODD:
        assert codec.encode(t or "", long=10) == codec.coding.encode_ordinary(t or "")
    clash = byte_codec.encode(docs.withColumnRenamed("score", "IDS"), MULTI_RANKS, public_tokenizers.PATTERN)
    assert clash.columns == ["doc_id", "text", "ids"] and clash.count() == len(ROWS)
    assert byte_codec.query(docs.limit(0), MULTI_RANKS, public_tokenizers.PATTERN).count() == 0


def test_archives(spark):
    page = "<html>" + "x" * 200
    rows = [(5, "http://a b", page), (3, None, page), (9, "u", page), (3, "u", page), (None, "u", page), (4, "u", None), (7, "u", ""), (8, "u", "short"), (2, "u", "short"), (1, "é", "é" * 60)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    folder = shared_dir(spark, "test")
    index = warc.write_bundles(warc.plan(pages), folder, frame_bytes=300, bundle_bytes=200)
    got = sorted(map(tuple, warc.read_bundles(index, folder).collect()), key=repr)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = min((j for j, _, h in rows if j is not None and (h or "") == (html or "")), default=None)
        again = len(data) >= 100 and i != first
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=repr)
    one = warc.fetch(index.where("record_id like 'urn:evidrake:1:%'"), folder).first()
    assert warc.parse(bytes(one.record))[1].endswith(("é" * 60).encode())
    assert warc.query(spark, pages.limit(0)).count() == 0


def test_bundle_is_seekable_zstandard():
    writer = warc.BundleWriter(frame_bytes=10)
    places = [writer.add(x) for x in (b"a" * 8, b"b" * 8, b"c" * 30, b"d")]
    reader = warc.BundleReader(io.BytesIO(writer.finish()))
    assert places == [(0, 0, 8), (0, 8, 8), (1, 0, 30), (2, 0, 1)] and reader.frame(1) == b"c" * 30 and reader.frame(0)[8:16] == b"b" * 8


def test_packing_uses_few_sequences():
    rng = np.random.default_rng(0)
    for n in (0, 1, 50, 3000):
        lengths = np.minimum(np.exp(rng.normal(4, 1.2, n)).astype(int) + 1, 256)
        histogram = {int(k): int(c) for k, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
        packed, got = packing.pack(histogram, 256), {}
        for count, pattern in packed:
            assert sum(k * a for k, a in pattern) <= 256
            for k, a in pattern:
                got[k] = got.get(k, 0) + a * count
        assert got == histogram
        assert sum(c for c, _ in packed) <= -(-int(lengths.sum()) // 256) * 1.02 + 2


def test_packing_of_long_texts_at_the_production_length(spark):
    docs = spark.createDataFrame([(1, "word " * 9000, "x"), (2, "short", "x"), (3, "a " * 4095, "x"), (4, "a " * 4096, "x")], SCHEMA)
    rows = packing.query(docs, WORD_BPE).collect()
    whole, want = Tokenizer.from_file(WORD_BPE), []
    for i, t in ((1, "word " * 9000), (2, "short"), (3, "a " * 4095), (4, "a " * 4096)):
        ids = [*whole.encode(t, add_special_tokens=False).ids, 1]
        want += [(i, k, k * 4096, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(ids[a : a + 4096] for a in range(0, len(ids), 4096))]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    assert len({r.sequence_id for r in rows}) == -(-sum(r.length for r in rows) // 4096)


def test_least_and_null_ids_in_token_files(spark):
    docs = spark.createDataFrame([(-(2**63), "a"), (None, "b"), (None, None), (0, "c")], "doc_id long, text string")
    folder = shared_dir(spark, "test")
    got = token_files.read_tokens(token_files.write_tokens(docs, folder, BYTE_BPE), folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -(2**63), 0] and [r.start for r in got] == [0, 1, 3, 5] or [r.start for r in got] == [0, 2, 3, 5]


def test_packing(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rows = packing.query(docs, WORD_BPE, capacity=64).collect()
    whole = Tokenizer.from_file(WORD_BPE)
    want = []
    for i, t, _ in ROWS:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k, k * 64, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(ids[a : a + 64] for a in range(0, len(ids), 64))]
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.query(docs.limit(0), WORD_BPE).count() == 0
