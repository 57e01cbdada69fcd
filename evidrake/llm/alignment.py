"""Alignment of two tokenizers over the same bytes, by DuckDB within Arrow partitions and counts merged in Spark.

Both vocabularies part a text before any space or line break that follows a non-space: the byte-level one splits there before
its merges, and no piece of the other one holds a space after another character, or a line break. So the units between such
places are encoded and aligned by themselves, and a text is its units one after another. Each task gathers some MB of texts (a
chunk), encodes units that are new to its worker, and gives their token intervals on both sides to DuckDB: ASOF joins find the
first and last B token that an A token meets, a range join the links, window sums over shared ends the groups. Out come a row for
each document (with the numbers of its units), the chunk's id pairs with their counts, and its units as lists of those pairs.

Spark sums the partial counts by id pair, finds each B id's highest, and joins them to the pairs of the chunks; a second pass
reads each chunk's pairs, units and documents in this order. Nothing is broadcast or collected, and a chunk is the most
that a task holds; a longer text is a chunk of its own.

Null and empty texts, and those whose tokens' bytes are not the text's (a text with U+2581), have no tokens: zeros, and '' for
the digest. Null ids come back null, repeated ids and rows are rows of their own, ties for a B id's highest all count, an empty table
gives no rows, other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, repeat

import duckdb
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunk_encoding import ChunkEncoder
from .common import arrow_schema, materialize, partitions, prepare

#: Characters of text that a chunk gathers, units that a worker remembers and aligns at once, and the memory of its DuckDB.
CHUNK, REMEMBERED, AT_ONCE, MEMORY = 4 << 20, 300_000, 50_000, "256MB"
MARK, WHITE = "▁", ("", " ", "\n", "\x00")
CUT = re.compile(r"(?<=\S)(?=[ \n])")
RUNS = re.compile(r"\s[ \n]")
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_AS_BYTE = {chr(b): b for b in _SHOWN} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}

# token intervals on one line of bytes (units end to end); of an A token, the first and the last B token that it meets
_REACH = """SELECT f.n, f.unit, f.id, f.head, l.n AS tail
    FROM (SELECT a.n, a.unit, a.id, a.hi, b.n AS head FROM a ASOF JOIN b ON a.lo >= b.lo) f ASOF JOIN b l ON f.hi > l.lo"""
_LINKS = f"SELECT r.unit, r.id AS a, b.id AS b FROM ({_REACH}) r JOIN b ON b.n BETWEEN r.head AND r.tail"
# the number of shared ends before a token is its group
_GROUPED = """SELECT n, cut, sum(cut) OVER (ORDER BY n) - cut AS g
    FROM (SELECT x.n, CASE WHEN y.hi IS NULL THEN 0 ELSE 1 END AS cut FROM {0} x LEFT JOIN {1} y ON x.hi = y.hi) ORDER BY n"""

_COUNTED = ("n_a", "n_b", "n_groups", "n_links")
#: Kinds of rows of a chunk, in the order in which the second pass reads them.
PAIR, UNITS, DOCUMENT = 0, 1, 2
_FOUND = (
    "chunk long, kind int, at int, a int, b int, n long, lengths binary, pairs binary, "
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, units binary"
)
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def units(text: str) -> list[str]:
    """The units of a space and the text."""
    whole = " " + text
    if "\x00" in whole or RUNS.search(whole):
        return CUT.split(whole)
    return whole.replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00")[1:]


class Aligner:
    """The two vocabularies and what their ids stand for in bytes; one for each worker process."""

    _made: dict[tuple[str, str], Aligner] = {}

    def __init__(self, path_a: str, path_b: str):
        self.encoder = ChunkEncoder(path_a, special_as_text=True)
        self.a = self.encoder.tokenizer
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        own = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(own.values()) + 1)
        for token, i in own.items():
            self.bytes_a[i] = bytes(_AS_BYTE[c] for c in token) if all(c in _AS_BYTE for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.mark = self.b.piece_to_id(MARK)
        if any(re.search(f"[^{MARK}]{MARK}|[ \n]", p) for p in pieces):
            raise ValueError("pieces run over spaces or line breaks, so units cannot be encoded by themselves")
        self.sql = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        numbers = [str(i) for i in range(max(len(self.bytes_a), len(pieces)))]
        self.shown_ids = [numbers, *([mark + x for x in numbers] for mark in ";|,")]
        self._forget()

    def _forget(self) -> None:
        """Nothing is known: units' places, and by place whether both sides have its bytes, its counts, groups and links."""
        self.slots: dict[str, int] = {}
        self.met = np.zeros(0, np.int64)  # in how many chunks
        self.good, self.counts = np.zeros(0, bool), {k: np.zeros(0, np.int64) for k in _COUNTED}
        self.shown: list[bytes] = []
        self.links = np.zeros((0, 2), np.int32)  # (a, b) of all units, one unit after another
        self.ends = np.zeros(1, np.int64)  # where each unit's links begin, and the end

    def _thin(self) -> None:
        """Forget what only one chunk had, or everything where that is still too much."""
        keep = np.flatnonzero(self.met > 1)
        if len(keep) > REMEMBERED // 2:
            return self._forget()
        names, kept = list(self.slots), keep.tolist()
        lengths = self.ends[keep + 1] - self.ends[keep]
        self.links = self.links[spans_of(self.ends[keep], lengths)]
        self.ends = np.concatenate([[0], np.cumsum(lengths)])
        self.good, self.met, self.counts = self.good[keep], self.met[keep], {k: v[keep] for k, v in self.counts.items()}
        self.shown = [self.shown[i] for i in kept]
        self.slots = {names[i]: n for n, i in enumerate(kept)}

    def places(self, flat: list[str]) -> np.ndarray:
        """The places of a chunk's units, of which the new ones are aligned."""
        if len(self.slots) > REMEMBERED:
            self._thin()
        out = np.fromiter(map(self.slots.get, flat, repeat(-1)), np.int64, len(flat))
        holes = np.flatnonzero(out < 0).tolist()
        new = list(dict.fromkeys(flat[i] for i in holes))
        for at in range(0, len(new), AT_ONCE):
            self._learn(new[at : at + AT_ONCE])
        if holes:
            out[holes] = [self.slots[flat[i]] for i in holes]
        self.met[np.unique(out)] += 1
        return out

    def _learn(self, found: list[str]) -> None:
        good, counts, shown, unit, links = self.align(found)
        for u in found:
            self.slots[u] = len(self.slots)
        self.good, self.met = np.concatenate([self.good, good]), np.concatenate([self.met, np.zeros(len(found), np.int64)])
        self.counts = {k: np.concatenate([self.counts[k], counts[k]]) for k in _COUNTED}
        self.shown += shown
        self.links = np.concatenate([self.links, links[np.argsort(unit, kind="stable")]])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts["n_links"])])

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Aligner:
        if (path_a, path_b) not in cls._made:
            cls._made[path_a, path_b] = cls(path_a, path_b)
        return cls._made[path_a, path_b]

    def tokens(self, found: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides for units; the second side adds the first space itself, and has a mark before a line break."""
        # the encoder's way for plain chunks, which it names without their space; white space after that is not plain
        left = [None if u[0] == " " and u[1:2] in WHITE else self.encoder._plain(u[1:] if u[0] == " " else u) for u in found]
        odd = [i for i, x in enumerate(left) if x is None]
        for i, e in zip(odd, self.a.encode_batch_fast([found[i] for i in odd], add_special_tokens=False) if odd else (), strict=True):
            left[i] = e.ids
        right = self.b.encode([u[1:] if u[0] == " " else u for u in found], num_threads=1) if found else []
        for i, u in enumerate(found):
            if u == " ":
                right[i] = [self.mark]
            elif u[0] != " ":
                right[i] = right[i][1:] if right[i][:1] == [self.mark] else []
        return left, right

    @staticmethod
    def _intervals(ids: list[list[int]], sizes: np.ndarray) -> dict[str, np.ndarray]:
        flat = np.fromiter(chain.from_iterable(ids), np.int32)
        ends = np.cumsum(sizes[flat])
        return {"n": np.arange(len(flat)), "unit": np.repeat(np.arange(len(ids)), [len(x) for x in ids]), "id": flat, "lo": ends - sizes[flat], "hi": ends}

    @staticmethod
    def _same(data: list[bytes], ids: list[list[int]], known: list[bytes], side: dict[str, np.ndarray]) -> np.ndarray:
        """Whose tokens' bytes are those of the unit: all at once, or else one by one."""
        sizes = np.bincount(side["unit"], weights=side["hi"] - side["lo"], minlength=len(data))
        if (sizes == [len(x) for x in data]).all() and b"".join([known[i] for i in chain.from_iterable(ids)]) == b"".join(data):
            return np.ones(len(data), bool)
        return np.array([b"".join([known[i] for i in x]) == d for x, d in zip(ids, data, strict=True)], bool)

    def align(self, found: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray], list[bytes], np.ndarray, np.ndarray]:
        """Of units: which have the same bytes on both sides, their counts, groups as text, and the links with their units."""
        tokens, data = self.tokens(found), [u.encode() for u in found]
        known, sizes = (self.bytes_a, self.bytes_b), (self.sizes_a, self.sizes_b)
        sides = [self._intervals(*x) for x in zip(tokens, sizes, strict=True)]
        good = np.logical_and(*(self._same(data, *x) for x in zip(tokens, known, sides, strict=True)))
        if not good.all():
            sides = [self._intervals([t if ok else [] for t, ok in zip(x, good.tolist(), strict=True)], n) for x, n in zip(tokens, sizes, strict=True)]
        for x, side in zip("ab", sides, strict=True):
            self.sql.register(f"{x}_rows", pa.table(side))
            self.sql.execute(f"CREATE OR REPLACE TEMP TABLE {x} AS SELECT * FROM {x}_rows")
            self.sql.unregister(f"{x}_rows")
        linked = self.sql.execute(_LINKS).fetchnumpy()
        grouped = [self.sql.execute(_GROUPED.format(*x)).fetchnumpy() for x in ("ab", "ba")]
        count = lambda at: np.bincount(at, minlength=len(found)).astype(np.int64)
        n_groups = count(sides[0]["unit"][grouped[0]["cut"] == 1])
        counts = {"n_a": count(sides[0]["unit"]), "n_b": count(sides[1]["unit"]), "n_groups": n_groups, "n_links": count(linked["unit"])}
        return good, counts, self._shown(len(found), sides, grouped), linked["unit"], np.stack([linked["a"], linked["b"]], 1).astype(np.int32)

    def _shown(self, n: int, sides: list[dict], grouped: list[dict]) -> list[bytes]:
        """The groups of units as text: ids with a mark before each but the first of a unit."""
        unit, ids = (np.concatenate([s[k] for s in sides]) for k in ("unit", "id"))
        group = np.concatenate([g["g"] for g in grouped]).astype(np.int64)
        side = np.repeat([0, 1], [len(s["n"]) for s in sides])
        order = np.lexsort((side, group))  # stable: tokens of a side stay in order
        unit, ids, group, side = unit[order], ids[order], group[order], side[order]
        new = lambda x: np.diff(x, prepend=-1) != 0
        mark = np.where(new(unit), 0, np.where(new(group), 1, np.where(new(side), 2, 3)))
        pieces = [self.shown_ids[m][i] for m, i in zip(mark.tolist(), ids.tolist(), strict=True)]
        ends = np.cumsum(np.bincount(unit, minlength=n)).tolist()
        return ["".join(pieces[lo:hi]).encode() for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]


def sums_of(starts: np.ndarray, codes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For rows of codes (``starts``: where each begins, and the end) the sums of their codes' values."""
    total = np.concatenate([[0], np.cumsum(values[codes])])
    return total[starts[1:]] - total[starts[:-1]]


def spans_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of several ranges, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Stored rows of chunks, by kind. DOCUMENT: its counts, its groups' digest, and the numbers of its units in the chunk.
    PAIR: ids a and b, and their n links in the chunk. UNITS: how many links each unit has, and those links' pairs, by number.

    Lists of numbers are little-endian with 32 bits.
    """
    spark = docs.sparkSession
    prepare(spark)
    schema = arrow_schema(spark, _FOUND)

    def rows_of(kind: int, chunk: int, rows: int, /, **columns) -> pa.RecordBatch:
        columns |= {"chunk": [chunk] * rows, "kind": [kind] * rows}
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

    def one(chunk: int, ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(path_a, path_b)
        rows = [units(t) if t else [] for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        places = aligner.places(list(chain.from_iterable(rows)))
        rows = None
        bad = sums_of(starts, places, (~aligner.good).astype(np.int64)) > 0
        counted = {k: np.where(bad, 0, sums_of(starts, places, aligner.counts[k])) for k in _COUNTED}
        own, codes = np.unique(places, return_inverse=True)
        times = np.bincount(codes[np.repeat(~bad, np.diff(starts))], minlength=len(own))
        lengths = aligner.ends[own + 1] - aligner.ends[own]
        links = aligner.links[spans_of(aligner.ends[own], lengths)].astype(np.int64)
        pairs, number = np.unique(links[:, 0] << 32 | links[:, 1], return_inverse=True)
        n = np.zeros(len(pairs), np.int64)
        np.add.at(n, number, np.repeat(times, lengths))
        for lo in range(0, len(pairs), 20_000):
            p = pairs[lo : lo + 20_000]
            yield rows_of(PAIR, chunk, len(p), at=np.arange(lo, lo + len(p)), a=p >> 32, b=p & 0xFFFFFFFF, n=n[lo : lo + len(p)])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        for lo in range(0, len(own), 20_000):
            hi = min(len(own), lo + 20_000)
            yield rows_of(UNITS, chunk, 1, at=[lo], lengths=[lengths[lo:hi].astype("<u4").tobytes()], pairs=[number[ends[lo] : ends[hi]].astype("<u4").tobytes()])
        listed, shown = places.tolist(), aligner.shown
        for lo in range(0, len(ids), 512):
            hi = min(len(ids), lo + 512)
            none = [bad[i] or starts[i] == starts[i + 1] for i in range(lo, hi)]
            digests = ["" if x else hashlib.sha256(b";".join([shown[c] for c in listed[starts[i] : starts[i + 1]]])).hexdigest() for i, x in enumerate(none, lo)]
            binary = [b"" if x else codes[starts[i] : starts[i + 1]].astype("<u4").tobytes() for i, x in enumerate(none, lo)]
            yield rows_of(DOCUMENT, chunk, hi - lo, at=range(lo, hi), doc_id=ids[lo:hi], groups_sha256=digests, units=binary, **{k: v[lo:hi] for k, v in counted.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if size and size + len(t or "") > CHUNK:
                    yield from one(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t or "")
        if ids:
            yield from one(number, ids, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, _FOUND), "alignments")


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, n, best): links of each id pair in all documents, and whether no A id has more links with that B id."""
    pairs = found.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("n").alias("n"))
    return pairs.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def scored(found: DataFrame, counts: DataFrame) -> DataFrame:
    """One row for each document of :func:`alignments`, with n_best and count_sum by ``counts``."""
    spark = found.sparkSession
    schema = arrow_schema(spark, _OUT)
    pairs = found.where(F.col("kind") == PAIR).select("chunk", "kind", "at", "a", "b").join(counts.select("a", "b", "n", "best"), ["a", "b"])
    others = found.where(F.col("kind") > PAIR).drop("a", "b", "n")
    both = others.unionByName(pairs.drop("a", "b"), allowMissingColumns=True)
    dealt = both.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk", "kind", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            chunks, kinds = batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(chunks) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(chunks)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if chunks[lo] != now:  # lists of arrays by kind, joined when the next kind comes
                    now, held = chunks[lo], {PAIR: ([], []), UNITS: ([], [])}
                rows, kind = batch.slice(lo, hi - lo), int(kinds[lo])
                if kind == PAIR:
                    held[PAIR][0].append(np.where(rows.column("best").to_numpy(zero_copy_only=False), 1, 0))
                    held[PAIR][1].append(rows.column("n").to_numpy())
                    continue
                values = [np.concatenate([np.zeros(0, np.int64), *x]) for x in held[kind - 1]]
                held[kind - 1] = tuple([x] for x in values)
                # a unit is a list of pairs, a document a list of units
                lists = rows.column("pairs" if kind == UNITS else "units").to_pylist()
                lengths = [np.frombuffer(x, "<u4").astype(np.int64) for x in rows.column("lengths").to_pylist()] if kind == UNITS else [np.array([len(x) // 4 for x in lists])]
                starts = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
                codes = np.frombuffer(b"".join(lists), "<u4").astype(np.int64)
                sums = [sums_of(starts, codes, v) for v in values]
                if kind == UNITS:
                    for x, v in zip(held[UNITS], sums, strict=True):
                        x.append(v)
                    continue
                made = {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
                yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else rows.column(f.name) for f in schema], schema=schema)

    return dealt.mapInArrow(run, _OUT)


def query(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of ``docs`` (doc_id, text)."""
    found = alignments(docs, path_a, path_b)
    return scored(found, materialize(pair_counts(found), "pair-counts"))
