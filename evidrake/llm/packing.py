"""Packing token pieces into sequences by the configuration linear program over the length histogram.

Lengths are at most the capacity, so the histogram, the patterns and the slots are bounded whatever the rows. The
program (as few sequences as possible, every length covered) is solved by multiplicative weights: each round prices
patterns with one knapsack dynamic program over the capacity and takes the best pattern, and the best ones through
each length that come near it. Rounded down, the solution fills sequences; what is left is placed by best fit, first
into their gaps. Pieces find their slots by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunk_encoding import ChunkEncoder
from .common import arrow_schema, map_rows, materialize, prepare

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


def price(worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best worth for each capacity and the length taken last there (0: none).

    ``worth[length]``: of a piece, minus infinity where there is none.
    """
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        total = worth[1 : c + 1] + best[c - 1 :: -1] if c else worth[:0]
        k = int(np.argmax(total))
        if total[k] > best[c - 1]:
            best[c], last[c] = total[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, last


def _trace(last: np.ndarray, c: int, first: int = 0) -> Pattern:
    got: dict[int, int] = defaultdict(int)
    if first:
        got[first] += 1
    while c > 0:
        if last[c]:
            got[int(last[c])] += 1
            c -= int(last[c])
        else:
            c -= 1
    return tuple(sorted(got.items(), reverse=True))


def solve(histogram: dict[int, int], capacity: int, rounds: int = 60, near: float = 0.02, each: int = 400) -> dict[Pattern, float]:
    """A fractional solution: how often each pattern is used. Deterministic; bounded by lengths, not counts."""
    lengths = np.array(sorted(histogram), np.int64)
    count = np.array([histogram[x] for x in lengths.tolist()], float)
    place = {x: i for i, x in enumerate(lengths.tolist())}
    covered, used = np.zeros(len(lengths)), defaultdict(float)
    for _ in range(rounds):
        share = covered / count
        weight = lengths / capacity * np.exp(-8.0 * (share - share.min()))
        worth = np.full(capacity + 1, -np.inf)
        worth[lengths] = weight
        best, last = price(worth, capacity)
        through = weight + best[capacity - lengths]
        order = np.argsort(-through, kind="stable")[:each]
        for k in order[through[order] >= (1 - near) * best[capacity]].tolist():
            pattern = _trace(last, capacity - int(lengths[k]), int(lengths[k]))
            step = min(count[place[x]] / a for x, a in pattern) / rounds * 2
            used[pattern] += step
            for x, a in pattern:
                covered[place[x]] += a * step
    return dict(used)


def best_fit(left: dict[int, int], groups: list[tuple[int, int, Pattern]], capacity: int) -> list[tuple[int, Pattern]]:
    """Place what is left, longest first, each where the least room stays; equal sequences move together."""
    rooms: dict[int, list[tuple[int, dict[int, int]]]] = defaultdict(list)
    has = np.zeros(capacity + 1, bool)
    for n, room, pattern in groups:
        rooms[room].append((n, dict(pattern)))
        has[room] = True
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            fits = np.flatnonzero(has[length:])
            if len(fits):
                room = length + int(fits[0])
                m, pattern = rooms[room].pop()
                if not rooms[room]:
                    has[room] = False
                if m > n:
                    rooms[room].append((m - n, pattern))
                    has[room] = True
                    m = n
                each = 1
            else:
                room, pattern, each = capacity, {}, min(capacity // length, n)
                m = n // each
            filled = dict(pattern)
            filled[length] = filled.get(length, 0) + each
            room -= each * length
            rooms[room].append((m, filled))
            has[room] = True
            n -= m * each
    return [(n, tuple(sorted(p.items(), reverse=True))) for room in sorted(rooms) for n, p in rooms[room]]


def pack(histogram: dict[int, int], capacity: int, rounds: int = 60) -> list[tuple[int, Pattern]]:
    """(how many sequences, pattern) covering the histogram exactly."""
    if not histogram:
        return []
    left, groups = dict(histogram), []
    for pattern, x in sorted(solve(histogram, capacity, rounds).items(), key=lambda p: (-p[1], p[0])):
        n = min(int(x), *(left[length] // a for length, a in pattern))
        if n:
            for length, a in pattern:
                left[length] -= n * a
            groups.append((n, capacity - sum(length * a for length, a in pattern), pattern))
    return best_fit({k: n for k, n in left.items() if n}, groups, capacity)


class Slots:
    """Where the piece of a rank among those of its length goes."""

    def __init__(self, packed: list[tuple[int, Pattern]]):
        by_length: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        taken: dict[int, int] = defaultdict(int)
        first = 0
        for n, pattern in packed:
            offset = 0
            for length, a in pattern:
                by_length[length].append((taken[length], first, a, offset))
                taken[length] += n * a
                offset += length * a
            first += n
        self.sequences = first
        self.rows = {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in by_length.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for x in np.unique(length).tolist():
            own = length == x
            start, first, a, base = self.rows[x]
            k = np.searchsorted(start, rank[own], "right") - 1
            r = rank[own] - start[k]
            sequence[own] = first[k] + r // a[k]
            offset[own] = base[k] + r % a[k] * x
        return sequence, offset


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of each document, numbered among those of their length in their partition; a table."""
    prepare(docs.sparkSession)
    arrow = arrow_schema(docs.sparkSession, _PIECES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = ChunkEncoder.of(vocabulary, white_space_dropped=True), TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            if not b.num_rows:
                continue
            rows = []
            ids, offsets = encoder.with_end(b.column("text"), end_id)
            data = memoryview(ids.astype("<u4")).cast("B")
            for doc, first, end in zip(b.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for k, at in enumerate(range(first, end, capacity)):
                    length = min(capacity, end - at)
                    rows.append((doc, k, at - first, length, zlib.crc32(data[4 * at : 4 * (at + length)]), part, seen[length]))
                    seen[length] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECES), "pieces")


def assign(cut: DataFrame, capacity: int, rounds: int = 60) -> DataFrame:
    """``cut`` (of :func:`pieces`) with sequence_id and offset. Only the histogram comes to the driver."""
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = Slots(pack(histogram, capacity, rounds))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def place(c: dict) -> dict:
        sequence, offset = slots.place(np.array(c["length"], np.int64), np.array(c.pop("rank"), np.int64))
        return c | {"sequence_id": sequence.tolist(), "offset": offset.tolist()}

    return map_rows(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(documents: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Nulls count as empty texts, which are one end id; null and repeated doc_ids are packed like others; an empty
    table gives no rows; other columns are not read."""
    return assign(pieces(documents, vocabulary, capacity, end_id), capacity)
