"""Similarity self-join of documents: Jaccard of word shingles at a threshold, by a MinHash LSH forest.

Each document's shingle set (``width`` words, lower case, parted at white space; a shorter text is one shingle) gets
``trees`` labels of ``depth`` minimum hashes. Labels are sorted for each tree, so that neighbours share the longest
prefixes and a shared prefix is a node of the tree's trie. Each document's prefix is shortened from the whole label
step by step: at every step the documents of a node that are not united yet are compared by their whole signatures, and
those that look alike are united. It ends where the node holds nothing new, and at the latest at the longest prefix that
finds a pair at the threshold with the target recall (:func:`least_prefix`). Documents alone at that prefix take no part.

United documents form groups, whose pairs are verified exactly on their shingle sets. Only documents that look alike by
all hashes are united, so a prefix that many unlike documents share joins no group. Documents with equal sets form a
class, whose members all link; only classes take part, so copies are never paired. Large nodes and groups are compared in
pairs of blocks, all of them, without a cap; sums and a spanning link for each class come out, not pairs.

Null and empty texts have no shingles and link with nothing, as do rows with a null id; rows that repeat an id count
as copies; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_rows, materialize, partitions, prepare, runs
from .components import connected_components
from .embedding_dedup import unite

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Candidates up to which their list is broadcast (five columns, about 100 bytes each: 10 MB); above it the texts are shuffled.
BROADCAST_ROWS = 100_000
#: Standard deviations below the threshold at which the share of equal hashes of two documents still makes them alike (a pair
#: at the threshold is lost there with a chance of 0.00002).
DEVIATIONS = 4.1


def least_equal(threshold: float, hashes: int) -> int:
    """How many of the hashes of two documents must be equal for them to count as alike: fewer for a lower threshold."""
    return max(0, math.floor(hashes * threshold - DEVIATIONS * math.sqrt(hashes * threshold * (1 - threshold))))


def least_prefix(threshold: float, trees: int, depth: int, target: float) -> int:
    """The longest prefix whose match in one of the trees finds a pair at the threshold with the target recall."""
    for k in range(depth, 1, -1):
        if 1 - (1 - threshold**k) ** trees >= target:
            return k
    return 1


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text; remembers word hashes (bounded)."""

    def __init__(self, width: int, memo: int = 200_000):
        self.width, self.limit, self.memo = width, memo, {}

    def words(self, text: str) -> np.ndarray:
        words = text.lower().split()
        got = list(map(self.memo.get, words))
        if None in got:
            if len(self.memo) > self.limit:
                self.memo.clear()
            for i, x in enumerate(got):
                if x is None:
                    got[i] = x = xxhash.xxh3_64_intdigest(words[i])
                    self.memo[words[i]] = x
        return np.array(got, np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        w = self.words(text or "")
        if not len(w):
            return w
        n = max(1, len(w) - self.width + 1)
        h = np.full(n, len(w) if n == 1 else self.width, np.uint64)
        for k in range(min(self.width, len(w))):
            h = (h ^ w[k : k + n]) * _MIX
            h ^= h >> np.uint64(29)
        return np.unique(h)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over the set."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        out = np.minimum(out, (shingles[at : at + 2048, None] * a + b).min(axis=0))
    return out


def _signed(docs: DataFrame, width: int, trees: int, depth: int, seed: int) -> DataFrame:
    """(doc_id, key, hashes): key is null without shingles; the hashes (two bytes of each minimum) of all trees."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, trees * depth, dtype=np.uint64)

    def run(c: dict) -> dict:
        shingler, keys, hashes = Shingler(width), [], []
        for text in c["text"]:
            s = shingler(text)
            keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            hashes.append(signature(s, a, b).astype(">u2").tobytes() if len(s) else None)
        return {"doc_id": c["doc_id"], "key": keys, "hashes": hashes}

    return map_rows(docs, run, "doc_id long, key binary, hashes binary")


def common_prefix(labels: np.ndarray) -> np.ndarray:
    """How many first hashes each label shares with the one before (0 for the first)."""
    same = np.zeros(labels.shape, bool)
    same[1:] = labels[1:] == labels[:-1]
    return np.cumprod(same, axis=1).sum(axis=1)


def neighbours(classes: DataFrame, trees: int, depth: int, least: int) -> DataFrame:
    """(tree, label, node) of labels that share ``least`` hashes or more with one beside them in the sorted tree.

    Labels are dealt in ranges, equal prefixes together, and read as a stream: nothing is held but the row before.
    """
    spark = classes.sparkSession
    size = 2 * depth
    own = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.substring("hashes", t * size + 1, F.lit(size)).alias("label")))
    entries = classes.select("node", F.explode(own).alias("e")).select("e.tree", "e.label", "node", F.substring("e.label", 1, 2 * least).alias("prefix"))
    dealt = entries.repartitionByRange(partitions(spark), "tree", "prefix").sortWithinPartitions("tree", "label", "node").drop("prefix")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, and whether it shares a prefix with the one before it
        for b in batches:
            if not b.num_rows:
                continue
            joined = pa.Table.from_batches([b] if held is None else [held[0], b])
            labels = np.frombuffer(b"".join(joined.column("label").to_pylist()), ">u2").reshape(len(joined), depth)
            tree = joined.column("tree").to_numpy()
            with_last = (common_prefix(labels) >= least) & (np.diff(tree, prepend=-1) == 0)
            keep = with_last | np.concatenate([with_last[1:], [False]])
            if held is not None:
                keep[0] |= held[1]
            held = b.slice(b.num_rows - 1), bool(with_last[-1])
            out = joined.slice(0, len(joined) - 1).filter(pa.array(keep[:-1])).combine_chunks()
            yield from out.to_batches()
        if held is not None and held[1]:
            yield held[0]

    return dealt.mapInArrow(walk, dealt.schema)


def alike(hashes: np.ndarray, others: np.ndarray, need: int) -> np.ndarray:
    """Which rows of both have at least ``need`` of their hashes equal."""
    out = np.zeros((len(hashes), len(others)), bool)
    step = max(1, 4_000_000 // max(1, others.size))
    for at in range(0, len(hashes), step):
        out[at : at + step] = np.count_nonzero(hashes[at : at + step, None, :] == others[None, :, :], axis=2) >= need
    return out


def descend(labels: np.ndarray, hashes: np.ndarray, least: int, need: int) -> np.ndarray:
    """For rows of a trie node, sorted by label, the first row of each one's cluster.

    From the longest shared prefix to the shortest: rows that a longer one has united are not compared again.
    """
    root, shared = np.arange(len(labels)), common_prefix(labels)
    for k in range(labels.shape[1], least - 1, -1):
        starts = np.flatnonzero(shared < k)
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(labels)], strict=True):
            if (root[lo:hi] == root[lo]).all():
                continue
            links = np.argwhere(alike(hashes[lo:hi], hashes[lo:hi], need)) + lo
            links = links[root[links[:, 0]] < root[links[:, 1]]]
            if len(links):
                root = unite(len(root), np.concatenate([links, np.stack([root, np.arange(len(root))], 1)]))
    return root


def grouped(classes: DataFrame, trees: int, depth: int, least: int, need: int, block: int) -> DataFrame:
    """(node, root): links that unite the documents of a trie node that look alike; spanning ones, not all."""
    spark = classes.sparkSession
    near = materialize(neighbours(classes, trees, depth, least).withColumn("prefix", F.substring("label", 1, 2 * least)), "forest")
    sizes = near.groupBy("tree", "prefix").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    at = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    with_hashes = near.join(sizes, ["tree", "prefix"]).join(classes.select("node", "hashes"), "node")
    placed = with_hashes.select("*", at.alias("at"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "tree", "prefix", F.least("at", "other").alias("b1"), F.greatest("at", "other").alias("b2"), (F.col("at") > F.col("other")).cast("int").alias("side"), "node", "label", "hashes")
    keys = ["tree", "prefix", "b1", "b2"]
    schema = arrow_schema(spark, "node long, root long")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, keys):
            if len(run) < 2:
                continue
            hashes = np.frombuffer(b"".join(run.column("hashes").to_pylist()), ">u2").reshape(len(run), -1).astype(np.uint16)
            ids = run.column("node").to_numpy()
            if run.column("b1")[0].as_py() == run.column("b2")[0].as_py():
                labels = np.frombuffer(b"".join(run.column("label").to_pylist()), ">u2").reshape(len(run), -1)
                root = descend(labels, hashes, least, need)
            else:
                side = run.column("side").to_numpy()
                left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                i, j = np.nonzero(alike(hashes[left], hashes[right], need))
                root = unite(len(run), np.stack([left[i], right[j]], 1))
            moved = np.flatnonzero(root != np.arange(len(run)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], schema=schema)

    dealt = placed.repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "label")
    return dealt.mapInArrow(search, "node long, root long")


def jaccard_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, threshold: float) -> np.ndarray:
    """Pairs of places with a similarity of at least ``threshold``: within ``left``, or of ``left`` and ``right``."""
    every = left if right is None else np.concatenate([left, right])
    size = np.array([len(sets[i]) for i in every.tolist()], np.int64)
    values, column = np.unique(np.concatenate([sets[i] for i in every.tolist()]), return_inverse=True)
    row = np.repeat(np.arange(len(every)), size)
    often = np.bincount(column, minlength=len(values))
    keep = often[column] > 1
    row, column = row[keep], np.unique(column[keep], return_inverse=True)[1]
    width = int(column.max()) + 1 if len(column) else 0
    cut = len(left) if right is not None else len(every)
    inner = np.zeros((cut, len(every) - cut if right is not None else len(every)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    step = max(64, 16_000_000 // max(1, len(every)))
    for at in range(0, width, step):  # a dense strip of shingles at a time
        lo, hi = np.searchsorted(column, [at, at + step])
        strip = np.zeros((len(every), min(step, width - at)), np.float32)
        strip[row[lo:hi], column[lo:hi] - at] = 1
        inner += strip[:cut] @ (strip[cut:] if right is not None else strip).T
    other = size[cut:] if right is not None else size
    union = size[:cut, None] + other[None, :] - inner
    i, j = np.nonzero(inner >= threshold * union - 1e-6)
    exact = inner[i, j].astype(np.int64)
    ok = exact / (size[i] + other[j] - exact) >= threshold
    if right is None:
        ok &= i < j
        return np.stack([every[i[ok]], every[j[ok]]], 1)
    return np.stack([left[i[ok]], right[j[ok]]], 1)


_SETS = "group long, b1 int, b2 int, side int, node long, copies long, shingles binary"
_FOUND = "node long, root long, n long"


def _verify(candidates: DataFrame, texts: DataFrame, width: int, threshold: float, block: int) -> DataFrame:
    """(node, root, n) from candidates (node, rep, key, group, copies, blocks): partial sums and a link within the group."""
    spark = candidates.sparkSession
    small = candidates.count() <= BROADCAST_ROWS
    chosen = texts.join(F.broadcast(candidates) if small else candidates, texts.doc_id == candidates.rep).select("node", "text", "group", "copies", "blocks", "key")
    schema, found_schema = arrow_schema(spark, _SETS), arrow_schema(spark, _FOUND)

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for b in batches:
            rows = []
            for node, text, group, copies, blocks, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = shingler(text)
                if not len(s) or xxhash.xxh3_128_digest(s.tobytes()) != key:  # another row with this id
                    continue
                at = zlib.crc32(b"%d" % node) % blocks
                rows += [(group, min(at, x), max(at, x), int(at > x), node, copies, s.tobytes()) for x in range(blocks)]
            for at in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*rows[at : at + 256], strict=True), schema, strict=True)], schema=schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ["group", "b1", "b2"]):
            if len(run) < 2:
                continue
            ids, copies, side = (run.column(k).to_numpy() for k in ("node", "copies", "side"))
            _, first = np.unique(ids, return_index=True)  # repeated rows of one id and set
            sets = [np.frombuffer(x, np.uint64) for x in run.column("shingles").to_pylist()]
            apart = run.column("b1")[0].as_py() != run.column("b2")[0].as_py()
            left = first[side[first] == 0] if apart else first
            right = first[side[first] == 1] if apart else None
            if not len(left) or apart and not len(right):
                continue
            pairs = jaccard_links(sets, left, right, threshold)
            if not len(pairs):
                continue
            order = np.argsort(ids, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            root = ids[order[unite(len(ids), place[pairs])]][place]
            n = np.zeros(len(ids), np.int64)
            np.add.at(n, pairs[:, 0], copies[pairs[:, 1]])
            np.add.at(n, pairs[:, 1], copies[pairs[:, 0]])
            keep = np.flatnonzero(n > 0)
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip((ids[keep], root[keep], n[keep]), found_schema, strict=True)], schema=found_schema)

    keys = ["group", "b1", "b2"]
    grouped = chosen.mapInArrow(shingle, _SETS).repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    return materialize(grouped.mapInArrow(compare, _FOUND), "shingle-links")


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, width: int = 5, trees: int = 20, depth: int = 6, target: float = 0.9995, block: int = 256, seed: int = 5
) -> DataFrame:
    """(doc_id, class_id, n_links, kept) for each row of ``docs`` (doc_id, text).

    class_id: the smallest doc_id reachable by links; n_links: other rows linked directly; kept: it is the smallest.
    """
    spark = docs.sparkSession
    prepare(spark)
    least = least_prefix(threshold, trees, depth, target)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = materialize(_signed(texts, width, trees, depth, seed), "signatures")
    members = keyed.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    # a class is known by its set, as ids can have several texts; the smallest id is for the output
    classes = materialize(
        members.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("hashes").alias("hashes")).withColumn("node", F.xxhash64("key")), "classes")
    groups = connected_components(grouped(classes, trees, depth, least, least_equal(threshold, trees * depth), block), "node", "root").withColumnRenamed("component", "group")
    sizes = groups.groupBy("group").agg(F.count("*").alias("size"))
    candidates = materialize(
        classes.join(groups, "node").join(sizes, "group")
        .select("node", "rep", "key", "group", "copies", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "candidates")
    found = _verify(candidates, texts, width, threshold, block)
    united = connected_components(found, "node", "root")
    tops = classes.join(united, "node").groupBy("component").agg(F.min("rep").alias("top"))
    sums = found.groupBy("node").agg(F.sum("n").alias("n"))
    summary = classes.join(sums, "node", "left").join(united, "node", "left").join(tops, "component", "left").select(
        "key", F.coalesce("top", "rep").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = keyed.select("doc_id", "key").join(summary, "key", "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
