"""Embedding near-duplicates by a forest of random-projection trees.

Every inner node projects onto a random direction and splits at the median; vectors near the split go to both sides
(spill), so that close ones seldom part, and several trees see to the rest. Vectors are compared within leaves by
exact cosine in double precision, links are verified there, and components are united over all of them.

The splits are fitted on ``sample`` vectors at most (documented bound); every vector is indexed, and recall is tested
against brute force. A node is a leaf when its largest label has ``leaf`` vectors or fewer by the sample, or when
its split would send nearly all to both sides (a tight cluster). Vectors are shuffled to the subtrees whose largest
label has ``bundle`` vectors or fewer, and descend to the leaves there, so spill low in the trees copies nothing.
Large leaves are compared in pairs of blocks, all of them: no cap. A pair that meets in several leaves counts in the
first one only. Labels of any type are equal when their texts are; vectors of doubles stay doubles.

Null, zero and non-finite vectors, and those with a null label, link with nothing; vectors of different lengths are
not compared; equal vectors of a label form one class, whose copies all link; rows that repeat a vec_id count as
copies and are returned once each; rows with a null id link with nothing; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, materialize, partitions, prepare, runs
from .components import connected_components


@dataclass
class Tree:
    """Node k has the children 2k+1 and 2k+2; a node without a split is a leaf."""

    seed: int
    splits: dict[int, tuple[float, float]] = field(default_factory=dict)  # node: lower and upper end of the spill band
    bundles: set[int] = field(default_factory=set)  # nodes to which vectors are shuffled: leaves, or nodes above them
    blocks: dict[tuple[str, int], int] = field(default_factory=dict)  # (label, leaf): blocks, where over one
    directions: dict[int, np.ndarray] = field(default_factory=dict)

    def project(self, node: int, x: np.ndarray) -> np.ndarray:
        """Row by row in a fixed order of sums, so that a vector gets the same value in every task."""
        if node not in self.directions:
            v = np.random.default_rng([self.seed, node]).standard_normal(x.shape[1])
            self.directions[node] = v / np.linalg.norm(v)
        return (x * self.directions[node]).sum(axis=1)

    def leaves(self, x: np.ndarray, bundles: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf or bundle, rows of x in it)"""
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node not in self.splits or bundles and node in self.bundles:
                yield node, rows
                continue
            low, high = self.splits[node]
            at = self.project(node, x[rows])
            todo += [(2 * node + 1, rows[at <= high]), (2 * node + 2, rows[at >= low])]


def below(node: int, top: int) -> bool:
    while node > top:
        node = (node - 1) // 2
    return node == top


def unit_length(x: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths; those whose squares leave the range of doubles are scaled first."""
    with np.errstate(over="ignore", under="ignore"):
        n = np.linalg.norm(x, axis=1, keepdims=True)
    odd = np.flatnonzero(~np.isfinite(n[:, 0]) | (n[:, 0] < 1e-150))
    if len(odd):
        x = x.copy()
        x[odd] /= np.abs(x[odd]).max(axis=1, keepdims=True)
        n[odd] = np.linalg.norm(x[odd], axis=1, keepdims=True)
    return x / n


def fit(x: np.ndarray, labels: np.ndarray, scale: float, trees: int, leaf: int, bundle: int, spill: float, block: int, tight: float, seed: int) -> list[Tree]:
    """Trees over the sample ``x``; ``scale``: vectors for each sampled one."""
    out = []
    for t in range(trees):
        tree = Tree(seed + t)
        todo = [(0, np.arange(len(x)), 0)]
        while todo:
            node, rows, depth = todo.pop()
            names, counts = np.unique(labels[rows], return_counts=True)
            if counts.max(initial=0) * scale <= bundle:
                tree.bundles.add(node)
            if counts.max(initial=0) * scale > leaf and len(rows) >= 8 and depth < 40:
                at = tree.project(node, x[rows])
                low, middle, high = np.quantile(at, [0.5 - spill, 0.5, 0.5 + spill])
                low, high = min(low, middle - tight), max(high, middle + tight)
                left, right = rows[at <= high], rows[at >= low]
                if max(len(left), len(right)) <= 0.8 * len(rows):
                    tree.splits[node] = (float(low), float(high))
                    todo += [(2 * node + 1, left, depth + 1), (2 * node + 2, right, depth + 1)]
                    continue
            for name, n in zip(names.tolist(), counts.tolist(), strict=True):
                if n * scale > block:
                    tree.blocks[name, node] = int(np.ceil(n * scale / block))
        out.append(tree)
    return out


def compare(x: np.ndarray, y: np.ndarray | None, threshold: float) -> np.ndarray:
    """Pairs (i, j) with a cosine of at least ``threshold``: i < j within x, or of x and y. Rows have length 1."""
    found, same = [], y is None
    y = x if same else y
    for at in range(0, len(x), 512):
        i, j = np.nonzero(x[at : at + 512] @ y.T >= threshold)
        i += at
        keep = i < j if same else slice(None)
        found.append(np.stack([i[keep], j[keep]], 1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def unite(n: int, pairs: np.ndarray) -> np.ndarray:
    """For each of n the smallest member of its component."""
    root = np.arange(n)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        before = root.copy()
        np.minimum.at(root, pairs[:, 0], low)
        np.minimum.at(root, pairs[:, 1], low)
        root = root[root]
        if (root == before).all():
            break
    return root


_PLACED = "label string, leaf long, b1 int, b2 int, side int, vec_id long, copies long, vector binary"
_FOUND = "vec_id long, root long, n long"
STRIDE = 1 << 42  # codes of nodes: tree * STRIDE + node


def linked(x: np.ndarray, copies: np.ndarray, side: np.ndarray | None, forest: list[Tree], bundle: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a bundle (a code): copies linked in its leaves, and the first row of the same component.

    Leaves are taken in the order of their codes. Those of earlier trees and bundles only mark the pairs that have
    met in them, which are counted there. With ``side`` only pairs of both sides are compared.
    """
    tree, top = divmod(bundle, STRIDE)
    n, joins = np.zeros(len(x), np.int64), [np.zeros((0, 2), np.int64)]
    seen = [(t, node, rows) for t in range(tree + 1) for node, rows in forest[t].leaves(x)]
    met = np.zeros((len(x), len(seen) // 8 + 1), np.uint8)
    for k, (t, node, rows) in enumerate(sorted(seen, key=lambda v: v[:2])):
        if t == tree and below(node, top) and len(rows) > 1:
            if side is None:
                pairs = rows[compare(x[rows], None, threshold)]
            else:
                left, right = rows[side[rows] == 0], rows[side[rows] == 1]
                pairs = compare(x[left], x[right], threshold)
                pairs = np.stack([left[pairs[:, 0]], right[pairs[:, 1]]], 1)
            for p in np.array_split(pairs, len(pairs) // 100_000 + 1):
                new = p[~(met[p[:, 0]] & met[p[:, 1]]).any(axis=1)]
                np.add.at(n, new[:, 0], copies[new[:, 1]])
                np.add.at(n, new[:, 1], copies[new[:, 0]])
            if len(pairs):
                members, at = np.unique(pairs, return_inverse=True)
                joins.append(np.stack([members, members[unite(len(members), at.reshape(-1, 2))]], 1))
        met[rows, k // 8] |= 1 << (k % 8)
    return n, unite(len(x), np.concatenate(joins))


def links(classes: DataFrame, threshold: float, trees: int, leaf: int, bundle: int, spill: float, sample: int, block: int, seed: int) -> DataFrame:
    """(vec_id, root, n): partial sums of linked copies, and a link to a member of the same component."""
    spark = classes.sparkSession
    total = classes.count()
    number = np.dtype(np.float32 if classes.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64)
    drawn = classes.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).select("dim", "label", "embedding").toArrow().to_pydict()
    dims = np.array(drawn["dim"], np.int64)
    forests: dict[int, list[Tree]] = {}
    # half the gap that a pair at the threshold has along a random direction, as a standard deviation
    for dim in np.unique(dims).tolist():
        own = np.flatnonzero(dims == dim)
        x = np.array([drawn["embedding"][i] for i in own.tolist()], float)
        tight = float(np.sqrt(2 - 2 * threshold) / np.sqrt(max(dim, 1)) / 4)
        names = np.array([drawn["label"][i] for i in own.tolist()])
        forests[dim] = fit(unit_length(x), names, total / max(1, len(dims)), trees, leaf, bundle, spill, block, tight, seed)
    placed = arrow_schema(spark, _PLACED)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, flat = b.column("dim").to_numpy(), b.column("embedding").flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            label, ids, copies = (b.column(k).to_pylist() for k in ("label", "vec_id", "copies"))
            rows = []
            for dim in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dim)
                raw = flat[starts[own][:, None] + np.arange(dim)]
                x = unit_length(raw.astype(float))
                for t, tree in enumerate(forests.get(dim) or [Tree(seed)]):
                    for node, members in tree.leaves(x, bundles=True):
                        for k in members.tolist():
                            i = int(own[k])
                            n = tree.blocks.get((label[i], node), 1)
                            at = hash((ids[i], 7)) % n
                            for other in range(n):
                                rows.append((label[i], t * STRIDE + node, min(at, other), max(at, other), int(at > other), ids[i], copies[i], raw[k].tobytes()))
            for at in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*rows[at : at + 4096], strict=True), placed, strict=True)], schema=placed)

    found_schema = arrow_schema(spark, _FOUND)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ["label", "leaf", "b1", "b2", "dim"]):
            if len(run) < 2:
                continue
            x = unit_length(np.frombuffer(b"".join(run.column("vector").to_pylist()), number).reshape(len(run), -1).astype(float))
            ids, copies, side = (run.column(k).to_numpy() for k in ("vec_id", "copies", "side"))
            whole = run.column("b1")[0] == run.column("b2")[0]
            n, root = linked(x, copies, None if whole else side, forests.get(x.shape[1]) or [Tree(seed)], run.column("leaf")[0].as_py(), threshold)
            keep = np.flatnonzero((n > 0) | (root != np.arange(len(run))))
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip((ids[keep], ids[root[keep]], n[keep]), found_schema, strict=True)], schema=found_schema)

    spread = classes.select("vec_id", "copies", "label", "dim", "embedding").repartition(partitions(spark)).mapInArrow(place, _PLACED)
    keys = ["label", "leaf", "b1", "b2", "dim"]
    grouped = spread.withColumn("dim", F.octet_length("vector")).repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    return materialize(grouped.mapInArrow(search, _FOUND), "vector-links")


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, trees: int = 6, leaf: int = 96, bundle: int = 2048, spill: float = 0.08,
    sample: int = 16_384, block: int = 4096, seed: int = 11,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    prepare(spark)
    number = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{number}>").alias("embedding"))
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    valid = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists(e, lambda x: x != 0), F.lit(False))
    keyed = rows.select("vec_id", "label", "embedding", F.when(valid, F.struct("label", F.size(e).alias("dim"), F.xxhash64(e).alias("h1"), F.xxhash64(F.reverse(e), F.lit(1)).alias("h2"))).alias("key"))
    classes = materialize(
        keyed.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.struct("vec_id", "embedding")).alias("m"), F.count("*").alias("copies"))
        .select("key", F.col("m.vec_id").alias("vec_id"), F.col("m.embedding").alias("embedding"), "copies", F.col("key.label").alias("label"), F.col("key.dim").alias("dim")), "vectors")
    found = links(classes, threshold, trees, leaf, bundle, spill, sample, block, seed)
    parts = connected_components(found, "vec_id", "root")
    sums = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    summary = (
        classes.select("key", "vec_id", "copies").join(sums, "vec_id", "left").join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    )
    out = keyed.select("vec_id", "key").join(summary, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
