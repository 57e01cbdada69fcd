"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found with a block-max inverted index.

Every term (a word) of every drawn example is indexed. A term's weight is 1 + ln(its count) times its idf times its
relevance: a floor, and the size of its log-odds between the labels, shrunk towards none for terms of few texts. Near
copies of a text (they share their minimum shingle hash) count once in these statistics, by the label of most of them.
A text's ``k`` nearest examples vote with their cosines; a logistic curve fitted on votes from outside each fold turns
the share of votes into a probability, and the nearest three are its evidence.

Null text counts as empty; labels, lang, source and doc_id are not inputs. Without labelled rows of both classes, and
for texts that share no term with an example, the score is a smoothed share of the label and the evidence is empty.
Rows are scored by themselves, so repeated rows and null ids come back as they are; ties between examples go to the
smaller place in the index; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, held_out, map_rows, prepare
from .labelled import draw

WORD = re.compile(r"\w+")
#: Labelled documents drawn at most (documented bound); all of them are examples.
EXAMPLES = 3072
#: Relevance of a term that tells nothing, and the texts of average label that each term is thought to have besides its own.
FLOOR, SHRINK = 0.02, 10.0


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges one after another, and how many each has."""
    n = end - start
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum())), n


class BlockMaxIndex:
    """Exact top-k cosine over sparse rows of length 1, in blocks of alike examples.

    Terms of few examples have lists of postings. Those of many have a weight for every example and the largest weight
    of every block. A search sums the short lists, bounds each block by its best such sum and its largest weights of the
    frequent terms, and opens only blocks whose bound reaches the k-th best sum: no other block can change the k best.
    """

    def __init__(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, examples: int, vocabulary: int, block: int = 64, often: float = 1 / 16):
        self.n, self.starts = examples, np.arange(0, examples, block)
        self.block_of = np.arange(examples) // block
        df = np.bincount(terms, minlength=vocabulary)
        self.frequent = np.full(vocabulary, -1)
        many = np.flatnonzero(df >= max(block, often * examples))
        self.frequent[many] = np.arange(len(many))
        own = self.frequent[terms] >= 0
        self.full = np.zeros((len(many), examples))
        self.full[self.frequent[terms[own]], rows[own]] = weights[own]
        self.most = np.maximum.reduceat(self.full, self.starts, axis=1) if examples else self.full
        order = np.lexsort((rows[~own], terms[~own]))
        self.docs, self.weights = rows[~own][order], weights[~own][order]
        self.cuts = np.searchsorted(terms[~own][order], np.arange(vocabulary + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k nearest with a cosine over 0, best first; equal ones by place. ``weights`` have length 1."""
        place = self.frequent[terms]
        rare = place < 0
        posting, n = _ranges(self.cuts[terms[rare]], self.cuts[terms[rare] + 1])
        total = np.bincount(self.docs[posting], np.repeat(weights[rare], n) * self.weights[posting], self.n).astype(float)
        least = float(np.partition(total, -k)[-k]) if k < self.n else 0.0
        place, heavy = place[~rare], weights[~rare]
        if len(place):
            bound = np.maximum.reduceat(total, self.starts) + heavy @ self.most[place]
            opened = np.flatnonzero((bound > 0) & (bound >= least - 1e-9))
            if 2 * len(opened) > len(self.starts):
                total += heavy @ self.full[place]
            else:
                inside = np.flatnonzero(np.isin(self.block_of, opened))
                total[inside] += heavy @ self.full[np.ix_(place, inside)]
                shut = np.ones(self.n, bool)
                shut[inside] = False
                total[shut] = 0.0  # only partly summed, and under the k best
        least = float(np.partition(total, -k)[-k]) if k < self.n else 0.0
        near = np.flatnonzero((total > 0) & (total >= least - 1e-12))
        near = near[np.lexsort((near, -np.round(total[near], 12)))][:k]
        return near, total[near]


@dataclass
class Sample:
    """Drawn texts as (row, term, count), with the class of near copies and the label of each row."""

    rows: np.ndarray
    terms: np.ndarray
    counts: np.ndarray
    copies: np.ndarray
    labels: np.ndarray
    vocabulary: int

    def part(self, chosen: np.ndarray) -> Sample:
        new = np.cumsum(chosen) - 1
        own = chosen[self.rows]
        return Sample(new[self.rows[own]], self.terms[own], self.counts[own], self.copies[chosen], self.labels[chosen], self.vocabulary)

    def weights(self) -> np.ndarray:
        """Of each term of the vocabulary: idf times relevance; 0 for those that no row has."""
        _, copy = np.unique(self.copies, return_inverse=True)
        label = np.bincount(copy, self.labels) / np.maximum(1, np.bincount(copy)) >= 0.5
        n, p = len(label), (label.sum() + 0.5) / (len(label) + 1)
        once = np.unique(self.terms.astype(np.int64) * n + copy[self.rows]) if n else np.zeros(0, np.int64)
        df = np.bincount(once // max(1, n), minlength=self.vocabulary)
        with_label = np.bincount(once // max(1, n), label[once % n] if n else None, self.vocabulary)
        share = (with_label + SHRINK * p) / (df + SHRINK)
        odds = np.log(share / (1 - share)) - np.log(p / (1 - p))
        return np.where(df > 0, (np.log((1 + n) / (1 + df)) + 1) * (FLOOR + np.abs(odds)), 0.0)


@dataclass
class Examples:
    """The fitted model: vocabulary, weights, index, labels and ids of the examples, and the curve of the scores."""

    place: dict[str, int]
    weights: np.ndarray
    index: BlockMaxIndex | None
    labels: np.ndarray
    ids: list
    prior: float
    k: int = 16
    slope: float = 1.0
    shift: float = 0.0

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Known terms and their weights, of length 1."""
        words = WORD.findall((text or "").lower())
        found = Counter(map(self.place.get, words))
        found.pop(None, None)
        terms = np.fromiter(found.keys(), np.int64, len(found))
        w = (1 + np.log(np.fromiter(found.values(), float, len(found)))) * self.weights[terms]
        return terms, w / max(1e-300, float(np.sqrt(w @ w)))

    def vote(self, terms: np.ndarray, w: np.ndarray) -> tuple[float | None, np.ndarray, np.ndarray]:
        near, cosine = self.index.search(terms, w, self.k)
        return (float(cosine @ self.labels[near] / cosine.sum()) if len(near) else None), near, cosine

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float, int]]]:
        """Score, and as evidence the three nearest examples (doc_id, cosine, label)."""
        terms, w = self.vector(text) if self.index is not None else (np.zeros(0, np.int64), np.zeros(0))
        if not len(terms):
            return self.prior, []
        share, near, cosine = self.vote(terms, w)
        if share is None:
            return self.prior, []
        score = float(1 / (1 + np.exp(-(self.slope * share + self.shift))))
        return score, [(self.ids[d], float(c), int(self.labels[d])) for d, c in zip(near[:3].tolist(), cosine[:3], strict=True)]


def _indexed(sample: Sample, weights: np.ndarray) -> tuple[BlockMaxIndex, np.ndarray]:
    """The index and the rows in its order: alike ones (by label and heaviest term) share blocks."""
    n = len(sample.labels)
    w = (1 + np.log(sample.counts)) * weights[sample.terms]
    norm = np.sqrt(np.bincount(sample.rows, w * w, n))
    heaviest = np.zeros(n, np.int64)
    by = np.argsort(w, kind="stable")
    heaviest[sample.rows[by]] = sample.terms[by]
    order = np.lexsort((np.arange(n), heaviest, sample.labels))
    new = np.empty(n, np.int64)
    new[order] = np.arange(n)
    return BlockMaxIndex(new[sample.rows], sample.terms, w / np.maximum(1e-300, norm[sample.rows]), n, sample.vocabulary), order


def _curve(votes: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope (0 at least) and shift of a logistic curve by Newton steps, with targets a little inside 0 and 1."""
    y, n = labels.sum(), len(labels)
    target = np.where(labels > 0, (y + 1) / (y + 2), 1 / (n - y + 2))
    x, beta = np.stack([votes, np.ones(n)], 1), np.array([4.0, -2.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (p - target) + 1e-3 * beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), slope)
        beta = np.clip(beta - np.clip(step, -2, 2), -50, 50)
        if np.abs(step).max() < 1e-6:
            break
    return max(0.0, float(beta[0])), float(beta[1])


def fit(sample: Sample, words: list[str], ids: list, k: int = 16, folds: int = 4) -> Examples:
    n, y = len(sample.labels), int(sample.labels.sum())
    prior = (y + 0.5) / (n + 1) if n else 0.5
    if not 0 < y < n:
        return Examples({}, np.zeros(0), None, sample.labels, [], prior)

    def model(part: Sample, names: list) -> Examples:
        weights = part.weights()
        index, order = _indexed(part, weights)
        return Examples({}, weights, index, part.labels[order], [names[i] for i in order.tolist()], prior, k)

    fold = np.array([zlib.crc32(str(c).encode()) % folds for c in sample.copies.tolist()])  # near copies stay together
    votes = np.full(n, prior)
    begin = np.searchsorted(sample.rows, np.arange(n + 1))
    for f in range(folds):
        rest = sample.part(fold != f)
        if not 0 < rest.labels.sum() < len(rest.labels):
            continue
        other = model(rest, [None] * len(rest.labels))
        for r in np.flatnonzero(fold == f).tolist():
            t = sample.terms[begin[r] : begin[r + 1]]
            w = (1 + np.log(sample.counts[begin[r] : begin[r + 1]])) * other.weights[t]
            if w.any():
                got = other.vote(t[w > 0], w[w > 0] / np.linalg.norm(w))[0]
                votes[r] = prior if got is None else got
    out = model(sample, ids)
    out.slope, out.shift = _curve(votes, sample.labels)
    out.place = {w: i for i, w in enumerate(words)}
    return out


def train(documents: DataFrame, labels: DataFrame, target: str = "toxic", sample: int = EXAMPLES) -> Examples:
    """At most ``sample`` sparse examples come to the driver, as Arrow columns."""
    prepare(documents.sparkSession)

    def run(c: dict) -> dict:
        names, counts, copies = [], [], []
        for text in c["text"]:
            row = WORD.findall((text or "").lower())
            found = Counter(row)
            names.append(list(found))
            counts.append(list(found.values()))
            copies.append(min((zlib.crc32(" ".join(row[i : i + 5]).encode()) for i in range(max(1, len(row) - 4))), default=0))
        return {"doc_id": c["doc_id"], "target": c["target"], "terms": names, "counts": counts, "copies": copies}

    schema = "doc_id long, target int, terms array<string>, counts array<int>, copies long"
    got = map_rows(draw(documents, labels, target, ["text"], sample), run, schema).toArrow().combine_chunks().sort_by("doc_id")
    flat = lambda name: pa.concat_arrays([x.flatten() for x in got.column(name).chunks]) if got.num_rows else pa.array([], pa.string() if name == "terms" else pa.int32())
    terms = flat("terms").dictionary_encode()
    lengths = np.array([len(x) for x in got.column("counts").to_pylist()], np.int64)
    found = Sample(
        np.repeat(np.arange(got.num_rows), lengths), terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat("counts").to_numpy(zero_copy_only=False).astype(float),
        got.column("copies").to_numpy(), got.column("target").to_numpy().astype(float), len(terms.dictionary))
    return fit(found, terms.dictionary.to_pylist(), got.column("doc_id").to_pylist())


def score(documents: DataFrame, model: Examples, threshold: float = 0.5) -> DataFrame:
    """documents with score, predicted and evidence; columns of these names are replaced."""
    schema = extended(documents, "score double, predicted int, evidence array<struct<doc_id: bigint, cosine: double, label: int>>")

    def run(c: dict) -> dict:
        got = [model.score(t) for t in c["text"]]
        return c | {
            "score": [s for s, _ in got], "predicted": [int(s >= threshold) for s, _ in got],
            "evidence": [[{"doc_id": i, "cosine": x, "label": y} for i, x, y in e] for _, e in got],
        }

    return map_rows(documents, run, schema)


def query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(documents, labels)
    scored = score(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")
