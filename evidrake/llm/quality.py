"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + w.x + 1/2 sum_f ((V_f.x)^2 - (V_f^2.x^2))): all pairwise interactions in time linear in the
features (sum-of-squares identity). Fitted by Adagrad on a bounded sample of labelled documents.

Null text counts as empty and has a score; null metadata is a value of its own; labels, lang, source and doc_id are
not inputs; without labelled rows of both classes every score is the smoothed share of label 1. Rows are scored by
themselves, so repeated rows, ties and null ids come back as they are; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, held_out, map_rows, prepare
from .labelled import SAMPLE, draw

WORD_BUCKETS, META_BUCKETS, BINS = 2048, 32, 10
STATISTICS = 17
WIDTH = WORD_BUCKETS + META_BUCKETS + STATISTICS * BINS
_PUNCT = np.array([chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for i in range(128)] + [False] * 128)
_SYMBOL = np.array([chr(i) in "#$%&*<=>@[\\]^_`{|}~+/" for i in range(128)] + [False] * 128)


def _histogram(data: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256)


class Features:
    """Word buckets, statistics and metadata of texts; remembers word hashes (bounded)."""

    def __init__(self, memo: int = 200_000):
        self.memo, self.limit = {}, memo

    def bucket(self, word: str) -> int:
        b = self.memo.get(word)
        if b is None:
            if len(self.memo) > self.limit:
                self.memo.clear()
            b = self.memo[word] = zlib.crc32(word.encode()) % WORD_BUCKETS
        return b

    def __call__(self, text: str | None, meta: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets, their values, and the statistics."""
        text = text or ""
        words, lines = text.lower().split(), text.split("\n")
        counts, data = Counter(words), text.encode()
        h, n, m = _histogram(data), max(1, len(words)), max(1, len(data))
        letters = max(1, int(h[65:91].sum() + h[97:123].sum() + h[128:].sum()))
        stats = np.array([
            np.log1p(len(text)), np.log1p(len(words)), len(text) / n, h[65:91].sum() / letters, h[48:58].sum() / m,
            h[_PUNCT].sum() / m, h[_SYMBOL].sum() / m, h[ord("|")] / n, h[ord("!")] / n, h[128:].sum() / m,
            len(counts) / n, max(counts.values(), default=0) / n, sum(map(str.__eq__, words, words[1:])) / n, len(counts) / n**0.7,
            np.log1p(len(lines)), len(set(lines)) / len(lines), len(re.findall(r"[.!?](?:\s|$)", text)) / n])
        keys = np.fromiter(map(self.bucket, counts), np.int64, len(counts))
        values = np.log1p(np.fromiter(counts.values(), float, len(counts)))
        idx, inverse = np.unique(keys, return_inverse=True)
        val = np.bincount(inverse, values, len(idx)) if len(idx) else np.zeros(0)
        val /= max(1e-9, np.linalg.norm(val))
        extra = sorted({WORD_BUCKETS + zlib.crc32(x.encode()) % META_BUCKETS for x in meta})
        return np.concatenate([idx, np.array(extra, np.int64)]), np.concatenate([val, np.ones(len(extra))]), stats


@dataclass
class Machine:
    edges: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def inputs(self, idx: np.ndarray, val: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """With one bin of each statistic."""
        bins = (stats[:, None] >= self.edges).sum(axis=1)
        more = WORD_BUCKETS + META_BUCKETS + np.arange(STATISTICS) * BINS + bins
        return np.concatenate([idx, more]), np.concatenate([val, np.full(STATISTICS, 0.5)])

    def score(self, idx: np.ndarray, val: np.ndarray, stats: np.ndarray) -> float:
        i, x = self.inputs(idx, val, stats)
        v = self.v[i] * x[:, None]
        z = self.w0 + self.w[i] @ x + 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, rank: int = 8, epochs: int = 15, batch: int = 128, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Machine:
    rng = np.random.default_rng(seed)
    share = (y.sum() + 1) / (len(y) + 2)
    machine = Machine(np.zeros((STATISTICS, BINS - 1)), float(np.log(share / (1 - share))), np.zeros(WIDTH), np.zeros((WIDTH, rank)))
    if len(y) == 0 or y.min() == y.max():
        return machine
    machine.edges = np.quantile(np.array([s for _, _, s in rows]), np.arange(1, BINS) / BINS, axis=0).T
    machine.v = rng.normal(0, 0.01, (WIDTH, rank))
    x = np.zeros((len(rows), WIDTH), np.float32)
    for k, row in enumerate(rows):
        i, values = machine.inputs(*row)
        x[k, i] = values
    w, v = np.zeros(WIDTH, np.float32), machine.v.astype(np.float32)
    gw, gv, g0, w0 = np.full(WIDTH, 1e-6, np.float32), np.full(v.shape, 1e-6, np.float32), 1e-6, machine.w0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            b = x[order[at : at + batch]]
            s = b @ v
            squares = b**2
            z = w0 + b @ w + 0.5 * ((s**2).sum(axis=1) - squares @ (v**2).sum(axis=1))
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[order[at : at + batch]]).astype(np.float32) / len(b)
            dw = b.T @ e + decay * w
            dv = b.T @ (e[:, None] * s) - v * (squares.T @ e)[:, None] + decay * v
            d0 = float(e.sum())
            gw, gv, g0 = gw + dw**2, gv + dv**2, g0 + d0**2
            w -= rate * dw / np.sqrt(gw)
            v -= rate * dv / np.sqrt(gv)
            w0 -= rate * d0 / g0**0.5
    machine.w0, machine.w, machine.v = float(w0), w.astype(float), v.astype(float)
    return machine


def _meta(c: dict, metadata: list[str], k: int) -> list[str]:
    """Metadata as name=value; numbers by their bit length, so that close ones share a weight."""
    return [f"{m}={int(x).bit_length() if isinstance(x := c[m][k], (int, float)) and x == x else x}" for m in metadata]


def train(documents: DataFrame, labels: DataFrame, target: str = "quality", metadata: tuple[str, ...] = ("n_chars",), sample: int = SAMPLE) -> Machine:
    prepare(documents.sparkSession)
    meta = list(metadata)

    def run(c: dict) -> dict:
        features = Features()
        got = [features(t, _meta(c, meta, k)) for k, t in enumerate(c["text"])]
        return {"doc_id": c["doc_id"], "target": c["target"], "idx": [i.astype("<i4").tobytes() for i, _, _ in got], "val": [v.astype("<f4").tobytes() for _, v, _ in got], "stats": [s.tolist() for _, _, s in got]}

    drawn = draw(documents, labels, target, ["text", *meta], sample)
    rows = map_rows(drawn, run, "doc_id long, target int, idx binary, val binary, stats array<double>").toArrow().to_pylist()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["stats"]))
    return fit([(np.frombuffer(r["idx"], "<i4").astype(np.int64), np.frombuffer(r["val"], "<f4").astype(float), np.array(r["stats"])) for r in rows], np.array([r["target"] for r in rows], float))


def scores(machine: Machine, c: dict, metadata: tuple[str, ...]) -> list[float]:
    """Of the texts and the metadata columns of a batch."""
    features, meta = Features(), list(metadata)
    return [machine.score(*features(t, _meta(c, meta, k))) for k, t in enumerate(c["text"])]


def known_metadata(documents: DataFrame) -> tuple[str, ...]:
    """The metadata columns that ``documents`` has; the number of characters is the one that is used."""
    return tuple(c for c in ("n_chars",) if c in documents.columns)


def score(documents: DataFrame, machine: Machine, threshold: float = 0.3, metadata: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """documents with score and predicted; columns of these names are replaced."""

    def run(c: dict) -> dict:
        got = scores(machine, c, metadata)
        return c | {"score": got, "predicted": [int(x >= threshold) for x in got]}

    return map_rows(documents, run, extended(documents, "score double, predicted int"))


def query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    meta = known_metadata(documents)
    machine = train(documents, labels, metadata=meta)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *meta)
    return score(docs, machine, metadata=meta).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
