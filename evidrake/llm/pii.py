"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans in other spellings.

Base spans (email, ip, card, phone) are exact matches of fixed patterns and always stay. The field scores whole
candidate segments (digits, groups, check digit, octets, separators, neighbours), sums over all segmentations of a
window for its probabilities, and a dynamic program over segments of bounded length chooses boundaries and kinds
together. A chosen segment is added if its probability is at least ``sure`` and no base span overlaps it: phone
numbers without a plus sign, addresses written with "at" and "dot", cards parted by dots. It is trained on windows of
a bounded sample of documents, with base spans as labels, and on made-up windows of such spellings and of look-alikes.

Null text counts as empty and has no spans; rows are independent, so repeated rows and null ids come back as they
are; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, map_column, map_rows, prepare

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]
#: Documents whose windows the field is trained on at most (documented bound), and windows of them.
SAMPLE_DOCS, SAMPLE_WINDOWS = 400, 250

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# a match never starts inside a run of digits, as the one before it takes the whole run
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]|\b[Dd][Oo][Tt]\b")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)
# what a candidate has at least: 7 digits, or three dots in a run of numbers (of 24 tokens and 19 digits at most), or a sign of an address
_LEAST = re.compile(r"[0-9](?:[ ().+-]{0,22}+[0-9]){6}|[0-9+(](?:[ ()+0-9-]{0,42}+\.){3}[ ().+-]{0,22}+[0-9]|@|\b[Dd][Oo][Tt]\b")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)  # nothing before this sign can be part of a later match
        at = text.find("@", max(at + 1, done))
    if re.search(r"[0-9]", text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return out


def windows(text: str, reach: int = 48) -> Iterator[tuple[int, int]]:
    """Parts of the text around digits, at signs and "dot", grown by words (two more before: a name and "at"); parts that touch are one."""
    near: list[tuple[int, int]] = []
    for m in _HINT.finditer(text):
        a, b = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if near and a <= near[-1][1]:
            near[-1] = (near[-1][0], b)
        else:
            near.append((a, b))
    start = end = -1
    for a, b in near:
        for _ in range(3):
            least = max(0, a - 1 - 4 * reach)
            a = max(0, a - 1)
            while a > least and not text[a - 1].isspace():
                a -= 1
        most = min(len(text), b + 4 * reach)
        while b < most and not text[b].isspace():
            b += 1
        if a <= end:
            end = b
        else:
            if end >= 0:
                yield start, end
            start, end = a, b
    if end >= 0:
        yield start, end


@dataclass
class Segment:
    first: int  # tokens
    last: int  # exclusive
    features: list[str]


_NUMBER = set("0123456789 ().-+")


def segments(text: str, tokens: list[tuple[int, int]], longest: int = 24) -> list[Segment]:
    """Candidates: beginnings of runs of digits and separators with 7 digits or more, and names around an at sign."""
    words = [text[a:b] for a, b in tokens]
    out = []
    for i, w in enumerate(words):
        if w.isdigit() or w in "+(":
            if i and words[i - 1] != " " and set(words[i - 1]) <= _NUMBER:
                continue  # only where a run of such tokens starts, and after its spaces
            digits = 0
            for j in range(i, min(len(words), i + longest)):
                if not set(words[j]) <= _NUMBER:
                    break
                if words[j].isdigit():
                    digits += len(words[j])
                    if digits > 19:
                        break
                    if digits >= 7 or words[i : j + 1].count(".") >= 3:
                        out.append((i, j + 1))
        elif w == "@" or w.lower() == "at":
            left = i - 1 - (i > 0 and words[i - 1] == " ")
            while left > 0 and words[left - 1] in "._%+-" or left > 0 and words[left - 1].isalnum() and words[left] in "._%+-":
                left -= 1
            right = i + 1 + (i + 1 < len(words) and words[i + 1] == " ")
            parts = 0
            if left < 0 or not words[left].isalnum():
                continue
            while right < len(words) and words[right].isalnum():
                right += 1
                parts += 1
                if parts >= 2:
                    out.append((left, right))
                if right + 1 < len(words) and words[right] in ".-":
                    right += 1
                elif [x.lower() for x in words[right : right + 3]] == [" ", "dot", " "]:
                    right += 3
                else:
                    break
    return [Segment(i, j, _features(text, tokens, words, i, j)) for i, j in out if j - i <= longest]


def _features(text: str, tokens: list[tuple[int, int]], words: list[str], i: int, j: int) -> list[str]:
    body = text[tokens[i][0] : tokens[j - 1][1]]
    digits = re.sub(r"[^0-9]", "", body)
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", lambda m: f"d{len(m[0])}", body))
    octets = re.split(r"\s*\.\s*", body)
    before, after = (words[i - 1] if i else "^"), (words[j] if j < len(words) else "$")
    kind = lambda w: "d" if w.isdigit() else "a" if w.isalpha() else w
    seps = "".join(sorted(set(re.sub(r"[0-9A-Za-z]", "", body))))
    out = ["one", f"n={len(digits)}", f"seps={seps}", f"before={kind(before)}", f"after={kind(after)}", f"first={kind(words[i])}", f"tight={kind(before)}{kind(words[i])}"]
    if len(shape) <= 28 and "a" not in shape:
        out.append(f"shape={shape}")
    if 13 <= len(digits) <= 19:
        out.append(f"luhn={luhn(digits)}")
    if len(octets) == 4 and all(p.isdigit() for p in octets):
        out.append(f"octets={all(len(p) <= 3 and int(p) <= 255 for p in octets)}")
    lower = [w.lower() for w in words[i:j]]
    out += [f"has={w}" for w in ("@", "at", "dot", "+", "(", ".") if w in lower]
    if any(w.isalpha() for w in words[i:j]):
        out.append(f"letters,at={'at' in lower or '@' in lower},dot={'dot' in lower or '.' in lower}")
        out.append(f"last={len(lower[-1])}")
    return out


@dataclass
class Field:
    """Weights of (kind, feature); plain tokens score 0."""

    weights: dict[tuple[str, str], float] = field(default_factory=dict)

    def scores(self, seg: Segment) -> list[float]:
        return [sum(self.weights.get((k, f), 0.0) for f in seg.features) for k in KINDS]

    def _sums(self, n: int, segs: list[Segment], scores: list[list[float]]) -> tuple[list[float], list[float]]:
        """Log sums over all segmentations up to and from each token."""
        into, out_of = defaultdict(list), defaultdict(list)
        for s, x in zip(segs, scores, strict=True):
            top = max(x)
            total = top + math.log(sum(math.exp(v - top) for v in x))
            into[s.last].append((s.first, total))
            out_of[s.first].append((s.last, total))
        ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
        for k in range(1, n + 1):
            ahead[k] = _log_sum([ahead[k - 1], *[ahead[i] + x for i, x in into[k]]])
        for k in range(n - 1, -1, -1):
            behind[k] = _log_sum([behind[k + 1], *[behind[j] + x for j, x in out_of[k]]])
        return ahead, behind

    def chances(self, n: int, segs: list[Segment]) -> list[list[float]]:
        scores = [self.scores(s) for s in segs]
        ahead, behind = self._sums(n, segs, scores)
        return [[math.exp(min(0.0, ahead[s.first] + x + behind[s.last] - ahead[n])) for x in row] for s, row in zip(segs, scores, strict=True)]

    def best(self, n: int, segs: list[Segment]) -> list[tuple[int, int]]:
        """The best segmentation: places in ``segs`` and in KINDS."""
        into = defaultdict(list)
        for p, s in enumerate(segs):
            row = self.scores(s)
            k = int(np.argmax(row))
            into[s.last].append((s.first, row[k], p, k))
        value, back = [0.0] * (n + 1), [None] * (n + 1)
        for t in range(1, n + 1):
            value[t] = value[t - 1]
            for first, x, p, k in into[t]:
                if value[first] + x > value[t]:
                    value[t], back[t] = value[first] + x, (first, p, k)
        found, t = [], n
        while t > 0:
            if back[t]:
                first, p, k = back[t]
                found.append((p, k))
                t = first
            else:
                t -= 1
        return found[::-1]

    def fit(self, examples: list[tuple[int, list[Segment], dict[int, str]]], epochs: int = 6, rate: float = 0.5, seed: int = 1) -> None:
        """Adagrad on the log-likelihood; an example: tokens, segments, and the kinds of the true ones by place."""
        squares: dict[tuple[str, str], float] = defaultdict(lambda: 1e-3)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for e in rng.permutation(len(examples)).tolist():
                n, segs, truth = examples[e]
                step: dict[tuple[str, str], float] = defaultdict(float)
                for p, (s, row) in enumerate(zip(segs, self.chances(n, segs), strict=True)):
                    for k, chance in zip(KINDS, row, strict=True):
                        d = (truth.get(p) == k) - chance
                        if abs(d) > 1e-4:
                            for f in s.features:
                                step[k, f] += d
                for key, d in step.items():
                    squares[key] += d * d
                    self.weights[key] = self.weights.get(key, 0.0) + rate * d / math.sqrt(squares[key])


def _log_sum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x))


def example(text: str, spans: list[Span]) -> tuple[int, list[Segment], dict[int, str]]:
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    segs = segments(text, tokens)
    place = {(tokens[s.first][0], tokens[s.last - 1][1]): p for p, s in enumerate(segs)}
    return len(tokens), segs, {place[a, b]: k for k, a, b in spans if (a, b) in place}


def made_up(n: int, seed: int = 2) -> list[tuple[str, list[Span]]]:
    """Windows of spellings that the base patterns miss, of those that they match, and of look-alikes (no span)."""
    rng = np.random.default_rng(seed)
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvw"), int(rng.integers(3, 9))))

    def card() -> str:
        body = d(15)
        return next(body + str(k) for k in range(10) if luhn(body + str(k)))

    def group(x: str, sep: str) -> str:
        return sep.join(x[i : i + 4] for i in range(0, len(x), 4))

    def bad(x: str) -> str:
        return x[:-1] + str((int(x[-1]) + int(rng.integers(1, 9))) % 10)

    octet = lambda: str(rng.integers(0, 256))
    host = lambda: f"{word()}.{rng.choice(['com', 'org', 'net', 'de', 'fr'])}"
    forms = [
        ("phone", lambda: f"({d(3)}) {d(3)}-{d(4)}"), ("phone", lambda: f"{d(3)}-{d(3)}-{d(4)}"), ("phone", lambda: f"+{rng.integers(1, 99)} ({d(3)}) {d(3)}-{d(4)}"),
        ("phone", lambda: f"+{d(2)} {d(3)} {d(6)}"), ("card", card), ("card", lambda: group(card(), " ")), ("card", lambda: group(card(), "-")), ("card", lambda: group(card(), ".")),
        ("email", lambda: f"{word()}.{word()}@{host()}"), ("email", lambda: f"{word()} at {host().replace('.', ' dot ')}"), ("email", lambda: f"{word()}.{d(2)} at {word()} dot {host().replace('.', ' dot ')}"),
        ("ip", lambda: ".".join(octet() for _ in range(4))), ("ip", lambda: " . ".join(octet() for _ in range(4))),
        (None, lambda: f"{d(4)}-{d(2)}-{d(2)}"), (None, lambda: f"{d(1)}.{d(2)}.{d(3)}.{rng.integers(300, 999)}"), (None, lambda: bad(card())), (None, lambda: group(bad(card()), " ")),
        (None, lambda: group(bad(card()), "-")), (None, lambda: d(int(rng.integers(7, 20)))), (None, lambda: f"{word()} at {word()} {word()}"), (None, lambda: f"{d(3)}.{d(3)}.{d(2)}"),
        (None, lambda: f"{d(2)} {d(3)} {d(3)}"), (None, lambda: f"{word()} at {word()}. {word()}"), (None, lambda: f"{d(4)} {d(4)}"), (None, lambda: f"{d(4)}-{d(4)} {d(4)}-{d(4)}"),
        (None, lambda: f"{word()} dot {word()}"), (None, lambda: f"{d(2)}.{d(2)}.{d(4)} {d(2)}:{d(2)}"), (None, lambda: " ".join(d(int(rng.integers(1, 5))) for _ in range(5))), (None, lambda: f"v{d(1)}.{d(1)}.{d(2)}.{d(5)}"),
    ]
    out = []
    for k in range(n):
        kind, make = forms[k % len(forms)]
        body = make()
        if kind is None and re.sub(r"[ -]", "", body).isdigit() and 13 <= len(re.sub(r"[ -]", "", body)) <= 19 and luhn(re.sub(r"[ -]", "", body)):
            body = "7"
        left, right = f"{word()} {word()} ", rng.choice([f" {word()}", f", {word()}", ".", f". {word()}"])
        out.append((left + body + right, [(kind, len(left), len(left) + len(body))] if kind else []))
    for _ in range(n // 8):  # neighbours that the base patterns take for one run and drop
        left, number, other = f"{word()} ", f"+{rng.integers(1, 99)} ({d(3)}) {d(3)}-{d(4)}", card()
        first, second = (("phone", number), ("card", other)) if rng.random() < 0.7 else (("card", other), ("card", card()))
        at = len(left) + len(first[1]) + 1
        out.append((f"{left}{first[1]} {second[1]} {word()}", [(first[0], len(left), at - 1), (second[0], at, at + len(second[1]))]))
    return out


def train(documents: DataFrame, made: int = 400) -> Field:
    """Trained on at most SAMPLE_WINDOWS windows of SAMPLE_DOCS documents (drawn by a hash of the id) and on ``made`` made-up ones."""
    prepare(documents.sparkSession)
    drawn = documents.where(F.col("text").rlike("[0-9@]")).orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(9)), "doc_id").select(F.xxhash64(F.col("doc_id").cast("string"), F.lit(9)).alias("h"), "doc_id").limit(SAMPLE_DOCS)
    ids = documents.join(F.broadcast(drawn.select("doc_id").distinct()), "doc_id", "left_semi")  # at most SAMPLE_DOCS ids

    def cut(c: dict) -> dict:
        parts = []
        for text in c["text"]:
            text = text or ""
            parts.append(sorted({text[a:b] for a, b in windows(text) if _LEAST.search(text, a, b) and b - a <= 400})[:8])
        return {"parts": parts}

    one = ids.groupBy("doc_id").agg(F.min("text").alias("text"))  # of rows that share an id one
    found = map_rows(one.select("text"), cut, "parts array<string>").toArrow().column("parts").to_pylist()
    texts = sorted({x for row in found for x in row}, key=lambda x: hashlib.md5(x.encode()).digest())[:SAMPLE_WINDOWS]
    examples = [example(t, b) for t in texts if (b := base_spans(t))] + [example(t, s) for t, s in made_up(made)]
    model = Field()
    model.fit([x for x in examples if x[1]])
    return model


def disjoint(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def meets(starts: list[int], ends: list[int], a: int, b: int) -> bool:
    """Whether one of the disjoint spans overlaps a to b: the last that starts before b ends last as well."""
    i = bisect_left(starts, b) - 1
    return i >= 0 and ends[i] > a


def find(text: str | None, model: Field | None, sure: float = 0.9) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans by kind and start."""
    text = text or ""
    if not _HINT.search(text):
        return [], []
    base = base_spans(text)
    added: list[Span] = []
    starts, ends = disjoint(base)
    for a, b in windows(text) if model else ():
        if not _LEAST.search(text, a, b):
            continue
        part = text[a:b]
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(part)]
        segs = [s for s in segments(part, tokens) if not meets(starts, ends, a + tokens[s.first][0], a + tokens[s.last - 1][1])]
        if segs:
            chances = model.chances(len(tokens), segs)
            added += [(KINDS[k], a + tokens[segs[p].first][0], a + tokens[segs[p].last - 1][1]) for p, k in model.best(len(tokens), segs) if chances[p][k] >= sure]
    return base, sorted({*base, *added}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def line(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Each span (overlapping ones as one) replaced by its kind in angle brackets."""
    out, at, merged = [], 0, []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1] = (merged[-1][0], merged[-1][1], max(b, merged[-1][2]))
        else:
            merged.append((kind, a, b))
    for kind, a, b in merged:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def redacted(documents: DataFrame, model: Field | None) -> DataFrame:
    """documents with the spans in text replaced, until none is found; a null text stays null."""

    def clean(texts: list[str | None]) -> list[str | None]:
        out = []
        for t in texts:
            while t and (spans := find(t, model)[1]):  # a span may show once its neighbour is gone
                t = redact(t, spans)
            out.append(t)
        return out

    return map_column(documents, "text", clean)


def annotate(documents: DataFrame, model: Field | None, spans: str = "pii") -> DataFrame:
    """documents with an array of (kind, start, end, base); a column of that name is replaced."""

    def run(c: dict) -> dict:
        rows = []
        for t in c["text"]:
            base, every = find(t, model)
            base = set(base)
            rows.append([{"kind": k, "start": a, "end": b, "base": (k, a, b) in base} for k, a, b in every])
        return c | {spans: rows}

    return map_rows(documents, run, extended(documents, f"{spans} array<struct<kind: string, start: int, end: int, base: boolean>>"))


def query(documents: DataFrame) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs)

    def run(c: dict) -> dict:
        out: dict[str, list] = {"doc_id": c["doc_id"], **{f"n_{k}": [] for k in KINDS}, "base_sha256": [], "spans": []}
        for t in c["text"]:
            base, every = find(t, model)
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(line(base).encode()).hexdigest())
            out["spans"].append(line(every))
        return out

    return map_rows(docs, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
