"""Source divergence, sharding and tokenizer alignment against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from evidrake.llm import alignment, divergence, sharding
from evidrake.llm.common import shared_dir
from evidrake.llm.queries import BYTE_BPE, PIECE_BPE, op12_sharding

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def audited(rows, least=10, top=10):
    """The audit by plain loops over all terms and pairs."""
    rows = [(t or "", la or "", s or "") for t, la, s in rows]
    out = []
    for lang in {r[1] for r in rows}:
        df, counts = Counter(), defaultdict(Counter)
        for text, la, source in rows:
            if la == lang:
                terms = TERM.findall(lowered(text))
                df.update(set(terms))
                counts[source].update(terms)
        kept = [t for t in df if df[t] >= least]
        v, whole = len(kept), Counter()
        for c in counts.values():
            whole.update(c)
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * v) for t in kept}
        shares, q = {s: p(c) for s, c in counts.items()}, p(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(o, sum(f(shares[s][t], shares[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, f(shares[s][t], q[t])) for t in kept if counts[s][t] and shares[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, n, r) for r, (i, n) in enumerate(ranked if part == "pair" else ranked[:top], 1)]
    return sorted(out)


def test_divergence(spark):
    rng = random.Random(3)
    words = ["Alpha", "beta", "Été", "été", "x", "naïve", "gamma", "東京", "😀", "z'z", "a1b", *[f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 60))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S3", "é", None, ""])) for _ in range(300)]
    rows += [("rare words alone", "fr", "s1"), (None, "fr", "s2"), ("", "xx", "only"), (rows[0][0],) + rows[0][1:]] * 2
    docs = spark.createDataFrame([(t, la, s, "clash", 1.0) for t, la, s in rows], "text string, lang string, source string, term string, p double")
    got = sorted(map(tuple, divergence.audit(docs).collect()))
    assert got == audited(rows) and {r[2] for r in got} == {"pair", "term"}
    assert ("fr", "s1", "pair", "s2", 0, 1) in got
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_of_many_sources(spark):
    """More sources than a matrix has, so that pairs lie in several blocks."""
    rng = random.Random(4)
    rows = [(" ".join(rng.choices("abcdefgh", k=4)), "en", f"s{i % 150}") for i in range(450)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(docs).collect())) == audited(rows)


def test_pieces_of_long_texts(monkeypatch):
    text = "Ab cd-éF gh " * 50 + "x" * 100 + "\x00 END"
    want = lowered(text)
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(divergence, "PIECE", size)
        assert [t.decode() for p in divergence.pieces(text) for t in p.split()] == TERM.findall(want)


def spread(sizes, shards, k):
    sums = [0] * k
    for n, s in zip(sizes, shards, strict=True):
        sums[s] += n
    return max(sums) - min(sums)


def differenced(sizes, k):
    """The spread that differencing reaches, by lists that are sorted anew each time."""
    parts = [sorted([n] + [0] * (k - 1)) for n in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0] - p[-1])
        a, b = parts[0], parts[1]
        parts = [sorted(x + y for x, y in zip(a, reversed(b), strict=True)), *parts[2:]]
    return parts[0][-1] - parts[0][0]


def test_differencing():
    assert sharding.difference([], 3) == [] and sharding.difference([5], 1) == [0]
    assert spread([8, 7, 6, 5, 4], sharding.difference([8, 7, 6, 5, 4], 2), 2) == 2
    rng = random.Random(2)
    for k in (1, 2, 3, 8):
        sizes = rng.sample(range(1, 10**9), 60)
        got = sharding.difference(sizes, k)
        assert spread(sizes, got, k) == differenced(sizes, k) and set(got) <= set(range(k))
    sizes = [rng.randint(1, 5000) for _ in range(3000)]
    assert spread(sizes, sharding.difference(sizes, 8), 8) <= 1
    assert spread([10**6, *sizes[:100]], sharding.difference([10**6, *sizes[:100]], 8), 8) < 10**6


def check_shards(rows, got, shards=8):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    homes = defaultdict(set)
    for r in got:
        homes[r.text_crc32, r.size].add(r.shard)
    assert all(len(h) == 1 for h in homes.values()) and {r.law for r in got} <= {"bytes"} and all(r.grown_shard is None for r in got)
    return [sum(r.size for r in got if r.shard == s) for s in range(shards)]


@pytest.mark.parametrize("items", [sharding.ITEMS, 64])
def test_shards(spark, items):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices("ab é", k=rng.randint(0, 300)))) for i in range(400)] + [(7, "again"), (7, "again"), (None, None), (500, ""), (501, None)] + [(600 + i, "hot text") for i in range(300)]
    rows.append((999, "long " * 4000))
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, Shard int, place string")
    sums = check_shards(rows, sharding.query(docs, 8, items).collect())
    rest = sorted(sums)[:-1]  # one text is larger than an equal share
    assert max(rest) - min(rest) <= (20 if items > 64 else max(rest) // 5)
    folder = shared_dir(spark, "test")
    sharding.write_shards(docs, folder, 3, items)
    assert sharding.read_shards(docs, folder).columns == ["doc_id", "text", "shard", "slot"] or set(sharding.read_shards(docs, folder).columns) == {"doc_id", "text", "shard", "slot"}
    assert sharding.query(docs.limit(0)).count() == 0


def test_shards_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = check_shards([(r.doc_id, r.text) for r in docs.collect()], op12_sharding(spark, "/root/testdata/sf0.01").collect())
    assert max(sums) - min(sums) <= 8


ODD = [
    None, "", "a", "  b", " a\n\n b", "x   y\tz \n q", "é́ á b", "'s it's  !!  \n", "a<|endoftext|> b", "\n", "\n\na", "a \nb\n c  ", "a　b c  d", "123 456\n789  0", "a\x1cb !\x1c! c", "\x00 a \x00b", "a▁b",
    "▁", "don't  it's\n'll", " ", "  ", "😀 😀😀", "x\t y\t\t z", "word " * 3000, "ab" * 4000, "　 　a", "<0x41> <unk> <s>", "line one\nline two\n", "end ", "mixed 東京 naïve ſ ﬁ",
]


def aligned(texts):
    """The rows of texts, by encoding each whole and comparing all tokens of it."""
    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    shown = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    docs, totals = [], Counter()
    for t in texts:
        left, right, whole = [], [], (" " + (t or "")).encode()
        if t:
            left = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids]
            right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)]
            if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
                left, right = [], []
        spans = []
        for side in (left, right):
            at, own = 0, []
            for i, x in side:
                own.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own)
        links, j0 = [], 0
        for i, lo, hi in spans[0]:
            while j0 < len(spans[1]) and spans[1][j0][2] <= lo:
                j0 += 1
            j = j0
            while j < len(spans[1]) and spans[1][j][1] < hi:
                links.append((i, spans[1][j][0]))
                j += 1
        cuts = sorted({h for _, _, h in spans[0]} & {h for _, _, h in spans[1]})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, lo, hi in own if low <= lo and hi <= c) for own in ([x for x in s if low <= x[1] < c] for s in spans)))
            low = c
        totals.update(links)
        docs.append((len(left), len(right), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if left else ""))
    highest = Counter()
    for (_, y), n in totals.items():
        highest[y] = max(highest[y], n)
    return [(n_a, n_b, n_g, len(li), sum(totals[x] == highest[x[1]] for x in li), sum(totals[x] for x in li), h) for n_a, n_b, n_g, li, h in docs], totals


@pytest.mark.parametrize("chunk", [200, alignment.CHUNK])
def test_alignment(spark, monkeypatch, chunk):
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    rng = random.Random(6)
    texts = [*ODD, *["".join(rng.choice(["a", "The", " ", " ", "\n", "\t", "é", "!", "9", "'s", "ing", "ﬁ", "東", "\xa0", "tion"]) for _ in range(rng.randint(0, 40))) for _ in range(120)]]
    want, totals = aligned([t for t in texts for _ in (0,)])
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, unit int, chunk string")
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = {r.doc_id: tuple(r[c] for c in columns) for r in alignment.query(docs, BYTE_BPE, PIECE_BPE).collect()}
    assert [got[i] for i in range(len(texts))] == want and sum(w[3] for w in want) > 10_000
    if chunk > 200:
        pairs = alignment.pair_counts(alignment.alignments(docs, BYTE_BPE, PIECE_BPE)).collect()
        assert {(r.a, r.b): r.n for r in pairs} == totals
        odd = spark.createDataFrame([(None, "null id"), (3, "again"), (3, "again")], "doc_id long, text string")
        assert sorted((r.doc_id or 0, r.n_a) for r in alignment.query(odd, BYTE_BPE, PIECE_BPE).collect())[1:] == [(3, 1)] * 2
        assert alignment.query(docs.limit(0), BYTE_BPE, PIECE_BPE).count() == 0


def test_units_join_to_the_text():
    rng = random.Random(8)
    for _ in range(3000):
        t = "".join(rng.choice(["a", " ", "\n", "\t", "é", "\x00", "\x1c", "\xa0"]) for _ in range(rng.randint(1, 12)))
        assert "".join(alignment.units(t)) == " " + t and alignment.units(t) == [u for u in alignment.CUT.split(" " + t) if u]


