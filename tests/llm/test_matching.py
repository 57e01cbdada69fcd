"""Near-duplicates, fingerprints: brute force on small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from evidrake.llm import embedding_dedup, merkle, shingle_join
from evidrake.llm.components import connected_components


def groups(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(100, 130)] + [(int(a), int(b)) for a, b in rng.integers(200, 260, (40, 2))] + [(0, i) for i in range(1, 60)] + [(5, 5), (None, 3)]
    got = connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b")
    known = {x for l in links if None not in l and l[0] != l[1] for x in l}
    assert {r.node: r.component for r in got.collect()} == groups(known, [l for l in links if None not in l])
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_shingle_join(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(int(rng.integers(30, 90)))]
        for _ in range(8):
            copy = list(base)
            for k in rng.integers(0, len(copy), int(rng.integers(0, 3))):
                copy[k] = word()
            texts.append(" ".join(copy))
    texts += [None, "", "short text", "Short  text", "a b c d e", "word " * 30_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in shingle_join.near_duplicates(spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, key string"), block=5).collect()}
    sets = {i: shingles(t) for i, t in rows}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    count, group = Counter(x for l in links for x in l), groups(sets, links)
    assert {i: (r.class_id, r.n_links, r.kept) for i, r in got.items()} == {i: (group[i], count[i], group[i] == i) for i in sets}


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.7, 0.9])
def test_recall_at_other_thresholds(spark, threshold):
    """Planted pairs a little above the threshold, each of other words: all are found."""
    rng = random.Random(int(threshold * 10))
    rows, planted = [], 0
    for i in range(150):
        words = [f"w{i}x{k}" for k in range(rng.randint(60, 200))]
        rows.append((2 * i, " ".join(words)))
        want = rng.uniform(threshold, min(0.99, threshold + 0.08))
        keep = round(len(words) * 2 * want / (1 + want))
        rows.append((2 * i + 1, " ".join([*words[:keep], *[f"v{i}x{k}" for k in range(len(words) - keep)]])))
    sets = {i: shingles(t) for i, t in rows}
    links = {(2 * i, 2 * i + 1) for i in range(150) if len(sets[2 * i] & sets[2 * i + 1]) / len(sets[2 * i] | sets[2 * i + 1]) >= threshold}
    got = shingle_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold=threshold).where("n_links = 1").collect()
    assert len(links) > 100 and {r.doc_id for r in got} == {x for link in links for x in link}


def test_descent_unites_what_looks_alike():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**16, (6, 120)).astype(np.uint16)
    hashes = np.repeat(base, 5, axis=0)
    for row in hashes:  # near ones differ in up to a tenth of their hashes, none in the first five
        row[rng.integers(5, 120, int(rng.integers(0, 12)))] += 1
    hashes[:, :5] = base[0, :5]  # one node of the trie holds all six families
    order = np.lexsort(hashes[:, 5::-1].T)
    root = shingle_join.descend(hashes[order][:, :6], hashes[order], 5, shingle_join.least_equal(0.8, 120))
    family = (np.arange(30) // 5)[order]
    assert all((root[i] == root[j]) == (family[i] == family[j]) for i in range(30) for j in range(30))
    assert shingle_join.common_prefix(np.array([[1, 2, 3], [1, 2, 4], [1, 5, 4], [1, 5, 4]])).tolist() == [0, 2, 1, 3]


def test_sorted_neighbours_share_prefixes(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(0, 3, 12).astype(">u2").tobytes()) for i in range(400)]
    classes = spark.createDataFrame(rows, "node long, hashes binary")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = Counter((r.tree, r.node) for r in shingle_join.neighbours(classes, 3, 4, 3).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = Counter()
    for t in range(3):
        seen = defaultdict(list)
        for i, h in rows:
            seen[h[8 * t : 8 * t + 6]].append(i)
        want.update((t, i) for v in seen.values() if len(v) > 1 for i in v)
    assert got == want


def test_shingle_join_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in shingle_join.near_duplicates(docs).collect()}
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    holders, links = defaultdict(list), set()
    for i, s in sorted(sets.items()):
        met = Counter(j for x in s for j in holders[x])
        links |= {(j, i) for j, n in met.items() if n / (len(s) + len(sets[j]) - n) >= 0.8}
        for x in s:
            holders[x].append(i)
    count, group = Counter(x for l in links for x in l), groups(sets, links)
    assert len(links) > 50 and sum(r.n_links for r in got.values()) >= 0.99 * 2 * len(links)
    assert all(r.n_links <= count[i] for i, r in got.items())
    assert np.mean([r.class_id == group[i] for i, r in got.items()]) >= 0.99


def test_shingle_join_edges(spark):
    rows = [(None, "a b c d e f"), (3, "A b c d e f"), (4, "a b  c d e f"), (4, "a b c d e f"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, shingle_join.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(None, None, 0, True), (3, 3, 2, True), (4, 3, 2, False), (4, 3, 2, False), (1, 1, 0, True)], key=repr)
    assert shingle_join.near_duplicates(docs.limit(0)).count() == 0
    assert shingle_join.least_prefix(0.8, 20, 6, 0.9995) == 5 and shingle_join.least_prefix(0.8, 1, 6, 0.9999) == 1


def test_one_id_with_two_texts(spark):
    rng = np.random.default_rng(8)
    long = lambda: [f"w{x}" for x in rng.integers(0, 10**6, 60)]
    a, b = long(), long()
    near = lambda t, k: " ".join([*t[:-k], *(f"z{i}" for i in range(k))])
    rows = [(7, " ".join(a)), (7, " ".join(b)), (9, near(a, 1)), (8, near(b, 1)), (3, near(b, 2)), (7, " ".join(b))]
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(6) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    count, group = Counter(x for l in links for x in l), groups(range(6), links)
    least = {g: min(rows[i][0] for i in range(6) if group[i] == g) for g in group.values()}
    want = sorted((rows[i][0], least[group[i]], count[i], rows[i][0] == least[group[i]]) for i in range(6))
    assert sorted(map(tuple, shingle_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == want


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([centres + rng.normal(scale=s, size=centres.shape) for s in (0, 0.05, 0.1, 0.2, 0.3)] + [centres[:1] + rng.normal(scale=0.05, size=(120, 16))]).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 3 > 0)) for i, v in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, x[0].tolist(), None), (904, [None] * 16, 1), (905, [], 1), (906, x[0].tolist()[:8], 0)]
    schema = "vec_id long, embedding array<float>, label int, copies int"
    table = spark.createDataFrame([(*r, 1) for r in rows + odd], schema)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = [(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.93]
    for options in ({}, {"leaf": 30, "bundle": 60, "block": 16, "trees": 10}, {"leaf": 12, "trees": 10}):
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table, **options).collect()}
        assert all(got[i].n_links == 0 and got[i].kept for i, _, _ in odd)
        found = sum(got[i].n_links for i, _, _ in rows) / 2
        assert 0.97 * len(links) <= found <= len(links)
        if not options:
            count, group = Counter(v for l in links for v in l), groups(range(len(x)), links)
            assert all((got[i].n_links, got[i].component_id) == (count[i], group[i]) for i, _, _ in rows)
    same = spark.createDataFrame([(5, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, embedding_dedup.near_duplicates(same).collect()), key=repr) == sorted([(5, 2, 2, False), (2, 2, 2, True), (2, 2, 2, True), (None, 0, None, True)], key=repr)
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_embeddings_with_splits(spark):
    """Vectors near the threshold, in several subtrees and many leaves, by the defaults."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(3000, 32))
    x = np.concatenate([base, base + rng.normal(scale=0.35, size=base.shape)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist(), "en") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    pairs = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.93, 1)), strict=True)}
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table).collect()}
    count = Counter(v for p in pairs for v in p)
    assert len(pairs) > 1000 and sum(r.n_links for r in got.values()) >= 0.98 * 2 * len(pairs)
    assert all(r.n_links <= count[i] for i, r in got.items())
    huge = spark.createDataFrame([(1, [1e200, 1e200], "a"), (2, [1e-200, 1e-200], "a"), (3, [1.0, -1.0], "a")], "vec_id long, embedding array<double>, label string")
    assert sorted(map(tuple, embedding_dedup.near_duplicates(huge).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_merkle(spark):
    rng = np.random.default_rng(2)
    words = ["alpha", "beta.", "gamma!", "delta", "\n", "\n\n", "é", "😀"]
    rows = [(int(i), " ".join(rng.choice(words, int(rng.integers(0, 60))))) for i in rng.permutation(40) * 2] + [(None, "first"), (7, None), (8, "tie"), (8, "tie b"), (99, "x " * 40_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, tree int")
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in merkle.query(docs).collect()), key=repr)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        q = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - q] + order[(k + 1) % len(order)][1][:q]).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert merkle.query(docs.limit(0)).count() == 0
    texts, prints = [t for _, t in order], {}
    for r in merkle.query(docs).collect():
        places = [k for k, (i, t) in enumerate(order) if i == r.doc_id and len(t) == r.n_chars and merkle_print(t) == r.fingerprint]
        assert places, r
        near = {likeness_of(merkle_print(texts[k]), merkle_print(texts[(k + 1) % len(texts)])) for k in places}
        edited = {texts[k][: len(texts[k]) - len(texts[k]) // 4] + texts[(k + 1) % len(texts)][: len(texts[k]) // 4] for k in places}
        assert r.near_next in near and r.edited_fingerprint in {merkle_print(e) for e in edited}
        assert r.near_edited == likeness_of(r.fingerprint, r.edited_fingerprint)
        prints.setdefault(r.fingerprint, set()).update(texts[k] for k in places)
    assert all(len(t) == 1 for t in prints.values()) and len(prints) == len(set(texts))


def merkle_print(text):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    roots, shown = [], []
    for section in text.split("\n\n"):
        paragraphs = [[sha(x) for x in re.findall(r"[^.!?]{1,24}[.!?]*|[.!?]+", p)] for p in section.split("\n")]
        digests = [sha("".join(p)) for p in paragraphs]
        roots.append(sha("".join(digests)))
        shown.append(roots[-1][:12] + "/" + ",".join(d[:12] + "." + "".join(x[:6] for x in p) for d, p in zip(digests, paragraphs, strict=True)))
    return sha("".join(roots)) + ":" + ";".join(shown)


def likeness_of(a, b):
    a, b = ([x[i : i + 6] for p in s.split(":")[1].replace(";", ",").split(",") for x in [p.split(".")[1]] for i in range(0, len(x), 6)] for s in (a, b))
    if not a and not b:
        return 1.0
    common = len(set(a) & set(b)) / max(len(set(a)), len(set(b)), 1)
    return max(common, sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b), 1))


def test_merkle_branches(spark):
    from pyspark.sql import functions as F

    cases = [
        ("one.\ntwo.\nthree.", "one.\n2.\nthree.", [("removed", 0, 1), ("inserted", 0, 1)]),
        ("one.\ntwo.", "one.\nnew.\ntwo.", [("inserted", 0, 1)]),
        ("one.\ntwo.", "two.\none.", [("moved", 0, 0), ("moved", 0, 1)]),
        ("one.\none.", "one.", [("removed", 0, 1)]),
        ("a\n\nb\n\nc", "c\n\nb\n\na", [("moved", 0, None), ("moved", 2, None)]),
        ("a\n\nb\nc", "a\n\nb\n\nc", [("regrouped", 2, 0)]),
        ("same\n\ntext", "same\n\ntext", []),
        ("", "", []),
        ("", "x", [("removed", 0, 0), ("inserted", 0, 0)]),
        (None, "x", None),
    ]
    rng = np.random.default_rng(4)
    for _ in range(60):  # unequal texts always differ somewhere, equal ones nowhere
        a, b = ("".join(rng.choice(["x", "y", "\n", "\n\n", "."], int(rng.integers(0, 8)))) for _ in range(2))
        cases.append((a, b, [] if a == b else ...))
    pair = spark.createDataFrame([(k, a, b, 1) for k, (a, b, _) in enumerate(cases)], "k int, a string, b string, edits int").drop("edits")
    prints = pair.select("k", *[F.when(F.col(c).isNotNull(), merkle.fingerprint(merkle.tree(F.col(c)))).alias(c) for c in "ab"])
    for r in merkle.differing_branches(prints, "a", "b").collect():
        want = cases[r.k][2]
        got = None if r.edits is None else [tuple(e) for e in r.edits]
        assert got and want is ... or got == want, (cases[r.k], got)


def test_merkle_ranges(spark):
    docs = spark.createDataFrame([(i * 3, "x" * (i % 7)) for i in range(500)], "doc_id long, text string")
    dealt = merkle.with_next(docs, 4, range_bytes=100)
    rows = dealt.selectExpr("spark_partition_id() p", "bucket", "ghost", "doc_id").collect()
    assert all(r.p == r.bucket for r in rows) and len({r.p for r in rows}) >= 12
    assert sorted(r.doc_id for r in rows if not r.ghost) == [i * 3 for i in range(500)]
