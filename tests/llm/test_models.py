"""Classifiers, personal data and the pipeline."""

import hashlib
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from evidrake.llm import pii, quality, toxicity
from evidrake.llm.queries import QUERIES, WORD_BPE

FOLDER = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.mark.parametrize(("module", "target", "rare"), [(quality, "quality", 0), (toxicity, "toxic", 1)])
def test_held_out_recall_and_precision(spark, module, target, rare):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = module.query(docs, labels).join(labels.dropDuplicates(["doc_id"]), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    hit = sum(r.predicted == rare == r[target] for r in got)
    assert hit >= 0.9 * sum(r[target] == rare for r in got) and hit >= 0.9 * sum(r.predicted == rare for r in got)
    if module is toxicity:  # a calibrated score, and evidence for every text that shares a term with an example
        assert abs(np.mean([r.score for r in got]) - np.mean([r.toxic for r in got])) < 0.02
        scored = {r.doc_id: r for r in got}
        texts = {r.doc_id: r.text for r in docs.where(docs.doc_id.isin(list(scored))).collect()}
        assert all(len(scored[i].evidence) == 3 for i, t in texts.items() if t and len(t.split()) > 5)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, module):
    rows = [(1, None, None, "x"), (2, "", 0, "x"), (None, "a word", 6, "x"), (3, "a word", 6, "x"), (3, "a word", 6, "x"), (4, "word " * 50_000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, Score string")
    none = spark.createDataFrame([(1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = module.query(docs, none).collect()
    assert len(got) == 6 and len({r.score for r in got}) == 1
    assert module.query(docs.limit(0), none.limit(0)).count() == 0
    assert module.query(docs.drop("n_chars"), none).count() == 6
    model = module.train(docs, none)
    assert "Score" not in module.score(docs, model).columns and module.score(docs, model).count() == 6


def test_repeated_labelled_rows_and_many_terms(spark):
    words = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(100)]
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.permutation(words if i % 2 else [f"{w}q" for w in words]))) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    twice = spark.createDataFrame([*rows, *rows[:60]], "doc_id long, text string")
    model = toxicity.train(twice, labels)
    drawn = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    assert len(model.place) == 200 and sorted(model.ids) == sorted(drawn)  # one row of each id
    assert len(toxicity.train(twice, labels, sample=10).ids) == 10
    got = toxicity.query(twice, labels).collect()
    assert len(got) == 180 and all(r.predicted == r.doc_id % 2 for r in got)


def test_interactions_in_linear_time():
    rng = np.random.default_rng(0)
    m = quality.Machine(np.zeros((quality.STATISTICS, quality.BINS - 1)), 0.3, rng.normal(size=quality.WIDTH), rng.normal(size=(quality.WIDTH, 4)))
    idx, val, stats = np.array([1, 5, 9]), np.array([0.1, 0.2, 0.3]), np.zeros(quality.STATISTICS)
    i, x = m.inputs(idx, val, stats)
    z = m.w0 + m.w[i] @ x + sum(x[a] * x[b] * (m.v[i[a]] @ m.v[i[b]]) for a in range(len(i)) for b in range(a + 1, len(i)))
    assert abs(m.score(idx, val, stats) - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


@pytest.mark.parametrize(("n", "per", "k"), [(500, 5, 7), (70, 3, 16), (5, 4, 16), (900, 12, 3)])
def test_block_max_search_is_exact(n, per, k):
    rng = np.random.default_rng(n)
    dense = np.zeros((n, 60))
    for row in dense:  # some terms in most rows, others rare
        row[np.unique((60 * rng.random(per) ** 3).astype(int))] = rng.random() + 0.1
    dense = dense[np.lexsort(dense.T[:5])]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    rows, terms = np.nonzero(dense)
    index = toxicity.BlockMaxIndex(rows, terms, dense[rows, terms], n, 60, block=16)
    for _ in range(60):
        q = np.unique(rng.integers(0, 60, 6))
        w = rng.random(len(q)) + 0.05
        w /= np.linalg.norm(w)
        near, cosine = index.search(q, w, k)
        want = dense[:, q] @ w
        order = np.lexsort((np.arange(n), -np.round(want, 12)))[:k]
        order = order[want[order] > 0]
        assert near.tolist() == order.tolist() and np.allclose(cosine, want[order])


E_, I_ = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
C_, P_ = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m.start(), m.end()) for m in E_.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in I_.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in C_.finditer(t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", m.start(), m.end()) for m in P_.finditer(t) if 9 <= len(digits(m)) <= 15]


def test_base_spans():
    rng = np.random.default_rng(3)
    for _ in range(20_000):
        t = "".join(rng.choice(list("a.@1-+ 2b.@()0é"), int(rng.integers(1, 40))))
        assert pii.base_spans(t) == plain(t)


def test_personal_data(spark):
    docs, _ = tables(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.query(docs).collect():
        base = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.line(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in ("email", "ip", "card", "phone")]
        assert set(pii.line(base).split(",")) - {""} <= set(r.spans.split(","))


def test_added_spans_and_redaction(spark):
    model = pii.Field()
    model.fit([x for x in (pii.example(t, s) for t, s in pii.made_up(400)) if x[1]])
    for text, want in [
        ("call (415) 555-2671 now", [("phone", 5, 19)]), ("jane at corp dot org", [("email", 0, 20)]), ("card 4242.4242.4242.4242 ok", [("card", 5, 24)]),
        ("on 2024-05-12 at noon", []), ("id 1234567890123456 x", []), ("v 1.2.3.4567", []), (None, []), ("", []),
    ]:
        assert pii.find(text, model) == ([], want)
    held = [x for x in (pii.example(t, s) for t, s in pii.made_up(290, seed=77)) if x[1]]
    right = sum({p: pii.KINDS[k] for p, k in model.best(n, segs)} == truth for n, segs, truth in held)
    assert right / len(held) >= 0.9
    long = ["9" * 50_000, "a@" * 20_000, "1." * 20_000, "+1 " * 10_000]
    rows = [(1, "a b@c.de f 10.0.0.1", "x"), (2, None, "y"), (None, "", "z"), *[(3, t, "") for t in long]]
    got = pii.redacted(spark.createDataFrame(rows, "doc_id long, text string, spans string"), model).collect()
    assert [r.text for r in got][:3] == ["a <EMAIL> f <IP>", None, ""] and len(got) == 7
    assert pii.annotate(spark.createDataFrame(rows, "doc_id long, text string, PII string"), model).count() == 7
    assert pii.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.fixture(scope="module")
def spelled():
    """The field as trained on made-up windows only."""
    model = pii.Field()
    model.fit([x for x in (pii.example(t, s) for t, s in pii.made_up(400)) if x[1]])
    return model


def test_long_lists_of_numbers(spelled):
    rng = np.random.default_rng(5)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))

    def card():
        body = digits(15)
        x = next(body + str(k) for k in range(10) if pii.luhn(body + str(k)))
        return " ".join(x[i : i + 4] for i in range(0, 16, 4))

    for kind, items in (("card", [card() for _ in range(20)]), ("phone", [f"({digits(3)}) {digits(3)}-{digits(4)}" for _ in range(20)])):
        at = np.cumsum([0, *[len(x) + 1 for x in items[:-1]]]).tolist()
        assert pii.find(" ".join(items), spelled)[1] == [(kind, a, a + len(x)) for a, x in zip(at, items, strict=True)]


def test_hints_before_an_address(spelled):
    """A digit at any distance before an address changes neither its bounds nor that it is found."""
    for far in range(2, 240):
        left = f"7 {'we saw it all here ' * 20}"[:far] + " . "
        assert ("email", len(left), len(left) + 20) in pii.find(f"{left}jane at corp dot org", spelled)[1], far
    domain = "c" * 60
    assert pii.find(f"jane at {domain} dot org", spelled)[1] == [("email", 0, 16 + len(domain))]
    rng = np.random.default_rng(6)
    for _ in range(2000):
        text = "".join(rng.choice(list("ab 1."), int(rng.integers(0, 400)), p=[0.5, 0.34, 0.1, 0.01, 0.05]))
        parts = list(pii.windows(text, 8))
        assert all(x[1] < y[0] for x, y in zip(parts, parts[1:])) and all(any(a <= i < b for a, b in parts) for i, c in enumerate(text) if c == "1")


def test_gates_admit_every_candidate(spelled):
    for text, want in [
        ("host 10 . 0 . 0 . 1 up", [("ip", 5, 19)]), ("ask 8 . 8 . 8 . 8 now", [("ip", 4, 17)]), ("JANE AT CORP DOT ORG", [("email", 0, 20)]), ("Jane At Corp Dot Org", [("email", 0, 20)]), ("DOT matrix", []),
    ]:
        assert pii.find(text, spelled)[1] == want
    rng = np.random.default_rng(7)
    for _ in range(20_000):
        text = "".join(rng.choice(list("12 .+-(a"), int(rng.integers(5, 30))))
        if pii.segments(text, [(m.start(), m.end()) for m in pii._TOKEN.finditer(text)]):
            assert pii._LEAST.search(text)


def dense(model):
    """The score of a text by its cosines with all examples, without an index."""
    index = model.index
    rows = np.zeros((index.n, len(model.weights)))
    for term, at in enumerate(index.frequent.tolist()):
        if at >= 0:
            rows[:, term] = index.full[at]
        lo, hi = index.cuts[term : term + 2]
        rows[index.docs[lo:hi], term] = index.weights[lo:hi]
    assert np.allclose(np.linalg.norm(rows, axis=1)[np.abs(rows).sum(axis=1) > 0], 1)

    def score(text):
        terms, w = model.vector(text)
        cosines = np.round(rows[:, terms] @ w, 12)
        near = [i for i in np.lexsort((np.arange(len(cosines)), -cosines)).tolist() if cosines[i] > 0][: model.k]
        if not near:
            return model.prior
        share = sum(cosines[i] * model.labels[i] for i in near) / sum(cosines[i] for i in near)
        return 1 / (1 + np.exp(-(model.slope * share + model.shift)))

    return score


def test_pipeline(spark, tmp_path):
    """Each stage against a plain version on its own input."""
    from evidrake.llm.shingle_join import near_duplicates

    docs, labels = tables(spark)
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, FOLDER).cache()
    machine = quality.train(docs, labels, metadata=quality.known_metadata(docs))
    every = docs.collect()
    by_rule = quality.scores(machine, {"text": [r.text for r in every], "n_chars": [r.n_chars for r in every]}, ("n_chars",))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r, x in zip(every, by_rule, strict=True) if x >= 0.3}
    assert good.columns == docs.columns
    civil = stages["toxicity"](spark, good, FOLDER).cache()
    nearest = dense(toxicity.train(good, labels))
    assert {r.doc_id for r in civil.collect()} == {r.doc_id for r in good.collect() if nearest(r.text) < 0.5} and 0 < civil.count() < good.count()
    one = stages["n-gram Jaccard join"](spark, civil, FOLDER).cache()
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in near_duplicates(civil).where("kept").collect()} and sorted(one.columns) == sorted(docs.columns)
    redacted = stages["personal data"](spark, one, FOLDER).cache()
    clean = {r.doc_id: r for r in redacted.collect()}
    whole, want = Tokenizer.from_file(WORD_BPE), []
    for r in clean.values():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 1]
        want += [(r.doc_id, k, k * 4096, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(ids[a : a + 4096] for a in range(0, len(ids), 4096))]
    packed = stages["best-fit packing"](spark, redacted, FOLDER).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(want)
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        assert [a for a, _ in sorted(found)] == [0, *np.cumsum([n for _, n in sorted(found)]).tolist()[:-1]] and sum(n for _, n in found) <= 4096
    assert len(places) <= -(-sum(r.length for r in packed) // 4096) + 2
    assert not any(plain(r.text) for r in clean.values()) and all(r.n_chars == len(r.text) for r in clean.values())
    odd = spark.createDataFrame([(1, None, None, None, None, "e"), (None, "a word", "en", "s", 6, "e"), (2, "", "en", "s", 0, "e")], "doc_id long, text string, lang string, source string, n_chars long, SCORE string")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), FOLDER).count() == 0
        assert stage(spark, odd, FOLDER).count() >= 1
    assert len(QUERIES) == 13


def test_long_texts_of_personal_data(spelled):
    """A log of a megabyte, one window from end to end, is searched in seconds; its parts give the same spans."""
    lines = [f"10.{i % 250}.{i % 99}.{i % 31} user{i}@corp{i % 7}.example.org called +44 20 7946 {i % 9000 + 1000} via jane dot smith at corp dot org" for i in range(1000)]
    began = time.process_time()
    short = "\n".join(lines)
    base, every = pii.find(short, spelled)
    once = time.process_time() - began
    assert [s for s in base if s[0] == "ip"] and len(base) >= 3000 and set(base) <= set(every)
    began = time.process_time()
    text = "\n".join([short] * 11)
    assert len(text) > 1_000_000
    base, every = pii.find(text, spelled)
    assert time.process_time() - began < 25 * max(once, 0.5)  # eleven times the text; its square would be 121 times
    at = len(short) + 1
    whole = pii.find(short, spelled)[1]
    for k in (1, 5, 7):
        assert {(n, a - k * at, b - k * at) for n, a, b in every if k * at <= a < (k + 1) * at - 200} == {s for s in whole if s[1] < len(short) - 199}


def test_span_lookups_against_all_spans():
    rng = np.random.default_rng(5)
    for _ in range(300):
        spans = [("x", int(a), int(a + n)) for a, n in zip(rng.integers(0, 60, 8), rng.integers(1, 15, 8))]
        starts, ends = pii.disjoint(spans)
        assert all(e <= s for e, s in zip(ends, starts[1:]))
        for a in range(0, 75, 3):
            for b in (a + 1, a + 4, a + 20):
                assert pii.meets(starts, ends, a, b) == any(a < y and b > x for _, x, y in spans)


def test_field_against_all_segmentations():
    """The chances and the best segmentation of small windows, by adding up every segmentation."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 7))
        spans = sorted({tuple(sorted(rng.choice(n + 1, 2, replace=False).tolist())) for _ in range(5)})
        segs = [pii.Segment(a, b, [f"f{i}", "all"]) for i, (a, b) in enumerate(spans)]
        model = pii.Field({(k, f): float(rng.normal()) for k in pii.KINDS for f in ["all", *(f"f{i}" for i in range(5))]})

        def ways(at, n=n, segs=segs):
            if at >= n:
                yield ()
                return
            yield from ways(at + 1)
            for p, s in enumerate(segs):
                if s.first == at:
                    for rest in ways(s.last):
                        for k in range(len(pii.KINDS)):
                            yield ((p, k), *rest)

        every = list(ways(0))
        value = [sum(model.scores(segs[p])[k] for p, k in w) for w in every]
        total = sum(np.exp(value))
        chances = model.chances(n, segs)
        for p in range(len(segs)):
            for k in range(len(pii.KINDS)):
                assert abs(chances[p][k] - sum(np.exp(v) for v, w in zip(value, every) if (p, k) in w) / total) < 1e-9
        assert abs(sum(model.scores(segs[p])[k] for p, k in model.best(n, segs)) - max(value)) < 1e-9
