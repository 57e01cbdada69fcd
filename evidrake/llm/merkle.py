"""Merkle fingerprints of documents, in DataFrame functions only.

A document is a tree: sections (parted by an empty line), their paragraphs (lines), and leaves (sentences, cut every
``LEAF`` characters). A leaf's digest is SHA-256 of its text, an inner node's of its children's digests. The cuts are
fixed by the text and lose nothing, so equal roots mean equal texts. The fingerprint holds the root and short codes of
all other nodes, so two fingerprints are compared from the top down: equal sections are passed over, then equal
paragraphs, and the branches that remain are the edits. Likeness is a share of leaves in common: an edit changes the
leaves that it touches, the nodes above them, and no others.

Null text counts as empty. Null ids come first in order and come back null, rows of one id follow in the order of
their texts, a single row is its own next one, an empty table gives no rows, other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

#: Most characters of a leaf before its closing marks; hexadecimal digits of the codes of leaves and of inner nodes.
LEAF, CODE, INNER = 24, 6, 12
SECTION_CUT, PARAGRAPH_CUT = "\n\n", "\n"
LEAVES = r"[^.!?]{1,%d}[.!?]*|[.!?]+" % LEAF
#: Bytes of text in a range of ids, and the most ranges (their bounds are literals of the plan).
RANGE_BYTES, RANGES = 16 << 20, 65_536


def tree(text: Column) -> Column:
    """Sections (digest, paragraphs (digest, leaf digests)); a node's digest is that of its children's, joined."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAVES), F.lit(0)), lambda x: F.sha2(x, 256))
    paragraph = lambda below: F.struct(F.sha2(F.array_join(below, ""), 256).alias("digest"), below.alias("below"))
    section = lambda below: F.struct(joined(below).alias("digest"), below.alias("below"))
    lists = F.transform(F.split(text, SECTION_CUT), lambda s: F.transform(F.split(s, PARAGRAPH_CUT), leaves))
    return F.transform(F.transform(lists, lambda s: F.transform(s, paragraph)), section)


def joined(nodes: Column) -> Column:
    """The digest of a node that has these children."""
    return F.sha2(F.array_join(F.transform(nodes, lambda n: n["digest"]), ""), 256)


def fingerprint(sections: Column) -> Column:
    """Of a :func:`tree`: root:section/paragraph.leaves,paragraph.leaves;section/paragraph.leaves and so on."""
    code = lambda n: F.substring(n["digest"], 1, INNER)
    leaves = lambda p: F.array_join(F.transform(p["below"], lambda x: F.substring(x, 1, CODE)), "")
    paragraph = lambda p: F.concat(code(p), F.lit("."), leaves(p))
    section = lambda s: F.concat(code(s), F.lit("/"), F.array_join(F.transform(s["below"], paragraph), ","))
    return F.concat(joined(sections), F.lit(":"), F.array_join(F.transform(sections, section), ";"))


def codes(print_: Column) -> Column:
    """The leaves' codes of a fingerprint, in order."""
    inner = F.regexp_replace(F.substring_index(print_, ":", -1), "[0-9a-f]{%d}[/.]" % INNER, "")
    return F.regexp_extract_all(inner, F.lit("[0-9a-f]{%d}" % CODE), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Of two :func:`codes`, the larger of two shares: distinct codes in common, and codes equal at the same place
    (a text that repeats itself has few distinct ones). Two empty ones are alike."""
    most = F.greatest(F.size(a), F.size(b))
    one, other = F.array_distinct(a), F.array_distinct(b)
    common = F.size(F.array_intersect(one, other)) / F.greatest(F.size(one), F.size(other), F.lit(1))
    aligned = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.greatest(most, F.lit(1))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.greatest(common, aligned))


def _counted(nodes: Column) -> Column:
    """Nodes with a key that tells equal ones apart: the code, and how many equal ones came before."""
    before = lambda n, i: F.size(F.filter(F.slice(nodes, F.lit(1), i), lambda m: m["code"] == n["code"]))
    return F.transform(nodes, lambda n, i: n.withField("key", F.concat_ws("#", n["code"], before(n, i).cast("string"))))


def _without(nodes: Column, others: Column) -> Column:
    return F.filter(nodes, lambda n: ~F.exists(others, lambda o: o["key"] == n["key"]))


def _sections(print_: Column) -> Column:
    parts = F.split(F.substring_index(print_, ":", -1), ";")
    return F.transform(parts, lambda s, i: F.struct(i.alias("section"), F.substring_index(s, "/", 1).alias("code"), F.substring_index(s, "/", -1).alias("below")))


def _paragraphs(sections: Column) -> Column:
    return F.flatten(F.transform(sections, lambda s: F.transform(
        F.split(s["below"], ","),
        lambda p, i: F.struct(s["section"].alias("section"), i.alias("paragraph"), F.substring_index(p, ".", 1).alias("code")))))


def differing_branches(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` and ``edits``: where the fingerprints in the columns ``a`` and ``b`` differ, found from the top down.

    Each edit is (change, section, paragraph), places from 0: ``removed`` (place in a: b has no such paragraph),
    ``inserted`` (place in b), ``moved`` (place in b; whole sections have a null paragraph), ``regrouped`` (place in
    b of a paragraph that begins a section in one text only). Equal roots give an empty list and are not descended,
    unequal ones at least one edit; equal sections are passed over. A null fingerprint gives null.
    """
    edit = lambda change, n, p: F.struct(F.lit(change).alias("change"), n["section"].alias("section"), p.alias("paragraph"))
    own, null = (lambda n: n["paragraph"]), (lambda n: F.lit(None).cast("int"))
    step = pairs
    for side, column in (("_a", a), ("_b", b)):
        step = step.withColumn(side, _counted(_sections(F.col(column))))
    top = step.withColumn("_ax", _without(F.col("_a"), F.col("_b"))).withColumn("_bx", _without(F.col("_b"), F.col("_a")))
    top = top.withColumn("_am", _without(F.col("_a"), F.col("_ax"))).withColumn("_bm", _without(F.col("_b"), F.col("_bx")))
    low = top.withColumn("_pa", _counted(_paragraphs(F.col("_ax")))).withColumn("_pb", _counted(_paragraphs(F.col("_bx"))))
    low = low.withColumn("_ga", _without(F.col("_pa"), F.col("_pb"))).withColumn("_gb", _without(F.col("_pb"), F.col("_pa")))
    low = low.withColumn("_pam", _without(F.col("_pa"), F.col("_ga"))).withColumn("_pbm", _without(F.col("_pb"), F.col("_gb")))
    out_of_place = lambda x, y, test: F.filter(F.col(y), lambda n, i: test(F.get(F.col(x), i), n))
    moved = lambda x, y: out_of_place(x, y, lambda m, n: m["key"] != n["key"])
    regrouped = out_of_place("_pam", "_pbm", lambda m, n: (m["key"] == n["key"]) & ((m["paragraph"] == 0) != (n["paragraph"] == 0)))
    as_edits = lambda nodes, change, place: F.transform(nodes, lambda n: edit(change, n, place(n)))
    found = F.concat(
        as_edits(moved("_am", "_bm"), "moved", null), as_edits(F.col("_ga"), "removed", own), as_edits(F.col("_gb"), "inserted", own),
        as_edits(moved("_pam", "_pbm"), "moved", own), as_edits(regrouped, "regrouped", own),
    )
    same = F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1)
    return low.select(*[F.col(c) for c in pairs.columns], F.when(same, F.slice(found, 1, 0)).when(~same, found).alias("edits"))


def with_next(docs: DataFrame, least: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """docs (doc_id, text) dealt into id ranges, with the first row of the following range as a ghost at each end.

    There are ``least`` ranges or more, by the bytes of all texts, and each is a partition of its own. The bounds are
    ids that occur (approximate percentiles), so the row at a bound is the first one of its range and is sent to the
    range before as well; texts are shuffled once.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first().bytes or 0
    buckets = min(RANGES, max(least, -(-size // range_bytes)))
    stats = docs.agg(
        F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)] or [0.5], max(100_000, 10 * buckets)).alias("q"),
        F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls"),
    ).first()
    bounds = sorted({b for b in stats.q or [] if b is not None and (stats.nulls or b != stats.least)}) if buckets > 1 else []
    edges = F.lit(bounds).cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    coarse = max(1, round(len(bounds) ** 0.5))
    heads = bounds[::coarse]
    blocks = F.array(*[F.lit(bounds[i : i + coarse]).cast("array<bigint>") for i in range(0, len(bounds), coarse)]) if bounds else None
    if bounds:  # two levels, so that a row is compared with few bounds
        k = F.size(F.filter(F.lit(heads).cast("array<bigint>"), lambda x: x <= F.col("doc_id")))
        bucket = F.when(k > 0, (k - 1) * coarse + F.size(F.filter(F.get(blocks, k - 1), lambda x: x <= F.col("doc_id")))).otherwise(0)
    else:
        bucket = F.lit(0)
    first = F.col("doc_id").isNull() if stats.nulls else F.col("doc_id") == F.lit(stats.least)
    at = lambda b, ghost: F.struct(b.cast("int").alias("bucket"), F.lit(ghost).alias("ghost"))
    placed = docs.withColumn("b", bucket).withColumn(
        "to",
        F.array_compact(F.array(
            at(F.col("b"), False),
            F.when(F.array_contains(edges, F.col("doc_id")), at(F.col("b") - 1, True)),
            F.when(first, at(F.lit(len(bounds)), True)))))
    return placed.select("doc_id", "text", F.explode("to").alias("to")).select("doc_id", "text", "to.*").repartitionById(len(bounds) + 1, F.col("bucket"))


def query(documents: DataFrame) -> DataFrame:
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = with_next(docs, 2 * partitions(spark))
    own = dealt.withColumn("tree", tree(F.col("text"))).withColumn("fingerprint", fingerprint(F.col("tree"))).drop("tree")
    after = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "text")
    pairs = own.withColumn("next_text", F.lead("text").over(after)).withColumn("next_print", F.lead("fingerprint").over(after)).where(~F.col("ghost"))
    n = F.char_length("text")
    edited = pairs.select(
        "doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_print",
        F.concat(F.substring("text", F.lit(1), n - F.floor(n / 4).cast("int")), F.substring("next_text", F.lit(1), F.floor(n / 4).cast("int"))).alias("edited"),
    )
    edited = edited.withColumn("tree", tree(F.col("edited"))).withColumn("edited_fingerprint", fingerprint(F.col("tree"))).drop("tree")
    coded = edited.withColumn("a", codes(F.col("fingerprint"))).withColumn("e", codes(F.col("edited_fingerprint"))).withColumn("x", codes(F.col("next_print")))
    return coded.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("a"), F.col("e")).alias("near_edited"), likeness(F.col("a"), F.col("x")).alias("near_next"),
    )
