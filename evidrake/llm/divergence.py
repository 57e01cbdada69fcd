"""Divergence of sources from each other and from their language, with count columns deduplicated.

Each language keeps the terms that occur in at least ``least_docs`` of its documents. A group (language and source) and the
language itself give a kept term p = 1 + floor(SCALE * (count + 2) / (N + 2 V)); two of them differ at a term by
floor((p - q)² / (p + q)), in whole numbers throughout. A pair of sources has the sum over all kept terms.

Terms with the same counts in the same sources differ alike for every pair, so terms are grouped by their sparse vector of
(source, count) and each distinct vector is evaluated once for every pair and multiplied by its multiplicity. A vector is
evaluated for the pairs that it names; what a pair has from terms that only one source uses, or none, follows from the histogram
of that source's counts and from V. With f00 = f(0, 0) in the pair's own p:

    value(a, b) = V f00 + sum over terms of a (f(a, 0) - f00) + sum over terms of b (f(0, b) - f00)
                  + sum over terms of both (f(a, b) - f(a, 0) - f(0, b) + f00)

Tasks hold one matrix of ``BLOCK`` x ``BLOCK`` sources at a time and emit sums, never pairs for each term. Nothing comes to the driver.

Null text, lang and source count as empty texts; a repeated row is another document; ids are not read, nor are other columns; a
source without terms takes part, a language without kept terms has values of 0; ties rank by the item's UTF-8 bytes; a text of
any length is read in pieces; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, materialize, prepare

SCALE = 1_000_000_000
#: Sources on a side of a matrix of sums.
BLOCK = 128
#: Terms that a task counts before it emits their sums; characters of a text that are split at once.
HELD, PIECE = 200_000, 1 << 20
# bytes that part terms become spaces, A-Z become a-z, all others stay
_PARTS = bytes(32 if b < 0x41 or 0x5B <= b < 0x61 or 0x7B <= b < 0x80 else b | 32 if b < 0x5B else b for b in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"
_SUMS = "lang string, x int, y int, value long"


def pieces(text: str) -> Iterator[bytes]:
    """The text's UTF-8 form with terms parted by spaces, in pieces that end between terms."""
    held = b""
    for at in range(0, len(text), PIECE):
        data = held + text[at : at + PIECE].encode().translate(_PARTS)
        cut = data.rfind(b" ") + 1 if at + PIECE < len(text) else len(data)
        held = data[cut:]
        yield data[:cut]


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): partial counts of occurrences and documents, summed within tasks as far as they hold them."""
    prepare(docs.sparkSession)
    schema = arrow_schema(docs.sparkSession, _COUNTS)

    def emit(found: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, seen) in found.items():
            terms = list(n)
            for at in range(0, len(terms), 20_000):
                some = terms[at : at + 20_000]
                columns = ([lang] * len(some), [source] * len(some), [t.decode() for t in some], [n[t] for t in some], [seen[t] for t in some])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for b in batches:
            for lang, source, text in zip(*(b.column(k).to_pylist() for k in ("lang", "source", "text")), strict=True):
                n, seen = found.setdefault((lang, source), (Counter(), Counter()))
                own: set[bytes] = set()
                for piece in pieces(text):
                    terms = piece.split()
                    n.update(terms)
                    own.update(terms)
                seen.update(own)
            if sum(len(n) for n, _ in found.values()) > HELD:
                yield from emit(found)
                found = {}
        yield from emit(found)

    return docs.mapInArrow(run, _COUNTS)


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a count, exactly; null where there are no kept terms."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + 2), F.nullif(wide(total + 2 * kept), F.lit(0).cast("decimal(19,0)"))) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def both_sums(vectors: DataFrame) -> DataFrame:
    """(lang, x, y, value) with x < y: what distinct vectors (lang, v, m) add to the pairs of sources that they name.

    v: array of (s, p, z), by s: the source's number, its p, and its p of a count of 0.
    """
    schema = arrow_schema(vectors.sparkSession, _SUMS)
    of = lambda b: F.filter("v", lambda e: F.floor(e.s / BLOCK) == b)
    blocks = F.array_distinct(F.transform("v", lambda e: F.floor(e.s / BLOCK)))
    sides = vectors.where(F.size("v") > 1).select("lang", "v", "m", F.explode(blocks).alias("a"), blocks.alias("bs"))
    sides = sides.select("lang", "v", "m", "a", F.explode(F.filter("bs", lambda b: b >= F.col("a"))).alias("b"))
    sides = sides.select("lang", "a", "b", "m", of(F.col("a")).alias("left"), of(F.col("b")).alias("right")).sortWithinPartitions("lang", "a", "b")

    def side(column: pa.ListArray) -> tuple[np.ndarray, ...]:
        lengths, inner = np.diff(column.offsets.to_numpy()), column.flatten()
        return np.cumsum(lengths) - lengths, lengths, *(inner.field(k).to_numpy() for k in ("s", "p", "z"))

    def add(sums: np.ndarray, b: pa.RecordBatch) -> None:
        start, n, s, p, z = side(b.column("left"))
        start2, n2, s2, p2, z2 = side(b.column("right"))
        of_row, m = np.repeat(np.arange(b.num_rows), n), b.column("m").to_numpy()
        each = n2[of_row]  # partners of each left element
        for lo in range(0, len(of_row), max(1, 2_000_000 // max(1, int(each.max(initial=1))))):
            hi = min(len(of_row), lo + max(1, 2_000_000 // max(1, int(each.max(initial=1)))))
            i = np.repeat(np.arange(lo, hi), each[lo:hi])
            first = np.cumsum(each[lo:hi]) - each[lo:hi]
            j = np.arange(len(i)) - np.repeat(first, each[lo:hi]) + start2[of_row[i]]
            keep = s[i] < s2[j]
            i, j = i[keep], j[keep]
            value = difference(p[i], p2[j]) - difference(p[i], z2[j]) - difference(z[i], p2[j]) + difference(z[i], z2[j])
            np.add.at(sums, (s[i] % BLOCK, s2[j] % BLOCK), value * m[of_row[i]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, np.zeros((BLOCK, BLOCK), np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            if key is not None:
                x, y = np.nonzero(sums)
                columns = ([key[0]] * len(x), x + key[1] * BLOCK, y + key[2] * BLOCK, sums[x, y])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                sums[:] = 0

        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in ("lang", "a", "b")), strict=True))
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    if keys[start] != key:
                        yield from flush()
                        key = keys[start]
                    add(sums, b.slice(start, i - start))
                    start = i
        yield from flush()

    return sides.mapInArrow(run, _SUMS)


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source).

    Part ``pair``: each other source of the language, with the pair's value. Part ``term``: the ``top`` terms that the
    source uses more than its language, by their value.
    """
    spark = docs.sparkSession
    prepare(spark)
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    term = Window.partitionBy("lang", "term")
    # dealt by term once: sums, document frequencies and the language's counts all keep to it
    flat = term_counts(plain).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    flat = flat.withColumn("all_docs", F.sum("docs").over(term)).withColumn("all_n", F.sum("n").over(term)).withColumn("first", F.min("source").over(term) == F.col("source"))
    kept = materialize(flat.where(F.col("all_docs") >= least_docs).select("lang", "term", "source", "n", "all_n", "first"), "kept-terms")

    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("firsts"))
    groups = plain.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["total", "firsts"])
    by_lang = Window.partitionBy("lang")
    groups = groups.withColumn("V", F.sum("firsts").over(by_lang)).withColumn("all_total", F.sum("total").over(by_lang))
    groups = groups.withColumn("s", F.row_number().over(by_lang.orderBy("source")) - 1)
    groups = materialize(groups.select("lang", "source", "s", "total", "V", "all_total", share(F.lit(0).cast("long"), F.col("total"), F.col("V")).alias("z")), "groups")

    rows = kept.join(groups, ["lang", "source"])
    rows = rows.withColumn("p", share(F.col("n"), F.col("total"), F.col("V"))).withColumn("q", share(F.col("all_n"), F.col("all_total"), F.col("V")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = rows.where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    terms = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    vectors = rows.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("s", "n", "p", "z"))).alias("v")).groupBy("lang", "v").agg(F.count("*").alias("m"))
    both = both_sums(vectors)
    own = groups.select("lang", F.col("s").alias("x"), F.col("z").alias("zx"), "V")
    other = groups.select("lang", F.col("s").alias("y"), F.col("z").alias("zy"))
    zeros = own.join(other, "lang").where("x < y").select("lang", "x", "y", (F.col("V") * F.coalesce(apart(F.col("zx"), F.col("zy")), F.lit(0))).alias("value"))
    histogram = rows.groupBy("lang", F.col("s").alias("x"), "p", F.col("z").alias("zx")).agg(F.count("*").alias("m"))
    alone = histogram.join(other, "lang").where("x <> y").select(
        "lang", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), (F.col("m") * (apart(F.col("p"), F.col("zy")) - apart(F.col("zx"), F.col("zy")))).alias("value"))
    values = zeros.unionByName(alone).unionByName(both).groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("x").alias("s"), F.col("y").alias("o")), F.struct(F.col("y").alias("s"), F.col("x").alias("o"))))
    pairs = values.select("lang", ways.alias("w"), "value").select("lang", "w.s", "w.o", "value")
    named = pairs.join(groups.select("lang", "s", "source"), ["lang", "s"]).join(groups.select("lang", F.col("s").alias("o"), F.col("source").alias("item")), ["lang", "o"])
    ranked = named.select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(order))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.withColumn("part", F.lit("pair")).select(*out).unionByName(terms.withColumn("part", F.lit("term")).select(*out))
