"""Text functions as Column builders; everything stays in the JVM.

Word edges are those of ASCII (letters with accents part words), lengths count code points, and trimming removes all
Unicode white space, which Spark's ``trim`` does not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

WHITE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The same as characters.
WHITE_CHARACTERS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
BEFORE, AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def words(alternatives: str) -> str:
    """A case-insensitive pattern for whole words."""
    return f"(?i){BEFORE}(?:{alternatives}){AFTER}"


def trim(x: Column) -> Column:
    """Without white space at both ends; looks at the ends only, which a pattern does not."""
    return F.btrim(x, F.lit(WHITE_CHARACTERS))


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def to_fixed(x: Column) -> Column:
    """``x`` (0 to 1, or a little more) to three places by its exact binary value, as printing it would give.

    ``round`` goes by the shortest decimal form, which can lie on a half that the value itself lies below.
    """
    n, bits = F.round(x * 1000).cast("long"), 2**60
    exact = F.floor(x * float(bits)).cast("decimal(20,0)") * F.lit(2000).cast("decimal(5,0)")
    half = (2 * n - 1).cast("decimal(10,0)") * F.lit(bits).cast("decimal(20,0)")
    return (n - F.when(exact < half, 1).otherwise(0)) / 1000


def literals(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def tokens(x: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, two characters or more, that are not stopwords; order kept."""
    return F.filter(
        F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)),
        lambda t: (F.length(t) > 1) & ~t.isin(*L.STOPWORDS),
    )


def stem(t: Column) -> Column:
    n = F.length(t)
    cut = lambda k: F.left(t, n - k)
    return (
        F.when((n > 4) & t.endswith("ies"), F.concat(cut(F.lit(3)), F.lit("y")))
        .when((n > 4) & t.endswith("ing"), cut(F.lit(3)))
        .when((n > 4) & t.endswith("ed"), cut(F.lit(2)))
        .when((n > 3) & t.endswith("es"), cut(F.lit(2)))
        .when((n > 3) & t.endswith("s") & ~t.endswith("ss"), cut(F.lit(1)))
        .otherwise(t)
    )


def content_stems(x: Column, besides: list[str] | None = None) -> Column:
    """Stems of the tokens that are not question stopwords, nor words of ``besides``; duplicates and order kept."""
    out = [*L.QUESTION_STOPWORDS, *(besides or [])]
    return F.transform(F.filter(tokens(x), lambda t: ~t.isin(*out)), stem)


def restem(stems: Column) -> Column:
    return F.array_distinct(F.transform(stems, stem))


def _pieces(x: Column) -> Column:
    return F.split(x, r"(?<=[.!?])\s+|\n{2,}")


def evidence_sentences(x: Column) -> Column:
    return F.filter(F.transform(_pieces(x), trim), lambda s: s != "")


def protected_sentences(x: Column) -> Column:
    """As above, but a.m., p.m., i.e. and e.g. end no sentence (their second letter comes out in lower case)."""
    for first, second in (("[ap]", "m"), ("i", "e"), ("e", "g")):
        x = F.regexp_replace(x, rf"(?i){BEFORE}({first})\.{second}\.", f"$1<period>{second}<period>")
    return F.filter(F.transform(_pieces(x), lambda s: F.replace(trim(s), F.lit("<period>"), F.lit("."))), lambda s: s != "")


def has_negation(x: Column) -> Column:
    return x.rlike(words(L.NEGATION_WORDS))


def starts_with_negation(x: Column) -> Column:
    return x.rlike(rf"(?i)^(?:{L.NEGATION_STARTS}){AFTER}")


def is_positive_yes_no(question: Column) -> Column:
    body = F.regexp_replace(trim(question), r"(?i)^according to [^,]+,\s*", "")
    return body.rlike(rf"(?i)^(?:{L.YES_NO_STARTS}){AFTER}") & ~has_negation(body)


def asks_about_instruction(question: Column) -> Column:
    return question.rlike(words(L.INSTRUCTION_NOUNS)) & question.rlike(words(L.REPORTING_VERBS))


def is_instruction_evidence(span: Column) -> Column:
    return span.rlike(words(L.INSTRUCTION_EVIDENCE))


def wants_compact(question: Column, passage: Column) -> Column:
    measure = rf"(?i)[{L.CURRENCY}]|{BEFORE}\d+(?:\.\d+)?\s*(?:{L.MEASURE_UNITS})(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    return question.rlike(words(L.COMPACT_WORDS)) | (question.rlike(words(L.METRIC_WORDS)) & passage.rlike(measure))


def escape_text(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def escape_attribute(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
