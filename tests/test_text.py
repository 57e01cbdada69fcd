import pytest
from pyspark.sql import functions as F

from evidrake.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, T.tokens(F.lit("Étude: the £214,000 (3.8%) A.I. x_y"))) == ["tude", "214", "000"]
    assert one(spark, T.tokens(F.lit("the and of"))) == []


STEMS = dict(zip("policies ties bring king speed seed uses buses class gas responses respons".split(), "policy ti br king spe seed us bus class gas respons respon".split(), strict=True))


def test_stems(spark):
    words = F.array(*map(F.lit, STEMS))
    assert one(spark, F.transform(words, T.stem)) == list(STEMS.values())


@pytest.mark.parametrize(
    ("build", "expected"),
    [
        (lambda: T.starts_with_negation(F.lit("No data breach")), True),
        (lambda: T.is_positive_yes_no(F.lit("Did it not fail?")), False),
        (lambda: T.is_positive_yes_no(F.lit("According to page 2, was it late?")), True),
        (lambda: T.has_negation(F.lit("ésno éno")), True),
        (lambda: T.wants_compact(F.lit("What did they record?"), F.lit("91% adoption")), False),
        (lambda: T.wants_compact(F.lit("What did they record?"), F.lit("14 hours")), True),
        (lambda: T.asks_about_instruction(F.lit("What do the instructions say?")), False),
        (lambda: T.protected_sentences(F.lit("Opens 10 A.M. daily. Closed later.")), ["Opens 10 A.m. daily.", "Closed later."]),
        (lambda: T.protected_sentences(F.lit("A <period> b. C")), ["A . b.", "C"]),
        (lambda: T.escape_text(F.lit("a<b>&")), "a&lt;b&gt;&amp;"),
        (lambda: T.trim(F.lit("  a ﻿")), "a"),
    ],
)
def test_predicates(spark, build, expected):
    assert one(spark, build()) == expected
