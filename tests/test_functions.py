"""Text and value functions on literals, in SQL and in Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import pytext as P, text as T, values as V

TEXTS = [
    "", "  ", "Olá, Ação! nº 5 e Dr. Silva chegou. Fim", "A. Souza veio. E foi? Sim… talvez", "quatro cinco maçãs", "x", "one two three four", "See art. 5 for details. Next sentence! And\nmore",
    "Prof. X and e.g. this. Done", "no end", "ends.", "a.b c. D"]


def sql(spark, expression, texts=TEXTS):
    t = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "n int, t string")
    return [r.v for r in t.select("n", F.expr(expression).alias("v")).orderBy("n").collect()]


@pytest.mark.parametrize("one, two", [
    (T.folded_words("t"), P.folded_words), (T.sentences("t"), P.sentences), (T.chunk_tokens("t"), P.chunk_tokens), (T.prompt_tokens("t"), P.prompt_tokens),
    (T.neutralize("t"), P.neutralize), (T.attribute("t"), P.attribute), (T.numbers(T.folded_words("t")), lambda x: P.numbers(P.folded_words(x)))])
def test_sql_and_python_agree(spark, one, two):
    assert sql(spark, one) == [two(x) for x in TEXTS]


def test_join_adjacent(spark):
    cases = [("a b c d", "c d e", "a b c d\n\ne"), ("a b", "a b", "a b"), ("", "x y", "x y"), ("a", "", "a"), ("a a a", "a a b", "a a a\n\nb"), ("p q", "r s", "p q\n\nr s")]
    t = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "n int, a string, b string")
    got = [r.v for r in t.select("n", F.expr(T.join_adjacent("a", "b")).alias("v")).orderBy("n").collect()]
    assert got == [c for *_, c in cases] == [P.join_adjacent(a, b) for a, b, _ in cases]


def test_jaccard(spark):
    pairs = [("a b c d", "a b c d", 1.0), ("a b c d", "a b c e", 1 / 3), ("a b", "A, B!", 1.0), ("", "", 1.0), ("a b", "a c", 0.0)]
    t = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(pairs)], "n int, a string, b string")
    t = t.select("n", F.expr(T.trigrams(T.folded_words("a"))).alias("a"), F.expr(T.trigrams(T.folded_words("b"))).alias("b"))
    assert [r.v for r in t.select("n", F.expr(T.jaccard("a", "b")).alias("v")).orderBy("n").collect()] == pytest.approx([x for *_, x in pairs])


def test_normalize_query(spark):
    assert sql(spark, T.normalize_query("t"), ["ﬁnd  the\tﬂow\x00 eﬃcient", "\n"]) == ["find the flow efficient", ""]


def test_sanitize(spark):
    got = sql(spark, T.sanitize("t"), ["open /Users/me/a.txt, then '/tmp/x y'", "z" * 400])
    assert got == ["open <path>, then '<path> y'", "z" * 300 + "…"]


def test_page_numbers_and_lists(spark):
    assert sql(spark, T.page_number("t"), ["12", "- 12 -", "Página 41", "Página 6 de 88", "Page 27 of 93", "14/55", "p. 62", "chapter 3", "123456", ""]) == [True] * 7 + [False] * 3
    assert sql(spark, T.starts_list("t"), ["• x", "- x", "1. x", "12) x", "a) x", "(b) x", "A. Souza", "1.x", "-x"]) == [True] * 6 + [False] * 3


def test_shorten():
    assert P.shorten("short", 10) == ("short", False)
    text, cut = P.shorten("First one. " * 30, 20)
    assert cut and text.endswith(". …") and P.prompt_tokens(text) <= 21
    assert P.shorten("é" * 100, 10)[0] == "é" * 28 + " …"


def test_longest_fit():
    rng = random.Random(1)
    for _ in range(200):
        n, limit = rng.randint(0, 50), rng.randint(0, 60)
        assert P.longest_fit(n, lambda k: k <= limit) == min(n, limit)  # noqa: B023


def test_serials(spark):
    from corvane.sources.office import serial_text

    xs = [0.0, 1.0, 59.0, 60.0, 61.0, 45352.0, 45352.5, 45352.604166667, 2958465.0]
    t = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "n int, x double")
    for old in (False, True):
        got = [r.v for r in t.select("n", F.expr(V.serial_to_text("x", old)).alias("v")).orderBy("n").collect()]
        assert got[:-1] == [serial_text(x, old) for x in xs][:-1]
    assert serial_text(45352.0) == "2024-03-01" and serial_text(45352.604166667) == "2024-03-01 14:30"
    assert sql(spark, V.is_date_format("t"), ["dd/mm/yyyy", "h:mm", "0.00", '"day" 0', "[Red]0", "[$-416]d mmm", "\\d0"]) == [True, True, False, False, False, True, False]


def test_pdf_dates(spark):
    assert sql(spark, V.pdf_date("t"), ["D:20240315103000Z", "D:2024", "20241399", ""]) == ["2024-03-15T10:30:00", "2024-01-01", None, None]
