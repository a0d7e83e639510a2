"""Long runs that a careless pattern would read again from each of their characters: each row takes seconds at most."""

import time

import pytest
from pyspark.sql import functions as F

from vetspan.functions import addresses, numbers, text
from vetspan.operators import headers

MILLION = 1_000_000
ZERO = "​"


def value(spark, column, given):
    spark.createDataFrame([(given[:50],)], "t string").select(column(F.col("t"))).collect()  # compiles the code
    began = time.perf_counter()
    out = spark.createDataFrame([(given,)], "t string").select(column(F.col("t")).alias("x")).first().x
    assert time.perf_counter() - began < 5, "far from linear"
    return out


CASES = {
    "padding of spaces": (text.compact_padding, "a" + " " * MILLION + "b", lambda x: len(x) == MILLION + 2),
    "padding with a format character": (text.compact_padding, "a" + " " * MILLION + ZERO + " b", lambda x: x == "a" + " " * 8 + "b"),
    "short runs": (text.compact_padding, (" " * 31 + ZERO + "x") * 20_000, lambda x: x == (" " * 8 + "x") * 20_000),
    "body of line ends": (text.normalised_space, "a" + "\n \t" * 300_000 + "b", lambda x: x == "a\n\nb"),
    "unclosed reserved tags": (text.without_reserved_tags, "<invisible x" * 100_000, lambda x: len(x) == 1_200_000),
    "reserved tags": (text.without_reserved_tags, "<invisible x>é</ invisible>" * 40_000 + "<invisible", lambda x: x == "é" * 40_000 + "<invisible"),
    "unclosed comments": (text.comment_statistics, "a<!-- x " * 100_000, lambda x: (x.characters, x.within_words) == (0, 0)),
    "many comments": (text.comment_statistics, "a<!--x-->b<!--[if y]>" * 50_000, lambda x: (x.characters, x.within_words) == (50_000, 50_000)),
    "identity of spaces": (text.smtp_identity, "a" + " " * MILLION + "b  ", lambda x: x == "a" + " " * 254),
    "address of dots": (lambda t: F.get(text.urls(t), F.lit(0)), "http://a" + "." * MILLION + "x..", lambda x: len(x) == MILLION + 9),
    "mailbox list without @": (headers.mailboxes, "a" * MILLION + " <b@c.example>", lambda x: list(x) == ["b@c.example"]),
    "group of spaces": (headers.empty_group, " " * MILLION, lambda x: x is False),
    "extension of dots": (lambda t: numbers.blocked_extension(t, ("exe",)), "a" + "." * MILLION + "x", lambda x: x is None),
    "parents of dots": (lambda t: F.size(addresses.parent_domains(t)), "a." * 500_000, lambda x: x == 1),
}


@pytest.mark.parametrize("name", CASES)
def test_long_runs(spark, name):
    column, given, expected = CASES[name]
    assert expected(value(spark, column, given))


def test_comments_in_words(spark):
    cases = {"a<!--x-->b": (1, 1), "a<!--x--> b": (1, 0), "a<!--x--> <!--y-->b": (2, 0), "a<!--[if z]>b<!--c-->d": (1, 1), "<!-->a-->": (0, 0), "1<!---->2": (0, 1), "é<!--x--><!--y-->ß": (2, 0), "": (0, 0), "a<!--b<!--c-->d": (6, 1), "a<!-- x": (0, 0)}
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", text.comment_statistics(F.col("t")).alias("s")).orderBy("i").collect()
    assert [(r.s.characters, r.s.within_words) for r in rows] == list(cases.values())

