"""String operators against literal cases and against Python."""

import random

import pytest
from pyspark.sql import functions as F

from leakgauge.functions import di_types as D
from leakgauge.functions import draws
from leakgauge.functions import text as X


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", make(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


def test_position_filter(spark):
    names = [" Irma Kestrel, seen 4 May", "Irma Kestrel", "\tIrma Kestrel", " irma KESTREL", ""]
    got = column(spark, names, lambda c: F.when(X.starts_clean(c, X.parse_name(c)), X.parse_name(c)))
    assert got[1] is None and got[4] is None and got[3] == "Irma Kestrel"


def test_parse_names(spark):
    assert column(spark, ["hugo marsh", "HUGO MARSH", "Ada Lund was here", "K. Birk", "o'brien jean-luc", "", None, "a\xa0b c"], X.parse_name) == ["Hugo Marsh", "Hugo Marsh", "Ada Lund", "K Birk", "O'Brien Jean-Luc", "", None, "A B"]
    assert column(spark, ["hugo  marsh elm"], X.first_two_words) == ["hugo marsh"]


def test_looks_like_name(spark):
    values = ["Hugo Marsh", "Clara Oaks", "___ ___", "Oaks ___", "Room 12", "Marsh", "Prof. Reed, PhD", "", None]
    assert column(spark, values, X.looks_like_name) == [True, True] + [False] * 7


@pytest.mark.parametrize("text", ["", "___", "______", "____", "a___b", "___a___", "x" * 50 + "___"])
def test_blanks_rebuild(spark, text):
    seg, n, num = spark.createDataFrame([(text,)], "v string").select(X.segments(F.col("v")), X.blank_count(F.col("v")), X.numbered(F.col("v"))).first()
    assert seg == text.split("___") and n == text.count("___")
    want, k = text, 0
    while "___" in want:
        k += 1
        want = want.replace("___", f"[{k}]", 1)
    assert num == want


def test_title_as_python(spark):
    random.seed(1)
    values = ["".join(random.choice("abÉé'- 3.Z") for _ in range(12)) for _ in range(60)]
    assert column(spark, values, X.title) == [v.title() for v in values]


def test_line_word_digits(spark):
    assert column(spark, ["\n  \n x y \nz", "", " ", None], X.parse_line) == ["x y", "", "", None]
    assert column(spark, ["  a b", "", None], X.parse_word) == ["a", "", None]
    assert column(spark, ["MRN 12 34", "none", None], X.parse_digits) == ["12", "", None]


def test_label_classifier(spark):
    prefixes = ["Name: ", "Name: x  Unit No: ", "Attending: ", "free text", "Mailing Address: ", "Name: " + "x" * 60, ""]
    assert column(spark, prefixes, D.detect) == ["name-patient", "id", "name-attending", "name-patient", "address", "name-patient", "name-patient"]
    with pytest.raises(KeyError):
        D.get("passport")


def test_draws_are_uniform_and_stable(spark):
    r = spark.range(4000).select(draws.draw("s", F.col("id")).alias("u")).agg(F.avg("u").alias("m"), F.min("u").alias("lo"), F.max("u").alias("hi")).first()
    assert 0 <= r.lo and r.hi < 1 and abs(r.m - 0.5) < 0.03
    a = spark.range(50).repartition(7).select(draws.draw("s", F.col("id")).alias("u"), "id").orderBy("id").collect()
    b = spark.range(50).coalesce(1).select(draws.draw("s", F.col("id")).alias("u"), "id").orderBy("id").collect()
    assert a == b


def test_money_and_labels(spark):
    got = spark.createDataFrame([(1500.0,), (2e6,), (0.01,), (3.0,)], "v double").select(X.money(F.col("v"))).collect()
    assert [r[0] for r in got] == ["$1.5K", "$2M", "$0.0100", "$3"]
