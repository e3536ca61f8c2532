"""Search patterns as Python means them, and dates whose form the column decides."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postmill.functions.dates import BY_NAME, FORMS, first_form, parse_form
from postmill.functions.patterns import translated
from postmill.operators import timeline

TEXTS = [
    "", "über m²", "a_b c", "x\x1cy", "line\nbreak", "end\n", "é accent", "٣ drei", "[tag] {1}", "a{,2}", "aa bb", "a-b", "\\ back", "$5.00^", "tab\there",
    "ÄÖÜ", "äöü", "Iıİi", "ß SS", "#x y", "a]b", " sep", "no\xa0break", "aXbX", "日本語", "--", "&&", "~", "foo(bar)", "a\x00b", "abcabc", "\x85nel", "x" * 5,
]
PATTERNS = [
    r"\w+²", r"\w+", r"^\w+$", r"\W", r"\s", r"\S+\s\S+", r"\d", r"\D\d", r"\bb", r"\Bb", r"[\w-]+", r"[^\W\d_]", r"[^\w\s]", r"[\D]", r"[]a]", r"[^]a]", r"[[]", r"[a&&b]", r"a{,2}b",
    r" {1", r"x{3}", r"x{2,}", r"\{1\}", r"a\Z", r"d$", r"k$", r"(?P<q_1>a)(?P=q_1)", r"(?P<a>abc)\1", r"(a)(b)?\1", r"(?i)ÄÖ", r"äö", r"\x41", r"ä", r"[\x00-\x1f]", r"\t", r"[a-c]{3}", r"(?s)line.break",
    r"line.break", r"(?:a|b)-", r"a(?=_)", r"(?<!a)b", r"\$5\.00\^", r"#x", r"a(?#note)_", r"(?m)^break", r"\n", r"[-a]", r"[a-]", r"\0", r"(?i:X)b", r"[\d_]", r"\\", r"a#", r"[#~]", r"\(bar\)", r"(?>a+)b", r"x++", r"[\]\-]", r"é", r"\A\s",
]


@pytest.mark.parametrize("flags", ["d", "iud"])
def test_patterns_mean_what_python_means(spark, flags):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    columns = [F.col("t").rlike(f"(?{flags})" + translated(p)).alias(f"p{k}") for k, p in enumerate(PATTERNS)]
    rows = {r.i: r for r in df.select("i", *columns).collect()}
    for k, p in enumerate(PATTERNS):
        want = [bool(re.search(p, t, re.I if "i" in flags else 0)) for t in TEXTS]
        assert [rows[i][f"p{k}"] for i in range(len(TEXTS))] == want, p


def test_what_has_no_counterpart_is_refused():
    for pattern in (r"(a)?(?(1)b|c)", r"\N{BULLET}", r"(?x)a b", r"(?a)\w", "(", "[a", r"\q", "a**", r"(?P<a>x)(?P<a>y)"):
        with pytest.raises(ValueError):
            translated(pattern)


def test_subject_search(spark):
    df = spark.createDataFrame([("1", "10 m² frei"), ("2", "M2"), ("3", None), ("4", "a.c"), ("5", "abc")], "i string, Subject string")
    assert [r.i for r in timeline.subject_matches(df, r"\w+²").collect()] == ["1"]
    assert [r.i for r in timeline.subject_matches(df, "A.C", literal=True).collect()] == ["4"]
    assert [r.i for r in timeline.subject_matches(df, r"(?P<x>m)\d").collect()] == ["2"]
    with pytest.raises(ValueError):
        timeline.subject_matches(df, r"\N{BULLET}")


def test_forms(spark):
    cases = {
        "03.04.2001": ("d.m.Y", datetime(2001, 4, 3)), "3/4/2001 10:00": ("d/m/Y H:M", datetime(2001, 4, 3, 10)), "13/25/2001": (None, None), "04/25/2001": ("m/d/Y", datetime(2001, 4, 25)),
        "2001-04-03T10:00:01Z": ("Y-m-dTH:M:S z", datetime(2001, 4, 3, 10, 0, 1)), "Mon, 14 May 2001 16:39:00 -0700 (PDT)": ("Day, d Mon Y H:M:S z (zone)", datetime(2001, 5, 14, 16, 39)),
        "14 MAY 2001": ("d Mon Y", datetime(2001, 5, 14)), "May 14, 2001 01:02:03.5": ("Mon d, Y H:M:S.f", datetime(2001, 5, 14, 1, 2, 3, 500000)), "30.02.2001": (None, None),
        "31 Foo 2001": (None, None), "": (None, None), "2001-04-03 10:00:01 +02:00": ("Y-m-d H:M:S z", datetime(2001, 4, 3, 10, 0, 1)), "01.01.0000": (None, None), "1.1.2001 25:00:00": (None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "c string")
    got = {r.c: r.f for r in df.select("c", first_form(F.col("c")).alias("f")).collect()}
    assert {k: (FORMS[f].name if f is not None else None) for k, f in got.items() if k is not None} == {k: v[0] for k, v in cases.items()}
    for text, (name, time) in cases.items():
        if name:
            assert spark.createDataFrame([(text,)], "c string").select(parse_form(F.col("c"), BY_NAME[name]).alias("t")).first().t == time


def test_the_first_value_in_row_order_decides(spark):
    values = ["", None, "no date", "13/04/2001", "04/13/2001", "2001-04-13", "01/02/2001"]
    for seed in range(3):
        rows = [(i, v) for i, v in enumerate(values)]
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "email_number int, Date string").repartition(3)
        assert timeline.inferred_form(df) == "d/m/Y"
        assert sorted(r.DateTime for r in timeline.with_inferred_time(df).collect()) == [datetime(2001, 2, 1), datetime(2001, 4, 13)]
        assert timeline.inferred_form(df.withColumn("email_number", -F.col("email_number"))) == "d/m/Y"
        assert timeline.inferred_form(df.filter("email_number between 4 and 5")) == "m/d/Y"
    assert timeline.inferred_form(df.filter("email_number < 3")) is None and timeline.with_inferred_time(df.filter("email_number < 3")).isEmpty()
