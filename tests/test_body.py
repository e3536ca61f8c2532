"""Hand-derived cases of the body steps."""

import time

import pytest
from pyspark.sql import functions as F

from postmill.functions import body as B
from postmill.operators.clean import clean_text, clean_text_audited

SYMBOL_STEPS = (B.drop_symbol_lines, B.drop_quote_marks, B.drop_empty_bullets)
CASES = {
    "escapes": (B.decode_escapes, {"=3D20": "=20", "=3D22": '"', "=3D27": "'", "a=\nb": "ab", "=\r\n": "=\r\n", "=09": "\t"}),
    "squeeze": (B.squeeze_spaces, {"a  b": "a  b", "a \t b": "a b", "a\n\n\nb": "a\n\n\nb", "a\n\n \n\n\nb": "a\n\n\nb"}),
    "controls": (B.drop_controls, {"a\x07b\x0bc\td\r\ne\rf": "abc\td\ne\nf", "\x1c\x7f": ""}),
    "line starts": (
        B.strip_line_starts,
        {
            "  > hi": "hi", "__ >foo": "foo", "_ _x": "_x", ">_f": "_f", "(2) two": "(2) two", " iv. x": "iv. x",
            "<html>": "html>", "....": "", "- - b": "b", "1.x": "1.x", "(a) q": "a) q", " (2) two": "(2) two",
            "(2)\ntwo": "2)\ntwo", "²x": "²x", "über": "über",
        },
    ),
    "blank start": ((B.strip_line_starts, B.drop_leading_blank_lines), {">\n\n a": "a", "\n\n": "", "a\n\nb": "a\n\nb"}),
    "tags": (
        B.TAG_STEPS,
        {
            "a<br>b<BR/>c<Br>d<br />e": "a\nb\nc<Br>d<br />e", "<p>x</p>": "\nx</p>", "x<html>y\nz</HTML>w": "xw",
            "a<header>b</head>c": "ac", "a<header>b</header>c": "ab</header>c", "a<title>b<title>c": "abc",
            "a<meta x": "a<meta x", "<script>1</script>2<script>3": "23",
        },
    ),
    "mojibake": (B.repair_mojibake, {"itâ€™s": "it's", "â€œqâ€": '"q"', "a" + chr(0xFFFD): "a", 'â€"': '""'}),
    "symbol lines": (
        B.drop_symbol_lines,
        {
            "x\n===\ny": "x\ny", "x\n--\ny": "x\ny", "x\na!!!!!!!!!": "x", "x\naaa!!!!!!!": "x\naaa!!!!!!!", "x\n!!": "x\n!!",
            "x\n-": "x\n-", "x\n\n y": "x\n\n y", "===": "", "x\n ___ ": "x",
        },
    ),
    "quote marks": (B.drop_quote_marks, {"a\n\n > b": "a\nb", "a\n>\nb": "a\nb", "> > x": "> x", ">\n  >x": ">x", ">\n>x": "x", "a > b": "a > b"}),
    "bullets": (B.drop_empty_bullets, {"a\n*\nb": "a\n\nb", "*\n\n-": "", "*\n-": "\n", "- x": "- x", "a\n \n* \n\n\nb": "a\n\nb"}),
    "after breaks": ((*B.TAG_STEPS, *SYMBOL_STEPS, B.left_trim_lines), {"a<br>> b": "a\nb", "a<br>* <br>b": "a\n\nb"}),
    "punctuation": (B.squeeze_punctuation, {"....": "....", ".....": "...", "-----": "-----", "------": "-----", "======": "=====", "==": "=="}),
    "lines changed": (B.count_line_starts, {"a\n b\n_c\n(1) d\n (1) d\n\n\n>": "4", "": "0"}),
}


@pytest.mark.parametrize("name", CASES)
def test_step(apply, name):
    steps, cases = CASES[name]
    assert dict(zip(cases, map(str, apply(steps, list(cases))))) == cases


def test_list_lines(apply):
    yes = ["1. a", "a. b", "B) c", "(12) d", "3) e", "IV. f", " xi.  g", "1. h"]
    no = ["1.a", "(a) b", "1 . a", "- a", "", "ab. c", "1. -"]
    assert apply(lambda c: B.is_list_line(c).cast("string"), yes + no) == ["true"] * len(yes) + ["false"] * len(no)


def test_order_of_steps_matters(apply):
    cases = {
        "<html>x</html>": "html>x</html>",  # the line start is stripped before tags are looked for
        "a <html>x</html> b": "a  b",
        "a<br>>b": "a\nb",
        "x <title/> y": "x  y",
    }
    assert dict(zip(cases, apply(clean_text, list(cases)))) == cases


def test_audit(spark):
    rows = ["=20x", "plain text", "", "  a\n\t> b\n(1) c", "a\r\nb", "a\rb", None, "   "]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    got = [r.a for r in df.select("i", clean_text_audited(F.col("t")).alias("a")).orderBy("i").collect()]
    lines = "Removed ALL leading spaces and symbols - {} lines modified (preserved structured lists flush left)"
    assert [g.cleaning_steps for g in got] == [
        ["Cleaned quoted-printable encoding", lines.format(1)],
        [],
        [],
        [lines.format(2)],
        ["Removed control characters and line ending artifacts"],
        [],
        [],
        ["Cleaned excessive whitespace", lines.format(1)],
    ]
    assert [(g.original_length, g.final_length, g.reduction_percent) for g in got[:4]] == [
        (4, 1, 75.0), (10, 10, 0.0), (0, 0, 0.0), (14, 9, 35.71)
    ]
    assert got[5].body == "a\nb"


def test_long_hostile_bodies_take_linear_time(apply):
    n = 60_000
    hostile = [
        "x" + "\n" * n + "y", "-----\n" * n, ">\n" * n, "a\n" + "*\n" * n, "<script>" * n, "<script " * n, "<html>" * n + "</html>",
        " \n\t" * n + ">", "a" + "\xa0\n" * n + "- b", "=" * n, "_" * n + ">x", "(1" * n,
    ]
    start = time.time()
    assert len(apply(clean_text, hostile)) == len(hostile)
    assert time.time() - start < 60


def test_filter_on_a_cleaned_body_keeps_the_plan_small(spark):
    df = spark.createDataFrame([("a <br> b",), ("c",)], "Body string").withColumn("Body", clean_text(F.col("Body")))
    kept = df.filter(F.col("Body").contains("a") & (F.length("Body") > 1) & ~F.col("Body").rlike("zz"))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<title") < 40
    assert kept.count() == 1
