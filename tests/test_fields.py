from postmill.functions.fields import clean_addresses, european_date, parse_european
from postmill.functions.headers import header_field, header_lines, message_body, split_message
from postmill.functions.names import base_name, extension, is_mail_file, natural_key, with_txt_suffix
from postmill.functions.text import REPLACEMENT, SPACE_CHARS, is_blank, lenient_utf8, round_half_even_2, strip, unify_line_breaks, words
from postmill.operators.parse import parse_messages
from pyspark.sql import functions as F


def check(apply, step, cases):
    assert dict(zip(cases, apply(step, list(cases)))) == cases


def test_whitespace_is_unicode_whitespace(apply):
    assert set(SPACE_CHARS) == {chr(i) for i in range(0x110000) if chr(i).isspace()}
    check(apply, strip, {f"{c}a{c}b{c}": f"a{c}b" for c in SPACE_CHARS} | {SPACE_CHARS: "", chr(0x200B) + "x": chr(0x200B) + "x"})
    assert apply(lambda c: is_blank(c).cast("string"), ["", SPACE_CHARS, "\x85x", None]) == ["true", "true", "false", "true"]


def test_words(apply):
    cases = {"Re: Über-x_1 ²y": "re über x_1 ²y", "": "", "--": "", None: ""}
    check(apply, lambda c: F.array_join(words(c), " "), cases)


def test_line_breaks(apply):
    check(apply, unify_line_breaks, {"a\r\nb\rc\x0bd\x0ce\x1cf\x85g" + chr(0x2028) + "h\x1fi": "a\nb\nc\nd\ne\nf\ng\nh\x1fi"})


def test_lenient_decoding(spark):
    rows = [(1, b"a\xffb\r\nc\rd"), (2, "über".encode()), (3, "über".encode()[:1]), (4, b"")]
    df = spark.createDataFrame(rows, "i int, b binary").select("i", lenient_utf8(F.col("b")).alias("t"))
    assert {r.i: r.t for r in df.collect()} == {1: "ab\nc\nd", 2: "über", 3: "", 4: ""}
    assert REPLACEMENT == "\N{REPLACEMENT CHARACTER}"


def test_rounding_agrees_with_exact_rounding(spark):
    import random

    rng = random.Random(3)
    pairs = [(a, b) for b in range(1, 420) for a in range(0, b + 1)]
    pairs += [(rng.randint(0, b), b) for b in (rng.randint(1, 10**7) for _ in range(20000))]
    df = spark.createDataFrame(pairs, "a int, b int").select("a", "b", round_half_even_2(F.col("a") / F.col("b") * 100).alias("r"))
    assert [r for r in df.collect() if r.r != round(r.a / r.b * 100, 2)] == []


def test_addresses(apply):
    cases = {
        "a;,b": "a, , b", "Bob <  b@x.com >;c@y.com": "Bob b@x.com, c@y.com", "": "", "a,": "a, ", "<a,b>": "<a, b>",
        "< >;x": " , x", "<<a>>": "<a>", "\xa0a\t; b": "a, b", None: None,
    }
    check(apply, clean_addresses, cases)


def test_european_dates(apply):
    same = ["31 Feb 2001 10:00:00", "not a date", "", "0 May 2001 10:00:00", "5 Mai 2001 10:00:00", "5 May 0000 10:00:00",
            "x (5 May 2001 10:00:00)", "a\n5 May 2001 10:00:00", "5 May 2001 1:00:00", "32 May 2001 10:00:00"]
    cases = {s: s for s in same} | {
        "Mon, 14 May 2001 16:39:00 -0700 (PDT)": "14.05.2001 16:39:00", "4 mAY 2001 99:99:99": "04.05.2001 99:99:99",
        "114 May 2001 10:00:00": "14.05.2001 10:00:00", " 04 Dec 0999 01:02:03 +0000": "04.12.0999 01:02:03",
        "29 Feb 2000 00:00:00": "29.02.2000 00:00:00", None: None,
    }
    check(apply, european_date, cases)


def test_parsing_european_dates(apply):
    cases = {
        "14.05.2001 16:39:00": "2001-05-14 16:39:00", "31.02.2001 10:00:00": None, "04.05.2001 99:99:99": None,
        "2001-05-14 16:39:00": None, "not a date": None, "": None, None: None, "1.5.2001 10:00:00": None,
    }
    check(apply, lambda c: parse_european(c).cast("string"), cases)


def test_extensions(apply):
    check(apply, extension, {"1.": ".", "1": "", "a.1": ".1", "a. 12": ". 12", "b.TXT": ".TXT", ".DS_Store": "", "..a": "", "a..b": ".b", "x.y.z": ".z"})
    mail = ["1", "a.1", "a. 12", "b.TXT", "c.txt", ".DS_Store"]
    other = ["1.", "x.csv", "a.1b"]
    assert apply(lambda c: is_mail_file(c).cast("string"), mail + other) == ["true"] * 6 + ["false"] * 3
    check(apply, with_txt_suffix, {"1": "1.txt", "a.1": "a.1.txt", "b.TXT": "b.TXT", "1.": "1.", "x.csv": "x.csv", ".DS_Store": ".DS_Store.txt"})
    check(apply, base_name, {"file:/a/b/1.": "1.", "x": "x"})


def test_natural_order(spark):
    import random

    names = ["10", "2", "1", "-a", "a", "m1", "m2", "m10", "m", "m10b2", "m10b10", "m010", "x" + "9" * 30, "x1" + "0" * 30, "é1", "m2.txt"]
    shuffled = random.Random(1).sample(names, len(names))
    df = spark.createDataFrame([(n,) for n in shuffled], "n string")
    got = [r.n for r in df.orderBy(natural_key(F.col("n")), "n").collect()]
    assert got == ["1", "2", "10", "-a", "a", "m", "m1", "m2", "m2.txt", "m010", "m10", "m10b2", "m10b10", "x" + "9" * 30, "x1" + "0" * 30, "é1"]


def message(apply, name):
    return lambda c: header_field(header_lines(split_message(c)), name)


def test_headers(apply):
    folded = "Subject: a\ngarbage\n  cont\nTo:\n\tfoo,\n bar \nSubject: b\n c\n\nbody"
    check(apply, message(apply, "Subject"), {
        folded: "b c", "Subject: x": "x", " Subject: x\n\n": "", "subject: x\n\n": "", "\nSubject: x": "", "Subject:\xa0x\t\n\n": "x",
        "A: 1\nSubject: x\nB: 2\n more\n\nSubject: y": "x", "Subject : x\n\n": "", "": "", None: "", "Subject: a\r\n\tb\r\n\r\nc": "a b",
    })
    check(apply, message(apply, "To"), {folded: " foo, bar", "  first\nTo: x\n\n": "x", "To: x\njunk\n y\n\n": "x y"})


def test_bodies(apply):
    whole = "Subject: x\nno blank line"
    check(apply, lambda c: message_body(split_message(c)), {
        whole: whole, "\nA: b": "A: b", "A: b\n\n c \n\nd\n": "c \n\nd", "A: b\n \t\nx": "x", "A: b\n  ": "", "A: b\n": "A: b",
        "A: b\n\n": "", "": "", None: "", "A: b\x0b\x0cx\x85y": "x\ny", "  ": "",
    })


def test_records(spark):
    df = spark.createDataFrame([("file:/c/f/3.", "From: a\nX-cc: b\nCc: c\n\nhi")], "path string, text string")
    row = parse_messages(df, keep=("path",)).first().asDict()
    assert row["From"] == "a" and row["X-cc"] == "b" and row["Body"] == "hi" and row["SourceFile"] == "3."
    assert row["Date"] == "" and "Cc" not in row and len(row) == 18
