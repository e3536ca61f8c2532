"""Random bodies and messages through the Spark patterns and through the line-by-line SQL."""

import random

import pytest
from pyspark.sql import functions as F

from postmill.functions import body as B
from postmill.operators.clean import clean_text, clean_text_audited
from postmill.operators.parse import parse_messages
from postmill.schema import RECORD_FIELDS
from workload import oracle

TOKENS = [
    "\n", "\n", "\n", "\n\n", " ", " ", "  ", "\t", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", chr(0x2028),
    chr(0x3000), ">", ">", "*", "-", "=", "_", "~", "#", "|", "+", ".", "!", "•", "⁃", "a", "B", "x y", "é", "²", "7",
    "(1) x", "(2)", "1. y", "IV. z", "b) q", "<br>", "<BR/>", "<p>", "<br />", "<html>", "</html>", "<head x>", "<header>",
    "</HEAD>", "<STYLE a>", "</style>", "<" + chr(0x17F) + "tyle>", "<script", "</script>", "<title/>", "=20", "=3D",
    "=\n", "=09", "=22", "â€™", "â€œ", "â€", chr(0xFFFD), "\x07", "\x7f", "......", "-------", "======", ":",
]


def texts(seed, n, most=14):
    rng = random.Random(seed)
    return ["".join(rng.choices(TOKENS, k=rng.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def bodies(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bodies"))
    rows = list(enumerate(texts(7, 6000) + texts(8, 300, most=120)))
    spark.createDataFrame(rows, 'id int, "Body" string'.replace('"', "")).repartition(4).write.mode("overwrite").parquet(path)
    return path


def compare(spark, duck, df, sql, path):
    duck.execute(f"CREATE OR REPLACE VIEW bodies AS SELECT * FROM '{path}/*.parquet'")
    got = {r[0]: tuple(r[1:]) for r in df.collect()}
    want = {r[0]: tuple(r[1:]) for r in duck.execute(sql).fetchall()}
    source = dict(duck.execute('SELECT id, "Body" FROM bodies').fetchall())
    wrong = [(source[k], got[k], want[k]) for k in want if got[k] != want[k]]
    assert not wrong, (len(wrong), sorted(wrong, key=lambda w: len(w[0]))[:3])
    assert len(got) == len(want)


STEPS = {
    "escapes": ((B.decode_escapes,), oracle.escapes),
    "spaces": ((B.squeeze_spaces,), oracle.spaces),
    "controls": ((B.drop_controls,), oracle.controls),
    "leading": ((B.strip_line_starts, B.drop_leading_blank_lines), oracle.leading),
    "tags": (B.TAG_STEPS, oracle.tags),
    "mojibake": ((B.repair_mojibake,), oracle.mojibake),
    "symbols": ((B.drop_symbol_lines, B.drop_quote_marks, B.drop_empty_bullets), oracle.symbol_lines),
    "trim": ((B.left_trim_lines,), oracle.left_trim),
    "punctuation": ((B.squeeze_punctuation, B.strip), lambda t: oracle.strip(oracle.punctuation(t))),
    "changed": ((B.count_line_starts,), oracle.changed),
}


@pytest.mark.parametrize("name", STEPS)
def test_step(spark, duck, bodies, name):
    steps, sql = STEPS[name]
    df = spark.read.parquet(bodies)
    for step in steps:
        df = df.withColumn("Body", step(F.col("Body")))
    column = '"Body"'
    compare(spark, duck, df, f"SELECT id, {sql(column)} FROM bodies", bodies)


def test_chain(spark, duck, bodies):
    df = spark.read.parquet(bodies).select("id", clean_text(F.col("Body")))
    compare(spark, duck, df, oracle.with_(oracle.chain("bodies", "Body")) + "SELECT id, clean FROM done", bodies)


def test_chain_with_audit(spark, duck, bodies):
    df = spark.read.parquet(bodies).select("id", clean_text_audited(F.col("Body")).alias("audit")).select(
        "id", "audit.body", F.array_join("audit.cleaning_steps", " | "), "audit.original_length",
        "audit.final_length", "audit.reduction_percent",
    )
    sql = oracle.with_(oracle.chain("bodies", "Body")) + oracle.audit_sql("id, clean")
    compare(spark, duck, df, sql, bodies)


def test_cleaned_bodies_keep_their_promises(spark, bodies):
    df = spark.read.parquet(bodies).withColumn("clean", clean_text(F.col("Body")))
    bad = df.filter(
        F.col("clean").rlike(r"(?md)^[ \t]") | F.col("clean").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\r]")
        | (F.length("clean") > F.length("Body"))
    )
    assert bad.count() == 0


MESSAGE_TOKENS = [
    "\n", "\n", "\n", "\n\n", "\r\n", " ", "\t", "\n ", "\n\t", "\n  \n", "\x0b", "\x85", chr(0x2029), "\xa0", "Subject:",
    "Subject: ", "To:", "To: a@b.c", "X-cc:", "From:", "Date :", "Cc: x", "subject: low", "é-1: v", "junk line", "http://u", "v",
    " w ", ":", "Message-ID: <1>", "X-FileName:  f ",
]


def test_parse(spark, duck, tmp_path):
    rng = random.Random(11)
    rows = [(i, f"/a/{i}", "".join(rng.choices(MESSAGE_TOKENS, k=rng.randint(0, 16)))) for i in range(6000)]
    path = str(tmp_path / "raw")
    spark.createDataFrame(rows, "doc_id int, path string, text string").repartition(4).write.parquet(path)
    duck.execute(f"CREATE VIEW raw AS SELECT * FROM '{path}/*.parquet'")
    df = parse_messages(spark.read.parquet(path), keep=("doc_id",))
    got = {r.doc_id: tuple(r[1:]) for r in df.collect()}
    sql = oracle.with_(oracle.parsed("raw", "doc_id")) + f"SELECT doc_id, {oracle.ALL_FIELDS} FROM parsed"
    want = {r[0]: tuple(r[1:]) for r in duck.execute(sql).fetchall()}
    wrong = [(rows[k][2], [(n, g, w) for n, g, w in zip(RECORD_FIELDS, got[k], want[k]) if g != w]) for k in want if got[k] != want[k]]
    assert not wrong, (len(wrong), sorted(wrong, key=lambda w: len(w[0]))[:3])
