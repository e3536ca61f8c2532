"""Mail-shaped frames over the given tables.

Every document is used in full. Events only date and address the mail: those without a document are left out, and a
document without an event has an empty date and the sender ``User 0``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.ordering import spread, with_position
from postmill.plans.corpus import cleaned_records
from postmill.schema import RECORD_FIELDS, quoted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per document, dated and addressed by the event with the same number (see FIXTURES.md).

    Bodies are decorated by document number so that every cleaning step meets its case.
    """
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    df = docs.join(events, docs.doc_id == events.event_id, "left")
    df = df.fillna({"user_id": 0, "event_type": "none"})
    i, text = F.col("doc_id"), F.col("text")
    n = i.cast("string")

    def cat(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    sent = cat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), " -0700 (PDT)")
    user = F.col("user_id").cast("string")
    decorated = {
        1: cat("> ", text),
        2: cat(text, "\n==========\n1. one\n* two"),
        3: cat("a=20b =3D c=\nd ", text),
        4: cat("x<br>y<STYLE a>z</STYLE>", text),
        5: cat(text, "\r\n\n\n\n\nend......."),
        6: cat("    ", text, "\t\t\tz"),
        7: cat("__ >", text, "\n>\ntail"),
        8: cat(text, "\na!!!!!!!!!\n-"),
        9: cat("a\x07b ", text, " itâ€™s"),
    }
    body = F.when(i % 20 == 0, "")
    for case, value in decorated.items():
        body = body.when(i % 10 == case, value)
    columns = {
        "Message-ID": cat("<", n, ".", F.col("n_chars").cast("string"), "@", F.col("source"), ".example.org>"),
        "Date": F.when((i % 37 == 0) | F.col("ts").isNull(), "").when(i % 41 == 0, "not a date").otherwise(sent),
        "From": cat("User ", user, " <u", user, "@", F.col("event_type"), ".example.com>"),
        "To": F.when(i % 13 == 0, "").otherwise(
            cat(
                "a", (i % 7).cast("string"), "@x.example.com;  B < b", (i % 11).cast("string"),
                "@y.example.com >,c@z.example.com",
            )
        ),
        "Subject": F.when(i % 25 == 0, "").otherwise(F.substring_index(text, "\n", 1)),
        "Mime-Version": F.lit("1.0"),
        "Content-Type": F.lit("text/plain; charset=us-ascii"),
        "Content-Transfer-Encoding": F.lit("7bit"),
        "X-From": cat("User ", user),
        "X-To": F.lit("B"),
        "X-cc": F.when(i % 9 == 0, "d@w.example.com;E <e@v.example.com>").otherwise(""),
        "X-bcc": F.lit(""),
        "X-Folder": cat("\\", F.col("source"), "\\inbox"),
        "X-Origin": F.col("source"),
        "X-FileName": cat(F.col("lang"), ".pst"),
        "Body": body.otherwise(text),
        "SourceFile": cat(n, "."),
    }
    return df.select("doc_id", *[columns[name].alias(name) for name in RECORD_FIELDS])


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the dashboards read: the cleaned records."""
    return cleaned_records(mail(spark, sf_dir))


def mail_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, email_number)``: the place of each mail in id order, worked out on ids only."""
    return with_position(mail(spark, sf_dir).select("doc_id"), ["doc_id"], "email_number", start=1)


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, path, text)``: mail written out as message files, with awkward headers and file names."""
    df = mail(spark, sf_dir)
    i, n = F.col("doc_id"), F.col("doc_id").cast("string")
    to = F.regexp_replace("To", ",", ",\n\t")
    lines = [
        F.concat(F.lit("Message-ID: "), F.col(quoted("Message-ID"))),
        F.concat(F.lit("Date: "), F.col("Date")),
        F.concat(F.lit("From: "), F.col("From")),
        F.concat(F.lit("To: "), to),
        F.concat(F.lit("Subject: "), F.col("Subject")),
        F.when(i % 17 == 0, F.concat(F.lit("Subject: Re: "), F.col("Subject"))),
        F.when(i % 23 == 0, F.lit("a line that is no header\n  continued")),
        F.concat(F.lit("X-Folder: "), F.col(quoted("X-Folder"))),
    ]
    head = F.concat_ws("\n", *lines)
    gap = F.when(i % 19 == 0, "\n").otherwise("\n\n")
    m = (i % 50).cast("string")
    name = (
        F.when(i % 6 == 0, m)
        .when(i % 6 == 1, F.concat(F.lit("m"), m, F.lit(".txt")))
        .when(i % 6 == 2, F.concat(m, F.lit(".")))
        .when(i % 6 == 3, F.concat(F.lit("m"), m, F.lit(".7")))
        .when(i % 6 == 4, F.lit("M.TXT"))
        .otherwise(F.concat(F.lit("x"), n, F.lit(".csv")))
    )
    folder = F.col(quoted("X-Origin"))
    return df.select(
        "doc_id",
        F.concat(F.lit("/"), folder, F.lit("/"), n, F.lit("/"), name).alias("path"),
        F.concat(head, gap, F.col("Body")).alias("text"),
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, text)``: every document as a text file."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(path.alias("path"), "text")
