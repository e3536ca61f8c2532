"""Record schemas. Field order is part of the contract: the first date-like column is found by position."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------------------------------------------
HEADER_FIELDS = (
    "Message-ID",
    "Date",
    "From",
    "To",
    "Subject",
    "Mime-Version",
    "Content-Type",
    "Content-Transfer-Encoding",
    "X-From",
    "X-To",
    "X-cc",
    "X-bcc",
    "X-Folder",
    "X-Origin",
    "X-FileName",
)
ADDRESS_FIELDS = ("From", "To", "X-cc", "X-bcc")
BOARD_FIELDS = ("Message-ID", "Date", "From", "To", "Subject", "Body", "X-From", "X-To")

RECORD_FIELDS = HEADER_FIELDS + ("Body", "SourceFile")

#: A structured mail record: strings only, a missing header is ``""``.
RECORD = T.StructType([T.StructField(name, T.StringType()) for name in RECORD_FIELDS])

#: A record that did not make it into the cleaned table, and why.
SKIP = T.StructType(
    [
        T.StructField("email_number", T.LongType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("from", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("skip_reason", T.StringType()),
        T.StructField("validation_errors", T.ArrayType(T.StringType())),
        T.StructField("has_subject", T.BooleanType()),
        T.StructField("has_body", T.BooleanType()),
        T.StructField("subject_length", T.IntegerType()),
        T.StructField("body_length", T.IntegerType()),
        T.StructField("skip_stage", T.StringType()),
    ]
)
# --- end of fixed values ----------------------------------------------------------------------------------------


def quoted(name: str) -> str:
    """Back-quote a column name; header names contain dashes and flattened ones contain dots."""
    return "`" + name.replace("`", "``") + "`"
