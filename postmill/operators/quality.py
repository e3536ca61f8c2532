"""Validation, routing and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import is_blank, once, round_half_even_2, strip, text_or_empty
from postmill.schema import SKIP, quoted

# --- fixed values -----------------------------------------------------------------------------------------------
NO_CONTENT = "Both subject and body are empty"
EMPTY_BODY = "not enough values to unpack (expected 5, got 0)"
CLEANED, VALIDATION, PROCESSING_ERROR = "cleaned", "validation", "processing_error"
UNKNOWN, EMPTY, NOT_AVAILABLE = "Unknown", "[EMPTY]", "N/A"
INVALID_LINE, ERROR_LINE = "Validation failed: ", "Processing error: "
# --- end of fixed values ----------------------------------------------------------------------------------------


def with_route(records: DataFrame, subject_only: str = "skip") -> DataFrame:
    """Add ``route``: ``validation`` without subject and body, ``processing_error`` for a subject without any body,
    else ``cleaned``.

    ``subject_only='keep'`` sends mail without a body to ``cleaned`` as well. A body of blanks is always cleaned.
    """
    if subject_only not in ("skip", "keep"):
        raise ValueError("subject_only must be 'skip' or 'keep'")

    def choose(r):
        route = F.when(is_blank(r["subject"]) & is_blank(r["body"]), VALIDATION)
        if subject_only == "skip":
            route = route.when(r["body"] == "", PROCESSING_ERROR)
        return route.otherwise(CLEANED)

    content = F.struct(
        text_or_empty(F.col("Subject")).alias("subject"), text_or_empty(F.col("Body")).alias("body")
    )
    return records.withColumn("route", once(content, choose))


def validation_errors(records: DataFrame) -> DataFrame:
    """Add ``validation_errors``, an empty array for a valid record."""
    invalid = is_blank(F.col("Subject")) & is_blank(F.col("Body"))
    none = F.array().cast("array<string>")
    return records.withColumn("validation_errors", F.when(invalid, F.array(F.lit(NO_CONTENT))).otherwise(none))


def profile(records: DataFrame) -> DataFrame:
    """Add identification with defaults, stripped lengths and presence flags."""
    subject = strip(text_or_empty(F.col("Subject")))
    body = strip(text_or_empty(F.col("Body")))

    def known(name: str):
        return F.coalesce(F.col(quoted(name)), F.lit(UNKNOWN))

    return records.withColumns(
        {
            "message_id": known("Message-ID"),
            "source_file": known("SourceFile"),
            "sender": known("From"),
            "sent": known("Date"),
            "shown_subject": F.when(subject == "", EMPTY).otherwise(subject),
            "has_subject": subject != "",
            "has_body": body != "",
            "subject_length": F.length(subject),
            "body_length": F.length(body),
        }
    )


def skipped_report(routed: DataFrame) -> DataFrame:
    """The records that were not cleaned, in the skip schema. Needs ``route`` and ``email_number``."""
    invalid = F.col("route") == VALIDATION
    errors = F.when(invalid, F.array(F.lit(NO_CONTENT)))
    reason = F.when(invalid, F.concat(F.lit(INVALID_LINE), F.array_join(errors, ", "))).otherwise(
        F.lit(ERROR_LINE + EMPTY_BODY)
    )
    columns = {
        "email_number": F.col("email_number"),
        "subject": F.col("shown_subject"),
        "from": F.col("sender"),
        "date": F.col("sent"),
        "skip_reason": reason,
        "validation_errors": errors,
        "skip_stage": F.col("route"),
    }
    rows = profile(routed.filter(F.col("route") != CLEANED))
    return rows.select(
        *[columns.get(f.name, F.col(quoted(f.name))).cast(f.dataType).alias(f.name) for f in SKIP.fields]
    )


def skip_details(skips: DataFrame) -> DataFrame:
    """The per-record listing of the run summary, ``N/A`` where a value is missing."""

    def shown(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(NOT_AVAILABLE)).alias(name)

    return skips.select(
        F.upper("skip_stage").alias("skip_stage"),
        "skip_reason",
        "email_number",
        "source_file",
        "message_id",
        "subject",
        shown("has_subject"),
        shown("has_body"),
        shown("subject_length"),
        shown("body_length"),
        F.array_join("validation_errors", ", ").alias("validation_errors"),
    )


def skips_by_reason(skips: DataFrame) -> DataFrame:
    """Number of skipped records per stage and reason. The members stay rows of the skip report."""
    return skips.groupBy("skip_stage", "skip_reason").agg(F.count(F.lit(1)).alias("emails"))


def run_summary(routed: DataFrame) -> DataFrame:
    """Totals and the success rate in percent (null without any record)."""
    counts = routed.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("route") == CLEANED).alias("processed"),
        F.count_if(F.col("route") != CLEANED).alias("skipped"),
        F.count_if(F.col("route") == VALIDATION).alias("skipped_at_validation"),
        F.count_if(F.col("route") == PROCESSING_ERROR).alias("skipped_on_error"),
    )
    rate = F.col("processed") / F.nullif(F.col("total"), F.lit(0)) * 100
    return counts.withColumn("success_rate", round_half_even_2(rate))
