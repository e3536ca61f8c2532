"""From raw files to cleaned records with reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.names import base_name, is_mail_file, natural_key, txt_name
from postmill.operators.clean import clean_fields, clean_text, clean_text_audited
from postmill.operators.dedup import last_per_name, surviving_paths
from postmill.operators.ordering import with_position
from postmill.operators.parse import parse_messages
from postmill.operators.quality import CLEANED, run_summary, skipped_report, with_route
from postmill.schema import RECORD_FIELDS, quoted
from postmill.sources.sinks import report_path, write_records, write_skips


def corpus_to_records(
    files: DataFrame,
    rename: bool = True,
    dedup: bool = True,
    collapse: bool = True,
    number: str | None = None,
    text: str = "text",
) -> DataFrame:
    """Records of a corpus ``(path, text[, hash])`` with the ``path`` they came from.

    ``rename`` gives extension-less files their ``.txt`` name, ``dedup`` keeps the first copy of each content,
    ``collapse`` keeps one file per name (names repeat across folders, so this loses mail; it is the default because
    results must match, and ``dedup.collapsed_files`` lists what is lost). ``number`` names a column for the 1-based place in natural order of file names.

    A new name never replaces the path: ``1`` and ``1.txt`` of one folder stay two files. Survivors are found and
    numbered on keys alone; one join on the unique path then shuffles the texts once.
    """
    name = txt_name if rename else base_name
    files = files.filter(is_mail_file(base_name(F.col("path"))))
    paths = None
    if dedup:
        paths = surviving_paths(files, text, collapse, name)
    elif collapse:
        paths = last_per_name(files.select("path", name(F.col("path")).alias("file_name")))
    if number:
        paths = files.select("path") if paths is None else paths
        named = paths.withColumn("SourceFile", name(F.col("path")))
        files = files.join(with_position(named, natural_order(), number, start=1).select("path", number), "path")
    elif paths is not None:
        files = files.join(paths, "path", "left_semi")
    return parse_messages(files, text, ("path", number) if number else ("path",), name)


def natural_order() -> list[Column]:
    """Ordering by source file name with numbers compared as numbers."""
    return [natural_key(F.col("SourceFile")), F.col("SourceFile"), F.col("path")]


def process_records(records: DataFrame, subject_only: str = "skip", audit: str | None = "audit") -> DataFrame:
    """Route every record and clean the fields and the body of those that pass. One narrow stage, no shuffle.

    Skipped records keep their original values and get no audit. Columns beyond the record fields are kept.
    """
    passed = F.col("route") == CLEANED
    fields = clean_fields(with_route(records, subject_only), where=passed)
    if audit is None:
        return fields.withColumn("Body", F.when(passed, clean_text(F.col("Body"))).otherwise(F.col("Body")))
    cleaned = fields.withColumn(audit, F.when(passed, clean_text_audited(F.col("Body"))))
    body = F.coalesce(F.col(audit)["body"], F.col("Body"))
    return cleaned.withColumns({"Body": body, audit: F.col(audit).dropFields("body")})


def cleaned_records(records: DataFrame, subject_only: str = "skip") -> DataFrame:
    """The cleaned records only. Reports that do not show bodies never clean them, as unused columns are pruned."""
    passed = with_route(records, subject_only).filter(F.col("route") == CLEANED).drop("route")
    fields = clean_fields(passed)
    return fields.withColumn("Body", clean_text(F.col("Body")))


@dataclass(frozen=True)
class CleanRun:
    """Tables of a finished run, read back from storage."""

    cleaned: DataFrame
    skipped: DataFrame
    summary: DataFrame


def run_cleaning(records: DataFrame, output: str, subject_only: str = "skip", json_export: bool = False) -> CleanRun:
    """Clean ``records`` (which carry ``email_number``) into ``output``.

    The long regex stage runs once: its result is written partitioned by route, and every table and report is read
    from there with only the columns it needs. Nothing is cached, so the job survives lost executors.
    """
    spark = records.sparkSession
    staged = output.rstrip("/") + "/records"
    processed = process_records(records, subject_only)
    processed.write.mode("overwrite").partitionBy("route").parquet(staged)

    table = spark.read.schema(processed.schema).parquet(staged)
    cleaned = table.filter(F.col("route") == CLEANED).drop("route")
    skipped = skipped_report(table)
    write_skips(skipped, report_path(output))
    if json_export:
        write_records(cleaned.select(*[quoted(n) for n in RECORD_FIELDS if n in cleaned.columns]), output + "/json", "json")
    return CleanRun(cleaned, skipped, run_summary(table))
