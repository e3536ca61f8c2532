"""Whole cleaning runs that readers see complete or not at all.

A run is written to a folder of its own; a manifest with the counts of what was written makes it whole, and one small
file that names the current run is swapped last. A run that stops half-way leaves the former one in place, and doing it
again, or doing it once more after it has succeeded, ends in the same tables.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.operators.quality import CLEANED, run_summary, skipped_report
from postmill.plans.corpus import CleanRun, run_cleaning
from postmill.schema import SKIP
from postmill.session import remove
from postmill.sources.sinks import report_path

_MANIFEST, _POINTER = "manifest.json", "current.json"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def read_small(spark: SparkSession, path: str) -> dict | None:
    """A small JSON file, or None where there is none."""
    system, where = _file_system(spark, path)
    if not system.exists(where):
        return None
    stream = system.open(where)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def swap_small(spark: SparkSession, path: str, value: dict) -> None:
    """Put a small JSON file in place of an earlier one by a single rename."""
    jvm = spark._jvm
    _, where = _file_system(spark, path)
    staged = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}.staged")
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = system.create(staged, True)
    try:
        stream.write(bytearray(json.dumps(value, sort_keys=True, indent=1).encode()))
    finally:
        stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(system.makeQualified(staged), system.makeQualified(where), options)


@dataclass(frozen=True)
class Run:
    """A committed run: its tables as read back, and the manifest that vouches for them."""

    tables: CleanRun
    manifest: dict


def _folder(output: str, run: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", run):
        raise ValueError("a run is named by letters, digits, dots and dashes")
    return f"{output.rstrip('/')}/runs/{run}"


def _tables(spark: SparkSession, folder: str, fields: dict) -> CleanRun:
    # A run without rows has no file that could tell the columns.
    schema = T.StructType([*T.StructType.fromJson(fields).fields, T.StructField("route", T.StringType())])
    table = spark.read.schema(schema).parquet(f"{folder}/tables/records")
    return CleanRun(table.filter(F.col("route") == CLEANED).drop("route"), skipped_report(table), run_summary(table))


def counted(tables: CleanRun, report: DataFrame) -> dict:
    """Rows as they are in storage; the summary must add up to them."""
    summary = {name: value if value is None or name == "success_rate" else int(value) for name, value in tables.summary.first().asDict().items()}
    found = {"cleaned": tables.cleaned.count(), "report": report.count()}
    if found["cleaned"] != summary["processed"] or found["report"] != summary["skipped"] or sum(found.values()) != summary["total"]:
        raise RuntimeError(f"written tables and summary differ: {found}, {summary}")
    return summary | found


def commit_run(records: DataFrame, output: str, run: str, subject_only: str = "skip", json_export: bool = False) -> Run:
    """Clean ``records`` as run ``run`` of ``output`` and make it the current one.

    What an earlier attempt under the same name left behind is overwritten; a run that is already whole is not done
    again but made current. The manifest is written when all tables are, with their counts; the pointer is swapped last.
    """
    spark, folder = records.sparkSession, _folder(output, run)
    manifest = read_small(spark, f"{folder}/{_MANIFEST}")
    if manifest is None:
        fields = run_cleaning(records, f"{folder}/tables", subject_only, json_export).cleaned.schema.jsonValue()
        report = spark.read.schema(SKIP).json(report_path(f"{folder}/tables"))
        manifest = {"run": run, "fields": fields, "counts": counted(_tables(spark, folder, fields), report)}
        swap_small(spark, f"{folder}/{_MANIFEST}", manifest)
    swap_small(spark, f"{output.rstrip('/')}/{_POINTER}", {"run": run})
    return Run(_tables(spark, folder, manifest["fields"]), manifest)


def current_run(spark: SparkSession, output: str) -> Run | None:
    """The run that ``output`` stands for now; None before the first one is whole."""
    pointer = read_small(spark, f"{output.rstrip('/')}/{_POINTER}")
    if pointer is None:
        return None
    folder = _folder(output, pointer["run"])
    manifest = read_small(spark, f"{folder}/{_MANIFEST}")
    return Run(_tables(spark, folder, manifest["fields"]), manifest)


def drop_run(spark: SparkSession, output: str, run: str) -> None:
    """Remove a run that is not the current one, whole or not."""
    pointer = read_small(spark, f"{output.rstrip('/')}/{_POINTER}")
    if pointer and pointer["run"] == run:
        raise ValueError("the current run stays")
    remove(spark, _folder(output, run))
