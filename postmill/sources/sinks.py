"""Writing records and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from postmill.operators.dedup import removal_lines


def write_records(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Records as ``parquet`` or as ``json`` lines (non-ASCII characters are written as they are)."""
    if form not in ("parquet", "json"):
        raise ValueError("form must be 'parquet' or 'json'")
    df.write.mode("overwrite").format(form).save(path)


def report_path(path: str) -> str:
    """Where the skip report of an output goes: ``x.json`` -> ``x_skipped_report.json``."""
    return path.replace(".json", "_skipped_report.json") if ".json" in path else path.rstrip("/") + "_skipped_report"


def write_skips(skips: DataFrame, path: str) -> bool:
    """Skip report as JSON lines, in place of any earlier one; false if nothing was skipped."""
    skips.write.mode("overwrite").json(path)
    return not skips.isEmpty()


def write_removals(removed: DataFrame, path: str) -> None:
    """Removal report, written even when it is empty."""
    removal_lines(removed).write.mode("overwrite").text(path)
