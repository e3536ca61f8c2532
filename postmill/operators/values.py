"""Value counts, distinct domains and equality filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.schema import quoted

ALL = "All"


def top_values(df: DataFrame, column: str, k: int = 10, count: str = "count") -> DataFrame:
    """The ``k`` most frequent values, ties by value. Nulls are ignored, empty strings are not."""
    c = F.col(quoted(column))
    counts = df.filter(c.isNotNull()).groupBy(c.alias(column)).agg(F.count(F.lit(1)).alias(count))
    return counts.orderBy(F.desc(count), F.asc(quoted(column))).limit(k)


def distinct_values(df: DataFrame, column: str, placeholder: str | None = None) -> DataFrame:
    """Sorted distinct values. Nulls are dropped, or shown as ``placeholder`` if one is given."""
    c = F.col(quoted(column))
    rows = df.filter(c.isNotNull()) if placeholder is None else df
    shown = c if placeholder is None else F.coalesce(c, F.lit(placeholder))
    return rows.select(shown.alias(column)).distinct().orderBy(quoted(column))


def equal_to(df: DataFrame, column: str, value: str = ALL) -> DataFrame:
    """Rows whose ``column`` equals ``value``; ``All`` keeps everything."""
    return df if value == ALL else df.filter(F.col(quoted(column)) == F.lit(value))


def mail_list(df: DataFrame) -> DataFrame:
    """The browsing columns under their display names."""
    return df.withColumnsRenamed({"From": "Sender", "To": "Recipient"}).select(
        "Date", "Sender", "Recipient", "Subject", "Body"
    )


def row_count(df: DataFrame, name: str = "emails") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))
