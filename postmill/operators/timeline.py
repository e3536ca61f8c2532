"""Time-based analytics: finding and parsing the date column, filtering, daily and hourly volume."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.dates import BY_NAME, FORMS, first_form, parse_form
from postmill.functions.fields import parse_european
from postmill.functions.patterns import translated
from postmill.schema import quoted

# --- fixed values -----------------------------------------------------------------------------------------------
DATE_HINTS = ("date", "time", "timestamp")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
# --- end of fixed values ----------------------------------------------------------------------------------------

TIME = "DateTime"


def date_like_columns(df: DataFrame) -> list[str]:
    """Columns whose name hints at a date, in schema order."""
    return [name for name in df.columns if any(hint in name.lower() for hint in DATE_HINTS)]


def first_date_column(df: DataFrame) -> str:
    names = date_like_columns(df)
    if not names:
        raise ValueError("no date-like column among: " + ", ".join(df.columns))
    return names[0]


def with_time(df: DataFrame, column: str | None = None) -> DataFrame:
    """Add ``DateTime`` parsed from ``column`` (default: the first date-like one) and drop rows that do not parse."""
    column = column or first_date_column(df)
    return df.withColumn(TIME, parse_european(F.col(quoted(column)))).filter(F.col(TIME).isNotNull())


def inferred_form(df: DataFrame, column: str | None = None, order: Sequence[str] = ("email_number",)) -> str | None:
    """Name of the written form of ``column``: that of the first value, by ``order``, that is a time in any known form.

    Where day and month could be either, the day comes first. None if no value is a time. An ordered minimum over
    (order, form), so only one row per task travels.
    """
    form = first_form(F.col(quoted(column or first_date_column(df)))).alias("form")
    known = df.select(*[F.col(quoted(o)).alias(f"o{i}") for i, o in enumerate(order)], form).filter("form is not null")
    found = known.agg(F.min(F.struct(*known.columns)).alias("first")).select("first.form").first()
    return None if found.form is None else FORMS[found.form].name


def with_inferred_time(df: DataFrame, column: str | None = None, order: Sequence[str] = ("email_number",)) -> DataFrame:
    """As :func:`with_time`, for a column in any one known form: values in another form than the first are dropped."""
    column = column or first_date_column(df)
    form = inferred_form(df, column, order)
    parsed = F.lit(None).cast("timestamp_ntz") if form is None else parse_form(F.col(quoted(column)), BY_NAME[form])
    return df.withColumn(TIME, parsed).filter(F.col(TIME).isNotNull())


def in_time_order(df: DataFrame, tie: str = "Message-ID") -> DataFrame:
    return df.orderBy(TIME, quoted(tie))


def time_bounds(df: DataFrame) -> DataFrame:
    """First and last calendar day."""
    return df.agg(F.min(TIME).cast("date").alias("min_date"), F.max(TIME).cast("date").alias("max_date"))


def on_days(df: DataFrame, start: date, end: date, time: str = TIME) -> DataFrame:
    """Rows from ``start`` to ``end``, both days included, as a half-open range that reaches the scan."""
    after = F.lit(end + timedelta(days=1)).cast("timestamp_ntz")
    return df.filter((F.col(time) >= F.lit(start).cast("timestamp_ntz")) & (F.col(time) < after))


def from_senders(df: DataFrame, senders: Sequence[str] | DataFrame, column: str = "From") -> DataFrame:
    """Rows of the selected senders. Null senders never match.

    A list becomes an ``IN``. A frame (first column) becomes a semi join, for which adaptive execution broadcasts the
    senders only if their measured size allows and splits a hot sender otherwise.
    """
    if isinstance(senders, DataFrame):
        chosen = senders.select(F.col(quoted(senders.columns[0])).alias(column)).distinct()
        return df.join(chosen, column, "left_semi")
    return df.filter(F.col(quoted(column)).isin(list(senders)))


def subject_matches(df: DataFrame, keyword: str | None, literal: bool = False, column: str = "Subject") -> DataFrame:
    """Rows whose subject contains the keyword, a case-insensitive pattern in Python's syntax unless ``literal``."""
    if not keyword:
        return df
    pattern = translated(re.escape(keyword) if literal else keyword)
    try:  # a pattern that the engine does not take is reported here, not by every task
        df.sparkSession._jvm.java.util.regex.Pattern.compile("(?iud)" + pattern)
    except Py4JJavaError as error:
        raise ValueError(f"invalid pattern: {keyword}") from error
    return df.filter(F.coalesce(F.col(quoted(column)).rlike("(?iud)" + pattern), F.lit(False)))


def select_mail(
    df: DataFrame,
    start: date,
    end: date,
    senders: Sequence[str] | DataFrame,
    keyword: str | None = None,
    literal: bool = False,
) -> DataFrame:
    """Date range, senders and keyword together."""
    return subject_matches(from_senders(on_days(df, start, end), senders), keyword, literal)


def timeline_points(df: DataFrame, tie: str = "Message-ID") -> DataFrame:
    """The points of the timeline, senders A-Z and then by time."""
    return df.orderBy("From", TIME, quoted(tie)).select(TIME, "From", "Subject")


def daily_volume(df: DataFrame, time: str = TIME) -> DataFrame:
    """``(day, emails)`` for every day from the first to the last, zero where nothing was sent.

    The calendar joins by union and sum: its zero rows meet the daily counts in a second, tiny aggregation, so nothing
    has to be broadcast.
    """
    days = df.groupBy(F.col(time).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("emails"))
    days = days.filter(F.col("day").isNotNull())
    # The total keeps this branch on the same daily counts, which Spark then computes once for both.
    bounds = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.sum("emails").alias("total"))
    bounds = bounds.filter(F.col("total") > 0)
    calendar = bounds.select(F.explode(F.sequence("lo", "hi")).alias("day"), F.lit(0).cast("bigint").alias("emails"))
    return days.unionByName(calendar).groupBy("day").agg(F.sum("emails").alias("emails")).orderBy("day")


def _weekday_name(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in WEEKDAYS]), number + 1)


def weekday_hour(df: DataFrame, time: str = TIME) -> DataFrame:
    """``(day_order, day_of_week, hour, emails)``, Monday first, only where there is mail."""
    c = F.col(time)
    counts = df.filter(c.isNotNull()).groupBy(
        F.weekday(c.cast("date")).alias("day_order"), F.hour(c).alias("hour")
    ).agg(F.count(F.lit(1)).alias("emails"))
    named = counts.withColumn("day_of_week", _weekday_name(F.col("day_order")))
    return named.select("day_order", "day_of_week", "hour", "emails").orderBy("day_order", "hour")


def weekday_hour_grid(df: DataFrame, time: str = TIME) -> DataFrame:
    """The same with all 7 x 24 cells."""
    slots = df.sparkSession.range(7 * 24)
    empty = slots.select(
        F.floor(F.col("id") / 24).cast("int").alias("day_order"),
        (F.col("id") % 24).cast("int").alias("hour"),
        F.lit(0).cast("bigint").alias("emails"),
    )
    seen = weekday_hour(df, time).select("day_order", "hour", "emails")
    cells = seen.unionByName(empty).groupBy("day_order", "hour").agg(F.sum("emails").alias("emails"))
    named = cells.withColumn("day_of_week", _weekday_name(F.col("day_order")))
    return named.select("day_order", "day_of_week", "hour", "emails").orderBy("day_order", "hour")
