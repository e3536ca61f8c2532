"""Dates of one written form, found out from the column itself."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.fields import MONTHS
from postmill.functions.text import once

_DAY, _YEAR, _NAME = "([0-9]{1,2})", "([0-9]{4})", "([a-z]{3})"
# --- fixed values -----------------------------------------------------------------------------------------------
#: Written forms of a day, the day before the month wherever both would do: name, pattern, groups of year, month, day.
DAYS = (
    ("d.m.Y", rf"{_DAY}\.{_DAY}\.{_YEAR}", "321"),
    ("d/m/Y", rf"{_DAY}/{_DAY}/{_YEAR}", "321"),
    ("d-m-Y", rf"{_DAY}-{_DAY}-{_YEAR}", "321"),
    ("d Mon Y", rf"{_DAY} {_NAME} {_YEAR}", "321"),
    ("Day, d Mon Y", rf"[a-z]{{3}}, {_DAY} {_NAME} {_YEAR}", "321"),
    ("Y-m-d", rf"{_YEAR}-{_DAY}-{_DAY}", "123"),
    ("Y/m/d", rf"{_YEAR}/{_DAY}/{_DAY}", "123"),
    ("m/d/Y", rf"{_DAY}/{_DAY}/{_YEAR}", "312"),
    ("m-d-Y", rf"{_DAY}-{_DAY}-{_YEAR}", "312"),
    ("m.d.Y", rf"{_DAY}\.{_DAY}\.{_YEAR}", "312"),
    ("Mon d, Y", rf"{_NAME} {_DAY}, {_YEAR}", "312"),
)
#: Written forms of a time of day behind it.
TIMES = (
    ("", ""), (" H:M:S", " ([0-9]{2}:[0-9]{2}:[0-9]{2})"), (" H:M", " ([0-9]{2}:[0-9]{2})"),
    ("TH:M:S", "t([0-9]{2}:[0-9]{2}:[0-9]{2})"), (" H:M:S.f", r" ([0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{1,6})"),
)
#: What may close a value: nothing, or the offset from UTC, with its comment in a mail header.
ZONES = (("", ""), (" z", r" ?(?:[+-][0-9]{2}:?[0-9]{2}|z)"), (" z (zone)", r" [+-][0-9]{4} \([^()]*\)"))
# --- end of fixed values ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Form:
    """One written form; values are compared in lower case."""

    name: str
    pattern: str
    order: str
    has_time: bool

    @property
    def named_month(self) -> bool:
        return "Mon" in self.name


#: Times with what may close them; a day alone has no offset.
_ENDS = tuple((time, t, zone, z) for time, t in TIMES for zone, z in ZONES if time or not zone)
FORMS = tuple(Form(day + time + zone, rf"\A{d}{t}{z}\z", order, bool(time)) for day, d, order in DAYS for time, t, zone, z in _ENDS)
BY_NAME = {form.name: form for form in FORMS}


def parse_form(c: Column, form: Form) -> Column:
    """Wall-clock timestamp of values in ``form``; null for any other value, and for days and times that don't exist.

    The offset from UTC is not applied, as elsewhere: what counts is the clock of the sender. Years before 1 don't exist.
    """
    year, month, day = form.order
    clock = "$4" if form.has_time else "00:00:00"

    def parsed(text: Column) -> Column:
        ordered = F.regexp_replace(text, form.pattern, f"${year}-${month}-${day} {clock}")
        if form.named_month:
            parts = F.split(ordered, "-", 3)
            number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.get(parts, F.lit(1)))
            ordered = F.concat(F.get(parts, F.lit(0)), F.lit("-"), number.cast("string"), F.lit("-"), F.get(parts, F.lit(2)))
        return F.when(text.rlike(form.pattern) & ~text.rlike(r"\b0000\b"), ordered)

    return once(F.lower(c), parsed).try_cast("timestamp_ntz")


def first_form(c: Column) -> Column:
    """Place in :data:`FORMS` of the first form that a value has as an existing time; null if none is.

    The day and what follows it are looked at apart, so that forms are not tried one by one.
    """
    day = rf"\A({'|'.join(d.replace('(', '(?:') for _, d, _ in DAYS)})"

    def found(text: Column) -> Column:
        date, rest = F.regexp_extract(text, day, 1), F.regexp_replace(text, day, "")
        days = [F.when(parse_form(date, FORMS[i * len(_ENDS)]).isNotNull(), F.lit(i)) for i in range(len(DAYS))]
        ends = [F.when(rest.rlike(rf"\A{t}{z}\z"), F.lit(i)) for i, (_, t, _, z) in enumerate(_ENDS)]
        clock = F.regexp_extract(rest, r"\A[ t]([0-9:.]+)", 1)
        exists = (clock == "") | F.concat(F.lit("2000-01-01 "), clock).try_cast("timestamp_ntz").isNotNull()
        return F.when(exists, F.coalesce(*days) * len(_ENDS) + F.coalesce(*ends))

    return once(F.lower(c), found)
