"""Address lists and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import SPACE, WORD, once, strip

# --- fixed values -----------------------------------------------------------------------------------------------
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# --- end of fixed values ----------------------------------------------------------------------------------------

_ANGLE = rf"<[{SPACE}]*([^<>]+?)[{SPACE}]*>"
_TRAILING_COMMENT = rf"(?d)(?<![{SPACE}])[{SPACE}]++\(.*?\)\z"
_DAY_AND_TIME = rf"(?d)\A.*?([0-9]{{1,2}} [{WORD}]{{3}} [0-9]{{4}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})"
_EUROPEAN = r"\A[0-9]{2}\.[0-9]{2}\.[0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"


def clean_addresses(c: Column) -> Column:
    """``;`` and ``,`` lists become ``, `` lists with angle brackets removed; empty parts stay."""
    parts = F.split(c, "[;,]", -1)
    return F.array_join(F.transform(parts, lambda p: F.regexp_replace(strip(p), _ANGLE, "$1")), ", ")


def european_date(c: Column) -> Column:
    """First ``d Mon yyyy HH:MM:SS`` as ``dd.mm.yyyy HH:MM:SS``; anything else comes back unchanged.

    The wall clock is kept and the offset is dropped. A date after the start of a trailing comment does not count.
    The calendar day is checked through a date cast, without a detour over a time zone.
    """

    def rearranged(parts: Column) -> Column:
        day, name, year, clock = (F.get(parts, F.lit(i)) for i in range(4))
        month = F.lpad(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(name)).cast("string"), 2, "0")
        dd = F.lpad(day, 2, "0")
        exists = F.concat(year, F.lit("-"), month, F.lit("-"), dd).try_cast("date").isNotNull()
        european = F.concat(dd, F.lit("."), month, F.lit("."), year, F.lit(" "), clock)
        return F.when(exists & (year != "0000"), european)

    def reformatted(text: Column) -> Column:
        bare = F.regexp_replace(strip(text), _TRAILING_COMMENT, "")
        parts = F.split(F.regexp_extract(bare, _DAY_AND_TIME, 1), " ")
        return F.coalesce(once(parts, rearranged), text)

    return once(c, reformatted)


def parse_european(c: Column) -> Column:
    """``dd.mm.yyyy HH:MM:SS`` as a wall-clock timestamp, null for anything else or for an impossible time."""

    def iso(text: Column) -> Column:
        day, month, year, clock = (F.substring(text, *at) for at in ((1, 2), (4, 2), (7, 4), (12, 8)))
        value = F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit(" "), clock)
        return F.when(text.rlike(_EUROPEAN), value)

    return once(c, iso).try_cast("timestamp_ntz")
