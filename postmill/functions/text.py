"""Unicode-aware text primitives.

Java's ``\\w``, ``\\s`` and ``.`` are narrower than the Unicode meaning the corpus needs, so the classes are spelled
out. All of them are written for use *inside* square brackets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce, wraps
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------------------
WORD = r"\p{L}\p{N}_"
ALNUM = r"\p{L}\p{N}"
INLINE_SPACE = r"\x{9}\x{b}\x{c}\x{d}\x{1c}\x{1d}\x{1e}\x{1f}\x{85}\p{Z}"
SPACE = r"\x{a}" + INLINE_SPACE
SPACE_CHARS = "".join(
    map(
        chr,
        (
            *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
            0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
        ),
    )
)
REPLACEMENT = chr(0xFFFD)
LINE_BREAKS = r"\x{b}\x{c}\x{d}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}-\x{2029}"
# --- end of fixed values ----------------------------------------------------------------------------------------


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` appearing a single time in the plan.

    A filter that is pushed below a projection receives a copy of the expression for every mention of it. Functions
    that look at their input several times bind it here, so that copies do not multiply when such functions are nested.
    """
    return F.get(F.transform(F.array(c), use), F.lit(0))


def bound(use: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Decorator for column functions that mention their input several times, see :func:`once`."""

    @wraps(use)
    def apply(c: Column) -> Column:
        return once(c, use)

    return apply


def strip(c: Column) -> Column:
    """Remove whitespace at both ends (``trim`` alone knows only U+0020)."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_blank(c: Column) -> Column:
    return F.ltrim(text_or_empty(c), F.lit(SPACE_CHARS)) == ""


def contains_any(c: Column, needles: Iterable[str]) -> Column:
    """Byte search for any of the needles, far cheaper than a pattern pass over the text."""
    return reduce(or_, (F.contains(c, F.lit(needle)) for needle in needles))


@bound
def unify_newlines(c: Column) -> Column:
    """CRLF and lone CR become LF."""
    return F.when(contains_any(c, "\r"), F.regexp_replace(c, r"\r\n?", "\n")).otherwise(c)


def lacks(c: Column, characters: str) -> Column:
    """Whether no character of a class (as written inside brackets) occurs.

    A negated class anchored at both ends runs in one tight loop; a search would start over at every position.
    """
    return c.rlike(rf"\A[^{characters}]*\z")


@bound
def unify_line_breaks(c: Column) -> Column:
    """Every Unicode line boundary becomes LF."""
    return F.when(lacks(c, LINE_BREAKS), c).otherwise(F.regexp_replace(c, rf"\r\n|[{LINE_BREAKS}]", "\n"))


def lenient_utf8(binary: Column) -> Column:
    """Decode bytes as UTF-8, dropping what is invalid, with newlines unified."""
    decoded = F.make_valid_utf8(binary.cast("string"))
    return unify_newlines(F.replace(decoded, F.lit(REPLACEMENT), F.lit("")))


def words(c: Column) -> Column:
    """Lower-cased runs of word characters, as an array (empty for null)."""
    runs = F.split(F.regexp_replace(F.lower(text_or_empty(c)), f"[^{WORD}]+", " "), " ")
    return F.filter(runs, lambda w: w != "")


def round_half_even_2(x: Column) -> Column:
    """Round a non-negative double to two places from its exact binary value.

    Spark's ``round`` works on the shortest decimal form and turns 2.675 (which is stored slightly below that) into
    2.68. Here the value is compared with the midpoint between the neighbouring hundredths. Only when it equals the
    nearest double to that midpoint does the tiny error of that double decide, and an exact tie goes to the even side.
    """
    below = F.floor(x * 100)
    twice = below * 2 + 1
    middle = twice.cast("double") / F.lit(200.0)
    # middle * 25 - twice / 8, evaluated without rounding: the float part has few enough bits to multiply exactly.
    head = middle.cast("float").cast("double")
    excess = (head * 25 - twice.cast("double") / F.lit(8.0)) + (middle - head) * 25
    up = (
        F.when(x != middle, x > middle)
        .when(excess != 0, excess > 0)
        .otherwise(F.pmod(below, F.lit(2)) == 1)
    )
    return (below + up.cast("int")).cast("double") / F.lit(100.0)
