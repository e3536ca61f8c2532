"""The body-cleaning steps, one column function per step. Their order is fixed in ``operators.clean``.

Every pattern is linear in the length of the body. Repetitions are possessive, so a long run of whitespace, an
unclosed tag or thousands of quote marks neither backtrack nor recurse. Steps that need a rare character are skipped
for bodies that lack it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import ALNUM, INLINE_SPACE, REPLACEMENT, SPACE, SPACE_CHARS, WORD, bound, contains_any, lacks, once, strip, unify_newlines

# --- fixed values -----------------------------------------------------------------------------------------------
ESCAPES = (("=\n", ""), ("=20", " "), ("=09", "\t"), ("=3D", "="), ("=22", '"'), ("=27", "'"))
MOJIBAKE = (("â€™", "'"), ("â€œ", '"'), ("â€", '"'))
REMOVED_TAGS = ("html", "head", "body", "meta", "title", "style", "script")
BULLETS = "-*•·▪▫◦‣⁃"
CONTROLS = (*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F)
RULE_CHARS = r"=\-_~*#.>|+"
# --- end of fixed values ----------------------------------------------------------------------------------------

# Single characters, not ranges: the pattern engine then tests one bit per character.
_CONTROL = "".join(rf"\x{code:02x}" for code in CONTROLS)
_SYMBOL = f"[^{ALNUM}{SPACE}]"
_LIST_MARKER = rf"(?:\p{{Nd}}+\.|[a-z]\.|[a-z]\)|\(\p{{Nd}}+\)|\p{{Nd}}+\)|[ivx]+\.)[{SPACE}]+[{WORD}]"
# Stripping symbols can only hurt the list form that starts with one.
_NUMBERED_PAREN = rf"\(\p{{Nd}}+\)[{INLINE_SPACE}]+[{WORD}]"
_LINE_PREFIX = rf"(?md)^[{INLINE_SPACE}]*+(?:(?={_NUMBERED_PAREN})|_*+[^{WORD}\n]*+)"
_CHANGED_LINE = rf"(?md)^(?:[{INLINE_SPACE}_]|(?!{_NUMBERED_PAREN})[^{WORD}\n])"
# A whitespace run is entered only at its start; group 1 is what precedes its first line start and is put back.
_QUOTE_LINE = rf"(?md)^[{INLINE_SPACE}]*+>"
_QUOTE = (
    rf"(?:\A|((?<![{SPACE}])[{INLINE_SPACE}]*+\n))[{SPACE}]*+>++[{SPACE}]*+(?:(?<=\n)>++[{SPACE}]*+)*+"
)
_BULLET_LINE = rf"(?md)^[{INLINE_SPACE}]*+[{BULLETS}]"
_EMPTY_BULLET = (
    rf"(?:\A|(?<=\n)\G|((?:(?<![{SPACE}])|\G)[{INLINE_SPACE}]*+\n))"
    rf"[{SPACE}]*+[{BULLETS}](?:[{SPACE}]*+\z|[{SPACE}]*(?=\n))"
)


def _replace_all(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _when_contains(c: Column, needles: tuple[str, ...], changed: Column) -> Column:
    """``changed`` for texts that hold any needle."""
    return F.when(contains_any(c, needles), changed).otherwise(c)


@bound
def decode_escapes(c: Column) -> Column:
    """The common quoted-printable escapes, decoded one after the other (``=3D20`` ends as ``=20``)."""
    return _when_contains(c, ("=",), _replace_all(c, ESCAPES))


@bound
def squeeze_spaces(c: Column) -> Column:
    """Three or more blanks or tabs become one blank; four or more line ends become three."""
    narrow = _when_contains(c, ("  ", "\t"), F.regexp_replace(c, r"[ \t]{3,}", " "))
    return F.regexp_replace(narrow, rf"\n(?:[{INLINE_SPACE}]*+\n){{3,}}+", "\n\n\n")


@bound
def _drop_controls(c: Column) -> Column:
    return F.when(lacks(c, _CONTROL), c).otherwise(F.regexp_replace(c, f"[{_CONTROL}]", ""))


def drop_controls(c: Column) -> Column:
    """Control characters go, except tab and line ends; line ends become LF."""
    return unify_newlines(_drop_controls(c))


def is_list_line(line: Column) -> Column:
    """``1. x``, ``a. x``, ``a) x``, ``(1) x``, ``1) x`` or ``IV. x``."""
    return strip(line).rlike(rf"(?iu)\A{_LIST_MARKER}")


def strip_line_starts(c: Column) -> Column:
    """Per line: blanks and symbols before the first word character go, list markers stay."""
    return F.regexp_replace(c, _LINE_PREFIX, "")


def count_line_starts(c: Column) -> Column:
    """Number of lines that :func:`strip_line_starts` changes."""
    return F.regexp_count(c, F.lit(_CHANGED_LINE))


def drop_leading_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\n+", "")


@bound
def break_tags(c: Column) -> Column:
    """``<br>``, ``<p>`` and ``<div>``, plain or self-closing, become line ends."""
    return _when_contains(c, ("<",), F.regexp_replace(c, r"<(?:br|BR|p|P|div|DIV)/?>", "\n"))


def strip_tag(tag: str) -> Callable[[Column], Column]:
    """Step that removes a tag with its content, and without it where it is not closed.

    Once an opening tag finds no closing one, no later one can, so the rest of the body is kept in one go (group 1).
    """
    opening = rf"<(?iu:{tag})"

    @bound
    def step(c: Column) -> Column:
        closed = F.regexp_replace(c, rf"(?s){opening}[^>]*+>.*?</(?iu:{tag})>|({opening}.*+)", "$1")
        bare = F.regexp_replace(closed, rf"(?s){opening}[^>]*+>|({opening}.*+)", "$1")
        return _when_contains(c, ("<",), F.when(c.rlike(opening), bare).otherwise(c))

    return step


#: Tag removal, to be applied in this order.
TAG_STEPS = (break_tags, *map(strip_tag, REMOVED_TAGS))


def repair_mojibake(c: Column) -> Column:
    """Replacement characters go; mis-decoded curly quotes become plain ones."""
    kept = F.replace(c, F.lit(REPLACEMENT), F.lit(""))
    return once(kept, lambda t: _when_contains(t, (MOJIBAKE[-1][0],), _replace_all(t, MOJIBAKE)))


@bound
def drop_symbol_lines(c: Column) -> Column:
    """Lines that are more than 70% symbols, or rules such as ``=====``, go.

    Such a line always has two symbols side by side, which is tested first for the body and then for the line.
    """
    pair = _SYMBOL + "{2}"
    rule = rf"\A[{INLINE_SPACE}]*+[{RULE_CHARS}]{{2,}}[{INLINE_SPACE}]*+\z"

    @bound
    def keep(line: Column) -> Column:
        size = F.length(F.btrim(line, F.lit(SPACE_CHARS)))
        mostly_symbols = (size > 2) & (F.regexp_count(line, F.lit(_SYMBOL)) * 10 > size * 7)
        return F.when(line.rlike(pair), ~(mostly_symbols | line.rlike(rule))).otherwise(F.lit(True))

    kept = F.array_join(F.filter(F.split(c, "\n", -1), keep), "\n")
    return F.when(c.rlike(pair), kept).otherwise(c)


@bound
def drop_quote_marks(c: Column) -> Column:
    """``>`` marks at line starts go, with the blanks and blank lines around them."""
    unquoted = F.when(c.rlike(_QUOTE_LINE), F.regexp_replace(c, _QUOTE, "$1")).otherwise(c)
    return _when_contains(c, (">",), unquoted)


@bound
def drop_empty_bullets(c: Column) -> Column:
    """Lines that hold only one bullet are emptied."""
    return F.when(c.rlike(_BULLET_LINE), F.regexp_replace(c, _EMPTY_BULLET, "$1")).otherwise(c)


def left_trim_lines(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?md)^[{INLINE_SPACE}]++", "")


@bound
def squeeze_punctuation(c: Column) -> Column:
    """Long runs of dots, dashes and equals signs become ``...``, ``-----`` and ``=====``."""
    squeezed = F.regexp_replace(c, r"(\.{3})\.{2,}|(-{5})-+|(={5})=+", "$1$2$3")
    return _when_contains(c, (".....", "------", "======"), squeezed)
