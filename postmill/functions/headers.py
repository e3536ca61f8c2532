"""Header block and body of a raw message, as flat expressions over one string column.

Only the header block is searched for fields, so the cost of a long body is one scan for the boundary.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import INLINE_SPACE, WORD, strip, text_or_empty, unify_line_breaks

_BLANK_LINE = rf"(?md)^[{INLINE_SPACE}]*+(?:\n|(?<=[{INLINE_SPACE}])\z)"
# Group 1 and 2: name and value of a field line without the blanks between them. Group 3: a continuation. Junk has no group.
_LINE = rf"(?md)^(?:([{WORD}-]++:)[{INLINE_SPACE}]*+([^\n]*)|([ \t][^\n]*)|[^\n]+\n?)"
_TRAILING = rf"(?md)[{INLINE_SPACE}](?<![{INLINE_SPACE}]{{2}})[{INLINE_SPACE}]*+$"
_FOLD = rf"\n[ \t][{INLINE_SPACE}]*+"


def split_message(content: Column) -> Column:
    """``[header block, body]`` cut at the first blank line, or ``[whole text]`` if there is none."""
    return F.split(unify_line_breaks(text_or_empty(content)), _BLANK_LINE, 2)


def header_lines(parts: Column) -> Column:
    """The header block as an array of ``name:value`` lines, continuations unfolded and everything else dropped.

    Blanks after the name go before unfolding: an empty first line keeps the joining blank of its continuation.
    """
    block = F.regexp_replace(parts.getItem(0), _LINE, "$1$2$3")
    block = F.regexp_replace(F.regexp_replace(block, _TRAILING, ""), _FOLD, " ")
    return F.split(block, "\n", -1)


def header_field(lines: Column, name: str) -> Column:
    """Value of the last ``name:`` line, ``""`` if the field is absent."""
    start = name + ":"
    last = F.try_element_at(F.filter(lines, lambda line: line.startswith(start)), F.lit(-1))
    return F.coalesce(F.substr(last, F.lit(len(start) + 1)), F.lit(""))


def message_body(parts: Column) -> Column:
    """Text after the boundary; without a boundary the whole message, headers included."""
    return strip(F.element_at(parts, -1))
