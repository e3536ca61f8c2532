"""File names: which files belong to the corpus, how they are called, and in which order they come."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import SPACE

# An extension starts at the last dot that has something other than dots before it.
_EXTENSION = r"(?s)\A.*[^.].*?(\.[^.]*)\z"
_NUMERIC_EXTENSION = rf"\A\.[{SPACE}]*\p{{Nd}}+\z"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Last extension with its dot, ``""`` if there is none. Leading dots do not start one."""
    return F.regexp_extract(name, _EXTENSION, 1)


def _lacks_real_extension(name: Column) -> Column:
    ext = extension(name)
    return (ext == "") | ext.rlike(_NUMERIC_EXTENSION)


def is_mail_file(name: Column) -> Column:
    """Text files, files without extension, and files whose extension is only a number."""
    return (F.lower(extension(name)) == ".txt") | _lacks_real_extension(name)


def with_txt_suffix(name: Column) -> Column:
    """The name with ``.txt`` added when it has no extension or only a numeric one."""
    return F.when(_lacks_real_extension(name), F.concat(name, F.lit(".txt"))).otherwise(name)


def txt_name(path: Column) -> Column:
    """Base name of a path with its ``.txt`` suffix supplied."""
    return with_txt_suffix(base_name(path))


def natural_key(name: Column) -> Column:
    """String whose plain order is natural order: digit runs of any length compare as integers.

    A digit run becomes NUL + its length in ten digits + the run without leading zeros. NUL sorts before every
    character a name can hold, so text that stops before a number precedes text that goes on.
    """
    parts = F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9]+)"), 1)

    def encode(part: Column) -> Column:
        digits = F.regexp_replace(part, r"^0+(?=[0-9])", "")
        number = F.concat(F.lit("\x00"), F.lpad(F.length(digits).cast("string"), 10, "0"), digits)
        return F.when(part.rlike("^[0-9]"), number).otherwise(part)

    return F.array_join(F.transform(parts, encode), "")
