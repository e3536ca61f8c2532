"""The body-cleaning chain with its audit, and the cleaning of a whole record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import body as B
from postmill.functions.fields import clean_addresses, european_date
from postmill.functions.text import once, round_half_even_2, strip, text_or_empty
from postmill.schema import ADDRESS_FIELDS, quoted

# --- fixed values: audit names, in order ---------------------------------------------------------------------------
STEP_NAMES = (
    "Cleaned quoted-printable encoding",
    "Cleaned excessive whitespace",
    "Removed control characters and line ending artifacts",
    "Removed ALL leading spaces and symbols - {} lines modified (preserved structured lists flush left)",
    "Removed safe HTML tags",
    "Fixed encoding artifacts",
    "Aggressive symbol and email artifact removal",
    "Final removal of ALL leading spaces from every line",
    "Cleaned excessive punctuation",
)
# --- end of fixed values ----------------------------------------------------------------------------------------

#: One group per audit name, each a sequence of column functions.
STEPS = (
    (B.decode_escapes,),
    (B.squeeze_spaces,),
    (B.drop_controls,),
    (B.strip_line_starts, B.drop_leading_blank_lines),
    B.TAG_STEPS,
    (B.repair_mojibake,),
    (B.drop_symbol_lines, B.drop_quote_marks, B.drop_empty_bullets),
    (B.left_trim_lines,),
    (B.squeeze_punctuation,),
)
_LINE_START_STEP = 3


def _step_name(number: int, before: Column) -> Column:
    if number != _LINE_START_STEP:
        return F.lit(STEP_NAMES[number])
    head, tail = STEP_NAMES[number].split("{}")
    return F.concat(F.lit(head), B.count_line_starts(before).cast("string"), F.lit(tail))


def clean_text(c: Column) -> Column:
    """The cleaned body."""
    c = text_or_empty(c)
    for group in STEPS:
        for step in group:
            c = step(c)
    return strip(c)


def clean_text_audited(c: Column) -> Column:
    """Struct of ``body``, ``cleaning_steps``, ``original_length``, ``final_length`` and ``reduction_percent``.

    The text and the names so far travel through the steps together, so that the whole chain stays one expression in
    which every step appears once. A step counts when it changed the length of the text. Whatever a step replaces gets
    shorter in characters and in bytes alike, and the byte length is stored rather than counted.
    """

    def take(number: int, state: Column) -> Column:
        def apply(old: Column) -> Column:
            new = old["text"]
            for step in STEPS[number]:
                new = step(new)
            return once(F.struct(old.alias("old"), new.alias("new")), note)

        def note(pair: Column) -> Column:
            before, after = pair["old"]["text"], pair["new"]
            changed = F.octet_length(before) != F.octet_length(after)
            name = F.when(changed, F.array(_step_name(number, before))).otherwise(F.array().cast("array<string>"))
            return F.struct(after.alias("text"), F.concat(pair["old"]["steps"], name).alias("steps"))

        return once(state, apply)

    def chain(original: Column) -> Column:
        state = F.struct(original.alias("text"), F.array().cast("array<string>").alias("steps"))
        for number in range(len(STEPS)):
            state = take(number, state)
        measured = once(state, lambda s: F.struct(strip(s["text"]).alias("body"), s["steps"].alias("cleaning_steps")))
        return once(F.struct(F.length(original).alias("before"), measured.alias("done")), result)

    def result(r: Column) -> Column:
        before, after = r["before"], F.length(r["done"]["body"])
        # nullif keeps the empty body away from the division; it counts as no reduction.
        percent = round_half_even_2((before - after) / F.nullif(before, F.lit(0)) * 100)
        return F.struct(
            r["done"]["body"].alias("body"),
            r["done"]["cleaning_steps"].alias("cleaning_steps"),
            before.alias("original_length"),
            after.alias("final_length"),
            F.coalesce(percent, F.lit(0.0)).alias("reduction_percent"),
        )

    return once(text_or_empty(c), chain)


def clean_fields(df: DataFrame, where: Column | None = None) -> DataFrame:
    """Rewrite the date and the address fields that the frame has, in the rows that meet ``where``."""
    changed = {name: clean_addresses(F.col(quoted(name))) for name in ADDRESS_FIELDS if name in df.columns}
    if "Date" in df.columns:
        changed["Date"] = european_date(F.col("Date"))
    if where is not None:
        changed = {name: F.when(where, c).otherwise(F.col(quoted(name))) for name, c in changed.items()}
    return df.withColumns(changed)
