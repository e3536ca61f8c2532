"""Bloom filters with one hash as tables of bitmaps. DataFrame functions only; the size has a fixed bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.schema import quoted

#: Bits of a filter per row, and the most bits it may have: 2**27 bits are the 16 MB that are broadcast at most.
BITS_PER_ROW, MOST_BITS = 16, 27
_WORD = 15  # bits of position inside one bitmap: Spark's bitmaps hold 32,768 bits


def filter_bits(rows: int) -> int:
    return min(MOST_BITS, max(_WORD + 1, (max(rows, 1) * BITS_PER_ROW - 1).bit_length()))


def _position(key: str, bits: int) -> tuple[Column, Column]:
    position = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    return F.shiftright(position, _WORD), position.bitwiseAND(F.lit((1 << _WORD) - 1))


def bitmaps(rows: DataFrame, key: str, bits: int, least: int = 1) -> DataFrame:
    """``(_word, _bits)``: the bitmaps of all positions that ``least`` or more rows hit; 2**bits bits in all at most."""
    word, bit = _position(key, bits)
    hit = rows.groupBy(word.alias("_word"), bit.alias("_bit")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    return hit.groupBy("_word").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def probed(df: DataFrame, key: str, maps: DataFrame, bits: int, name: str) -> DataFrame:
    """Add ``name``: false for rows whose key surely hit no position of ``maps``. A map-side probe."""
    word, bit = _position(key, bits)
    byte = "cast(conv(hex(substring(_bits, cast(shiftright(_bit, 3) as int) + 1, 1)), 16, 10) as int)"
    is_set = F.expr(f"({byte} & shiftleft(1, cast(_bit % 8 as int))) <> 0")
    found = df.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(maps), "_word", "left")
    return found.withColumn(name, F.coalesce(is_set, F.lit(False))).drop("_word", "_bit", "_bits")


def likely_in(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be in ``wanted`` (a written table of that column), before a join on it.

    Wide rows that the join would drop are dropped where they are read. A filter that has reached its largest size lets
    more rows through; the join decides in any case.
    """
    bits = filter_bits(wanted.count())
    return probed(df, key, bitmaps(wanted, key, bits), bits, "_likely").filter("_likely").drop("_likely")


def without(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is not in ``gone`` (a written table of that column), null keys included.

    Most rows pass the filter where they are read; only those that it holds for members meet ``gone`` in a join.
    """
    bits = filter_bits(gone.count())
    flagged = probed(df, key, bitmaps(gone, key, bits), bits, "_likely")
    rest = flagged.filter("_likely").join(gone, key, "left_anti")
    return flagged.filter("not _likely").unionByName(rest).select(*[F.col(quoted(c)) for c in df.columns])
