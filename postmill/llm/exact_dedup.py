"""Exact deduplication that shuffles only rows whose hash may repeat. DataFrame functions only.

Pass one sets bits: each hash has one position in a filter, and a position hit more than once goes into the bitmap of
possible repeats. Pass two streams all rows past that bitmap, whose size has a fixed bound. Rows that miss it are unique
for certain and pass straight through; only the others are shuffled and compared by their full hash.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.bitmaps import bitmaps, filter_bits, probed
from postmill.llm.common import unpacked, whole_row
from postmill.operators.ordering import materialize
from postmill.schema import quoted


def normalised(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null counts as empty. Texts of one byte a character take the quick way."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ascii_uppercase, ascii_lowercase)
    )


def text_hash(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def duplicate_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``; of equal texts the largest id stays.

    Null texts count as empty. Null ids come before all others, so such a row stays only if its whole group has no id;
    then ``keep_id`` is null. Rows that repeat both text and id are all marked with the same result. Other columns are
    not read. The text is read and hashed once; (id, hash) is written and used from there on.
    """
    hashed = docs.select(F.col(quoted(id)).alias("_id"), F.unhex(text_hash(F.col(quoted(text)))).alias("_key"))
    hashed = materialize(hashed, "hashes")
    bits = filter_bits(hashed.count())
    flagged = probed(hashed, "_key", bitmaps(hashed, "_key", bits, least=2), bits, "_maybe")
    once = flagged.filter(~F.col("_maybe")).select(
        "_id", "_key", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    maybe = flagged.filter("_maybe").select("_id", "_key")
    # Written first, so that the join shuffles both sides by itself and adaptive execution can split a hot group.
    groups = materialize(maybe.groupBy("_key").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    repeated = maybe.join(groups, "_key").select("_id", "_key", "keep_id", "group_size")
    kept = F.col("_id").eqNullSafe(F.col("keep_id"))
    return once.unionByName(repeated).select(
        F.col("_id").alias(id), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("_key")).alias("text_sha256")
    )


def drop_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those that :func:`duplicate_groups` drops; of rows that repeat text and
    id, one. Null texts count as empty, null ids come before all others, and columns of any name pass through.

    The decisions are made on (id, hash); then one pass over the texts sends the unique rows straight through, while rows
    that may repeat meet their group's survivor in a shuffle. An empty table stays empty.
    """
    key, own = F.unhex(text_hash(F.col(quoted(text)))).alias("_key"), F.col(quoted(id)).alias("_id")
    hashed = materialize(docs.select(own, key), "hashes")
    bits = filter_bits(hashed.count())
    repeats = materialize(bitmaps(hashed, "_key", bits, least=2), "bitmaps")
    keep = probed(hashed, "_key", repeats, bits, "_maybe").filter("_maybe").groupBy("_key").agg(F.max("_id").alias("_keep"))
    flagged = probed(docs.select(whole_row(docs).alias("whole"), own, key), "_key", repeats, bits, "_maybe")
    survives = (F.col("m._key") == F.col("k._key")) & F.col("m._id").eqNullSafe(F.col("k._keep"))
    found = flagged.filter("_maybe").alias("m").join(keep.alias("k"), survives, "left_semi").dropDuplicates(["_key", "_id"])
    return unpacked(flagged.filter(~F.col("_maybe")).unionByName(found), docs.columns)
