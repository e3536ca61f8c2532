"""Conversations as sequences of turns for the prefix trie, and digests of who ends where."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of ids that are joined before they are handed on.
CHUNK_BYTES = 1 << 13


def turn_lists(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: per conversation the array of ``(turn, code, size)``, by turn, null first.

    ``code`` is half a SHA-256 of role and text as hex, ``size`` the code points of the text; null role or text counts as
    empty. Turns that repeat a number follow by code. Rows without a ``conv_id`` belong to no conversation. Texts stay
    where they are; a turn moves as some 40 bytes, and one conversation's turns must fit into a task.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    fields = F.struct("turn", F.substring(F.sha2(told, 256), 1, 32).alias("code"), F.char_length(text).cast("long").alias("size"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), fields.alias("turn"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def rebuilt(lists: DataFrame, group: int = 100, most: int = 5) -> DataFrame:
    """Each conversation with its first ``h`` turns replaced by those of the first of its ``group``.

    ``h`` is the crc32 of the id as text modulo ``most + 1``. A leader that is absent or too short gives what it has.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    leader = F.col("conv_id") - F.col("conv_id") % group
    leads = lists.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("leader"), F.slice("turns", 1, most).alias("lead"))
    joined = lists.withColumn("leader", leader).join(leads, "leader", "left")
    lead = F.slice(F.coalesce("lead", F.slice("turns", 1, 0)), F.lit(1), h)
    own = F.slice("turns", h + 1, F.size("turns"))
    return joined.select("conv_id", F.concat(lead, own).alias("turns"))


def sequences(lists: DataFrame) -> DataFrame:
    """``conv_id, seq, key, sizes``: the codes of all turns joined, a digest of them, and the sizes."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["code"]), ""))
    named = lists.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    return named.select("conv_id", F.unhex(F.substring(F.sha2("key", 256), 1, 32)).alias("seq"), "key", "sizes")


def joined_id_digests(members: DataFrame) -> DataFrame:
    """``seq, least, n, digest`` of ``members`` (``seq, id``): SHA-256 of a group's ids in decimal, ascending, comma-joined.

    A hash takes its bytes in order. The ids of all groups are range-sorted, a large group over many tasks, and joined to
    stretches of text there; what meets in one task is a few long texts, which stream through the hash.
    """

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, ids, held = None, [], 0
        out: list[tuple] = []

        def close() -> None:
            if ids:
                out.append((seq, ids[0], len(ids), ",".join(map(str, ids))))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["seq", "least", "n", "ids"])

        for batch in batches:
            for own, id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != seq or len(ids) * 20 > CHUNK_BYTES:
                    close()
                    seq, ids = own, []
                    held += 1
                    if held % 1000 == 0 and out:
                        yield flush()
                        out.clear()
                ids.append(id)
        close()
        if out:
            yield flush()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, least, n, state = None, 0, 0, hashlib.sha256()
        for batch in batches:
            done: list[tuple] = []
            for own, first, count, ids in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if own != seq:
                    if seq is not None:
                        done.append((seq, least, n, state.hexdigest()))
                    seq, least, n, state = own, first, 0, hashlib.sha256()
                elif n:
                    state.update(b",")
                state.update(ids.encode())
                n += count
            yield made(done)
        if seq is not None:
            yield made([(seq, least, n, state.hexdigest())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["seq", "least", "n", "digest"])

    ordered = members.select("seq", "id").repartitionByRange("seq", "id").sortWithinPartitions("seq", "id")
    texts = ordered.mapInArrow(stretches, "seq binary, least long, n long, ids string")
    met = texts.repartition("seq").sortWithinPartitions("seq", "least")
    return met.mapInArrow(digests, "seq binary, least long, n long, digest string")
