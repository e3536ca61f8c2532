"""Best-fit packing of documents into sequences, in bulk-synchronous rounds.

Documents are ordered by length and open sequences by gap. A round takes the documents of the longest length left: each
finds its successor, the smallest gap that takes it; where there are more documents than gaps their rank decides who
gets one; gaps shrink, the rest sweeps again, opens sequences in the end, and the next length follows. Equal lengths and
equal gaps are interchangeable, so both sorted lists are kept as runs (value, count): a sweep over runs does
what a sweep over all documents does, on lists that the capacity bounds whatever the number of documents. Spark counts
the runs, numbers the documents within each length and places them all in one pass.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.common import ranked, released, sized, sliced, with_columns
from postmill.llm.tokens import WordTokenizer
from postmill.operators.ordering import materialize
from postmill.schema import quoted


def pieces(docs: DataFrame, tokenizer: WordTokenizer, capacity: int, id: str = "doc_id", text: str = "text", ids: str | None = None) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` (and the ids themselves as binary column ``ids`` if named) of every document.

    Only documents longer than ``capacity`` are cut; the last piece may be shorter. A document without tokens gives one
    piece of length 0. Null texts are empty. Null and repeated ids pass through; other columns are not read.
    """
    kind = docs.schema[id].dataType
    fields = [
        T.StructField(id, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ]
    if ids:
        fields.append(T.StructField(ids, T.BinaryType()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1 << 10):
            texts = batch.column(1).to_pylist()
            for part in sized(texts):
                rows, starts, data = [], [], []
                for i, own in zip(part, tokenizer.encode([texts[i] for i in part]), strict=True):
                    for at in range(0, max(len(own), 1), 4 * capacity):
                        rows.append(i)
                        starts.append(at // 4)
                        data.append(own[at : at + 4 * capacity])
                columns = [
                    batch.column(0).take(pa.array(rows, pa.int64())), pa.array([s // capacity for s in starts], pa.int32()),
                    pa.array(starts, pa.int64()), pa.array([len(d) // 4 for d in data], pa.int64()),
                    pa.array([zlib.crc32(d) for d in data], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(data, pa.binary())] if ids else []), names=[f.name for f in fields])

    return docs.select(quoted(id), quoted(text)).mapInArrow(released(cut, tokenizer.forget), T.StructType(fields))


@dataclass
class Plan:
    """Runs of placements: the documents ``rank .. rank + count`` of one length go to consecutive sequences."""

    sequences: int = 0
    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)

    def place(self, length: int, rank: int, sequence: int, offset: int) -> None:
        self.length.append(length)
        self.rank.append(rank)
        self.sequence.append(sequence)
        self.offset.append(offset)


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> Plan:
    """Place ``counts[i]`` documents of ``lengths[i]`` (1 .. capacity, distinct), the longest first, by best fit."""
    plan = Plan()
    runs: dict[int, list[list[int]]] = {}  # gap -> runs [first sequence, count] of open sequences
    gaps: list[int] = []  # sorted

    def put(size: int, rank: int, first: int, count: int, gap: int) -> None:
        plan.place(size, rank, first, capacity - gap)
        if gap > size:
            if gap - size not in runs:
                insort(gaps, gap - size)
            runs.setdefault(gap - size, []).append([first, count])

    for size, left in sorted(zip(lengths.tolist(), counts.tolist(), strict=True), reverse=True):
        rank = 0
        while left:
            at = bisect_left(gaps, size)
            if at < len(gaps):
                gap, run = gaps[at], runs[gaps[at]][-1]
                count = min(run[1], left)
                first, run[0], run[1] = run[0], run[0] + count, run[1] - count
                if not run[1]:
                    runs[gap].pop()
                    if not runs[gap]:
                        del runs[gap], gaps[at]
            else:
                gap, first, count = capacity, plan.sequences, -(-left // (capacity // size))
                plan.sequences += count
            put(size, rank, first, count, gap)
            rank, left = rank + count, left - count
    return plan


def pack(parts: DataFrame, capacity: int, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), seed: int = 0) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (gapless from 0 in each sequence) to rows of ``length`` 0 .. ``capacity``.

    Rows of full length are sequences of their own; rows of length 0 stand at the start of the first sequence.
    Ties are numbered in a seeded order of ``order``; rows that repeat it are placed separately, in any order. Null
    lengths count as 0. ``parts`` is read three times and must be stable. Existing columns of the new names are replaced.
    The driver sees at most ``capacity`` counts, and the placements that it sends out are runs over them.
    """
    parts = parts.drop("sequence_id", "offset")
    rows = parts.withColumn("_length", F.coalesce(F.col(length), F.lit(0)).cast("long"))
    runs = rows.groupBy("_length").agg(F.count(F.lit(1)).alias("n")).orderBy("_length").collect()
    found = {r._length: r.n for r in runs}
    if any(not 0 <= x <= capacity for x in found):
        raise ValueError(f"lengths must be between 0 and {capacity}")
    lengths = np.array([x for x in found if x], np.int64)
    plan = best_fit(lengths, np.array([found[x] for x in lengths.tolist()], np.int64), capacity)
    by = np.lexsort((plan.rank, plan.length))
    keys = [np.array(x, np.int64)[by] for x in (plan.length, plan.rank, plan.sequence, plan.offset)]
    where = (keys[0] << 44) | keys[1]  # ranks within a length stay below 2**44

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_length", "_rank"))
            if len(where):
                at = np.maximum(np.searchsorted(where, (size << 44) | rank, side="right") - 1, 0)
                sequence, offset = keys[2][at] + rank - keys[1][at], keys[3][at]
            else:
                sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            empty = size == 0
            yield [pa.array(np.where(empty, 0, sequence)), pa.array(np.where(empty, 0, offset))]

    fields = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return with_columns(ranked(rows, ["_length"], list(order), "_rank", seed), fields, place).drop("_length", "_rank")


def pack_documents(docs: DataFrame, tokenizer: WordTokenizer, capacity: int, id: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """Cut, number and place all documents; texts are read and encoded once."""
    parts = materialize(pieces(docs, tokenizer, capacity, id, text), "pieces")
    return pack(parts, capacity, "length", (id, "piece"), seed)
