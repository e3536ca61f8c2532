"""Token sequences in training order: every sequence has its place in a shuffled order before anything is written.

A keyed Feistel network permutes the numbers of all sequences; numbers that leave the range walk on along their cycle
until they are back. The place of a sequence gives its shard and its offset there, so a trainer reads shards from front
to back and resumes at any place by a seek.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.common import sized, with_columns
from postmill.llm.storage import committed, opened
from postmill.llm.tokens import WordTokenizer
from postmill.operators.ordering import materialize
from postmill.schema import quoted

ROUNDS = 6
#: Sequences per shard: as many as give about 256 shards, within these bounds.
SMALLEST_SHARD, LARGEST_SHARD, SHARDS = 1 << 10, 1 << 16, 256


def permuted(numbers: np.ndarray, size: int, key: int) -> np.ndarray:
    """The place of each of ``numbers`` (0 .. size - 1) in a keyed permutation of all ``size`` numbers."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [int.from_bytes(hashlib.blake2b(f"{key}:{i}".encode(), digest_size=8).digest(), "little") for i in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        return (left << np.uint64(half)) | right

    out = once(np.asarray(numbers, np.uint64))
    while len(away := np.flatnonzero(out >= np.uint64(size))):
        out[away] = once(out[away])
    return out.astype(np.int64)


def sequences(docs: DataFrame, tokenizer: WordTokenizer, length: int, id: str = "doc_id", text: str = "text", width: int = 2, packed: bool = False) -> DataFrame:
    """``block, place, doc_id, start, n_tokens, ids``: the documents of a task, one behind the other, cut to ``length``.

    ``doc_id`` and ``start`` tell which document, and which of its ids, comes first. ``ids`` are unsigned integers of
    ``width`` bytes, compressed one by one if ``packed``; only the last sequence of a block is shorter. Null texts are
    empty and only add their end id.
    """
    kind = docs.schema[id].dataType
    fields = [
        T.StructField("block", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("doc_id", kind),
        T.StructField("start", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("ids", T.BinaryType()),
    ]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, place = TaskContext.get().partitionId(), 0
        held, first, arrow_kind = b"", None, None
        rows: list[tuple] = []
        compress = zstandard.ZstdCompressor().compress if packed else bytes

        def add(data: bytes, origin: tuple) -> None:
            nonlocal place
            ids = np.frombuffer(data, "<u4").astype(f"<u{width}").tobytes()
            rows.append((block, place, *origin, len(data) // 4, compress(ids)))
            place += 1

        def batch_of_rows() -> pa.RecordBatch:
            types = (pa.int32(), pa.int64(), arrow_kind, pa.int64(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.name for f in fields])

        for batch in batches:
            arrow_kind = batch.column(0).type
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in sized(texts):
                for i, own in zip(part, tokenizer.encode([texts[i] for i in part]), strict=True):
                    at = 0
                    while at < len(own):
                        if not held:
                            first = (names[i], at // 4)
                        more = own[at : at + 4 * length - len(held)]
                        held, at = held + more, at + len(more)
                        if len(held) == 4 * length:
                            add(held, first)
                            held = b""
                if len(rows) >= 1000:
                    yield batch_of_rows()
                    rows.clear()
        if held:
            add(held, first)
        if rows:
            yield batch_of_rows()

    return docs.select(quoted(id), quoted(text)).mapInArrow(cut, T.StructType(fields))


def write_shards(
    docs: DataFrame, tokenizer: WordTokenizer, folder: str, length: int = 2048, key: int = 0, id: str = "doc_id", text: str = "text",
    width: int = 2, shard_rows: int | None = None,
) -> DataFrame:
    """Write all sequences below ``folder`` and return their index: ``slot, shard, offset, number, doc_id, start, n_tokens``.

    A shard holds ``shard_rows`` slots of ``length * width`` bytes each, short sequences padded with zeros. Sequences are
    numbered by block, so equal files read under equal split settings give equal shards; each order is a permutation of
    all sequences under ``key``. Texts are encoded once; ids are written, and shuffled once by shard, compressed. Repeated and null
    ids of documents are carried along. An empty table writes no shard.
    """
    made = materialize(sequences(docs, tokenizer, length, id, text, width, packed=True), "sequences")
    total = made.count()
    shard_rows = shard_rows or min(LARGEST_SHARD, max(SMALLEST_SHARD, 1 << (max(1, total // SHARDS) - 1).bit_length()))
    earlier = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # one row per task that read the documents
    before = made.groupBy("block").agg(F.count(F.lit(1)).alias("n")).select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # As many small rows as tasks read the documents; a join that shuffles would move all ids.
    numbered = made.join(F.broadcast(before), "block").withColumn("number", F.col("before") + F.col("place")).drop("before", "place", "block")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            numbers = batch.column(batch.schema.get_field_index("number")).to_numpy()
            yield [pa.array(permuted(numbers, total, key))]

    placed = with_columns(numbered, [T.StructField("slot", T.LongType())], slots)
    placed = placed.withColumns({"shard": F.floor(F.col("slot") / shard_rows), "offset": (F.col("slot") % shard_rows) * (length * width)})
    dealt = placed.repartition(max(1, -(-total // shard_rows)), "shard").sortWithinPartitions("slot")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, stream = None, None
        decompress = zstandard.ZstdDecompressor().decompress
        with ExitStack() as stack:
            for batch in batches:
                for own, ids in zip(batch.column("shard").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                    if own != shard:
                        stack.close()
                        shard, stream = own, stack.enter_context(committed(folder, f"shard-{own:06d}.bin"))
                    stream.write(decompress(ids).ljust(length * width, b"\0"))
                keep = [n for n in batch.schema.names if n != "ids"]
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep], names=keep)

    index = dealt.mapInArrow(write, T.StructType([f for f in dealt.schema.fields if f.name != "ids"]))
    index.write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(index.schema).parquet(f"{folder}/index")


def read_shards(spark: SparkSession, folder: str, length: int = 2048, width: int = 2, from_slot: int = 0) -> DataFrame:
    """``slot, n_tokens, ids`` of all sequences from a slot on, read front to back, one task per shard."""
    index = spark.read.parquet(f"{folder}/index").filter(F.col("slot") >= from_slot)
    shards = index.groupBy("shard").agg(
        F.min("offset").alias("first"), F.min("slot").alias("slot"), F.expr("transform(array_sort(collect_list(struct(slot, n_tokens))), x -> x.n_tokens)").alias("sizes")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride = length * width
        for batch in batches:
            for row in batch.to_pylist():
                with opened(folder, f"shard-{row['shard']:06d}.bin") as stream:
                    stream.seek(row["first"])
                    for at in range(0, len(row["sizes"]), 1024):
                        sizes = row["sizes"][at : at + 1024]
                        data = stream.read(stride * len(sizes))
                        ids = [data[i * stride : i * stride + n * width] for i, n in enumerate(sizes)]
                        slots = np.arange(row["slot"] + at, row["slot"] + at + len(sizes))
                        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(sizes, pa.int32()), pa.array(ids, pa.binary())], names=["slot", "n_tokens", "ids"])

    return shards.mapInArrow(read, "slot long, n_tokens int, ids binary")


def digests(sequences: DataFrame) -> DataFrame:
    """``slot, ids_crc32`` of sequences read back."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [zlib.crc32(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("slot"), pa.array(values, pa.int64())], names=["slot", "ids_crc32"])

    return sequences.mapInArrow(crc, "slot long, ids_crc32 long")
