"""JSON arrays of records, read in pieces however large one file is.

A file is read as the stretches between closing braces, which Spark splits by bytes like lines. A task writes its
stretches as chunks of some megabytes. Whether a brace stands in a string, and how deep it stands, depends on all that
comes before it in the file; each chunk is summed up for both cases (quotes, braces), running sums over the chunks of a
block and over the blocks of a file settle which case holds, and a record ends where the depth is back at nought. Only
one row of numbers a chunk is summed and joined. The texts stay where they were written: a chunk is cut into records by
the task that reads it, and just the pieces of a record that lies in two chunks or more meet in a group, as large as the
record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.operators.ordering import materialize
from postmill.schema import RECORD, quoted

_BROKEN = "_broken"
#: A chunk is closed by the stretch that brings it to this many bytes.
CHUNK = 1 << 22
_QUOTE, _OPEN, _CLOSE, _ESCAPE = b'"{}\\'


def _marks(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and characters of the quotes and braces of a chunk, the brace behind it included, without escaped ones.

    An escape can't reach over a closing brace: that brace would be the escaped character, which JSON doesn't have.
    """
    codes = np.frombuffer(text + b"}", np.uint8)
    at = np.flatnonzero((codes == _QUOTE) | (codes == _OPEN) | (codes == _CLOSE))
    slashes = np.flatnonzero(codes == _ESCAPE)
    if len(slashes):
        begins = np.diff(slashes, prepend=-2) > 1
        run = slashes[begins][np.cumsum(begins) - 1]
        before = np.maximum(np.searchsorted(slashes, at) - 1, 0)
        escaped = (slashes[before] == at - 1) & ((at - run[before]) % 2 == 1)
        at = at[~escaped | (codes[at] == _CLOSE)]
    return at, codes[at]


def _steps(marks: np.ndarray, inside: bool) -> np.ndarray:
    """What each mark adds to the depth, by whether the chunk starts inside a string."""
    outside = (np.cumsum(marks == _QUOTE) + inside) % 2 == 0
    return ((marks == _OPEN).astype(np.int64) - (marks == _CLOSE)) * outside


def _chunks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, block, id, text, quotes, net, net_in``: the file in chunks, numbered by ``id`` in each block.

    Each ends before a closing brace, or with the file. ``net`` is the change of depth over the chunk and that brace if
    it starts outside a string, ``net_in`` if inside.
    """
    rows = spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("text")
    )

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, size, held = None, 0, 0, []

        def closed() -> pa.RecordBatch:
            text = b"}".join(held)
            marks = _marks(text)[1]
            values = [*at, number, text, int((marks == _QUOTE).sum()), int(_steps(marks, False).sum()), int(_steps(marks, True).sum())]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, (pa.string(), pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * 3), strict=True)],
                names=["path", "block", "id", "text", "quotes", "net", "net_in"],
            )

        for batch in batches:
            for path, block, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (size >= CHUNK or at != (path, block)):
                    yield closed()
                    number, size, held = number + 1, 0, []
                if at != (path, block):
                    at, number = (path, block), 0
                held.append(text)
                size += len(text) + 1
        if held:
            yield closed()

    return rows.mapInArrow(chunk, "path string, block long, id int, text binary, quotes long, net long, net_in long")


_KEYS = ["path", "block", "id"]


def _with_before(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over all earlier chunks of the file: those of the block, and whole blocks before."""
    inside = W.partitionBy("path", "block").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    blocks = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = df.groupBy("path", "block").agg(F.sum(value).alias("_sum"))
    offsets = sums.select("path", "block", F.coalesce(F.sum("_sum").over(blocks), F.lit(0)).alias("_offset"))
    summed = df.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(offsets, ["path", "block"]).withColumn(name, F.col(name) + F.col("_offset")).drop("_offset")


def _ends(text: bytes, inside: bool, depth: int, last: bool) -> tuple[bytes, np.ndarray]:
    """A chunk with the brace behind it, and the places right behind each record that ends in it.

    Of a file's last chunk no brace is known to follow.
    """
    at, marks = _marks(text)
    done = (marks == _CLOSE) & (_steps(marks, inside) != 0) & (depth + np.cumsum(_steps(marks, inside)) == 0)
    ends = at[done] + 1
    return (text, ends[ends <= len(text)]) if last else (text + b"}", ends)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk the number of records that end in it, and what stands before the first end and behind the last.

    ``head`` ends a record begun earlier. ``tail`` begins a record or the rest of the file. A chunk between the two
    that is all inside one record has neither.
    """
    for batch in batches:
        found = []
        for text, inside, depth, last in zip(*(batch.column(c).to_pylist() for c in ("text", "inside", "depth", "last")), strict=True):
            body, ends = _ends(text, inside, depth, last)
            begins = not inside and depth == 0
            start = int(ends[-1]) if len(ends) else 0
            tail = body[start:] if (len(ends) or begins) and (last or start < len(body)) else None
            found.append((len(ends), None if begins or not len(ends) else body[: ends[0]], tail))
        kinds = (pa.int64(), pa.binary(), pa.binary())
        more = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *more], names=[*kept, "ends", "head", "tail"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that lie in one chunk, ``record`` being the number of records that end before the chunk."""
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("path", "text", "inside", "depth", "last", "record"))
        for path, text, inside, depth, last, record in zip(*columns, strict=True):
            body, ends = _ends(text, inside, depth, last)
            begins = not inside and depth == 0
            cuts = np.concatenate([[0], ends])[0 if begins else 1 :].astype(np.int32)
            count = len(cuts) - 1
            if count > 0:
                texts = pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(body)])
                numbers = pa.array(np.arange(count) + (record + (not begins)), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([path] * count, pa.string()), numbers, texts], names=["path", "record", "text"])


def read_json_array(
    spark: SparkSession, path: str | list[str], schema: T.StructType = RECORD, number: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Records of files that hold one JSON array of objects each, and ``(path, text)`` of what is none.

    ``number`` names a column for the 1-based place of the record in its file. A record that does not parse, or that is
    not parted from its neighbours by just a comma, is a reject with its text; so is the stretch that follows the last
    complete record if the array is not closed there, which may be the start of a long broken rest. A file cut off right
    behind a brace loses that last record to the rejects as well, because the brace can't be told from the end. Files
    without any text give nothing. Fields beyond the schema are dropped, missing ones null. The input is read once and
    written to the shared folder in chunks; both results cut and parse them when they are read.
    """
    chunks = materialize(_chunks(spark, path), "chunks")
    narrow = chunks.drop("text")
    last = narrow.groupBy("path").agg(F.max(F.struct("block", "id")).alias("end"))
    inside = F.col("quotes_before") % 2 == 1
    steps = _with_before(narrow, "quotes", "quotes_before").withColumn("step", F.when(inside, F.col("net_in")).otherwise(F.col("net")))
    states = _with_before(steps, "step", "depth").join(last, "path")
    # Joins with the texts are to tables that are written, whose size is known beforehand: few enough rows are broadcast.
    states = materialize(states.select(*_KEYS, inside.alias("inside"), "depth", (F.struct("block", "id") == F.col("end")).alias("last")), "states")
    found = chunks.select(*_KEYS, "text").join(states, _KEYS)
    shape = "path string, block long, id int, inside boolean, depth long, last boolean, ends long, head binary, tail binary"
    edges = materialize(found.select("text", *states.columns).mapInArrow(_edges, shape), "edges")
    numbered = _with_before(edges.select(*states.columns, "ends"), "ends", "record")
    totals = edges.groupBy("path").agg(F.sum("ends").alias("records"))
    placed = materialize(numbered.join(totals, "path"), "record_ends")

    full = chunks.select(*_KEYS, "text").join(placed.filter("ends > 0"), _KEYS)
    single = full.select("path", "text", "inside", "depth", "last", "record").mapInArrow(_whole, "path string, record long, text binary")
    ended = edges.select(*_KEYS, "head", "tail").join(placed.select(*_KEYS, "last", "ends", "record", "records"), _KEYS)
    within = placed.filter("ends = 0 AND (inside OR depth != 0) AND record < records").select(*_KEYS, "record")
    within = within.join(chunks.select(*_KEYS, F.concat("text", F.lit(b"}")).alias("text")), _KEYS)
    pieces = (
        ended.select(*_KEYS, "record", F.col("head").alias("text"))
        .union(ended.filter("record + ends < records").select(*_KEYS, F.col("record") + F.col("ends"), "tail"))
        .filter("text IS NOT NULL").union(within.select(*_KEYS, "record", "text"))
    )
    parts = F.array_sort(F.collect_list(F.struct("block", "id", F.col("text").cast("string").alias("text"))))
    divided = pieces.groupBy("path", "record").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
    texts = single.withColumn("text", F.col("text").cast("string")).union(divided)
    at = F.instr("text", "{")
    lead = F.substring(F.col("text"), F.lit(1), at - 1)
    parted = F.when(F.col("record") == 0, lead.rlike(r"\A\s*\[\s*\z")).otherwise(lead.rlike(r"\A\s*,\s*\z"))
    fields = T.StructType([*schema.fields, T.StructField(_BROKEN, T.StringType())])
    body = F.substring(F.col("text"), at, F.length("text"))
    parsed = F.from_json(body, fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN})
    # No filter gets below a generator, where it would parse each record once more.
    read = texts.select("path", "record", "text", parted.alias("parted"), F.explode(F.array(parsed)).alias("value"))
    right = F.col("parted") & F.col(f"value.{_BROKEN}").isNull()

    rest = ended.filter("record + ends = records AND tail IS NOT NULL").groupBy("path").agg(
        F.min_by(F.struct(F.col("tail").cast("string").alias("text"), "last", "records"), F.struct("block", "id")).alias("rest")
    ).select("path", "rest.*")
    closed = F.when(F.col("records") == 0, F.col("text").rlike(r"\A\s*\[\s*\]\s*\z")).otherwise(F.col("text").rlike(r"\A\s*\]\s*\z"))
    open_ended = rest.filter(~(closed & F.col("last"))).select("path", F.substring_index("text", "}", 1).alias("text"))

    shown = [F.col(f"value.{quoted(f.name)}").alias(f.name) for f in schema.fields]
    place = [(F.col("record") + 1).alias(number)] if number else []
    good = read.filter(right).select(*place, *shown)
    return good, read.filter(~right).select("path", "text").unionByName(open_ended)


def write_json_array(df: DataFrame, path: str) -> None:
    """Records as JSON arrays: each file below ``path`` is one array, one record a line, null fields written as null.

    Every task's rows become one file, in their order. No rows give no file.
    """
    write_array_lines(df.select(F.to_json(F.struct(*[quoted(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("value")), path)


def write_array_lines(values: DataFrame, path: str) -> None:
    """The only column's texts, which are no nulls, as the elements of arrays: one array a task, one element a line."""

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = batch.column(0)
            if not len(rows):
                continue
            if held is None:
                yield pa.RecordBatch.from_arrays([pa.array(["["])], names=["value"])
            else:
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(held, ",", "")], names=["value"])
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(rows.slice(0, len(rows) - 1), ",", "")], names=["value"])
            held = rows.slice(len(rows) - 1)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([held, pa.array(["]"])])], names=["value"])

    lines = values.mapInArrow(bracketed, "value string").select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"), "value")
    # One file a task: the rows are in order, and the sort that a partitioned write asks for keeps it.
    lines = lines.sortWithinPartitions("part", "id").drop("id")
    lines.write.mode("overwrite").option("maxRecordsPerFile", 0).partitionBy("part").text(path)
