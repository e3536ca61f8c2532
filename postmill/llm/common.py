"""Helpers the operators share: batches, seeded ranks that survive hot groups, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.operators.ordering import materialize
from postmill.schema import quoted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(column: str):
    """crc32 of an id written as text; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def sized(texts: Sequence[str | None], limit: int = 1 << 20) -> Iterator[range]:
    """Ranges of consecutive texts with about ``limit`` characters, so that a batch of long texts stays small."""
    start = total = 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if i > start and total + size > limit:
            yield range(start, i)
            start, total = i, 0
        total += size
    if start < len(texts):
        yield range(start, len(texts))


def released(step: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], *held: Callable[[], None]):
    """``step`` for ``mapInArrow``, after which its worker gives the memory that it no longer uses back to the machine.

    A worker outlives its task and waits beside those of the next stage; what it freed would stay with it. ``held`` are
    called first, to let go of what the step keeps.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            for let_go in held:
                let_go()
            release()

    return run


def sliced(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so that few texts at a time become Python's."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def release() -> None:
    """Give freed memory back, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def with_columns(
    df: DataFrame, fields: Sequence[T.StructField], compute: Callable[[Iterator[pa.RecordBatch]], Iterator[list]], rows: int = 1 << 31
) -> DataFrame:
    """Add columns worked out batch by batch; ``compute`` yields one list of Arrow arrays per batch it takes,
    of at most ``rows`` rows.

    Columns of the input with one of the new names are replaced.
    """
    names = [f.name for f in fields]
    base = df.drop(*[n for n in names if n in df.columns])
    schema = T.StructType([*base.schema.fields, *fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[pa.RecordBatch] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, rows):
                seen.append(batch)
                yield batch

        for arrays in compute(noted()):
            batch = seen.pop()
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])

    return base.mapInArrow(released(run), schema)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The given names, each behind as many underscores as it takes to clash with no column, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def whole_row(df: DataFrame):
    """All columns as one struct, under names of its own; :func:`unpacked` gives them back whatever they are called."""
    return F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])


def unpacked(df: DataFrame, columns: Sequence[str], whole: str = "whole") -> DataFrame:
    return df.select(*[F.col(f"{whole}.c{i}").alias(c) for i, c in enumerate(columns)])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, seed: int = 0, splits: int = 1024, ties: Sequence[str] = ()) -> DataFrame:
    """Number the rows of each group of equal ``keys`` (not null) from 0, in a seeded random order of ``order``.

    A window over the group would take a hot group into one task. The rows of a group are dealt to ``splits`` buckets by
    a hash instead; a bucket's rows are numbered after all rows of the buckets before it. Rows that agree in all of
    ``order`` share a bucket and are numbered by ``ties``, else in any order. ``df`` is read twice and must give the same rows both times.
    """
    hashed = F.xxhash64(F.lit(seed), *order)
    rows = df.withColumn("_hash", hashed).withColumn("_bucket", F.pmod("_hash", F.lit(splits)).cast("int"))
    groups = [*keys, "_bucket"]
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_size"))
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(*groups, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy(*groups).orderBy("_hash", *order, *ties)) - 1
    numbered = rows.withColumn("_within", within).join(before, groups)
    return numbered.withColumn(name, F.col("_before") + F.col("_within")).drop("_hash", "_bucket", "_before", "_within")


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The table of ``edges``, written, and their number and sum of hashes, which are taken while they are written."""
    noted = Observation()
    table = materialize(edges.observe(noted, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hashes")), "edges")
    return table, (noted.get.get("n"), noted.get.get("hashes"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node with an edge to another one; the component is its smallest node.

    Alternating large and small stars: every round hangs the neighbours of a node on the smallest of them, by one
    aggregation and one join that adaptive execution can split where a node has very many neighbours. Each round is
    written to the shared folder, which cuts the lineage; whether it changed anything is found on the way, because every
    job more stays in the driver's memory. The number of rounds grows with the logarithm of the diameter.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    current = materialize(pairs, "edges")
    before = () if current.isEmpty() else None
    while before != ():
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = materialize(large.filter("u > v").distinct(), "edges")
        least = stars.groupBy("u").agg(F.min("v").alias("m"))
        joined = stars.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        current, after = _written(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        if after == before:
            break
        before = after
    member = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return member.union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
