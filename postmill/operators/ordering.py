"""Global positions and exact joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.schema import quoted
from postmill.session import shared_dir, shuffles_freed

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row in partition below


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash a scan with fewer partitions than there are cores over all cores, ahead of a CPU-bound text stage.

    Parquet splits by row group, so a small file is one task however long its texts are. A table of any size worth a
    cluster has more partitions than cores and comes back as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def materialize(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder, or in ``folder``, and read it back, which cuts its lineage.

    Unlike a checkpoint the table is columnar: whoever reads it again reads only the columns it needs. What was shuffled
    for it is deleted at once.
    """
    spark = df.sparkSession
    place = f"{(folder or shared_dir(spark)).rstrip('/')}/{label}-{uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def with_position(df: DataFrame, order: Sequence[Column | str], name: str, start: int = 0) -> DataFrame:
    """Add the row's place in the global order ``order`` (which must be total), counting from ``start``.

    A window without partitions would pull the table into one task. Here the rows are range-sorted and each gets
    (partition, row in partition). The result is written to the shared folder, so that a lost executor cannot renumber
    it; whoever owns that folder removes it. One small row per partition then carries the offset of that partition;
    their number is the number of partitions, which bounds both the window and the broadcast. All columns of ``df`` are
    sorted and written, so pass keys only and join the rest, as :func:`numbered_by` does.
    """
    local = "_local_position"
    # A sort evaluates its expressions at every comparison, so they become columns first.
    keys = {f"_key{i}": F.col(quoted(o)) if isinstance(o, str) else o for i, o in enumerate(order)}
    ranged = df.withColumns(keys).orderBy(*keys).drop(*keys)
    placed = materialize(ranged.withColumn(local, F.monotonically_increasing_id()), "positions")
    part = F.shiftright(F.col(local), _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    row = F.col(local).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + row + F.lit(start))
        .drop("_part", "_offset", local)
    )


def with_running_sum(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows before this one in the global order ``order`` (which must be total).

    As in :func:`with_position`, rows are range-sorted and written, and one offset per partition carries the rest.
    """
    local, part = "_local_place", "_local_part"
    ranged = df.orderBy(*[F.col(quoted(o)) for o in order]).withColumn(local, F.monotonically_increasing_id())
    placed = materialize(ranged.withColumn(part, F.shiftright(F.col(local), _ROW_BITS)), "sums")
    sums = placed.groupBy(part).agg(F.sum(value).alias("_size"))
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(part, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(part).orderBy(local).rowsBetween(W.unboundedPreceding, -1)
    summed = placed.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(F.broadcast(offsets), part).withColumn(name, F.col(name) + F.col("_offset")).drop(part, "_offset", local)


def numbered_by(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """The ``order`` columns and each row's place ``name`` from 0: only key columns are sorted and written."""
    return with_position(df.select(*map(quoted, order)), list(order), name)


def attach_group(members: DataFrame, groups: DataFrame, key: str, unique: str, size: str, hot: int) -> DataFrame:
    """Inner join of many ``members`` to one ``groups`` row per ``key`` when a key may own a third of all members.

    Groups with at least ``hot`` members are split: each member picks one of ``size / hot + 1`` salts from its
    ``unique`` column and the group row is repeated once per salt, so no join task sees much more than ``hot`` rows of a
    key. At most (number of members / hot) groups can be hot; whether the list of their salts is small enough to be
    broadcast is left to adaptive execution, which measures it.
    """
    salts = F.floor(F.col(size) / F.lit(hot)).cast("int") + 1
    # Asking for every column keeps this branch the same as the joined one, so Spark aggregates the groups once.
    complete = reduce(and_, (F.col(quoted(name)).isNotNull() for name in groups.columns))
    hot_keys = groups.filter((F.col(size) >= hot) & complete).select(key, salts.alias("_salts"))
    salted = (
        members.join(hot_keys, key, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(unique), F.coalesce("_salts", F.lit(1))).cast("int"))
        .drop("_salts")
    )
    repeated = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return salted.join(repeated, [key, "_salt"]).drop("_salt")
