"""Picking rows by position, paging and the detail view."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import count, islice
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.operators.ordering import materialize, numbered_by, with_running_sum
from postmill.operators.timeline import TIME
from postmill.schema import quoted

# --- fixed values -----------------------------------------------------------------------------------------------
PAGE_SIZE = 50
MIN_SELECTED = 1
NO_SUBJECT = "(no subject)"
NO_CONTENT = "_No content available_"
# --- end of fixed values ----------------------------------------------------------------------------------------

#: Rows that a top-k keeps cheaply; deeper positions are numbered with a distributed sort.
SHALLOW = 10_000
#: Places of one repeated row that are listed in one value.
_PLACES = 1 << 16

TIME_ORDER = (TIME, "Message-ID")


def _ordering(order: Sequence[str]) -> list[Column]:
    return [F.col(quoted(name)) for name in order]


def _row_hashes(df: DataFrame) -> list[Column]:
    """128 bits of hash over the whole row: the order among rows that tie in everything they are ordered by."""
    plain = [F.to_json(F.struct(quoted(f.name))) if "map<" in f.dataType.simpleString() else F.col(quoted(f.name)) for f in df.schema.fields]
    return [F.xxhash64(*plain), F.xxhash64(F.lit(1), *plain)]


def _top(df: DataFrame, rows: int, order: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """The first ``rows`` rows as a top-k, and the columns that order them.

    The keys alone are looked at first, which reads no other column: only if two of them are equal does the hash of
    the whole row take part in the order.
    """
    by = _ordering(order)
    keys = df.select(*by).orderBy(*by).limit(rows + 1).collect()
    if any(tuple(a) == tuple(b) for a, b in zip(keys, keys[1:])):
        by = by + _row_hashes(df)
    return df.orderBy(*by).limit(rows), by


def _numbered(df: DataFrame, asked: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows of ``df`` at the distinct places ``asked`` (``position``), with their ``position``.

    Only order keys are numbered, by a range sort. Equal keys have consecutive places, the first of which and their
    number come with the key. A key of one row is that row's place. Rows of equal keys are counted by the hash of the
    whole row, and running sums of those counts give each its places, so that k rows meet k places once; of rows that
    are equal in full, one stands for all. Neither step takes the rows of a key into one task.
    """
    names = [f"_order{i}" for i in range(len(order))]
    place = F.col("position")
    keys = numbered_by(df, order, "position")
    keys = keys.select(*[F.col(quoted(n)).alias(a) for n, a in zip(order, names, strict=True)], place)
    wanted = keys.join(asked, "position", "left_semi").drop("position").distinct()

    def same(left: str, right: str) -> Column:
        return reduce(and_, (F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names))

    groups = keys.alias("k").join(wanted.alias("w"), same("k", "w"), "left_semi").groupBy(*names)
    groups = materialize(groups.agg(F.min("position").alias("_first"), F.count(F.lit(1)).alias("_rows")), "groups")
    whole = df.select(F.struct(*[quoted(c) for c in df.columns]).alias("row"), *[F.col(quoted(n)).alias(a) for n, a in zip(order, names, strict=True)])
    matched = whole.alias("r").join(groups.alias("g"), same("r", "g")).select("row", "_first", "_rows")
    fields = [F.col(f"row.{quoted(c)}").alias(c) for c in df.columns if c != "position"]
    found = matched.filter("_rows = 1").select(*fields, F.col("_first").alias("position")).join(asked, "position", "left_semi")
    if groups.filter("_rows > 1").isEmpty():
        return found.select(*[quoted(c.name) for c in df.schema.fields if c.name != "position"], "position")

    hashed = df.select(F.struct(*[quoted(c) for c in df.columns]).alias("row"), *[h.alias(f"_hash{i}") for i, h in enumerate(_row_hashes(df))],
                       *[F.col(quoted(n)).alias(a) for n, a in zip(order, names, strict=True)])
    tied = hashed.alias("r").join(groups.filter("_rows > 1").alias("g"), same("r", "g")).select("_first", "_hash0", "_hash1", "row")
    triple = ["_first", "_hash0", "_hash1"]
    counts = with_running_sum(tied.groupBy(*triple).agg(F.count(F.lit(1)).alias("_n")), triple, "_n", "_before")
    starts = counts.groupBy("_first").agg(F.min("_before").alias("_start"))
    counts = counts.join(starts, "_first").withColumn("_at", F.col("_first") + F.col("_before") - F.col("_start"))
    # A row that is there very often has its places dealt out in parts.
    parts = counts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.expr(f"(_n - 1) div {_PLACES}"))))
    low = F.col("_at") + F.col("_part") * _PLACES
    high = F.least(F.col("_at") + F.col("_n"), low + _PLACES) - 1
    places = parts.select(*triple, F.explode(F.sequence(low, high)).alias("position")).join(asked, "position", "left_semi")
    once = tied.groupBy(*triple).agg(F.first("row").alias("row"))
    repeated = once.join(places, triple).select(*fields, "position")
    return found.select(*repeated.columns).unionByName(repeated)


def rows_at(
    df: DataFrame, positions: Iterable[int] | DataFrame, order: Sequence[str] = TIME_ORDER, shallow: int = SHALLOW
) -> DataFrame:
    """Rows at the given 0-based positions of the order, with their ``position`` (a column of that name is replaced).

    ``positions`` are numbers, or a frame whose first column holds them. Numbers below ``shallow`` are found by a top-k.
    Deeper ones and frames number the order keys alone, which writes a table of keys, and join the rows to the keys
    picked. Both ways start jobs when called and give the same rows: rows that tie in ``order`` follow by a hash of the
    whole row, and rows equal in full can't be told apart. Positions past the end give nothing.
    """
    if isinstance(positions, DataFrame):
        asked = positions.select(F.col(quoted(positions.columns[0])).cast("bigint").alias("position")).distinct()
        return _numbered(df, asked, order)
    wanted = sorted(set(positions))
    if not wanted:
        return df.withColumn("position", F.lit(0).cast("bigint")).filter(F.lit(False))
    if wanted[-1] < shallow:
        top, by = _top(df, wanted[-1] + 1, order)
        numbered = top.withColumn("position", F.row_number().over(W.orderBy(*by)).cast("bigint") - 1)
        return numbered.filter(F.col("position").isin(wanted))
    asked = df.sparkSession.createDataFrame([(i,) for i in wanted], "position bigint")
    return rows_at(df, asked, order, shallow)


def working_set(
    df: DataFrame,
    selected: Iterable[int] = (),
    minimum: int = MIN_SELECTED,
    order: Sequence[str] = TIME_ORDER,
    shallow: int = SHALLOW,
) -> DataFrame:
    """The selected rows, filled up with the oldest others to ``minimum``; without a selection the oldest ``minimum``.

    Positions past the end select nothing and do not count towards ``minimum``. As many of the oldest others as could be
    needed are looked up along with the selection; how many of the selected exist then decides how many of them stay.
    """
    chosen = sorted({i for i in selected if i >= 0})
    taken = set(chosen)
    spare = list(islice((i for i in count() if i not in taken), minimum))
    if not chosen:
        return rows_at(df, spare, order, shallow)
    found = rows_at(df, [*chosen, *spare], order, shallow)
    picked = F.col("position").isin(chosen)
    # The rows asked for are few, so one task can count them.
    found = found.withColumns({"_chosen": picked, "_existing": F.count(F.when(picked, 1)).over(W.partitionBy())})
    rank = F.row_number().over(W.partitionBy("_chosen").orderBy("position"))
    found = found.withColumn("_rank", rank)
    return found.filter(F.col("_chosen") | (F.col("_rank") <= F.lit(minimum) - F.col("_existing"))).drop("_chosen", "_existing", "_rank")


def page(
    df: DataFrame, number: int, size: int = PAGE_SIZE, order: Sequence[str] = TIME_ORDER, shallow: int = SHALLOW
) -> DataFrame:
    """Page ``number`` (from 1) of the ordered frame.

    Pages that end within the first ``shallow`` rows are a top-k. A deeper one would hold all rows before it in one task,
    so the order keys are numbered instead, as in :func:`rows_at`, with the same rows where keys tie;
    :func:`page_after` is the cheap way to go on where they don't.
    """
    if number < 1:
        raise ValueError("pages count from 1")
    first = (number - 1) * size
    if first + size <= shallow:
        _, by = _top(df, first + size, order)
        return df.orderBy(*by).offset(first).limit(size)
    asked = df.sparkSession.range(first, first + size).select(F.col("id").alias("position"))
    if "position" not in df.columns:
        return _numbered(df, asked, order).orderBy("position").drop("position")
    # A column of the caller's that has the name stays.
    kept = df.withColumnRenamed("position", "_own_position")
    order = ["_own_position" if o == "position" else o for o in order]
    found = _numbered(kept, asked, order).orderBy("position").drop("position")
    return found.withColumnRenamed("_own_position", "position").select(*[quoted(c) for c in df.columns])


def page_after(df: DataFrame, last: Sequence, size: int = PAGE_SIZE, order: Sequence[str] = TIME_ORDER) -> DataFrame:
    """The page that follows the row with key values ``last``; deep pages cost no more than the first."""
    later = F.lit(False)
    for name, value in reversed(list(zip(order, last))):
        c, v = F.col(quoted(name)), F.lit(value)
        later = (c > v) | ((c == v) & later)
    first_key = F.col(quoted(order[0])) >= F.lit(last[0])  # implied, and simple enough to be pushed down
    return df.filter(first_key & later).orderBy(*_ordering(order)).limit(size)


def page_count(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """Number of rows and of pages."""
    rows = df.agg(F.count(F.lit(1)).alias("emails"))
    return rows.withColumn("pages", F.ceil(F.col("emails") / F.lit(size)))


def overview(df: DataFrame) -> DataFrame:
    return df.select(TIME, "From", "Subject")


def detail(df: DataFrame) -> DataFrame:
    """``(title, from, to, body)`` of each message; ``to`` only if the frame has recipients."""

    def filled(name: str):
        return [F.nullif(F.col(quoted(name)), F.lit(""))] if name in df.columns else []

    minute = F.substring(F.col(TIME).cast("string"), 1, 16)
    subject = F.coalesce(F.col("Subject"), F.lit(NO_SUBJECT)) if "Subject" in df.columns else F.lit(NO_SUBJECT)
    columns = [
        F.concat(minute, F.lit(" — "), subject).alias("title"),
        (F.coalesce(F.col("From"), F.lit("")) if "From" in df.columns else F.lit("")).alias("from"),
    ]
    if "To" in df.columns:
        columns.append(F.col("To").alias("to"))
    columns.append(F.coalesce(*filled("Body"), *filled("Content"), F.lit(NO_CONTENT)).alias("body"))
    return df.select(*columns)
