"""Mix sources to target weights by fitting word budgets exactly.

Documents are counted by exact length. A source takes all its documents as often as its target allows; what is left of
the target is a subset-sum problem over (length, count), solved by proportional shares and a bounded-knapsack dynamic
program for the rest. Which documents of a length go in is a seeded draw.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.llm.common import ranked
from postmill.operators.ordering import materialize
from postmill.schema import quoted

WORD = r"[^\x20\x09-\x0D]+"
#: Budgets up to this many words are fitted by the dynamic program; what lies above is filled by shares.
WINDOW = 1 << 16


def targets(sources: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """Add ``target`` to one row per source ``(source, source_size)``.

    Sources in code-point order, null last, take ``weights`` in turn. Targets share the sum of all sizes by weight;
    none exceeds ``most`` times its size, and the excess goes to the others by weight. Closed form: a source is held at
    its limit if its limit per weight is at most the level that the sources before it, ordered by that ratio, leave.
    """
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1
    each = F.array(*[F.lit(float(w)) for w in weights])
    weighted = sources.withColumn("_weight", F.get(each, F.pmod(place, F.lit(len(weights)))))
    weighted = weighted.withColumn("_limit", F.col("source_size") * F.lit(float(most)))
    everything = W.partitionBy()
    lower = W.orderBy(F.col("_limit") / F.col("_weight"), "_weight", "_limit", F.col("source").isNull(), "source")
    before = lower.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    open_weight = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    levels = weighted.withColumns({"_place": F.row_number().over(lower), "_level": left / open_weight})
    # The first source in that order whose limit lies above its level fixes the level of all that follow.
    above = F.when(F.col("_limit") > F.col("_level") * F.col("_weight"), F.struct("_place", "_level"))
    first = F.min(above).over(everything)
    free = first.isNotNull() & (F.col("_place") >= first["_place"])
    target = F.when(free, first["_level"] * F.col("_weight")).otherwise(F.col("_limit"))
    return levels.withColumn("target", target).drop("_weight", "_limit", "_level", "_place")


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to ``budget`` as found, not above.

    Shares first: the same part of each length, rounded down, until at most ``window`` words are left to the documents
    that remain, longest first. The rest is exact: the reachable sums are the bits of an integer, one shift per power of
    two of a count, and the largest sum within the rest is traced back.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts.astype(np.int64)
    rest = budget
    if budget > window:
        take = (counts * ((budget - window // 2) / total)).astype(np.int64)
        rest = budget - int((lengths * take).sum())
        for i in np.argsort(-lengths, kind="stable"):
            if rest <= window:
                break
            more = min(int(counts[i] - take[i]), (rest - window // 2) // max(1, int(lengths[i])))
            take[i] += max(0, more)
            rest -= max(0, more) * int(lengths[i])
    mask, reach, steps = (1 << (rest + 1)) - 1, 1, []
    for i in np.argsort(-lengths, kind="stable"):
        length, free = int(lengths[i]), int(counts[i] - take[i])
        if length == 0 or length > rest:
            continue
        free, power = min(free, rest // length), 1
        while free > 0:
            part = min(power, free)
            steps.append((i, part, reach))
            reach |= (reach << (part * length)) & mask
            free, power = free - part, power * 2
        if reach >> rest & 1:
            break
    left = reach.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> left & 1:
            take[i] += part
            left -= part * int(lengths[i])
    return take


def _fit_source(groups: pd.DataFrame, most: int) -> pd.DataFrame:
    """``groups``: one source's (number, size, n, target, source_size). Adds whole repeats and extra copies by length.

    ``extra[k]`` documents of a length take a (k + 1)-th copy beyond the repeats. One extra copy each comes first; further
    ones, ``most`` copies in all, fill what documents too long for the budget leave open.
    """
    groups = groups.sort_values("size")
    size, target = int(groups["source_size"].iloc[0]), float(groups["target"].iloc[0])
    repeats = int(target // size) if size else 1
    lengths, counts = groups["size"].to_numpy(), groups["n"].to_numpy()
    rest, layers = round(target - repeats * size) if size else 0, []
    while rest > 0 and repeats + len(layers) < most and counts.any():
        counts = fit_lengths(lengths, counts, rest)
        layers.append(counts)
        rest -= int((lengths * counts).sum())
    extra = np.stack(layers, axis=1).tolist() if layers else [[] for _ in lengths]
    return pd.DataFrame({"number": groups["number"], "size": groups["size"], "repeats": repeats, "extra": extra})


def _draw(rows: DataFrame, weights: Sequence[float], most: float, seed: int) -> DataFrame:
    """``rows``: ``id, text, source, row``. The columns of :func:`mix` and the key ``row`` they belong to."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    sized = materialize(rows.select("id", "source", "row", size.alias("size"), F.xxhash64("text").alias("hash")), "sizes")
    histogram = materialize(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    totals = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    number = F.row_number().over(W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8")))
    plan = materialize(targets(totals, weights, most).withColumn("number", number), "targets")

    def with_number(df: DataFrame, *columns: str) -> DataFrame:
        keys = plan.select("source", "number", *columns).alias("p")
        return df.alias("d").join(keys, F.col("d.source").eqNullSafe(F.col("p.source"))).drop("source")

    fitted = with_number(histogram, "target", "source_size").groupBy("number").applyInPandas(
        lambda groups: _fit_source(groups, int(most)), "number int, size long, repeats long, extra array<long>"
    )
    numbered = with_number(sized, "target", "source_size")
    drawn = ranked(numbered, ["number", "size"], ["id", "hash"], "place", seed, ties=["row"]).join(fitted, ["number", "size"])
    copies = F.col("repeats") + F.size(F.filter("extra", lambda taking: F.col("place") < taking))
    copies = F.when(F.col("size") == 0, F.greatest(F.col("repeats"), F.lit(1))).otherwise(copies)
    return drawn.select(
        "row", "id", "size", "source_size", F.col("target").cast("double").alias("target"),
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def _rows(docs: DataFrame, id: str, text: str, source: str, *more: Column) -> DataFrame:
    columns = {"id": id, "text": text, "source": source}
    return docs.select(*[F.col(quoted(c)).alias(name) for name, c in columns.items()], F.monotonically_increasing_id().alias("row"), *more)


def mix(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = (5, 2, 1), most: float = 3, seed: int = 0,
) -> DataFrame:
    """One row per document: ``id, size, source_size, target, copies, taken``.

    Null texts have size 0; a null source is a source of its own, the last. Documents without words take no budget and
    are copied as often as their source is repeated whole, at least once. Repeated rows are rows of their own. Reruns on
    the same rows agree, whatever the partitioning; rows that repeat id and text may swap their draws. Other columns
    are not read. The lengths are counted once and written; a source's histogram has one row per distinct length, and
    the number of sources is taken to fit one task.
    """
    drawn = _draw(_rows(docs, id, text, source), weights, most, seed)
    return drawn.select(F.col("id").alias(id), "size", "source_size", "target", "copies", "taken")


def apply_mix(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = (5, 2, 1), most: float = 3, seed: int = 0,
) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as :func:`mix` says of that row.

    Ids may be null or repeated: rows are numbered as they are written to the shared folder, and both the draw and the
    join go by that number.
    """
    whole = F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("whole")
    rows = materialize(_rows(docs, id, text, source, whole).drop("text"), "rows")
    place = docs.columns.index(text)
    copies = _draw(rows.withColumn("text", F.col(f"whole.c{place}")), weights, most, seed).filter("copies > 0")
    joined = rows.select("row", "whole").join(copies.select("row", "copies"), "row")
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return joined.select(*[F.col(f"whole.c{i}").alias(c) for i, c in enumerate(docs.columns)])
