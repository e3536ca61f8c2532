"""Near-duplicate vectors with spherical-cap filters.

Filter directions are the words of a random product code: a vector is cut into blocks, each block has a few random unit
directions, and every combination of one direction per block is a filter. Decoding walks the blocks and drops partial
words that cannot reach the cap any more, so a vector finds all filters whose cap it lies in without looking at the
others. Vectors that share a filter are compared. A pair counts in the first filter that both share, so links can be
summed without listing pairs; a bucket sends out one row per vector and one edge per vector at most.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.common import components, with_columns
from postmill.operators.ordering import materialize
from postmill.schema import quoted


@dataclass(frozen=True)
class Filters:
    """``per_vector`` filters are expected for each of ``rows`` vectors, ``per_filter`` vectors in each filter.

    The filters come from ``codes`` product codes, each under a rotation of its own, so that no direction is poor in
    filters. Their number grows with the number of vectors, so that buckets of unrelated vectors do not.
    """

    rows: int
    per_vector: int = 24
    per_filter: int = 24
    codes: int = 4
    blocks: int = 4
    least_words: int = 8
    seed: int = 0

    def code(self, dim: int) -> tuple[int, list[slice], float]:
        """Words per block, blocks of the coordinates, and the height of the caps."""
        blocks = max(1, min(self.blocks, dim // 4))
        share = self.per_filter / max(1, self.rows)
        each = self.per_vector / self.codes
        words = max(self.least_words, int(np.ceil((each / share) ** (1 / blocks))))
        share = min(0.25, each / words**blocks)
        heights = np.linspace(0, 1, 200_001)[:-1]
        weight = (1 - heights**2) ** ((dim - 3) / 2)
        above = np.cumsum(weight[::-1])[::-1] / (2 * weight.sum())
        height = float(heights[np.searchsorted(-above, -share)]) if dim > 1 else 0.5
        edges = np.linspace(0, dim, blocks + 1).astype(int)
        return words, [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)], height

    def products(self, unit: np.ndarray, number: int) -> list[np.ndarray]:
        """Inner products of the blocks of the rotated rows with the words of each block of code ``number``."""
        words, cuts, _ = self.code(unit.shape[1])
        random = np.random.default_rng([self.seed, number, unit.shape[1]])
        rotation, _ = np.linalg.qr(random.standard_normal((unit.shape[1],) * 2))
        turned = unit @ rotation
        out = []
        for cut in cuts:
            block = random.standard_normal((words, cut.stop - cut.start))
            out.append(turned[:, cut] @ (block / np.linalg.norm(block, axis=1, keepdims=True) / np.sqrt(len(cuts))).T)
        return out

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, filter)`` for all filters in whose cap the rows of ``unit`` lie, sorted by row and filter.

        Rows that lie in fewer than half of the filters expected take that many of the nearest ones, by lower caps:
        neighbours of such a row are as poor in filters and have the same ones near.
        """
        words, cuts, height = self.code(unit.shape[1])
        wanted, rows, filters = min(self.per_vector // 2, words ** len(cuts)), [], []
        products = [self.products(unit, number) for number in range(self.codes)]
        open_rows = np.arange(len(unit))
        while len(open_rows):
            row, word, reached = self._within([[p[open_rows] for p in own] for own in products], words, height)
            full = np.bincount(row, minlength=len(open_rows)) >= wanted
            if rows:  # a lowered cap: the nearest of what it holds
                order = np.lexsort((word, -reached, row))
                row, word = row[order], word[order]
                first = np.searchsorted(row, np.arange(len(open_rows)))
                nearest = np.arange(len(row)) - first[row] < wanted
                row, word = row[nearest], word[nearest]
            keep = full[row] if height > -1 else np.ones(len(row), bool)
            rows.append(open_rows[row[keep]])
            filters.append(word[keep])
            open_rows, height = open_rows[~full] if height > -1 else open_rows[:0], height - 0.05
        row, word = np.concatenate(rows), np.concatenate(filters)
        order = np.lexsort((word, row))
        return row[order], word[order]

    def _within(self, products: list[list[np.ndarray]], words: int, height: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, filter, inner product)`` of all filters above ``height``, code by code, block by block."""
        out = []
        for number, own_products in enumerate(products):
            count = len(own_products[0])
            best = [*np.cumsum([p.max(axis=1) for p in own_products[::-1]], axis=0)[::-1], np.zeros(count)]
            row, word, reached = np.arange(count), np.full(count, number, np.int64), np.zeros(count)
            for own, rest in zip(own_products, best[1:], strict=True):
                sums = reached[:, None] + own[row]
                entry, choice = np.nonzero(sums + rest[row][:, None] >= height)
                row, reached, word = row[entry], sums[entry, choice], word[entry] * words + choice
            out.append((row, word, reached))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors of a list column, one matrix per dimension."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    found = []
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        block = values[starts[rows][:, None] + np.arange(dim)]
        block = block / np.abs(block).max(axis=1, keepdims=True)
        found.append((rows, block / np.linalg.norm(block, axis=1, keepdims=True)))
    return found


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of batches sorted by them."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        columns = [table.column(k).to_numpy() for k in keys]
        change = np.zeros(max(0, table.num_rows - 1), bool)
        for values in columns:
            change |= values[1:] != values[:-1]
        cuts = np.flatnonzero(change) + 1
        start = 0
        for end in cuts.tolist():
            yield table.slice(start, end - start)
            start = end
        rest = table.slice(start)
    if rest is not None and rest.num_rows:
        yield rest


def _compare(batches: Iterator[pa.RecordBatch], least_cosine: float) -> Iterator[pa.RecordBatch]:
    """``node, links, root`` of each bucket: links counted here, and the smallest node that links inside it reach."""
    for group in _groups(batches, ["filter", "low", "high"]):
        if group.num_rows < 2:
            continue
        group = group.combine_chunks()
        current, crossing = group["filter"][0].as_py(), group["low"][0].as_py() != group["high"][0].as_py()
        node, copies, part = (group[c].to_numpy() for c in ("node", "copies", "part"))
        filters = group["filters"].chunk(0)
        for rows, unit in _matrix(group["embedding"].chunk(0)):
            if len(rows) < 2:
                continue
            near = unit @ unit.T >= least_cosine
            np.fill_diagonal(near, False)
            if crossing:
                near &= part[rows][:, None] != part[rows][None, :]
            linked = np.flatnonzero(near.any(axis=1))
            if not len(linked):
                continue
            near, rows = near[np.ix_(linked, linked)], rows[linked]
            own = filters.take(pa.array(rows))
            owner = np.repeat(np.arange(len(rows)), np.diff(own.offsets.to_numpy()))
            values = own.flatten().to_numpy()
            before = values < current
            names, place, count = np.unique(values[before], return_inverse=True, return_counts=True)
            shared = count > 1
            place, holder = np.cumsum(shared)[place] - 1, owner[before]
            use = shared[np.searchsorted(names, values[before])]
            held = np.zeros((len(rows), int(shared.sum())), np.float32)
            held[holder[use], place[use]] = 1
            first = near & ~((held @ held.T) > 0)
            links = first @ copies[rows]
            root = np.arange(len(rows))
            order = np.argsort(node[rows])
            near = near[np.ix_(order, order)]
            while True:
                lower = np.minimum(root, np.where(near, root[None, :], len(rows)).min(axis=1))
                lower = lower[lower]
                if (lower == root).all():
                    break
                root = lower
            ordered = node[rows][order]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ordered), pa.array(links[order].astype(np.int64)), pa.array(ordered[root])], names=["node", "links", "root"]
            )


def similar_vectors(
    vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", least_cosine: float = 0.95,
    block_rows: int = 1024, **filters,
) -> DataFrame:
    """One row per vector: ``id, n_links, component_id, kept``.

    Cosines are compared in double precision and pairs found below ``least_cosine`` never count. Vectors that are null,
    empty or zero or hold null or non-finite components, and rows with a null id, link with nothing (0 links; their
    component is their id). Vectors of different dimensions do not link. Equal vectors are one node with a count, so
    copies cost nothing. Rows that repeat an id are vectors of their own. Which pairs are found is a matter of chance,
    but not of the partitioning: at the default of 24 filters a vector all pairs but a few in ten thousand share one.
    Buckets above ``block_rows`` are compared block by block in tasks of their own. Other columns are not read.
    """
    usable = F.expr(
        "vector is not null and id is not null and exists(vector, x -> x <> 0) and "
        "forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    vectors = vectors.select(F.col(quoted(id)).alias("id"), F.col(quoted(embedding)).alias("vector"))
    usable = F.coalesce(usable, F.lit(False))
    classes = vectors.filter(usable).groupBy("vector").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    code = Filters(classes.count(), **filters)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("embedding"))
            lists: list = [None] * batch.num_rows
            for rows, unit in _matrix(column):
                for start in range(0, len(rows), 512):
                    part = rows[start : start + 512]
                    row, word = code.decode(unit[start : start + 512])
                    for i, own in zip(part, np.split(word, np.searchsorted(row, np.arange(1, len(part)))), strict=True):
                        lists[i] = own
            yield [pa.array(lists, pa.list_(pa.int64()))]

    # Filters of different dimensions share numbers; vectors that meet there are told apart when they are compared.
    plain = classes.select("node", "copies", F.col("vector").alias("embedding"))
    decoded = materialize(with_columns(plain, [T.StructField("filters", T.ArrayType(T.LongType()))], decode), "decoded")
    large = decoded.select(F.explode("filters").alias("filter")).groupBy("filter").count().filter(F.col("count") > block_rows)
    large = large.select("filter", F.ceil(F.col("count") / block_rows).cast("int").alias("parts"))
    met = decoded.select("node", "copies", "embedding", "filters", F.explode("filters").alias("filter")).join(large, "filter", "left")
    met = met.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["filter", "low", "high"]
    met = met.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}).drop("parts", "other")
    dealt = met.repartition(*keys).sortWithinPartitions(*keys)
    found = materialize(dealt.mapInArrow(lambda b: _compare(b, least_cosine), "node long, links long, root long"), "links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.filter("node <> root"), "node", "root")
    named = roots.join(classes.select("node", "first"), "node")
    smallest = named.groupBy("component").agg(F.min("first").alias("smallest"))
    of_class = classes.join(links, "node", "left").join(named.select("node", "component"), "node", "left").join(smallest, "component", "left")
    of_class = of_class.select(
        F.col("vector").alias("_vector"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("smallest", "first").alias("component_id"),
    )
    out = vectors.filter(usable).join(of_class, F.col("vector") == F.col("_vector")).select("id", "n_links", "component_id")
    alone = vectors.filter(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = out.union(alone)
    return out.select(F.col("id").alias(id), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
