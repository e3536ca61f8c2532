"""The trie of shared prefixes of sequences, from their sorted order and the lengths of common prefixes (LCPs).

Different sequences are range-sorted; a prefix of depth d of the sequence at place i belongs to the places around i between
which no LCP is below d. Each candidate prefix finds the left and the right end of that interval by binary searches over a
sparse table of range minima, independently of all others, so no stack walks over the sequences. A node of the trie is a
candidate whose interval starts at its own sequence; the candidate at the depth of a sequence's LCP is the parent of the
first node that the sequence adds.

Blocks of consecutive places have tables of their own in one task each. A search that leaves its block goes on over
the minima of whole blocks, whose number is bounded, to the block where it ends, and takes the place there from the few
steps in which that block's running minimum falls. Sums over an interval are differences of running sums.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.ordering import materialize, with_position

#: Bytes of an element's code in a key.
CODE = 16
#: Places in a block at least, and blocks at most: what bounds the tables that travel with tasks.
BLOCK, MOST_BLOCKS = 1024, 1 << 16

_ENTRIES = "block long, place long, lcp int, depth int, leaf int, members long, least long, whole long, sizes array<long>"
_FOUND = """kind int, block long, place long, depth int, members long, leaves long, spent long, above long,
 least long, ending long, far long, up long, up_far long"""
NODE, RIGHT, LEFT = 0, 1, 2


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """``table[k][i]``: the minimum of the 2^k values from ``i`` on."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        last, half = table[-1], 1 << (len(table) - 1)
        table.append(np.minimum(last[:-half], last[half:]))
    return table


def range_minimum(table: Sequence[np.ndarray], low: np.ndarray, high: np.ndarray, empty: int) -> np.ndarray:
    """Minima of ``low .. high - 1``; ``empty`` where that is no range."""
    out = np.full(len(low), empty, np.int64)
    length = high - low
    for k, row in enumerate(table):
        own = np.flatnonzero((length >= 1 << k) & (length < 2 << k))
        out[own] = np.minimum(row[low[own]], row[high[own] - (1 << k)])
    return out


def next_below(table: Sequence[np.ndarray], start: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first place from ``start`` on whose value is below ``depth``, by binary search; the length where there is none."""
    at, n = start.astype(np.int64), len(table[0])
    for k in reversed(range(len(table))):
        inside = np.flatnonzero(at + (1 << k) <= n)
        inside = inside[table[k][at[inside]] >= depth[inside]]
        at[inside] += 1 << k
    return at


def last_below(table: Sequence[np.ndarray], end: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last place up to ``end`` whose value is below ``depth``, by binary search; -1 where there is none."""
    at = end.astype(np.int64)
    for k in reversed(range(len(table))):
        inside = np.flatnonzero(at - (1 << k) + 1 >= 0)
        inside = inside[table[k][at[inside] - (1 << k) + 1] >= depth[inside]]
        at[inside] -= 1 << k
    return at


def common_elements(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // CODE
    other = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(other.argmax()) // CODE


def _entries(rows: pd.DataFrame, size: int) -> pd.DataFrame:
    """One block's places with the LCP with the place before, from the block's rows and one on either side."""
    rows = rows.sort_values("place")
    block, keys, places = int(rows["block"].iloc[0]), rows["key"].tolist(), rows["place"].to_numpy()
    lcps = [-1] + [common_elements(a, b) for a, b in zip(keys, keys[1:])]
    lcps[0] = -1  # of the very first place: no sequence before it shares even the root
    out = []
    for i in np.flatnonzero(places // size == block).tolist():
        depth = len(keys[i]) // CODE
        sums = np.concatenate(([0], np.cumsum(np.asarray(rows["sizes"].iloc[i], np.int64))))
        leaf = int(i + 1 == len(keys) or lcps[i + 1] < depth)
        row = rows.iloc[i]
        out.append((block, int(places[i]), lcps[i], depth, leaf, int(row["members"]), int(row["least"]), int(sums[-1]), sums[max(lcps[i], 0):]))
    return pd.DataFrame(out, columns=["block", "place", "lcp", "depth", "leaf", "members", "least", "whole", "sizes"])


class _Blocks:
    """Minima and running sums of whole blocks."""

    def __init__(self, summary: pd.DataFrame):
        summary = summary.sort_values("block")
        self.minima = sparse_table(summary["lcp"].to_numpy(np.int64))
        self.least = sparse_table(summary["least"].to_numpy(np.int64))
        self.before = {c: np.concatenate(([0], np.cumsum(summary[c].to_numpy(np.int64)))) for c in ("members", "leaves", "spent")}
        self.count = len(summary)


_NONE = np.iinfo(np.int64).max


def _found(rows: pd.DataFrame, blocks: _Blocks) -> pd.DataFrame:
    """The nodes that a block's sequences add, and the steps of its minima from either side."""
    rows = rows.sort_values("place")
    block, first, n = int(rows["block"].iloc[0]), int(rows["place"].iloc[0]), len(rows)
    lcp, depth, least = (rows[c].to_numpy(np.int64) for c in ("lcp", "depth", "least"))
    arrays = [np.asarray(x, np.int64) for x in rows["sizes"]]
    new = rows["whole"].to_numpy(np.int64) - np.array([x[0] for x in arrays], np.int64)
    # What the members of the sequences hold in all, less what the sequences add to the trie.
    spent = rows["members"].to_numpy(np.int64) * rows["whole"].to_numpy(np.int64) - new
    running = {
        name: blocks.before[name][block] + np.concatenate(([0], np.cumsum(values)))
        for name, values in (("members", rows["members"].to_numpy(np.int64)), ("leaves", rows["leaf"].to_numpy(np.int64)), ("spent", spent))
    }
    minima, smallest = sparse_table(lcp), sparse_table(least)

    # Candidates: for each sequence the depth of its LCP, then every depth that it adds.
    top = np.maximum(lcp, 0)
    own = np.repeat(np.arange(n), depth - top + 1)
    at = np.arange(len(own)) - np.repeat(np.cumsum(depth - top + 1) - (depth - top + 1), depth - top + 1)
    deep = top[own] + at
    left = last_below(minima, own, deep)
    right = next_below(minima, own + 1, deep)
    node = deep > lcp[own]
    # Searches that leave the block end in another one.
    left_block = np.where(left < 0, last_below(blocks.minima, np.full(len(own), block - 1), deep) if block else -1, -1)
    right_block = next_below(blocks.minima, np.full(len(own), block + 1), deep)
    right_block = np.where(right == n, right_block, block)
    inner = range_minimum(smallest, own, right, _NONE)
    over = np.flatnonzero(right == n)
    inner[over] = np.minimum(inner[over], range_minimum(blocks.least, np.full(len(over), block + 1), right_block[over], _NONE))
    closed = right_block == block
    to_end = right_block == blocks.count
    far = np.where(closed | to_end, -1, right_block)

    def upto(name: str) -> np.ndarray:
        """The running sum at the right end, as far as it is known here."""
        return np.where(closed, running[name][np.minimum(right, n)], np.where(to_end, blocks.before[name][-1], 0))

    # Sizes of the elements above a node, its own excluded.
    above = np.concatenate(arrays)
    shift = np.where(deep > top[own], -1, 0)
    above = np.where(deep == 0, 0, above[np.arange(len(own)) + shift])
    start = {name: running[name][own] for name in running}
    ended = rows["whole"].to_numpy(np.int64)[own]
    # saved = spent in the interval + what the own sequence added above the node - (members - 1) * elements above
    base = -start["spent"] + new[own] - ended
    up = np.where(at > 0, first + own, -1)
    parent = np.maximum(np.arange(len(own)) - 1, 0)
    # The first node of a sequence hangs on the candidate before it, whose left end is the parent's place.
    hangs = node & (deep > 0) & (deep - 1 <= lcp[own])
    up = np.where(hangs, np.where(left[parent] < 0, -1, first + left[parent]), up)
    up_far = np.where(hangs & (left[parent] < 0), left_block[parent], -1)
    nodes = pd.DataFrame({
        "kind": NODE, "block": block, "place": first + own, "depth": deep,
        "members": upto("members") - start["members"], "leaves": upto("leaves") - start["leaves"],
        "spent": upto("spent") + base, "above": above, "least": inner,
        "ending": pd.array(least[own], "Int64"), "far": far, "up": up, "up_far": up_far,
    })
    nodes.loc[deep < depth[own], "ending"] = pd.NA
    nodes = nodes[node]

    def steps(kind: int, order: np.ndarray) -> pd.DataFrame:
        values = lcp[order]
        low = np.concatenate(([True], values[1:] < np.minimum.accumulate(values)[:-1]))
        at = order[low]
        return pd.DataFrame({
            "kind": kind, "block": block, "place": first + at, "depth": lcp[at],
            "members": running["members"][at], "leaves": running["leaves"][at], "spent": running["spent"][at], "above": 0,
            "least": range_minimum(smallest, np.zeros(len(at), np.int64), at, _NONE),
            "ending": pd.array([pd.NA] * len(at), "Int64"), "far": -1, "up": -1, "up_far": -1,
        })

    return pd.concat([nodes, steps(RIGHT, np.arange(n)), steps(LEFT, np.arange(n)[::-1])])


def _steps(block: str, steps: DataFrame) -> DataFrame:
    """One row per block: its steps as an array, from the outside in, so that depths fall."""
    outside = F.when(F.col("kind") == RIGHT, F.col("place")).otherwise(-F.col("place"))
    fields = F.struct(outside.alias("outside"), "depth", "place", "members", "leaves", "spent", "least")
    return steps.groupBy(F.col("block").alias(block)).agg(F.array_sort(F.collect_list(fields)).alias("steps"))


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """Nodes of the trie of ``sequences``: one row ``(key, sizes, members, least)`` per different sequence.

    ``key`` joins the 16-byte codes of the elements, ``sizes`` holds their sizes, ``members`` counts the members with that
    sequence and ``least`` is their smallest id. One row per node: ``place`` (of its first sequence in the sorted order),
    ``depth`` (0 is the root), ``parent_place`` (null for the root; the parent's depth is one less), ``node`` and
    ``parent`` (smallest member id of each), ``n_members``, ``n_children``, ``n_leaves`` (childless nodes in the subtree),
    ``saved`` (sum over the subtree of (members - 1) * size of the last element) and ``ending`` (smallest id of
    the members whose whole sequence the node is, null if there are none). The members of a node are the places from its own on that its interval takes in.

    Null keys are not allowed. A key (16 bytes an element) must fit into a task, as must a block of them; everything else
    is bounded whatever the number of sequences or the size of a subtree. No rows give no nodes.
    """
    placed = with_position(sequences.select("key", "sizes", "members", "least"), ["key"], "place")
    rows = placed.count()
    if not rows:
        return placed.sparkSession.createDataFrame([], "place long, depth int, parent_place long, node long, parent long, n_members long, n_children long, n_leaves long, saved long, ending long")
    size = max(BLOCK, -(-rows // MOST_BLOCKS))
    block, inside = F.floor(F.col("place") / size), F.col("place") % size
    # A block's first and last rows go to its neighbours as well.
    around = F.array(
        F.when((inside == 0) & (F.col("place") > 0), block - 1), block, F.when((inside == size - 1) & (F.col("place") < rows - 1), block + 1)
    )
    dealt = placed.withColumn("block", F.explode(F.filter(around, lambda b: b.isNotNull())))
    entries = dealt.groupBy("block").applyInPandas(lambda df: _entries(df, size), _ENTRIES)
    entries = materialize(entries, "lcps")
    added = F.col("whole") - F.get("sizes", F.lit(0))
    summary = entries.groupBy("block").agg(
        F.min("lcp").alias("lcp"), F.min("least").alias("least"), F.sum("members").alias("members"), F.sum("leaf").alias("leaves"),
        F.sum(F.col("members") * F.col("whole") - added).alias("spent"),
    ).toPandas()  # at most MOST_BLOCKS rows
    blocks = _Blocks(summary)
    found = materialize(entries.groupBy("block").applyInPandas(lambda df: _found(df, blocks), _FOUND), "nodes")

    right = _steps("far", found.filter(F.col("kind") == RIGHT))
    left = _steps("up_far", found.filter(F.col("kind") == LEFT))

    def falls_below(depth: Column) -> Column:
        return F.get("steps", F.size(F.filter("steps", lambda s: s["depth"] >= depth)))

    # Only one prefix of each depth leaves a block on either side, however many nodes hang on it.
    nodes = found.filter(F.col("kind") == NODE).drop("kind")
    away = nodes.filter("up_far >= 0")
    ups = away.select("block", "depth", "up_far").distinct().join(left, "up_far")
    ups = ups.select("block", "depth", falls_below(F.col("depth") - 1)["place"].alias("l"))
    nodes = nodes.filter("up_far < 0").withColumn("l", F.lit(None).cast("long")).unionByName(away.join(ups, ["block", "depth"]))
    step = right.schema["steps"].dataType.elementType
    over = nodes.filter("far >= 0").join(right, "far").withColumn("r", falls_below(F.col("depth"))).drop("steps")
    nodes = nodes.filter("far < 0").withColumn("r", F.lit(None).cast(step)).unionByName(over)
    members = F.col("members") + F.coalesce("r.members", F.lit(0))
    spent = F.col("spent") + F.coalesce("r.spent", F.lit(0))
    nodes = nodes.select(
        "place", "depth", F.when(F.col("depth") > 0, F.coalesce("l", "up")).alias("parent_place"),
        F.least("least", "r.least").alias("node"), members.alias("n_members"),
        (F.col("leaves") + F.coalesce("r.leaves", F.lit(0))).alias("n_leaves"), (spent - (members - 1) * F.col("above")).alias("saved"), "ending",
    )
    nodes = materialize(nodes, "trie")
    children = nodes.filter("depth > 0").groupBy(F.col("parent_place").alias("place"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("place").alias("parent_place"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    out = nodes.join(children, ["place", "depth"], "left").join(parents, ["parent_place", "depth"], "left")
    return out.select(
        "place", "depth", "parent_place", "node", "parent", "n_members", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "n_leaves", "saved", "ending",
    )
