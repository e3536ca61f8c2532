"""Exact Jaccard self-join on word shingles by partitioning the universe of shingles.

Two sets of sizes a and b that reach the threshold differ in at most H = (100 - p)(a + b) / (100 + p) elements. Hashing
the universe into H + 1 segments leaves at least one segment in which both hold the same elements (pigeonhole). Every
set therefore publishes the signature of its elements in each segment; in a few segments it also publishes those with
one element deleted, so that these segments match up to one difference and count twice. What that wins over the H + 1
needed is slack: a set stops probing with the signatures that meet most others, which are counted for that. The number of segments depends on the size band of a pair: bands double, and a pair lies in one band or in two
neighbouring ones, each case with its own bound H.

Before that, sets that share too little with any other to link are set aside: of each set the smallest elements, a
head of the length that linking sets must share some of, are counted over all sets; of those left, all elements are.

Links are needed between different sets only, and for classes one path of links is enough. So a bucket of equal
signatures first compares each member with the one that meets most others; only buckets whose members then still belong
to different classes compare members across classes, by size and profile inside the tasks. All candidates are verified
on whole texts.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.bitmaps import likely_in, without
from postmill.llm.common import components, released, unpacked, whole_row, with_columns
from postmill.operators.ordering import materialize
from postmill.schema import quoted
from postmill.session import run_scope, shared_dir

BINS, BITS = 128, 1024
#: One segment in so many publishes one-deletion signatures.
DELETION_EVERY = 12
#: Fingerprints of sets that a task has published, to publish copies once; a full table starts anew.
SEEN = 200_000
#: Buckets up to this size are probed without counting the cost.
CHEAP = 8
#: Heads of sets: the part of a set's size that linking sets share of them, bytes of an element, elements sorted in one task.
HEAD_PART, HEAD_BYTES, CUT_TOKENS = 20, 6, 1 << 20
#: Owner of the elements that a task has settled; no fingerprint is odd.
NOBODY = 1
#: Members of a bucket that are compared with as many others in one piece, and members that a task takes in small pieces.
BLOCK, TASK_ROWS = 4096, 4096


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text with A-Z in lower case.

    Words are runs of anything but ASCII white space. Fewer words than ``width`` are one shingle; no words are none.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(width, len(words))
    total = np.full(len(words) - span + 1, span, np.uint64)
    for i in range(span):
        total = total * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(total)]
    return np.unique(_mix(total))


def fingerprint(hashes: np.ndarray) -> int:
    """Hash of a set of hashes; even, so that one bit is free for the probe mark, and within a signed long."""
    return int(xxhash.xxh3_64_intdigest(hashes.tobytes(), seed=7) >> 2 << 1)


def profile(hashes: np.ndarray) -> bytes:
    """Elements per bin, then the parity of elements per bit of a finer sketch; what :func:`apart` compares."""
    bins = np.minimum(np.bincount((hashes & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8)
    parity = np.bincount(((hashes >> np.uint64(16)) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) % 2
    return bins.tobytes() + np.packbits(parity.astype(np.uint8)).tobytes()


def profiles(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS + BITS // 8)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of two arrays of profiles, how many elements differ at least.

    A differing element changes one bin by one and turns one bit. Bins tell large sets apart, bits small ones.
    """
    bins = np.abs(a[:, :BINS].astype(np.int16) - b[:, :BINS]).sum(axis=1)
    return np.maximum(bins, np.bitwise_count(a[:, BINS:] ^ b[:, BINS:]).sum(axis=1, dtype=np.int64))


def schemes(size: int, percent: int) -> list[tuple[int, int, int]]:
    """``(scheme, segments, needed)`` in which a set of ``size`` takes part: one for its own band, up to two for neighbours.

    ``needed`` is H + 1 for the pairs in which this set is the larger one, 0 where it is always the smaller.
    """
    band = (size - 1).bit_length()
    top = 1 << band
    found = [(2 * band, 2 * top * (100 - percent) // (100 + percent) + 1, 2 * size * (100 - percent) // (100 + percent) + 1)]
    if 100 * size > percent * top:  # smaller set of a pair with the next band
        found.append((2 * band + 1, top * (100 - percent) // percent + 1, 0))
    top //= 2
    if band and percent * size <= 100 * top:  # larger set of a pair with the band before
        found.append((2 * band - 1, top * (100 - percent) // percent + 1, (size + top) * (100 - percent) // (100 + percent) + 1))
    return found


def signatures(hashes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of a set, whether the set probes with each, and the room each leaves to stop probing.

    The room is a long: scheme, slack left, and what the signature is worth (2 for a segment with one-deletion
    signatures, else 1). Empty segments are left out here, as far as the slack goes.
    """
    size = len(hashes)
    mixed = _mix(hashes + np.uint64(0x632BE59BD9B4E019))
    high = hashes >> np.uint64(32)
    out, probe, room = [], [], []
    for scheme, segments, needed in schemes(size, percent):
        doubled = max(1, segments // DELETION_EVERY)
        segment = ((high * np.uint64(segments)) >> np.uint64(32)).astype(np.int64)  # sorted, as the hashes are
        sums = np.zeros(segments, np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        sums[segment[starts]] = np.add.reduceat(mixed, starts)
        salt = _mix(np.arange(segments, dtype=np.uint64) + np.uint64(scheme << 40))
        worth = np.ones(segments, np.int64)
        worth[:doubled] = 2
        slack = segments + doubled - needed
        asks = np.full(segments, needed > 0)  # a set that is always the smaller never probes
        empty = np.ones(segments, bool)
        empty[segment] = False
        spare = np.flatnonzero(empty)[::-1]  # doubled segments come last
        spare = spare[np.cumsum(worth[spare]) <= slack]
        asks[spare] = False
        left = (scheme << 32) + 4 * (slack - int(worth[spare].sum()))
        upto = int(np.searchsorted(segment, doubled))
        out += [_mix(sums + salt), _mix(sums[segment[:upto]] - mixed[:upto] + salt[segment[:upto]])]
        probe += [asks, asks[segment[:upto]]]
        room += [left + worth, np.full(upto, left + 1)]
    return np.concatenate(out), np.concatenate(probe), np.concatenate(room)


def overlap(size: int, percent: int) -> int:
    """Elements that a set of ``size`` has in common with any set it links with."""
    return -(-percent * size // 100)


def shared_least(size: int, percent: int) -> int:
    """Head elements (see :func:`head`) that a set which links with some other one shares with heads of other sets."""
    return -(-overlap(size, percent) // HEAD_PART)


def head(hashes: np.ndarray, percent: int) -> bytes:
    """The smallest elements of a set, 6 bytes each: all but ``overlap`` of them, and ``1 / HEAD_PART`` of the size more.

    Of two sets that link, the heads have ``1 / HEAD_PART`` of the smaller one's size in common: both leave out no more than
    the overlap, and all that they share of smaller elements is in both heads.
    """
    size = len(hashes)
    longest = size - overlap(size, percent) - (-size // HEAD_PART)
    return np.ascontiguousarray(hashes[:longest]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HEAD_BYTES].tobytes()


def _tokens(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // HEAD_BYTES, 8), np.uint8)
    out[:, :HEAD_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, HEAD_BYTES)
    return out.view("<u8").reshape(-1)


def _sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``id, n, c, profile, head``: set size, fingerprint (null for empty sets), profile and head of each document."""
    fields = [T.StructField("n", T.LongType()), T.StructField("c", T.LongType()), T.StructField("profile", T.BinaryType()), T.StructField("head", T.BinaryType())]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            n, c, profiles, heads = [], [], [], []
            for text in batch.column("text").to_pylist():
                own = shingles(text, width)
                n.append(len(own))
                c.append(fingerprint(own) if len(own) else None)
                profiles.append(profile(own) if len(own) else None)
                heads.append(head(own, percent) if len(own) else None)
            yield [pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(profiles, pa.binary()), pa.array(heads, pa.binary())]

    return with_columns(docs, fields, compute, 1 << 10).drop("text")


def _linkable(sets: DataFrame, percent: int) -> DataFrame:
    """``c`` of the sets of ``c, n, head`` that may link with another one: enough of their head is in heads of other sets."""

    def read(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        yield from zip(batch.column("c").to_pylist(), map(_tokens, batch.column("head").to_pylist()), strict=True)

    tokens = sets.agg(F.coalesce(F.sum(F.octet_length("head")), F.lit(0)).alias("n")).first().n // HEAD_BYTES
    found = _shared(sets.select("c", "head"), read, tokens)
    needed = F.ceil(F.ceil(F.col("n") * percent / 100) / HEAD_PART)
    return found.join(sets.select("c", "n").dropDuplicates(["c"]), "c").filter(F.col("k") >= needed).select("c")


def _likely_linked(docs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """``id`` of the sets of ``c, id, n`` (written) of which other ones of them hold as many elements as a link takes.

    A passage that very many sets share lets them through :func:`_linkable`; here it would have to be most of a set.
    """

    def read(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for text in batch.column("text").to_pylist():
            own = shingles(text, width)
            if len(own):
                yield fingerprint(own), own & np.uint64((1 << 8 * HEAD_BYTES) - 1)

    elements = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    found = _shared(likely_in(docs, "id", sets.select("id")).select("text"), read, elements)
    return sets.join(found, "c").filter(F.col("k") >= F.ceil(F.col("n") * percent / 100)).select("id")


def _shared(sets: DataFrame, read: Callable[[pa.RecordBatch], Iterable[tuple[int, np.ndarray]]], tokens: int) -> DataFrame:
    """``c, k``: how many tokens of a set other sets have too. ``read`` gives fingerprints and tokens, ``tokens`` is about their number.

    Tokens move as packed bytes, cut by token. What several sets of one task share is settled there and sent on once, so
    that a passage of very many sets is as many tokens as there are tasks. A set that several tasks have may count too many.
    """
    cuts = max(1, -(-tokens // CUT_TOKENS))
    names = ["cut", "owners", "counts", "tokens", "known", "known_counts"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        owners: list[int] = []
        heads: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            every, sizes = np.concatenate(heads), np.array([len(h) for h in heads])
            own = np.repeat(np.arange(len(owners)), sizes)
            order = np.argsort(every, kind="stable")
            every, own = every[order], own[order]
            starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
            counts = np.diff(np.append(starts, len(every)))
            several = np.repeat(counts > 1, counts)
            found = np.bincount(own[several], minlength=len(owners))
            # Tokens of several sets go on once, under no owner.
            every = np.concatenate((every[~several], every[starts[counts > 1]]))
            own = np.concatenate((own[~several], np.full(int((counts > 1).sum()), len(owners))))
            cut = (every % np.uint64(cuts)).astype(np.int64)
            order = np.lexsort((own, cut))
            every, own, cut = every[order], own[order], cut[order]
            ids = np.array([*owners, NOBODY], np.int64)
            home = ids[:-1] // 2 % cuts
            rows = []
            for k in range(cuts):
                low, high = np.searchsorted(cut, (k, k + 1))
                mine = np.flatnonzero((home == k) & (found > 0))
                if low == high and not len(mine):
                    continue
                who, amounts = np.unique(own[low:high], return_counts=True)
                packed = every[low:high].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HEAD_BYTES].tobytes()
                rows.append((k, ids[who].tobytes(), amounts.astype(np.int32).tobytes(), packed, ids[mine].tobytes(), found[mine].astype(np.int32).tobytes()))
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(x, pa.binary()) for x in columns[1:]]], names=names)

        for batch in batches:
            for c, own in read(batch):
                if c in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(c)
                owners.append(c)
                heads.append(own)
                held += len(heads[-1])
                if held > CUT_TOKENS:
                    yield flush()
                    owners, heads, held = [], [], 0
        if owners:
            yield flush()

    def met(table: pa.Table) -> pa.Table:
        packed = {n: b"".join(table.column(n).to_pylist()) for n in names[1:]}
        own = np.repeat(np.frombuffer(packed["owners"], np.int64), np.frombuffer(packed["counts"], np.int32))
        every = _tokens(packed["tokens"])
        order = np.argsort(every, kind="stable")
        every, own = every[order], own[order]
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(every)), bool), every[1:] != every[:-1])))
        low, high = (f.reduceat(own, starts) if len(starts) else own for f in (np.minimum, np.maximum))
        several = np.repeat(low < high, np.diff(np.append(starts, len(every))))
        who, amounts = np.unique(own[several & (own != NOBODY)], return_counts=True)
        known, settled = np.frombuffer(packed["known"], np.int64), np.frombuffer(packed["known_counts"], np.int32)
        return by_home(np.concatenate((who, known)), np.concatenate((amounts, settled)).astype(np.int64))

    def by_home(who: np.ndarray, amounts: np.ndarray) -> pa.Table:
        """A row per cut, which counts the sets whose home it is."""
        home = who // 2 % cuts
        order = np.argsort(home, kind="stable")
        bounds = np.searchsorted(home[order], np.arange(cuts + 1))
        full = np.flatnonzero(np.diff(bounds))
        parts = [order[bounds[k] : bounds[k + 1]] for k in full]
        return pa.table({
            "home": pa.array(full, pa.int32()), "owners": pa.array([who[x].tobytes() for x in parts], pa.binary()),
            "counts": pa.array([amounts[x].tobytes() for x in parts], pa.binary()),
        })

    def summed(table: pa.Table) -> pa.Table:
        who, amounts = (np.frombuffer(b"".join(table.column(x).to_pylist()), np.int64) for x in ("owners", "counts"))
        names, at = np.unique(who, return_inverse=True)
        return pa.table({"c": names, "k": np.bincount(at, amounts, minlength=len(names)).astype(np.int64)})

    dealt = sets.mapInArrow(released(deal), "cut int, owners binary, counts binary, tokens binary, known binary, known_counts binary")
    return dealt.groupBy("cut").applyInArrow(met, "home int, owners binary, counts binary").groupBy("home").applyInArrow(summed, "c long, k long")


def _published(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``sig, c, room``: signatures of all sets; the lowest bit of ``c`` marks rows that probe. A task publishes copies once."""

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs, owners, rooms, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(x) for x in (np.concatenate(sigs).view(np.int64), np.concatenate(owners), np.concatenate(rooms))]
            return pa.RecordBatch.from_arrays(arrays, names=["sig", "c", "room"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                own = shingles(text, width)
                if not len(own) or (c := fingerprint(own)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(c)
                sig, probe, room = signatures(own, percent)
                sigs.append(sig)
                owners.append(probe.astype(np.int64) + c)
                rooms.append(room)
                held += len(sig)
                if held > 100_000:
                    yield flush()
                    sigs, owners, rooms, held = [], [], [], 0
        if sigs:
            yield flush()

    return docs.select("text").mapInArrow(released(publish), "sig long, c long, room long")


def _allocated(rows: DataFrame) -> DataFrame:
    """``sig, c, probe, pivot``: the buckets of several sets, one row per signature and set, probed where that is cheapest.

    What a signature costs is the size of its bucket. A set stops probing with its costliest ones, in each scheme as many
    as its slack allows; small buckets are not worth it. Whoever does not probe can still be found.
    """
    rows = rows.repartition("sig").select(
        "sig", F.col("c").bitwiseAND(F.lit(-2)).alias("c"), (F.col("c") % 2 != 0).alias("probe"), "room"
    )
    grouped = rows.withColumns({
        "least": F.expr("min(c) over (partition by sig)"), "most": F.expr("max(c) over (partition by sig)"),
        "asked": F.expr("bool_or(probe) over (partition by sig)"),
    }).filter("least < most and asked")
    # Tasks that hold copies of a text each publish its set.
    grouped = grouped.groupBy("sig", "c").agg(F.bool_or("probe").alias("probe"), F.max("room").alias("room"), F.min("least").alias("least"))
    grouped = grouped.withColumn("cost", F.expr("count(*) over (partition by sig)"))
    grouped = materialize(grouped.select("sig", "c", "probe", "room", "least", "cost"), "grouped")
    columns = ("sig", "c", "probe", "pivot")
    dear = F.col("probe") & (F.col("cost") > CHEAP)
    scheme, slack = F.shiftright("room", 32), F.shiftright("room", 2).bitwiseAND(F.lit((1 << 30) - 1))
    costliest = W.partitionBy("c", "scheme").orderBy(F.desc("cost"), "sig").rowsBetween(W.unboundedPreceding, W.currentRow)
    chosen = grouped.filter(dear).withColumns({"scheme": scheme, "slack": slack, "worth": F.col("room").bitwiseAND(F.lit(3))})
    chosen = chosen.withColumn("probe", F.sum("worth").over(costliest) > F.col("slack")).select("sig", "c", "probe")
    large = chosen.union(grouped.filter(~dear & (F.col("cost") > CHEAP)).select("sig", "c", "probe"))
    # The set that meets most others is likely near all of a group of copies: it is what the others are compared with.
    central = grouped.filter(F.col("cost") > CHEAP).groupBy("c").agg(F.sum("cost").alias("score"))
    large = large.join(central, "c").withColumns({
        "asked": F.expr("bool_or(probe) over (partition by sig)"), "pivot": F.expr("max(struct(score, c)) over (partition by sig)")["c"],
    }).filter("asked").select(*columns)
    return grouped.filter(F.col("cost") <= CHEAP).select("sig", "c", "probe", F.col("least").alias("pivot")).union(large)


def _placed(split: DataFrame) -> tuple[DataFrame, int]:
    """The members of ``split`` (written) in cells, ``left`` if they ask and ``right`` if they are asked there, and their number.

    A small bucket is one cell. A large one is a rectangle, so many probing members by so many members in a cell: a member
    goes to as many cells as there are blocks of probing members, and once more for each block of members if it probes.
    """
    large = split.groupBy("sig").agg(F.count(F.lit(1)).alias("members"), F.count_if("probe").alias("probing")).filter(F.col("members") > BLOCK)
    columns, lines = (F.ceil(F.col(x) / BLOCK).cast("int") for x in ("members", "probing"))
    large = materialize(large.withColumns({"columns": columns, "lines": lines}), "large")
    yes, no, first = F.lit(True), F.lit(False), F.lit(0)

    def cell(i, j, left, right):
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), left.alias("left"), right.alias("right"))

    def own(of):
        return F.pmod(F.xxhash64("c"), of)

    none = F.array().cast("array<struct<i:int,j:int,left:boolean,right:boolean>>")
    asking = F.transform(F.sequence(first, F.col("columns") - 1), lambda k: cell(own(F.col("lines")), k, yes, no))
    asked = F.transform(F.sequence(first, F.col("lines") - 1), lambda k: cell(k, own(F.col("columns")), no, yes))
    many = F.when(F.col("lines") > 0, F.concat(F.when(F.col("probe"), asking).otherwise(none), asked)).otherwise(none)
    cells = F.when(F.col("columns").isNull(), F.array(cell(first, first, F.col("probe"), yes))).otherwise(many)
    dealt = split.join(F.broadcast(large.select("sig", "columns", "lines")), "sig", "left")
    more = large.agg(F.sum(F.col("probing") * F.col("columns") + F.col("members") * (F.col("lines") - 1))).first()[0]
    return dealt.withColumn("cell", F.explode(cells)).select("sig", "cell.*", "c", "n", "label", "probe", "profile"), split.count() + (more or 0)


def _across(split: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of probing members of ``split`` (``sig, c, n, label, probe, profile``) with members of other labels.

    Pairs of other sizes than can link, or with profiles too far apart, are passed over inside the tasks, which take
    many small cells or one large one: nothing is listed that need not be verified.
    """
    placed, rows = _placed(split)
    task = F.pmod(F.xxhash64("sig", "i", "j"), F.lit(max(1, rows // TASK_ROWS)))

    def compare(table: pa.Table) -> pa.Table:
        sig, i, j, c, n, label = (table.column(x).to_numpy() for x in ("sig", "i", "j", "c", "n", "label"))
        left, right, probe = (table.column(x).to_numpy() for x in ("left", "right", "probe"))
        sketch = profiles(table.column("profile"))
        order = np.lexsort((j, i, sig))
        same = (sig[order][1:] == sig[order][:-1]) & (i[order][1:] == i[order][:-1]) & (j[order][1:] == j[order][:-1])
        bounds = np.flatnonzero(np.concatenate(([True], ~same, [True])))
        firsts, seconds = [], []
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            members = order[low:high]
            others = members[right[members]]
            asking = members[left[members]]
            for at in range(0, len(asking), 128):
                some = asking[at : at + 128]
                both = n[some][:, None] + n[others]
                smaller, larger = np.minimum(n[some][:, None], n[others]), np.maximum(n[some][:, None], n[others])
                fits = (label[some][:, None] != label[others]) & (100 * smaller >= percent * larger)
                fits &= (c[some][:, None] > c[others]) | ~probe[others]
                x, y = np.nonzero(fits)
                for part in range(0, len(x), 1 << 16):
                    p, q = x[part : part + (1 << 16)], y[part : part + (1 << 16)]
                    near = apart(sketch[some[p]], sketch[others[q]]) <= both[p, q] * (100 - percent) // (100 + percent)
                    firsts.append(c[some[p[near]]])
                    seconds.append(c[others[q[near]]])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (firsts, seconds))
        pairs = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b))), axis=1)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    return placed.withColumn("task", task).groupBy("task").applyInArrow(compare, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of fingerprints whose sets reach the threshold, checked on one text of each set."""
    small = sets.select("c", "id", "n", "profile")

    def side(name: str) -> DataFrame:
        return small.select(*[F.col(x).alias(f"{x}_{name}") for x in small.columns])

    sized = pairs.join(side("a"), F.col("a") == F.col("c_a")).join(side("b"), F.col("b") == F.col("c_b"))
    lower, upper = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    sized = sized.filter(lower * 100 >= upper * percent)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            both = (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()) * (100 - percent) // (100 + percent)
            keep = pa.array(apart(profiles(batch.column("profile_a")), profiles(batch.column("profile_b"))) <= both)
            yield pa.RecordBatch.from_arrays([batch.column(x).filter(keep) for x in ("a", "b", "id_a", "id_b")], names=["a", "b", "id_a", "id_b"])

    kind = sets.schema["id"].dataType.simpleString()
    close = sized.select("a", "b", "id_a", "id_b", "n_a", "n_b", "profile_a", "profile_b").mapInArrow(released(near), f"a long, b long, id_a {kind}, id_b {kind}")
    close = materialize(close, "close")
    asked = materialize(close.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct(), "asked")
    texts = likely_in(docs.select("id", "text"), "id", asked)
    joined = close.join(texts.select(F.col("id").alias("id_a"), F.col("text").alias("text_a")), "id_a")
    joined = joined.join(texts.select(F.col("id").alias("id_b"), F.col("text").alias("text_b")), "id_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[int, np.ndarray] = OrderedDict()

        def known(c: int, text: str | None) -> np.ndarray | None:
            if c not in recent:
                own = shingles(text, width)
                if fingerprint(own) != c:  # an id that several texts share
                    return None
                recent[c] = own
                if len(recent) > 64:
                    recent.popitem(last=False)
            return recent[c]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for x, y, tx, ty in zip(a, b, batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                one, two = known(x, tx), known(y, ty)
                if one is None or two is None:
                    keep.append(False)
                    continue
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * common >= percent * (len(one) + len(two) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(released(check), "a long, b long").distinct()


def similar_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: ``id, n_shingles, component_id``, the smallest id reachable by links.

    Sets link when 100 * intersection >= ``percent`` * union; ``percent`` must be 50 to 100. Documents without words have
    0 shingles and link with nothing, so their component is their own id. Equal sets are one class with all their
    documents. Rows with a null id keep their size but take no part in links and have a null component. Rows that repeat
    an id share the smallest component of any of their texts only if these link. Other columns are not read.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be between 50 and 100")
    docs = docs.select(F.col(quoted(id)).alias("id"), F.col(quoted(text)).alias("text"))
    outer = shared_dir(docs.sparkSession)
    with run_scope(docs.sparkSession):
        out = _classes(docs, width, percent)
        return materialize(out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")), "classes", outer)


def _classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``id, n, component`` of ``docs`` (``id, text``). Tables that only one step reads go with a scope of their own."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    with run_scope(spark):
        all_sets = materialize(_sets(docs, width, percent), "sets")
        sets = all_sets.filter(F.col("id").isNotNull() & F.col("c").isNotNull())
        smallest_ids = sets.groupBy("c").agg(F.min("id").alias("id"))
        # Asked for by most of the steps below, each of which would work it out again.
        one_each = materialize(sets.drop("head").join(smallest_ids, ["c", "id"]).dropDuplicates(["c"]), "one_each", folder)
        members = materialize(all_sets.select("id", "n", "c"), "members", folder)
        maybe = materialize(one_each.select("c", "id", "n").join(_linkable(sets, percent), "c", "left_semi"), "maybe", folder)
    classes = one_each.select("c", "id")
    docs = docs.filter(F.col("id").isNotNull())

    # One text of each set that may link at all.
    asking = materialize(_likely_linked(docs, maybe, width, percent), "asking")
    with run_scope(spark):
        buckets = materialize(_allocated(_published(likely_in(docs, "id", asking), width, percent)), "buckets", folder)
    stars = buckets.filter("probe and c <> pivot").select(F.greatest("c", "pivot").alias("a"), F.least("c", "pivot").alias("b"))
    stars = materialize(stars.distinct(), "stars")
    links = materialize(_verified(stars, one_each, docs, width, percent), "links")
    label = materialize(components(links, "a", "b"), "labels")

    known = one_each.select("c", "n").join(label, F.col("c") == F.col("node"), "left").select("c", "n", F.coalesce("component", "c").alias("label"))
    split = buckets.join(known, "c").select("sig", "c", "n", "probe", "label").withColumns({
        "low": F.expr("min(label) over (partition by sig)"), "high": F.expr("max(label) over (partition by sig)"),
        "asked": F.expr("bool_or(probe) over (partition by sig)"), "members": F.expr("bit_xor(xxhash64(c)) over (partition by sig)"),
    }).filter("low < high and asked")
    # Buckets with the same members, such as those of one shared passage, are one.
    split = split.groupBy(F.col("members").alias("sig"), "c", "n", "label").agg(F.bool_or("probe").alias("probe"))
    split = materialize(split.join(one_each.select("c", "profile"), "c"), "split")
    across = _across(split, percent).join(stars, ["a", "b"], "left_anti")
    more = materialize(_verified(across, one_each, docs, width, percent), "links")
    final = components(links.union(more), "a", "b")

    named = final.join(classes, F.col("node") == F.col("c"))
    smallest = named.groupBy("component").agg(F.min("id").alias("first"))
    by_class = classes.join(named.select("c", "component"), "c", "left").join(smallest, "component", "left")
    by_class = by_class.select("c", F.coalesce("first", "id").alias("component_id"))
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return members.join(by_class, "c", "left").select("id", "n", own.alias("component"))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, all columns, of which one document of each class of similar ones stays: the smallest id.

    Rows without an id, without words or alone in their class all stay; rows that repeat the id that stays do too. Columns
    of any name pass through. An empty table stays empty.
    """
    classes = similar_classes(docs, id, text, width, percent)
    gone = materialize(classes.filter(F.col("component_id") < F.col(quoted(id))).select(F.col(quoted(id)).alias("key")).distinct(), "gone")
    rows = docs.select(whole_row(docs).alias("whole"), F.col(quoted(id)).alias("key"))
    return unpacked(without(rows, "key", gone), docs.columns)
