"""Packing whose windows hold every source at its target proportion, by deficit round-robin over source queues.

The documents of a source, in the order of the input, are a queue of tokens. In every window each queue is owed its
quantum, its share of the window; what is owed and not yet served is its deficit, which goes on into the next window.
Documents may be cut, so a queue is served whenever a whole token is owed and every window is full: a deficit stays below
one token. What a queue has been served before a window is therefore a number that integers give exactly, with no walk
over the windows before it. Each partition starts from the tokens that earlier partitions put into the same queue, and
so with the deficits they left, and places its documents where they are read: only counts move.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.common import sized
from postmill.llm.tokens import WordTokenizer
from postmill.operators.ordering import materialize
from postmill.schema import quoted

#: Starts of queues in partitions are broadcast up to this many rows; more are joined as Spark sees fit.
BROADCAST_ROWS = 200_000


class Schedule:
    """How many tokens of each queue the windows before a given one hold.

    Phases of whole windows share them by weight. Before a queue runs dry, one window takes what is left of it and shares
    the rest; from then on the others share all. The last window takes the rest of all. So there are at most two phases a
    queue, whatever the number of windows.
    """

    def __init__(self, sizes: Sequence[int], weights: Sequence[int], window: int):
        self.window, self.queues, self.tokens = window, len(sizes), sum(sizes)
        self.starts: list[int] = []
        self.phases: list[tuple[list[int], list[int], int]] = []  # tokens before the phase, weights; both of the queues before
        left, at = list(sizes), 0

        def before(amounts: Sequence[int]) -> list[int]:
            out = [0]
            for amount in amounts:
                out.append(out[-1] + amount)
            return out

        while any(left):
            base = before([size - rest for size, rest in zip(sizes, left, strict=True)])
            owed = [weight if rest else 0 for weight, rest in zip(weights, left, strict=True)]
            total = sum(owed)
            if sum(left) <= window:
                whole, served, shares = 1, before(left), ([0] * (self.queues + 1), 1)
            elif whole := min(rest * total // (window * weight) for rest, weight in zip(left, owed, strict=True) if weight):
                shares = before(owed), total
                served = [whole * window * weight // total for weight in shares[0]]
            else:
                last: set[int] = set()
                while True:
                    free = window - sum(left[i] for i in last)
                    others = sum(weight for i, weight in enumerate(owed) if i not in last)
                    more = {i for i, weight in enumerate(owed) if weight and i not in last and left[i] * others < free * weight}
                    if not more:
                        break
                    last |= more
                parts = before([0 if i in last else weight for i, weight in enumerate(owed)])
                cut = [free * part // others if others else 0 for part in parts]
                given = [left[i] if i in last else cut[i + 1] - cut[i] for i in range(self.queues)]
                whole, served, shares = 1, before(given), ([0] * (self.queues + 1), 1)
            self.starts.append(at)
            self.phases.append((base, *shares))
            left = [rest - (b - a) for rest, a, b in zip(left, served, served[1:])]
            at += whole
        self.windows = at
        self.starts.append(at)
        self.phases.append((before(sizes), [0] * (self.queues + 1), 1))

    def served(self, queues: int, window: int) -> int:
        """Tokens of the first ``queues`` queues in all windows before ``window``."""
        i = bisect_right(self.starts, window) - 1
        base, shares, total = self.phases[i]
        return base[queues] + (window - self.starts[i]) * self.window * shares[queues] // total

    def of_queue(self, queue: int, window: int) -> int:
        return self.served(queue + 1, window) - self.served(queue, window)

    def holding(self, queue: int, token: int) -> int:
        """The window that holds a token of a queue."""
        low, high = 0, self.windows
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.of_queue(queue, middle) <= token else (low, middle)
        return low


def tail_sequences(rest: int) -> list[int]:
    """Lengths of the sequences for a last part of ``rest`` tokens: powers of two, which need no padding."""
    return [1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1]


def assigned_queues(sizes: Mapping[str | None, int], weights: Mapping[str | None, float] | None, window: int):
    """``({source: (queue, tokens before it in the queue)}, sizes, weights)`` of the queues, by code point, null last.

    A source that is owed less than one token a window has no queue of its own: such sources share one, the last, one
    after the other, which the smallest others join until it is owed a token.
    """
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8", "replace")))
    if weights is None:
        shares = {name: sizes[name] for name in names}
    else:
        shares = {name: round(weights.get(name, 0) * (1 << 20)) for name in names}
        if any(shares[name] < 1 for name in names):
            raise ValueError("every source needs a weight above 0")
    total, small, held = sum(shares.values()), [], 0
    for name in sorted(names, key=lambda s: shares[s]):
        if shares[name] * window < total or small and held * window < total:
            small.append(name)
            held += shares[name]
    if len(small) == 1:
        small = []
    queues = [[name] for name in names if name not in set(small)] + [[name for name in names if name in set(small)]] * bool(small)
    place = {}
    for number, members in enumerate(queues):
        start = 0
        for name in members:
            place[name] = (number, start)
            start += sizes[name]
    return place, [sum(sizes[n] for n in q) for q in queues], [sum(shares[n] for n in q) for q in queues]


def encoded(docs: DataFrame, tokenizer: WordTokenizer, id: str, text: str, source: str) -> DataFrame:
    """``id, source, part, before, n, ids``: 16-bit ids of every document, and how many tokens of its source the task
    that read it had seen before. Written, so that a lost executor cannot change the order."""
    fields = [
        T.StructField("id", docs.schema[id].dataType), T.StructField("source", T.StringType()), T.StructField("part", T.IntegerType()),
        T.StructField("before", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()),
    ]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            texts, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for rows in sized(texts, 1 << 22):
                before, counts, data = [], [], []
                for i, ids in zip(rows, tokenizer.encode([texts[i] for i in rows]), strict=True):
                    before.append(seen.get(sources[i], 0))
                    counts.append(len(ids) // 4)
                    seen[sources[i]] = before[-1] + counts[-1]
                    data.append(np.frombuffer(ids, "<u4").astype("<u2").tobytes())
                own = batch.slice(rows.start, len(rows))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(2), pa.array([part] * len(rows), pa.int32()), pa.array(before, pa.int64()), pa.array(counts, pa.int64()), pa.array(data, pa.binary())],
                    names=[f.name for f in fields],
                )

    named = docs.select(F.col(quoted(id)).alias("id"), F.col(quoted(text)).alias("text"), F.col(quoted(source)).cast("string").alias("source"))
    return materialize(named.mapInArrow(encode, T.StructType(fields)), "tokens")


def pack_by_source(
    docs: DataFrame, tokenizer: WordTokenizer, capacity: int = 2048, window: int | None = None,
    weights: Mapping[str | None, float] | None = None, id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """Pieces ``id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of all documents.

    Windows of ``window`` tokens (a multiple of ``capacity``; default: one sequence) hold each source at its weight, to
    the token; the default weights are the sources' token counts, so that no source runs dry before the end. With other
    weights a source that runs dry leaves its share to the rest. Sequences hold ``capacity`` tokens, but for the last
    part, which becomes sequences of powers of two: nothing is padded. A piece is what a document gives to one sequence.

    Null texts count as empty and give their end id; a null source is a source of its own, the last. Null and repeated
    ids and repeated rows are documents like others. An empty table gives no pieces. Other columns are not read. Queues
    follow the order in which the input is read: the same files under the same splits give the same packing. The
    tokenizer must close each document with an end id and have less than 65,536 ids. A sum for each source, whose number
    is taken to fit the driver, is all that leaves the cluster.
    """
    window = window or capacity
    if window % capacity:
        raise ValueError("a window must hold whole sequences")
    tokens = encoded(docs, tokenizer, id, text, source)
    counts = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    earlier = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = materialize(counts.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "starts")
    sizes = {r.source: r.n for r in starts.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    place, queue_sizes, queue_weights = assigned_queues(sizes, weights, window)
    schedule = Schedule(queue_sizes, queue_weights, window)
    whole = schedule.tokens - schedule.tokens % capacity
    ends = [whole]
    for length in tail_sequences(schedule.tokens - whole):
        ends.append(ends[-1] + length)

    def located(position: int) -> tuple[int, int, int]:
        """Sequence, offset and the position where the sequence ends, for a position in the stream of all windows."""
        if position < whole:
            sequence, offset = divmod(position, capacity)
            return sequence, offset, position - offset + capacity
        i = bisect_right(ends, position)
        return whole // capacity + i - 1, position - ends[i - 1], ends[i]

    def place_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[int]] = {}  # queue -> window, its first and last token of the queue, where they stand

        def at(queue: int, number: int) -> list[int]:
            first, last = schedule.of_queue(queue, number), schedule.of_queue(queue, number + 1)
            inside = schedule.served(queue, number + 1) - schedule.served(queue, number)
            return [number, first, last, number * window + inside]

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("source", "n", "before", "start")]
            data = batch.column("ids")
            rows, starts, lengths, crcs, sequences, offsets = ([] for _ in range(6))
            for row, (name, n, before, start) in enumerate(zip(*columns, strict=True)):
                queue, base = place[name]
                first = base + start + before
                ids = np.frombuffer(data[row].as_buffer(), "<u2").astype("<u4").tobytes()
                now, done = known.get(queue), 0
                while done < n:
                    token = first + done
                    if now is None or not now[1] <= token < now[2]:
                        near = now is not None and now[2] == token and now[0] + 1 < schedule.windows
                        now = at(queue, now[0] + 1) if near else None
                        if now is None or not now[1] <= token < now[2]:
                            now = at(queue, schedule.holding(queue, token))
                    position = now[3] + token - now[1]
                    sequence, offset, end = located(position)
                    length = min(n - done, now[2] - token, end - position)
                    rows.append(row)
                    starts.append(done)
                    lengths.append(length)
                    crcs.append(zlib.crc32(ids[4 * done : 4 * (done + length)]))
                    sequences.append(sequence)
                    offsets.append(offset)
                    done += length
                known[queue] = now
            picked = pa.array(rows, pa.int64())
            whole_columns = [batch.column(c).take(picked) for c in ("id", "source", "n")]
            made = [pa.array(x, pa.int64()) for x in (starts, lengths, crcs, sequences, offsets)]
            yield pa.RecordBatch.from_arrays([*whole_columns[:2], *made[:3], whole_columns[2], *made[3:]], names=[f.name for f in fields])

    keys = F.col("t.source").eqNullSafe(F.col("s.source")) & (F.col("t.part") == F.col("s.part"))
    small = F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts
    joined = tokens.alias("t").join(small.select("source", "part", "start").alias("s"), keys)
    long = T.LongType()
    fields = [
        T.StructField(id, docs.schema[id].dataType), T.StructField("source", T.StringType()),
        *[T.StructField(c, long) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")],
    ]
    rows = joined.select("t.id", "t.source", "t.n", "t.before", "s.start", "t.ids")
    return rows.mapInArrow(place_pieces, T.StructType(fields))
