"""Runs of words that repeat with a period, caught online by blocks of power-of-two length.

A catcher watches each completed block of 2^k words that starts at a multiple of 2^k. Every word appended completes a
suffix of 2^k words; where that suffix equals the block of the catcher whose distance q from it is 2^k .. 2^(k+1) - 1, the
words between make a square of period q. A run of period q repeats itself over at least 2q words, so it holds such a
block whole, and every run is caught at the level of its period. Squares of one period whose blocks follow one another are one
run, whose ends are then found on the words themselves. Blocks of 8 words catch all periods below 16, because a run has
24 words at least.

Words are appended in chunks and compared as arrays, which makes the same comparisons as word by word. Suffixes are
compared by hashes, runs by the words: a chance agreement of hashes is found out and can't hide a run.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shortest run in words, and how often its period must fit into it.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Level of the smallest blocks: 8 words.
LOWEST = 3
#: Words that are appended at a time.
CHUNK = 1 << 16
#: Bytes of text after which a task hands on its rows.
FLUSH_BYTES = 1 << 22


def _joined(left: np.ndarray, right: np.ndarray, level: int) -> np.ndarray:
    """Hashes of twice the length, from those of two neighbouring parts."""
    mixed = left * np.uint64(0x9E3779B97F4A7C15 + 2 * level) + right * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ (mixed >> np.uint64(29))


class Catchers:
    """Squares in a growing text. ``append`` takes word codes and returns the squares they complete.

    Of each level only the hashes that later words can meet are kept, so the state is bounded by the number of words.
    """

    def __init__(self, longest: int):
        """``longest``: the longest period looked for."""
        self.longest = longest
        self.first: list[int] = []  # of each level, the position of the first hash kept
        self.hashes: list[np.ndarray] = []

    def append(self, codes: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """``(length, starts, periods)``: blocks of that length which the words from start + period on repeat."""
        found, new, level = [], (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 0
        while level <= LOWEST or 1 << level <= self.longest:
            if level == len(self.hashes):
                self.first.append(0)
                self.hashes.append(new[:0])
            held = np.concatenate((self.hashes[level], new)) if len(self.hashes[level]) else new
            first, fresh = self.first[level], len(held) - len(new)
            if level >= LOWEST and len(new):
                found += self._squares(level, held, first, fresh)
            # The next level joins each hash with the one 2^level words on.
            half = 1 << level
            start = max(0, fresh - half)
            above = _joined(held[start : len(held) - half], held[start + half :], level) if len(held) > start + half else held[:0]
            keep = max(0, len(held) - half)
            if level >= LOWEST:
                last = first + len(held)
                keep = min(keep, max(0, (((last >> level) - 1) << level) - first))
            self.first[level], self.hashes[level] = first + keep, held[keep:]
            new, level = above, level + 1
            if not len(new) and level >= len(self.hashes):
                break
        return found

    def _squares(self, level: int, held: np.ndarray, first: int, fresh: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        size, out = 1 << level, []
        # The catcher for the suffix at j is the block before the block in which j lies.
        skip = -first % size
        blocks = np.repeat(held[skip::size], size)
        for back in (1, 0) if level == LOWEST else (1,):
            # back 1: distances size .. 2 size - 1; back 0: distances 1 .. size - 1, in the block itself
            begin = max(fresh, skip + back * size)
            if begin >= len(held):
                continue
            same = held[begin:] == blocks[begin - skip - back * size : len(held) - skip - back * size]
            at = np.flatnonzero(same) + begin + first
            starts = ((at >> level) - back) << level
            out.append((size, starts[at > starts], (at - starts)[at > starts]))
        return out


def _ends(codes: np.ndarray, start: int, period: int) -> tuple[int, int]:
    """The widest stretch around ``start`` in which each word equals the one ``period`` on; empty if ``start`` doesn't."""
    high, step, n = start, 64, len(codes) - period
    while high < n:
        other = codes[high : min(high + step, n)] != codes[high + period : min(high + step, n) + period]
        if other.any():
            high += int(other.argmax())
            break
        high, step = min(high + step, n), step * 2
    low, step = start, 64
    while low > 0:
        begin = max(0, low - step)
        other = codes[begin:low] != codes[begin + period : low + period]
        if other.any():
            low -= int(other[::-1].argmax())
            break
        low, step = begin, step * 2
    return low, high


def runs(codes: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """All ``(start, length, period)``, by start and period: stretches of at least ``max(least, times * period)`` words
    with that smallest period, which no neighbouring word extends. ``least`` must be 24 and ``times`` 3 or more."""
    if least < LEAST_WORDS or times < LEAST_TIMES:
        raise ValueError("runs have 24 words and three periods at least")
    if len(codes) < least:
        return []
    catchers = Catchers(len(codes) // times)
    levels: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for at in range(0, len(codes), CHUNK):
        for size, starts, periods in catchers.append(codes[at : at + CHUNK]):
            if len(starts):
                levels.setdefault(size, []).append((starts, periods))
    found: dict[int, list[tuple[int, int]]] = {}  # period -> (start, end)

    def inside(size: int, starts: np.ndarray, periods: np.ndarray) -> np.ndarray:
        """Squares within a run of a divisor of their period: the same words again."""
        known = np.zeros(len(starts), bool)
        for period, stretches in found.items():
            where = np.flatnonzero(~known & (periods % period == 0))
            if len(where):
                begin, end = (np.array(x) for x in zip(*sorted(stretches), strict=True))
                i = np.searchsorted(begin, starts[where], side="right") - 1
                known[where[(i >= 0) & (end[i] >= starts[where] + periods[where] + size)]] = True
        return known

    for size in sorted(levels):
        starts, periods = (np.concatenate(x) for x in zip(*levels[size], strict=True))
        fits = periods * times <= len(codes)
        starts, periods = starts[fits], periods[fits]
        if size > 1 << LOWEST and found:
            rest = ~inside(size, starts, periods)
            starts, periods = starts[rest], periods[rest]
        order = np.lexsort((starts, periods))
        starts, periods = starts[order], periods[order]
        for period in np.unique(periods).tolist():
            own = starts[np.searchsorted(periods, period) : np.searchsorted(periods, period, side="right")]
            if size == 1 << LOWEST and found:  # only here can one level hold a period and its multiples
                own = own[~inside(size, own, np.full(len(own), period))]
            # Blocks that follow one another are in one stretch.
            heads = own[np.concatenate(([True], np.diff(own) != size))] if len(own) else own
            end, new = -1, []
            for start in heads.tolist():
                if start < end:
                    continue
                low, end = _ends(codes, start, period)
                if end - low + period >= max(least, times * period):
                    new.append((low, end + period))
            if new:
                found.setdefault(period, []).extend(new)
    return sorted((low, high - low, period) for period, stretches in found.items() for low, high in stretches)


def repeated(n: int, spans: Iterable[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words lie in a run after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in spans:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) > 0


def word_codes(words: Sequence[bytes]) -> np.ndarray:
    """A number for each word, the same for the same word of this text only."""
    codes: dict[bytes, int] = {}
    return np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))


def with_runs(docs: DataFrame, text: str = "text", runs_column: str = "runs", words_column: str = "n_words", collapsed: str = "collapsed") -> DataFrame:
    """Add ``n_words``, ``runs`` (array of start, length, period in words, by start and period) and ``collapsed``: the
    words that no run repeats, joined by one space.

    Words are what ASCII white space separates. Null and empty texts have no words, no runs and an empty collapsed text.
    Repeated rows are rows of their own; other columns stay, but for those of the new names, which are replaced. One
    text's words must fit into a task; its state besides grows with them and no faster.
    """
    names = (words_column, runs_column, collapsed)
    base = docs.drop(*[c for c in names if c in docs.columns and c != text])
    span = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([
        *base.schema.fields, T.StructField(words_column, T.LongType()), T.StructField(runs_column, T.ArrayType(span)), T.StructField(collapsed, T.StringType()),
    ])
    arrow_span = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    place = base.columns.index(text)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(place).cast(pa.binary())
            counts, spans, texts, first, held = [], [], [], 0, 0

            def flush(end: int) -> pa.RecordBatch:
                made = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(arrow_span)), pa.array(texts, pa.binary()).cast(pa.string())]
                return pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns, *made], names=schema.names)

            for row, data in enumerate(whole):
                words = (data.as_py() or b"").split()
                found = runs(word_codes(words)) if len(words) >= LEAST_WORDS else []
                counts.append(len(words))
                spans.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                if found:
                    words = [w for w, gone in zip(words, repeated(len(words), found).tolist(), strict=True) if not gone]
                texts.append(b" ".join(words))
                held += len(texts[-1])
                if held > FLUSH_BYTES:
                    yield flush(row + 1)
                    counts, spans, texts, first, held = [], [], [], row + 1, 0
            if counts:
                yield flush(batch.num_rows)

    return base.mapInArrow(find, schema)


def strongest(runs_column: str = "runs"):
    """The run with the greatest exact length / period; of equals the first, then that of the smallest period."""
    # Compared crosswise, as whole numbers. Runs are in the order of start and period, so a later one must be greater.
    better = F.aggregate(
        F.slice(runs_column, 2, F.greatest(F.size(runs_column), F.lit(1))), F.get(runs_column, F.lit(0)),
        lambda best, run: F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best),
    )
    return F.when(F.size(runs_column) > 0, better)
