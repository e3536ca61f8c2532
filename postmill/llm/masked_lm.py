"""Masked pseudo-likelihood of documents under a bidirectional window network.

The network predicts the class of a word from the classes on both sides of it. Words are counted over all documents; the
frequent ones are classes of their own, the others share hashed classes, so a document becomes one byte per word. Training
is data-parallel: in each round every task trains its own copy of the parameters on the masked words of its documents and
the copies are averaged by the number of words. Then every word of every document is predicted: the logarithms of the
probability of its class and of its share in that class, by the counts of all words, sum up to the score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.common import with_columns
from postmill.operators.ordering import materialize
from postmill.schema import quoted

WORDS = re.compile(r"\w+|[^\w\s]")
#: The same for texts of ASCII in lower case, where a plain set of characters is found faster than a class of Unicode.
_ASCII_WORDS = re.compile(r"[a-z0-9_]+|[^a-z0-9_ \t-\r\x1c-\x1f]")
CLASSES, HASHED, SIDE, WIDTH = 256, 63, 2, 16
#: Words this far apart are masked and predicted together; the rounds of training share out all places.
MASK_EVERY, ROUNDS = 16, 3
#: Words whose counts travel with the tasks; the counts of the others come by a join.
KNOWN = 1 << 14
#: Steps of the grid of counts per power of two.
_GRID = 8
_EDGE = 0  # class that stands beyond the ends of a document
#: Words of one training step, and those whose predictions are worked on at a time.
_BATCH, _PIECE = 2048, 512
#: Number of each hidden unit of each class.
_CELLS = np.arange(CLASSES * WIDTH).reshape(CLASSES, WIDTH)


@dataclass(frozen=True)
class Network:
    """``context[p, w]``: what word ``w`` at place ``p`` of the window adds; ``out``, ``bias``: one column per class."""

    context: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def started(counts: np.ndarray, seed: int) -> Network:
        random = np.random.default_rng(seed)
        context = random.normal(0, 0.1, (2 * SIDE, CLASSES, WIDTH)).astype(np.float32)
        out = random.normal(0, 0.1, (WIDTH, CLASSES)).astype(np.float32)
        return Network(context, np.zeros(WIDTH, np.float32), out, np.log((counts + 1) / (counts + 1).sum()).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.context, self.hidden_bias, self.out, self.bias)])

    def shaped(self, values: np.ndarray) -> Network:
        parts, at = [], 0
        for x in (self.context, self.hidden_bias, self.out, self.bias):
            parts.append(values[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Network(*parts)

    def hidden(self, window: np.ndarray) -> np.ndarray:
        """Values of the hidden units, and a last column of ones that stands for the bias of each class."""
        words = window.astype(np.intp)
        units = self.hidden_bias + self.context[0].take(words[0], axis=0)
        for place in range(1, 2 * SIDE):
            units += self.context[place].take(words[place], axis=0)
        total = np.ones((len(units), WIDTH + 1), np.float32)
        total[:, :WIDTH] = np.tanh(units, out=units)
        return total

    def log_probability(self, window: np.ndarray, target: np.ndarray) -> np.ndarray:
        found, logits = np.empty(len(target), np.float32), np.empty((_PIECE, CLASSES), np.float32)
        weights, ones, rows = np.vstack((self.out, self.bias)), np.ones(CLASSES, np.float32), np.arange(_PIECE)
        for at in range(0, len(target), _PIECE):
            wanted = target[at : at + _PIECE]
            part = np.matmul(self.hidden(window[:, at : at + _PIECE]), weights, out=logits[: len(wanted)])
            own = part[rows[: len(wanted)], wanted]
            np.exp(part, out=part)
            found[at : at + _PIECE] = own - np.log(part @ ones)
        return found

    def trained(self, window: np.ndarray, target: np.ndarray, rate: float) -> Network:
        """A copy after one pass of gradient steps with per-parameter rates over the given words.

        A step takes ``_BATCH`` words. Their predictions are worked out in pieces that stay in the processor's cache and are
        never divided by their sums: the hidden values are, which are far fewer.
        """
        context, hidden_bias = self.context.copy(), self.hidden_bias.copy()
        weights = np.vstack((self.out, self.bias))  # the bias is the weight of the hidden units' last column
        summing = np.ones_like(weights)
        net = Network(context, hidden_bias, weights[:WIDTH], weights[WIDTH])
        seen = [np.full(x.shape, 1e-2, np.float32) for x in (context, hidden_bias, weights)]
        logits, rows = np.empty((_PIECE, CLASSES), np.float32), np.arange(_PIECE)
        for start in range(0, len(target), _BATCH):
            end = min(start + _BATCH, len(target))
            back, step = np.empty((end - start, WIDTH), np.float32), np.zeros_like(weights)
            summing[:WIDTH] = weights[:WIDTH]
            columns = np.ascontiguousarray(weights[:WIDTH].T)
            for at in range(start, end, _PIECE):
                wanted = target[at : min(at + _PIECE, end)]
                hidden = net.hidden(window[:, at : at + len(wanted)])
                error = np.matmul(hidden, weights, out=logits[: len(wanted)])
                np.exp(error, out=error)
                both = error @ summing.T
                total = both[:, WIDTH:]
                units = hidden[:, :WIDTH]
                back[at - start : at - start + len(wanted)] = (both[:, :WIDTH] / total - columns[wanted]) * (1 - units * units)
                error[rows[: len(wanted)], wanted] -= total[:, 0]
                hidden /= total
                step += (error.T @ hidden).T
            step /= end - start
            back /= end - start
            moved = back.ravel().astype(np.float64)
            sums = [np.bincount(_CELLS.take(word, axis=0).ravel(), moved, minlength=CLASSES * WIDTH) for word in window[:, start:end].astype(np.intp)]
            places = np.stack(sums).reshape(context.shape)
            for value, change, past in zip((context, hidden_bias, weights), (places.astype(np.float32), back.sum(axis=0), step), seen, strict=True):
                past += change * change
                value -= rate * change / np.sqrt(past)
            # Logits stay far below what single precision can exponentiate.
            np.clip(weights[:WIDTH], -3, 3, out=weights[:WIDTH])
            np.clip(weights[WIDTH], -20, 20, out=weights[WIDTH])
        return net


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (place, word), targets and text number of every word; texts are held apart by edges."""
    gap = bytes(SIDE)
    codes = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(lengths.sum()) + SIDE * (owner + 1)
    shifts = [s for s in range(-SIDE, SIDE + 1) if s]
    return np.stack([codes[place + s] for s in shifts]), codes[place], owner


def _parts(texts: list[bytes], limit: int = 1 << 18) -> Iterator[list[int]]:
    held, total = [], 0
    for i, text in enumerate(texts):
        if held and total + len(text) > limit:
            yield held
            held, total = [], 0
        held.append(i)
        total += len(text)
    if held:
        yield held


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case and its single punctuation marks, as :data:`WORDS` finds them."""
    lower = (text or "").lower()
    return (_ASCII_WORDS if lower.isascii() else WORDS).findall(lower)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n`` over all documents: words in lower case and single punctuation marks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for value in batch.column(0).to_pylist():
                found.update(words_of(value))
                if len(found) > 300_000:
                    yield packed()
                    found.clear()
        yield packed()

    return docs.select(quoted(text)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _hashed(word: str) -> int:
    return CLASSES - HASHED + zlib.crc32(word.encode("utf-8", "replace")) % HASHED


@dataclass(frozen=True)
class Coder:
    """``number`` of each known word; by number its class and the logarithm of its share in that class."""

    number: dict[str, int]
    classes: np.ndarray
    shares: np.ndarray

    def coded(self, text: str | None) -> tuple[bytes, float, Counter[str]]:
        """One class per word, the sum of the known words' shares, and how often each other word occurs."""
        words = words_of(text)
        number = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        codes, other = self.classes[number], np.flatnonzero(number < 0)
        rare = [words[i] for i in other]
        codes[other] = [_hashed(w) for w in rare]
        return codes.tobytes(), float(self.shares[number[number >= 0]].sum()), Counter(rare)


@dataclass(frozen=True)
class Vocabulary:
    """``counts``: ``word, n`` of all words; ``totals[class]``: the sum over the words of each hashed class."""

    coder: Coder
    counts: DataFrame
    totals: list[int]

    def encode(self, text: str | None) -> bytes:
        """One class per word; words without a class of their own share one by hash."""
        return self.coder.coded(text)[0]


def vocabulary(docs: DataFrame, text: str = "text") -> Vocabulary:
    """Counts of all words. The most frequent ones, ties by code point, get classes of their own, as many as are free.

    Up to ``KNOWN`` words from the top of a grid of counts come to the driver, so that no frequent word is joined.
    """
    counts = materialize(word_counts(docs, text), "words")
    own = counts.orderBy(F.desc("n"), F.encode("word", "UTF-8")).limit(CLASSES - HASHED - 1).collect()
    bucket = F.crc32(F.encode("word", "UTF-8")) % HASHED
    totals = [0] * CLASSES
    for r in counts.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).collect():
        totals[CLASSES - HASHED + r.bucket] = r.n
    for r in own:
        totals[_hashed(r.word)] -= r.n
    grid = F.floor(F.log2("n") * _GRID)
    level, held = None, 0
    for r in sorted(counts.groupBy(grid.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r.level):
        held += r.words
        if held > KNOWN:
            break
        level = r.level
    known = {r.word: r.n for r in counts.filter(grid >= level).collect()} if level is not None else {}
    first = {r.word: i + 1 for i, r in enumerate(own)}
    words = [*first, *(w for w in known if w not in first)]
    classes = [first[w] if w in first else _hashed(w) for w in words]
    shares = [0.0 if w in first else float(np.log(known[w] / totals[c])) for w, c in zip(words, classes, strict=True)]
    # The last entry stands for words without a number.
    coder = Coder({w: i for i, w in enumerate(words)}, np.array([*classes, 0], np.uint8), np.array([*shares, 0.0]))
    return Vocabulary(coder, counts, totals)


def encoded(docs: DataFrame, words: Vocabulary, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, classes, within``: every document as one byte per word, and the logarithms of its words' shares in their
    classes summed up; written to the shared folder.

    The shares of words without a number are joined by word, one row per document and word. A word that the counts lack
    counts as one that occurs once.
    """
    coder = words.coder
    kind = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("times", T.LongType())]))
    fields = [T.StructField("classes", T.BinaryType()), T.StructField("known", T.DoubleType()), T.StructField("rare", kind)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            found = [coder.coded(t) for t in batch.column(1).to_pylist()]
            rare = [f[2] for f in found]
            times = pa.array(list(chain.from_iterable(r.values() for r in rare)), pa.int64())
            pairs = pa.StructArray.from_arrays([pa.array(list(chain.from_iterable(rare)), pa.string()), times], names=["word", "times"])
            ends = pa.array(np.cumsum([0, *map(len, rare)]), pa.int32())
            yield [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.float64()), pa.ListArray.from_arrays(ends, pairs)]

    plain = docs.select(F.col(quoted(id)).alias("id"), F.col(quoted(text)).alias("text"))
    coded = with_columns(plain, fields, encode).drop("text").withColumn("row", F.monotonically_increasing_id())
    coded = materialize(coded, "coded")
    bucket = (F.crc32(F.encode("word", "UTF-8")) % HASHED + (CLASSES - HASHED)).cast("int")
    total = F.get(F.array(*[F.lit(int(n)) for n in words.totals]), bucket)
    pairs = coded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times").join(words.counts, "word", "left")
    share = F.log(F.coalesce("n", F.lit(1)) / F.greatest(total, F.lit(1)))
    others = pairs.groupBy("row").agg(F.sum(F.col("times") * share).alias("other"))
    joined = coded.select("row", "id", "classes", "known").join(others, "row", "left")
    return materialize(joined.select("id", "classes", (F.col("known") + F.coalesce("other", F.lit(0.0))).alias("within")), "classes")


def masked_places(turn: int, rounds: int, mask_every: int, seed: int) -> list[int]:
    """The places modulo ``mask_every`` that a round masks, one after the other; all rounds together mask every place."""
    return [(place + seed) % mask_every for place in range(turn, max(rounds, mask_every), rounds)]


def train(classes: DataFrame, rounds: int = ROUNDS, mask_every: int = MASK_EVERY, rate: float = 0.05, seed: int = 0) -> Network:
    """A network trained on all words of all documents: each is masked once, one in ``mask_every`` at a time, in one round.

    A task returns one row per parameter; rows are summed where they are made and once more by parameter, so the driver
    gets as many numbers as the network has. Results depend on how documents are dealt to tasks. Without any word the
    network stays as it started.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8), minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(total)], names=["class", "n"])

    rows = classes.select("classes").mapInArrow(count, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES)
    for r in rows:
        counts[r["class"]] = r.n
    net = Network.started(counts, seed)
    for turn in range(rounds):
        places = masked_places(turn, rounds, mask_every, seed)

        def learn(batches: Iterator[pa.RecordBatch], net: Network = net, turn: int = turn, places: list[int] = places) -> Iterator[pa.RecordBatch]:
            total, own = 0, net
            for batch in batches:
                texts = batch.column(0).to_pylist()
                for part in _parts(texts):
                    window, target, _ = _windows([texts[i] for i in part])
                    for place in places:
                        masked = target[place::mask_every]
                        if len(masked):
                            own = own.trained(window[:, place::mask_every], masked, rate / (1 + turn))
                            total += len(masked)
            if total:
                values = np.append(own.flat().astype(np.float64) * total, total)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["place", "value"])

        sums = classes.select("classes").mapInArrow(learn, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        if not sums:
            break
        values = np.zeros(len(sums))
        for r in sums:
            values[r.place] = r.value
        net = net.shaped(values[:-1] / values[-1])
    return net


def score(classes: DataFrame, net: Network, id: str = "doc_id") -> DataFrame:
    """``id, n_tokens, log_probability, mean_log_probability``: every word of every document predicted from both sides.

    A word's probability is that of its class in the window times its share among all words of that class.
    Null and empty texts have no tokens, sum 0 and a null mean. Equal texts score equal; null and repeated ids pass
    through. A document of any length is scored whole, in windows, with bounded memory for the predictions.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("log_probability", T.DoubleType()), T.StructField("mean_log_probability", T.DoubleType())]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sums = batch.column(2).to_numpy().copy()
            for part in _parts(texts):
                window, target, owner = _windows([texts[i] for i in part])
                sums[part] += np.bincount(owner, net.log_probability(window, target), minlength=len(part))
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            mean = [s / n if n else None for s, n in zip(sums.tolist(), sizes.tolist(), strict=True)]
            yield [pa.array(sizes), pa.array(sums), pa.array(mean, pa.float64())]

    out = with_columns(classes.select("id", "classes", "within"), fields, compute)
    return out.select(F.col("id").alias(id), *[f.name for f in fields])


def score_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Count words, train and score over all rows of ``docs``. Other columns are not read."""
    classes = encoded(docs, vocabulary(docs, text), id, text)
    return score(classes, train(classes, **options), id)
