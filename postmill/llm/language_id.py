"""Language identification with one bit-sliced Bloom filter for all languages.

A slot of the filter is a mask with one bit per language, so a probe of an n-gram (the AND of its slots) returns all
languages that contain it at once. A text's language is the one with the most n-grams after taking off the hits that the
filter gives by chance.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.common import free_names, ranked, released, sized, with_columns
from postmill.operators.ordering import materialize

UNKNOWN = "und"
SIZES = (3, 4)
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Texts and characters that are worked on at a time; a character takes some hundred bytes on the way.
_ROWS, _CHARACTERS = 1 << 10, 1 << 17
_BOUNDARY = 32  # any run of characters other than letters


@cache
def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or a boundary. Marks join letters of many scripts and count as such."""
    out = np.full(0x110000, _BOUNDARY, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if unicodedata.category(char)[0] in "LM":
            lower = char.lower()
            out[code] = ord(lower) if len(lower) == 1 else code
    return out


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts and the number of each one's text; words are padded with one boundary."""
    codes = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths)
    # The separator in front of a text belongs to it and the one behind it to the next.
    owner = np.append(owner, len(texts) - 1) if len(texts) else owner
    letters = _letters()[codes]
    edge = letters == _BOUNDARY
    keep = ~edge
    keep[1:] |= edge[1:] & ~edge[:-1]
    keep[0] = True
    letters, owner = letters[keep].astype(np.uint64), owner[keep]
    hashes, owners = [], []
    for n in SIZES:
        if len(letters) < n:
            continue
        code = np.zeros(len(letters) - n + 1, np.uint64)
        for i in range(n):
            code = code * np.uint64(0x100000001B3) + letters[i : i + len(code)]
        # A boundary may only be the first or the last character; a text's last boundary may be counted to the next one.
        inner = np.ones(len(code), bool)
        for i in range(1, n - 1):
            inner &= letters[i : i + len(code)] != _BOUNDARY
        mixed = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes.append((mixed ^ (mixed >> np.uint64(32)))[inner])
        owners.append(owner[1 : 1 + len(code)][inner])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


@dataclass(frozen=True)
class Model:
    """``slots[i]`` holds the mask words of slot i; ``chance[l]`` is the share of foreign n-grams that hit language l."""

    languages: tuple[str, ...]
    slots: np.ndarray
    chance: np.ndarray
    fallback: int

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Masks of the languages containing each n-gram."""
        shift = np.uint64(64 - int(len(self.slots)).bit_length() + 1)
        out = None
        for multiplier in _MULTIPLIERS:
            found = self.slots[(hashes * np.uint64(multiplier)) >> shift]
            out = found if out is None else out & found
        return out

    def decide(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        hashes, owners = _grams(texts)
        masks = self.probe(hashes)
        total = np.bincount(owners, minlength=len(texts)).astype(float)
        hits = np.empty((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            bit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits[:, i] = np.bincount(owners[bit.astype(bool)], minlength=len(texts))
        real = np.maximum(0, hits - total[:, None] * self.chance) / (1 - self.chance)
        best = real.argmax(axis=1)
        top = real[np.arange(len(texts)), best]
        best[top <= 0] = self.fallback
        score = np.clip(top / np.maximum(total, 1), 0, 1)
        return [self.languages[i] for i in best], score.tolist()


def _empty_filter(rows: int, languages: int) -> np.ndarray:
    size = 1 << max(10, (16 * max(rows, 1) - 1).bit_length())
    return np.zeros((size, (languages + 63) // 64), np.uint64)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", per_language: int = 1500, top: int = 4000) -> Model:
    """Learn from at most ``per_language`` documents of each language, seeded by id, and keep ``top`` n-grams of each.

    Rows with a null text or language teach nothing. Only (language, id) pairs are ranked to draw the sample, in salted
    buckets, because one language may own most rows. N-grams are counted by Spark; ``top`` rows a language come to the
    driver. Without any usable row the model knows no language and answers ``und``. Equal counts are ordered by hash.
    """
    labelled = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    labelled = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    ids = materialize(labelled.select("id", "lang", F.xxhash64("text").alias("key")), "labelled")
    drawn = ranked(ids, ["lang"], ["id", "key"], "place").filter(F.col("place") < per_language).drop("place").distinct()
    # At most per_language small rows for each language.
    sample = labelled.withColumn("key", F.xxhash64("text")).alias("l").join(
        F.broadcast(drawn).alias("d"),
        F.col("l.id").eqNullSafe(F.col("d.id")) & (F.col("l.lang") == F.col("d.lang")) & (F.col("l.key") == F.col("d.key")), "left_semi"
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
            for part in sized(texts, _CHARACTERS):
                hashes, owners = _grams([texts[i] for i in part])
                names = langs[part.start : part.stop]
                for name in sorted(set(names)):
                    values, counts = np.unique(hashes[np.flatnonzero((names == name)[owners])], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(counts)],
                        names=["lang", "gram", "n"],
                    )

    counts = sample.select("text", "lang").mapInArrow(released(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept = counts.withColumn("place", place).filter(F.col("place") <= top).select("lang", "gram").collect()
    shares = {r.lang: r.rows for r in ids.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).collect()}
    languages = tuple(sorted(shares, key=lambda x: x.encode()))
    slots = _empty_filter(max([sum(r.lang == x for r in kept) for x in languages], default=0), max(1, len(languages)))
    shift = np.uint64(64 - int(len(slots)).bit_length() + 1)
    chance = np.zeros(len(languages))
    for i, name in enumerate(languages):
        grams = np.array([r.gram for r in kept if r.lang == name], np.int64).view(np.uint64)
        for multiplier in _MULTIPLIERS:
            slots[(grams * np.uint64(multiplier)) >> shift, i // 64] |= np.uint64(1 << (i % 64))
        filled = float(((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean())
        chance[i] = min(0.99, filled ** len(_MULTIPLIERS))
    fallback = max(range(len(languages)), key=lambda i: (shares[languages[i]], -i), default=0)
    return Model(languages, slots, chance, fallback)


def identify(docs: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and the share of the text's n-grams that it explains (0 to 1).

    Texts that are null or hold no letter are ``und`` with score 0. A text none of whose n-grams is known gets the most
    frequent learned language with score 0. Ties go to the first language by code point. Repeated rows get equal results.
    Columns that have the output names are replaced; all others pass through. Whole texts count. The model is at most
    a few hundred kilobytes a language and travels with the tasks.
    """
    fields = [T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            usable = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
            for part in sized([texts[i] for i in usable], _CHARACTERS):
                own = [usable[i] for i in part]
                for i, name, value in zip(own, *model.decide([texts[i] for i in own]), strict=True):
                    names[i], scores[i] = name, value
            yield [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return with_columns(docs, fields, compute, _ROWS)


def lettered(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that :func:`identify` does not call ``und``: those whose text holds a letter.

    A model that learned no language tells texts with a letter from the others all the same. Null and empty texts go,
    repeated rows share their fate, and columns of any name pass through. An empty table stays empty.
    """
    if not model.languages:
        model = Model(("any",), _empty_filter(0, 1), np.zeros(1), 0)
    pred, score = free_names(docs, "_lang_pred", "_score")
    return identify(docs, model, text, pred, score).filter(F.col(pred) != UNKNOWN).drop(pred, score)
