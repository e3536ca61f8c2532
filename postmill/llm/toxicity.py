"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Examples stand in an inverted index whose postings are grouped into blocks of examples; each (term, block) knows its
largest weight. The sum of those bounds every cosine in a block, so blocks are visited in the order of their bounds and
the rest is left out once no bound can reach the nearest examples found so far. The neighbours vote by similarity; a
logistic curve fitted on the examples, each judged by the others, turns votes into probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.common import ranked, sized, with_columns
from postmill.operators.ordering import materialize
from postmill.schema import quoted

WORDS = re.compile(r"[^\W\d_]+")
STEM = 4  # letters that inflected and compounded words share
BLOCK = 64
#: Bounds of the fit: examples of each label, and terms kept of those that tell the labels apart.
PER_LABEL, MOST_TERMS = 4000, 4096
NEIGHBOURS = 25


def terms_of(words: Iterable[str]) -> Iterator[str]:
    """Each word, and for longer words the stem ``abcd-`` too."""
    for word in words:
        yield word
        if len(word) > STEM:
            yield word[:STEM] + "-"


def words_like(text: str, starts: frozenset[str]) -> list[str]:
    """The words of a whole text in lower case whose first letters are those of some chosen term."""
    return [w for w in WORDS.findall(text.lower()) if w[:STEM] in starts]


def starts_of(terms: Iterable[str]) -> frozenset[str]:
    return frozenset(t[:STEM] for t in terms)


@dataclass(frozen=True)
class Index:
    """Postings sorted by (term, block, example); ``entry_*`` describe the runs of one term and block."""

    terms: dict[str, int]
    starts: frozenset[str]
    idf: np.ndarray
    first_entry: np.ndarray  # of each term
    entry_block: np.ndarray
    entry_most: np.ndarray
    entry_start: np.ndarray
    posting_example: np.ndarray
    posting_weight: np.ndarray
    labels: np.ndarray
    ids: list
    blocks: int

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms and unit TF-IDF weights of a whole text; empty where it holds no term of the index."""
        get = self.terms.get
        found = [i for t in terms_of(words_like(text, self.starts)) if (i := get(t)) is not None]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        term, count = np.unique(np.array(found, np.int64), return_counts=True)
        weight = (1 + np.log(count)) * self.idf[term]
        return term, weight / np.linalg.norm(weight)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of largest cosine and those cosines (0 left out), nearest first, ties by example number."""
        starts, ends = self.first_entry[term], self.first_entry[term + 1]
        entry = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)] or [np.zeros(0, np.int64)])
        query = np.repeat(weight, ends - starts)
        bound = np.bincount(self.entry_block[entry], query * self.entry_most[entry], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        cosine = np.zeros(len(self.labels))
        seen, least, step = 0, 0.0, max(1, -(-2 * k // BLOCK))
        while seen < len(order) and bound[order[seen]] * (1 + 1e-12) >= least:
            chosen = np.zeros(self.blocks, bool)
            chosen[order[seen : seen + step]] = True
            use = chosen[self.entry_block[entry]]
            lengths = self.entry_start[entry[use] + 1] - self.entry_start[entry[use]]
            offset = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            posting = np.repeat(self.entry_start[entry[use]], lengths) + offset
            cosine += np.bincount(
                self.posting_example[posting], np.repeat(query[use], lengths) * self.posting_weight[posting], minlength=len(cosine)
            )
            if without >= 0:
                cosine[without] = 0
            seen, step = seen + step, step * 2
            top = np.partition(cosine, max(0, len(cosine) - k))[max(0, len(cosine) - k):]
            least = top.min() if len(cosine) >= k else 0.0
        best = np.flatnonzero((cosine >= least) & (cosine > 0))
        best = best[np.argsort(-cosine[best], kind="stable")][:k]
        return best, cosine[best]


@dataclass(frozen=True)
class Model:
    index: Index
    slope: float
    offset: float
    no_term: float

    def vote(self, text: str, without: int = -1) -> tuple[float | None, np.ndarray, np.ndarray]:
        """Share of toxic votes, each weighing 1 / (distance + a hundredth), and the neighbours with their cosines."""
        term, weight = self.index.vector(text)
        if not len(term):
            return None, np.zeros(0, np.int64), np.zeros(0)
        near, cosine = self.index.nearest(term, weight, NEIGHBOURS, without)
        if not len(near):
            return None, near, cosine
        votes = 1 / (1.01 - np.minimum(cosine, 1))
        return float(votes @ self.index.labels[near] / votes.sum()), near, cosine

    def probability(self, share: float | None) -> float:
        if share is None:
            return self.no_term
        return float(1 / (1 + np.exp(-(self.slope * share + self.offset))))


def build_index(texts: list[str], labels: list[int], ids: list, terms: list[str], idf: np.ndarray) -> Index:
    """Index of the examples that hold a term. Examples are ordered by label and strongest term, so blocks are alike."""
    empty = np.zeros(0, np.int64)
    blank = Index({t: i for i, t in enumerate(terms)}, starts_of(terms), idf, np.zeros(len(terms) + 1, np.int64), empty, np.zeros(0), np.zeros(1, np.int64), empty, np.zeros(0), empty, [], 1)
    vectors = [blank.vector(t) for t in texts]
    held = [i for i, (term, _) in enumerate(vectors) if len(term)]
    held.sort(key=lambda i: (labels[i], int(vectors[i][0][vectors[i][1].argmax()]), i))
    if not held:
        return blank
    sizes = [len(vectors[i][0]) for i in held]
    example = np.repeat(np.arange(len(held)), sizes)
    term = np.concatenate([vectors[i][0] for i in held])
    weight = np.concatenate([vectors[i][1] for i in held])
    order = np.lexsort((example, term))
    example, term, weight = example[order], term[order], weight[order]
    block = example // BLOCK
    start = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1]))))
    return Index(
        blank.terms, blank.starts, idf, np.searchsorted(term[start], np.arange(len(terms) + 1)), block[start], np.maximum.reduceat(weight, start),
        np.append(start, len(term)), example, weight, np.array([labels[i] for i in held]), [ids[i] for i in held], int(block.max()) + 1,
    )


def _curve(shares: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps, held back a little so that separable data stay finite."""
    at, x = np.zeros(2), np.column_stack([shares, np.ones(len(shares))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        gradient = x.T @ (labels - p) - 1e-2 * at
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), gradient)
        at = at + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def _term_rows(df: DataFrame) -> DataFrame:
    """``term, toxic, n``: in how many texts of a batch and label each term occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = batch.column("text").to_pylist(), batch.column("toxic").to_pylist()
            for part in sized(texts):
                found: dict[tuple[str, int], int] = {}
                for i in part:
                    for word in set(terms_of(WORDS.findall((texts[i] or "").lower()))):
                        found[word, labels[i]] = found.get((word, labels[i]), 0) + 1
                columns = [pa.array([w for w, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32()), pa.array(found.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "toxic", "n"])

    return df.select("text", "toxic").mapInArrow(count, "term string, toxic int, n long")


def _document_counts(docs: DataFrame, terms: list[str]) -> dict[str, int]:
    """In how many of all documents each chosen term occurs; a task sends one row per term at most."""
    chosen, starts = frozenset(terms), starts_of(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = dict.fromkeys(terms, 0)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for word in chosen.intersection(terms_of(words_like(text or "", starts))):
                    found[word] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r.term: r.n for r in rows.collect()}


def fit(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", toxic: str = "toxic", label_id: str = "doc_id",
    per_label: int = PER_LABEL, most_terms: int = MOST_TERMS,
) -> Model:
    """Learn from at most ``per_label`` labelled documents of each label, seeded by id.

    ``labels`` holds the rows to learn from; null labels teach nothing, and of several labels of an id the largest
    counts. Terms are those whose occurrence depends on the label beyond chance (a likelihood-ratio test held to all
    terms at once), ``most_terms`` of the strongest at most; their inverse document frequencies come from all of
    ``docs``. Without labels or terms every text scores the share of toxic labels.
    """
    docs = docs.select(F.col(quoted(id)).alias("id"), F.col(quoted(text)).alias("text"))
    known = labels.select(F.col(quoted(label_id)).alias("id"), F.col(quoted(toxic)).cast("int").alias("toxic")).dropna()
    known = materialize(known.groupBy("id").agg(F.max("toxic").alias("toxic")), "labels")
    drawn = ranked(known, ["toxic"], ["id"], "place").filter(F.col("place") < per_label).select("id", "toxic")
    sample = materialize(docs.join(F.broadcast(drawn), "id"), "examples")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, bad = sizes.get(0, 0), sizes.get(1, 0)
    everything = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = {y: everything.get(y, 0) / sizes[y] for y in sizes}  # undoes the equal draw of rare and frequent labels
    rate = (everything.get(1, 0) + 0.5) / (sum(everything.values()) + 1) if everything else 0.0

    a, b = F.coalesce(F.sum(F.when(F.col("toxic") == 1, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("toxic") == 0, F.col("n"))), F.lit(0))
    counted = _term_rows(sample).groupBy("term").agg(a.alias("a"), b.alias("b")).filter(F.col("a") + F.col("b") >= 3)

    def part(n, rows, all_rows):  # n * log(n / expected)
        expected = (F.col("a") + F.col("b")) * F.lit(rows / max(1, all_rows))
        return F.when(n > 0, n * F.log(n / expected)).otherwise(F.lit(0.0))

    present = part(F.col("a"), bad, bad + clean) + part(F.col("b"), clean, bad + clean)
    missing = F.lit(float(bad + clean)) - F.col("a") - F.col("b")

    def lacking(n, rows):
        left = F.lit(float(rows)) - n
        return F.when(left > 0, left * F.log(left / (missing * F.lit(rows / max(1, bad + clean))))).otherwise(F.lit(0.0))

    ratio = 2 * (present + lacking(F.col("a"), bad) + lacking(F.col("b"), clean))
    scored = materialize(counted.select("term", ratio.alias("ratio")), "terms")
    limit = 2 * np.log(max(2, scored.count()))  # chance lifts a fifth of a term above it, of all terms together
    kept = [r.term for r in scored.filter(F.col("ratio") >= float(limit)).orderBy(F.desc("ratio"), "term").limit(most_terms).collect()]
    total = docs.count()
    frequency = _document_counts(docs, kept) if kept else {}
    idf = np.array([np.log((1 + total) / (1 + frequency.get(t, 0))) + 1 for t in kept])
    examples = sample.orderBy("id", "text").collect()  # at most twice per_label documents
    texts, truth = [r.text or "" for r in examples], [r.toxic for r in examples]
    index = build_index(texts, truth, [r.id for r in examples], kept, idf)
    number = {r: i for i, r in enumerate(index.ids)}
    plain = Model(index, 1.0, 0.0, rate)
    shares = [plain.vote(t, number.get(r.id, -1))[0] for t, r in zip(texts, examples, strict=True)]
    blank = {y: sum(weights[y] for s, v in zip(shares, truth, strict=True) if s is None and v == y) for y in sizes}
    no_term = (blank.get(1, 0) + 0.5 * rate) / (sum(blank.values()) + 0.5) if blank else rate
    voted = np.array([s is not None for s in shares], bool)
    if not voted.any():
        return Model(index, 1.0, float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))), float(no_term))
    slope, offset = _curve(np.array([s for s in shares if s is not None]), np.array(truth)[voted])
    return Model(index, slope, offset, float(min(max(no_term, 0.0), 1.0)))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score", evidence: str | None = "evidence") -> DataFrame:
    """Add the probability of label 1 (0 to 1) and, if named, the three nearest examples ``(id, cosine, label)``.

    Null and empty texts, and texts without any term of the index, score the share of toxic ones among such examples.
    Every document is searched exactly, over its whole text. Existing columns of the new names are replaced, others pass
    through; repeated rows score equal. The model has a fixed bound and travels with the tasks.
    """
    fields = [T.StructField(name, T.DoubleType())]
    if evidence:
        fields.append(T.StructField(evidence, T.ArrayType(T.StructType([
            T.StructField("id", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())
        ]))))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            scores, found = [], []
            for text_value in batch.column(text).to_pylist():
                share, near, cosine = model.vote(text_value or "")
                scores.append(model.probability(share))
                found.append([
                    {"id": str(model.index.ids[i]), "cosine": float(c), "label": int(model.index.labels[i])} for i, c in zip(near[:3], cosine[:3], strict=True)
                ])
            arrays = [pa.array(scores, pa.float64())]
            if evidence:
                kind = pa.list_(pa.struct([("id", pa.string()), ("cosine", pa.float64()), ("label", pa.int32())]))
                arrays.append(pa.array(found, kind))
            yield arrays

    return with_columns(docs, fields, compute)
