"""Word frequencies and word-cloud weights."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.functions.text import words
from postmill.operators.ordering import materialize
from postmill.schema import quoted

# --- fixed values: common English words a word cloud leaves out -------------------------------------------------------
STOP_WORDS = tuple(
    """
    a about above after again against all also am an and any are as at be because been before being below between both
    but by can cannot com could did do does doing down during each else ever few for from further get had has have
    having he hence her here hers herself him himself his how however http i if in into is it its itself just k let
    like me more most my myself no nor not of off on once only or other otherwise ought our ours ourselves out over own
    r same shall she should since so some such than that the their theirs them themselves then there therefore these
    they this those through to too under until up very was we were what when where which while who whom why with would
    www you your yours yourself yourselves
    """.split()
)
PAIR_THRESHOLD = 30.0
# --- end of fixed values ----------------------------------------------------------------------------------------


def word_counts(df: DataFrame, column: str) -> DataFrame:
    """``(word, frequency)`` over all texts of a column. Counts combine before the shuffle, so hot words are cheap."""
    return df.select(F.explode(words(F.col(quoted(column)))).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("frequency")
    )


def top_words(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The ``k`` most common words, ties in word order."""
    return word_counts(df, column).orderBy(F.desc("frequency"), F.asc("word")).limit(k)


def _singular_stem(word: Column) -> Column:
    """The word without a final ``s`` that could be a plural ending."""
    plural = word.endswith("s") & ~word.endswith("ss") & (F.length(word) > 1)
    return F.when(plural, F.left(word, F.length(word) - 1)).otherwise(word)


def _merge_plurals(counts: DataFrame) -> DataFrame:
    """``(stem, word, frequency)``: ``words`` counts for ``word`` if both occur.

    A stem owns at most two rows, and no plural is the singular of another word, so one grouping does it.
    """
    stem = _singular_stem(F.col("word"))
    stems = counts.groupBy(stem.alias("stem")).agg(
        F.sum("frequency").alias("frequency"), F.bool_or(stem == F.col("word")).alias("has_singular")
    )
    word = F.when(F.col("has_singular"), F.col("stem")).otherwise(F.concat("stem", F.lit("s")))
    return stems.select("stem", word.alias("word"), "frequency")


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    floor = F.lit(1e-10)
    return F.log(F.greatest(p, floor)) * k + F.log(F.greatest(1 - p, floor)) * (n - k)


def _collocations(counts: DataFrame, merge_plurals: bool, threshold: float) -> DataFrame:
    """``(word, frequency, first, second)`` of pairs that occur together far more often than their words suggest.

    ``counts`` holds words and pairs (two words and a space) with their ``stem``.
    """
    pair = F.col("word").contains(" ")
    single = counts.filter(~pair)
    total = single.agg(F.sum("frequency").cast("double").alias("n")).scalar()

    def side(name: str) -> DataFrame:
        return single.select(
            F.col("stem").alias(f"{name}_stem"), F.col("word").alias(name),
            F.col("frequency").cast("double").alias(f"{name}_count"),
        )

    def stem(word: Column) -> Column:
        return _singular_stem(word) if merge_plurals else word

    halves = F.split("word", " ")
    found = (
        counts.filter(pair)
        .select(
            "word", "frequency", stem(F.get(halves, F.lit(0))).alias("first_stem"),
            stem(F.get(halves, F.lit(1))).alias("second_stem"),
        )
        .join(side("first"), "first_stem")
        .join(side("second"), "second_stem")
        .withColumn("n", total)
    )
    both, c1, c2, n = F.col("frequency").cast("double"), F.col("first_count"), F.col("second_count"), F.col("n")
    expected, with_first, without_first = c2 / n, both / c1, F.try_divide(c2 - both, n - c1)
    score = -2 * (
        _log_likelihood(both, c1, expected) + _log_likelihood(c2 - both, n - c1, expected)
        - _log_likelihood(both, c1, with_first) - _log_likelihood(c2 - both, n - c1, without_first)
    )
    kept = found.filter(F.when((n <= c1) | (n <= c2), 0.0).otherwise(score) > threshold)
    return kept.select("word", "frequency", "first", "second")


def cloud_weights(
    df: DataFrame,
    column: str,
    k: int = 200,
    stop_words: Iterable[str] = STOP_WORDS,
    merge_plurals: bool = True,
    pairs: bool = True,
    threshold: float = PAIR_THRESHOLD,
) -> DataFrame:
    """``(word, frequency, weight)`` behind a word cloud; the weight is relative to the most frequent entry.

    Stop words and plain numbers are left out. With ``merge_plurals``, ``words`` counts for ``word`` if both occur. With
    ``pairs``, neighbours in a text that belong together (Dunning's likelihood ratio above ``threshold``) become an entry
    of their own and no longer count for their words.

    Words and pairs are taken from the texts in one pass and counted together. With pairs the counts, one row per
    distinct word or pair, are written to the shared folder, since words, both halves and pairs are read from them.
    """
    stops = list(stop_words)
    tokens = F.filter(words(F.col(quoted(column))), lambda w: ~w.rlike(r"\A\p{Nd}+\z"))
    texts = df.select(tokens.alias("tokens"))
    entries = F.filter(F.col("tokens"), lambda w: ~w.isin(stops))
    if pairs:
        following = F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0)))
        neighbours = F.zip_with(
            "tokens", following, lambda a, b: F.when(~a.isin(stops) & ~b.isin(stops), F.concat(a, F.lit(" "), b))
        )
        entries = F.concat(entries, F.array_compact(neighbours))
    counts = texts.select(F.explode(entries).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("frequency"))
    counts = _merge_plurals(counts) if merge_plurals else counts.withColumn("stem", F.col("word"))
    if pairs:
        counts = materialize(counts, "words")
        together = _collocations(counts, merge_plurals, threshold)
        changes = F.explode(F.array(
            F.struct("word", "frequency"), F.struct(F.col("first").alias("word"), (-F.col("frequency")).alias("frequency")),
            F.struct(F.col("second").alias("word"), (-F.col("frequency")).alias("frequency")),
        ))
        changed = together.select(changes.alias("change")).select("change.word", "change.frequency")
        single = counts.filter(~F.col("word").contains(" ")).select("word", "frequency")
        counts = single.unionByName(changed).groupBy("word").agg(F.sum("frequency").alias("frequency")).filter("frequency > 0")
    top = counts.select("word", "frequency").orderBy(F.desc("frequency"), F.asc("word")).limit(k)
    everything = W.orderBy(F.desc("frequency")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # The window sees the k rows of the report, not the table.
    return top.withColumn("weight", F.col("frequency") / F.max("frequency").over(everything))
