"""Exact dedup, Jaccard join, mixing, packing and language ID against brute force, with every awkward kind of row."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postmill.llm import bitmaps, common, exact_dedup, jaccard_join, language_id, mixing, packing
from postmill.llm.common import components, ranked
from postmill.llm.oracle import ORACLE
from postmill.llm.queries import QUERIES, word_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _key string, _bucket int"
SF = "/root/testdata/sf0.001"


def frame(spark, rows, parts=3):
    """Documents with extra columns whose names operators use inside."""
    full = [(i, t, lang, source, len(t or ""), 9.0, "x", 7) for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def word_texts(count, seed=1):
    """Texts in groups of near copies of several strengths, a passage many share, short texts and no text."""
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = [f"p{i}" for i in range(60)]
    texts = ["", None, "   \n", "one", "One", "two words", "a b c d", "a b c d e", "\x1cx y"]
    while len(texts) < count:
        base = [pick.choice(words) for _ in range(pick.choice([6, 12, 40, 120, 300]))]
        if pick.random() < 0.3:
            base += passage
        for _ in range(pick.choice([1, 1, 2, 3, 8])):
            copy = list(base)
            for _ in range(pick.choice([0, 1, 2, max(1, len(base) // 30), max(1, len(base) // 15)])):
                copy[pick.randrange(len(copy))] = pick.choice(words)
            texts.append(pick.choice([" ", "\t", "\n "]).join(copy).replace("w1", pick.choice(["w1", "W1"])))
    return texts[:count]


def sets_of(texts, width=5):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(set(zip(*[w[i:] for i in range(width)])) if len(w) >= width else ({tuple(w)} if w else set()))
    return out


def linked_components(ids, sets, percent):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i, j in itertools.combinations(range(len(ids)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            links += 1
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(ids))], links


@pytest.mark.parametrize("percent", [75, 50, 90, 100])
def test_jaccard_join_finds_every_link(spark, percent):
    texts = word_texts(260, percent)
    ids = list(range(len(texts)))
    random.Random(3).shuffle(ids)
    docs = frame(spark, [(i, t, "en", "s") for i, t in zip(ids, texts, strict=True)])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_classes(docs, percent=percent).collect()}
    sets = sets_of(texts)
    want, links = linked_components(ids, sets, percent)
    assert links > 20
    assert got == {i: (len(s), c) for i, s, c in zip(ids, sets, want, strict=True)}


def test_jaccard_signatures_keep_the_promise_for_single_pairs():
    """Random pairs at the very threshold share a signature with which the larger one probes."""
    pick = np.random.default_rng(5)
    for size in (1, 2, 3, 5, 8, 17, 64, 65, 200, 513):
        for percent in (50, 75, 90):
            for _ in range(6):
                a = np.unique(pick.integers(0, 2**63, size, dtype=np.uint64))
                other = int(pick.integers(-(-len(a) * percent // 100), len(a) + 1))
                most = (100 - percent) * (len(a) + other) // (100 + percent)
                extra = max(0, (most - (len(a) - other)) // 2)
                b = np.concatenate([pick.permutation(a)[: other - extra], pick.integers(0, 2**63, extra, dtype=np.uint64)])
                b = np.unique(b)
                common = len(np.intersect1d(a, b))
                if not len(b) or 100 * common < percent * (len(a) + len(b) - common):
                    continue
                large, small = jaccard_join.signatures(a, percent), jaccard_join.signatures(b, percent)
                assert set(large[0][large[1]].tolist()) & set(small[0].tolist())


def test_profiles_never_tell_more_apart_than_differ():
    pick = np.random.default_rng(8)
    for size in (1, 30, 150, 5000, 60_000):
        for off in (0, 1, size // 10, size // 3):
            a = np.unique(pick.integers(0, 2**63, size, dtype=np.uint64))
            b = np.unique(np.concatenate([a[off:], pick.integers(0, 2**63, off, dtype=np.uint64)]))
            differ = len(np.setxor1d(a, b))
            x, y = (np.frombuffer(jaccard_join.profile(v), np.uint8)[None] for v in (a, b))
            assert differ * (0.9 if size == 150 else 0) <= jaccard_join.apart(x, y)[0] <= differ


def test_heads_of_linking_sets_share_what_is_asked():
    pick = np.random.default_rng(6)
    for percent in (50, 75, 90):
        for size in (1, 2, 5, 9, 20, 21, 79, 400):
            for _ in range(30):
                a = np.unique(pick.integers(0, 2**63, size, dtype=np.uint64))
                kept = int(pick.integers(jaccard_join.overlap(len(a), percent), len(a) + 1))
                b = np.unique(np.concatenate([pick.permutation(a)[:kept], pick.integers(0, 2**63, int(pick.integers(0, len(a) // 3 + 1)), dtype=np.uint64)]))
                common = len(np.intersect1d(a, b))
                if 100 * common < percent * (len(a) + len(b) - common):
                    continue
                heads = [set(jaccard_join._tokens(jaccard_join.head(x, percent)).tolist()) for x in (a, b)]
                assert len(heads[0] & heads[1]) >= max(jaccard_join.shared_least(len(a), percent), jaccard_join.shared_least(len(b), percent))


@pytest.mark.parametrize("tokens", [1 << 20, 50])
def test_sets_that_share_too_little_are_set_aside(spark, tokens, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CUT_TOKENS", tokens)
    pick = np.random.default_rng(7)
    shared = np.unique(pick.integers(0, 2**63, 60, dtype=np.uint64))
    sets = [np.unique(np.concatenate([shared[: 60 * (i % 2)], pick.integers(0, 2**63, 40, dtype=np.uint64)])) for i in range(40)]
    rows = [(2 * i, len(x), jaccard_join.head(x, 75)) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows + rows[:1], "c long, n long, head binary").repartition(5)
    heads = [set(jaccard_join._tokens(h).tolist()) for _, _, h in rows]
    want = {c for c, n, _ in rows if sum(any(t in h for j, h in enumerate(heads) if 2 * j != c) for t in heads[c // 2]) >= jaccard_join.shared_least(n, 75)}
    got = {r.c for r in jaccard_join._linkable(df, 75).collect()}
    # The first set stands in two tasks, perhaps, which makes copies of its own of all it holds.
    assert want - {0} == got - {0} and len(want) == 20


@pytest.mark.parametrize("block", [3, 1024])
def test_members_of_other_classes_are_compared_block_by_block(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    pick = random.Random(3)
    members = [(s, 2 * c, 100, pick.randrange(3), pick.random() < 0.6, bytes([1] * 64 + [pick.choice([1, 2])] * 64 + [0] * 128)) for s in range(9) for c in pick.sample(range(60), pick.choice([2, 3, 14]))]
    df = spark.createDataFrame(members, "sig long, c long, n long, label int, probe boolean, profile binary").withColumn("label", F.col("label").cast("long"))
    want = {
        (max(a[1], b[1]), min(a[1], b[1])) for a in members for b in members
        if a[0] == b[0] and a[3] != b[3] and a[4] and (a[1] > b[1] or not b[4]) and sum(abs(x - y) for x, y in zip(a[5], b[5])) <= 28
    }
    assert want and {(r.a, r.b) for r in jaccard_join._across(df, 75).collect()} == want


def test_jaccard_buckets_hold_each_set_once(spark):
    pick = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(base[:k] + [f"x{pick.random()}"] + base[k + 1:]) for k in range(12)]
    # One task per row, so that no task sees that it publishes a copy.
    docs = spark.createDataFrame([(t,) for t in texts * 2], "text string").repartition(24)
    published = spark.createDataFrame(jaccard_join._published(docs, 5, 75).collect(), "sig long, c long, room long")
    rows = [(r.sig, r.c) for r in jaccard_join._allocated(published).collect()]
    assert published.count() > published.distinct().count()
    assert rows and len(rows) == len(set(rows))


def test_jaccard_join_nulls_and_repeats(spark):
    text = " ".join(f"t{i}" for i in range(50))
    rows = [(None, text), (5, text), (3, text + " more"), (3, "quite another text of its own"), (9, None), (9, ""), (7, text.upper())]
    docs = frame(spark, [(i, t, None, None) for i, t in rows])
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.similar_classes(docs).collect())
    assert got == sorted([("None", 46, "None"), ("5", 46, "3"), ("3", 47, "3"), ("3", 2, "3"), ("9", 0, "9"), ("9", 0, "9"), ("7", 46, "3")])
    empty = frame(spark, [])
    assert jaccard_join.similar_classes(empty).collect() == []
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "3", "9", "9", "None"]


def test_rounds_of_components_start_no_jobs_but_their_tables(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91), (7, 7)], "a long, b long")
    tables, asked, first = [], [], type(edges).first
    monkeypatch.setattr(common, "materialize", lambda df, label, do=common.materialize: tables.append(label) or do(df, label))
    monkeypatch.setattr(type(edges), "first", lambda self: asked.append(1) or first(self))
    got = components(edges, "a", "b")
    assert not asked and set(tables) == {"edges"}
    assert sorted(map(tuple, got.collect())) == sorted([(i, 0) for i in range(41)] + [(90, 90), (91, 90)])


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(1, i) for i in range(2, 90)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path + star + [(7, 7), (500, 499)], "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(100, 141), 100), **dict.fromkeys(range(1, 90), 1), 499: 499, 500: 499}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_ranks_are_dense_and_do_not_depend_on_partitions(spark):
    rows = [(i % 3, i) for i in range(300)]
    out = []
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "k int, i int").repartition(parts)
        out.append(sorted(map(tuple, ranked(df, ["k"], ["i"], "place", seed=4, splits=7).collect())))
    assert out[0] == out[1]
    for k in range(3):
        assert sorted(r[2] for r in out[0] if r[0] == k) == list(range(100))


def test_exact_dedup_against_brute_force(spark):
    pick = random.Random(2)
    long = "Ab é" * 40000
    pool = ["", None, "ABC", "abc", "Abc ", "É", "é", "ß", "SS", "İ", long, long.lower(), long.upper()] + [f"text {i}" for i in range(40)]
    rows = [(pick.choice([None, *range(60)]), pick.choice(pool), None, None) for _ in range(200)]
    docs = frame(spark, rows, 4)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(low)].append(i)
    want = collections.Counter()
    for i, t, *_ in rows:
        members = groups[(t or "").translate(low)]
        keep = max((m for m in members if m is not None), default=None)
        want[i, keep, len(members), i == keep, hashlib.sha256((t or "").translate(low).encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, exact_dedup.duplicate_groups(docs).collect())) == want
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    got = collections.Counter(((r.text or "").translate(low), r.doc_id) for r in kept.collect())
    assert got == {(t, max((m for m in members if m is not None), default=None)): 1 for t, members in groups.items()}
    assert exact_dedup.duplicate_groups(frame(spark, [])).collect() == []
    assert exact_dedup.drop_duplicates(frame(spark, [])).collect() == []


INTERNAL = [
    "_key", "_id", "_keep", "_maybe", "_word", "_bit", "_bits", "_likely", "whole", "key", "c", "c0", "n", "sig", "profile", "label", "node", "component", "component_id",
    "n_shingles", "_lang_pred", "_score", "__score", "lang_pred", "score", "row", "copies", "copy", "size", "target", "id", "_KEY2",
]


def test_stages_return_rows_as_they_are_whatever_their_columns_are_called(spark):
    text = " ".join(f"t{i}" for i in range(50))
    texts = [text, text.upper(), text + " more", "other words here", None, "", "1 2 3", "und so weiter"]
    rows = [(i, t, "en", "s", 1, *[f"{name}{i}" for name in INTERNAL]) for i, t in enumerate([*texts, *texts])]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{name}` string" for name in INTERNAL)
    docs = spark.createDataFrame(rows, kinds).repartition(4)
    given = {tuple(r) for r in docs.collect()}
    model = language_id.fit(docs)
    for stage, kept in (
        (exact_dedup.drop_duplicates, {9, 10, 11, 13, 14, 15}), (jaccard_join.keep_one, {0, 3, 4, 5, 6, 7, 12, 13}),
        (lambda d: language_id.lettered(d, model), {0, 1, 2, 3, 7, 8, 9, 10, 11, 15}), (mixing.apply_mix, None),
    ):
        out = stage(docs)
        found = [tuple(r) for r in out.collect()]
        assert out.columns == docs.columns and set(found) <= given
        assert kept is None or sorted(r[0] for r in found) == sorted(kept)
        assert stage(docs.filter("doc_id < 0")).collect() == []


def test_exact_dedup_filter_lets_unique_rows_through(spark):
    df = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"))
    df = df.union(df.limit(1))
    bits = bitmaps.filter_bits(3001)
    flagged = bitmaps.probed(df, "key", bitmaps.bitmaps(df, "key", bits, least=2), bits, "maybe")
    assert 2 <= flagged.filter("maybe").count() < 400
    assert flagged.filter("maybe").groupBy("key").count().filter("count > 1").count() == 1
    assert bitmaps.filter_bits(10**12) == bitmaps.MOST_BITS
    likely = bitmaps.likely_in(df, "key", df.limit(20))
    assert likely.join(df.limit(20), "key").count() >= 20 and likely.count() < 100
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan


def test_exact_dedup_sql(spark, duck_tables):
    got = QUERIES["op9_exact_dedup"](spark, SF)
    want = duck_tables.execute(ORACLE["op9_exact_dedup"])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def water_fill(sizes, weights, most):
    """Targets by repeated rounds: share, hold what is above its limit, share the rest anew."""
    held, total = {}, sum(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in held]
        level = (total - sum(held.values())) / sum(weights[i] for i in free) if free else 0
        over = [i for i in free if level * weights[i] > most * sizes[i] + 1e-9]
        if not over:
            return [held.get(i, level * weights[i]) for i in range(len(sizes))]
        held |= {i: most * sizes[i] for i in over}


def test_mixing_meets_targets(spark):
    pick = random.Random(4)
    sources = ["a", "b", "c", "d", "é", "z", "Z", None]
    rows = [(i, " ".join("w" * pick.choice([1, 3]) for _ in range(pick.choice([0, 1, 5, 9, 33, 200]))) if pick.random() > 0.02 else None,
             "en", pick.choice(sources[:1] * 6 + sources)) for i in range(900)]
    rows.append((900, "x " * 20000, "en", "b"))
    docs = frame(spark, rows)
    out = mixing.mix(docs).collect()
    order = sorted((s for s in {r[3] for r in rows} if s is not None), key=lambda s: s.encode()) + [None]
    size = {i: len(re.findall("[^ \t-\r]+", t or "")) for i, t, *_ in rows}
    totals = [sum(size[r[0]] for r in rows if r[3] == s) for s in order]
    want = water_fill(totals, [(5, 2, 1)[i % 3] for i in range(len(order))], 3)
    where = {r[0]: order.index(r[3]) for r in rows}
    taken = collections.Counter()
    assert len(out) == len(rows)
    for r in out:
        assert r.size == size[r.doc_id] and r.source_size == totals[where[r.doc_id]] and 0 <= r.taken <= 3 * r.size
        assert r.target == pytest.approx(want[where[r.doc_id]])
        taken[where[r.doc_id]] += r.taken
    for i, target in enumerate(want):
        assert abs(taken[i] - target) <= 5
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))
    applied = mixing.apply_mix(docs)
    assert applied.columns == docs.columns
    copies = collections.Counter(r.doc_id for r in applied.collect())
    assert copies == {r.doc_id: r.copies for r in out if r.copies}
    assert mixing.mix(frame(spark, [])).collect() == []
    assert [r.taken for r in mixing.mix(frame(spark, [(1, None, None, None), (2, "", "x", "s")])).collect()] == [0, 0]


def test_mixing_of_null_and_repeated_ids(spark):
    pick = random.Random(6)
    # Texts are told apart by their first word, so that each row's copies can be counted whatever its id is.
    rows = [(pick.choice([None, None, 1, 2, i + 10]), " ".join([f"t{i}"] + ["w"] * pick.choice([0, 3, 3, 40])), "en", pick.choice("aaaab") if i % 9 else None) for i in range(400)]
    rows += [(5, "same text", "en", "a")] * 3 + [(None, None, "en", "a"), (None, "", "en", "b"), (1, None, "en", "b")]
    docs = frame(spark, rows)
    planned = mixing.mix(docs).collect()
    applied = mixing.apply_mix(docs)
    out = applied.collect()
    assert applied.columns == docs.columns and len(planned) == len(rows)
    copies = collections.Counter((r.doc_id, r.text, r.source) for r in out)
    given = collections.Counter((i, t, s) for i, t, _, s in rows)
    assert set(copies) <= set(given) and all(n <= 3 * given[k] for k, n in copies.items())
    # As many copies of each id and length, and of words in all, as planned.
    length = lambda t: len((t or "").split())
    want, got = collections.Counter(), collections.Counter()
    for r in planned:
        want[r.doc_id, r.size] += r.copies
    for (i, t, _), n in copies.items():
        got[i, length(t)] += n
    assert got == +want
    sizes, taken = collections.Counter(), collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += length(t)
    for (_, t, s), n in copies.items():
        taken[s] += n * length(t)
    order = ["a", "b", None]
    for s, target in zip(order, water_fill([sizes[s] for s in order], [5, 2, 1], 3), strict=True):
        assert abs(taken[s] - target) <= 5
    again = collections.Counter((r.doc_id, r.text, r.source) for r in mixing.apply_mix(docs.repartition(7)).collect())
    assert again == copies


def test_fit_lengths_is_exact_within_the_window():
    pick = np.random.default_rng(6)
    for _ in range(60):
        lengths = np.unique(pick.integers(1, 40, 6))
        counts = pick.integers(1, 4, len(lengths))
        budget = int(pick.integers(0, int((lengths * counts).sum()) + 3))
        take = mixing.fit_lengths(lengths, counts, budget)
        sums = {sum(c) for c in itertools.product(*[[k * n for k in range(m + 1)] for n, m in zip(lengths.tolist(), counts.tolist(), strict=True)])}
        assert ((0 <= take) & (take <= counts)).all()
        assert (lengths * take).sum() == max(s for s in sums if s <= budget)
    lengths, counts = np.arange(1, 3000), np.full(2999, 50)
    take = mixing.fit_lengths(lengths, counts, 123_456_789, window=5000)
    assert (lengths * take).sum() == 123_456_789 and (take <= counts).all()


def test_tokenizer_gives_the_ids_of_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["", None, "Plain words, and so on. ...", "don't's ''s 3.14 x2y", "É é É ́a ÷×ª", "Σας İstanbul K", "a\x1cb\xa0c\x85d", "日本語。ok",
             "<|endoftext|> A <|STARTOFTEXT|>", "word " * 5000, "x" * 3000, "!?.,;" * 9, "😀 ok😀", " a　b"]
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for t in texts]
    mine = word_tokenizer()
    assert mine.encode(texts) == want and mine.encode(texts) == want


def check_packing(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_documents(spark):
    words = ["alpha", "beta", "gamma"]
    rows = [(i, " ".join(words[j % 3] for j in range(n)), None, None) for i, n in enumerate([0, 1, 5, 30, 31, 31, 31, 32, 33, 70, 200])]
    rows += [(None, None, None, None), (3, "twice", None, None), (3, "twice", None, None)]
    tokenizer = word_tokenizer()
    out = packing.pack_documents(frame(spark, rows), tokenizer, 32).collect()
    check_packing(out, 32)
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = tokenizer.encode([t])[0]
        for piece, at in enumerate(range(0, len(ids), 128)):
            part = ids[at : at + 128]
            want[i, piece, at // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    assert packing.pack_documents(frame(spark, []), tokenizer, 32).collect() == []


def test_packing_is_as_dense_as_sequential_best_fit(spark):
    pick = random.Random(8)
    sizes = [min(64, max(0, int(pick.lognormvariate(2.5, 1)))) for _ in range(1500)] + [64, 0, 0] + [33] * 100
    df = spark.createDataFrame([(i, n, "mine") for i, n in enumerate(sizes)], "doc_id long, length int, offset string").withColumn("piece", F.lit(0))
    from postmill.operators.ordering import materialize

    out = packing.pack(materialize(df, "lengths"), 64).collect()
    used = check_packing(out, 64)
    gaps, bins = [], 0
    for n in sorted((s for s in sizes if s), reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            bins += 1
            gaps.append(64 - n)
    assert used == bins
    bad = spark.createDataFrame([(1, 0, 65)], "doc_id long, piece int, length int")
    with pytest.raises(ValueError):
        packing.pack(bad, 64)


def test_language_id_on_held_out_documents(spark):
    out = QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = out.join(truth, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_of_awkward_texts(spark):
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate([("the cat and the dog " * 9, "en"), ("der hund und die katze " * 9, "de"), ("only text", None), (None, "fr")] * 3)]
    model = language_id.fit(frame(spark, rows))
    assert model.languages == ("de", "en")
    asked = frame(spark, [(i, t, None, None) for i, t in enumerate([None, "", "123 !?", "THE DOG", "katze", "ж", "the dog " * 300000])])
    out = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(asked, model).collect()}
    assert [out[i][0] for i in range(7)] == ["und", "und", "und", "en", "de", "de", "en"]
    assert [out[i][1] for i in (0, 1, 2, 5)] == [0.0] * 4 and out[6][1] > 0.9
    blank = language_id.fit(frame(spark, []))
    assert {r.lang_pred for r in language_id.identify(asked, blank).collect()} == {"und"}
    assert language_id.identify(frame(spark, []), model).collect() == []


def test_language_stage_rejects_only_texts_without_a_letter(spark):
    texts = [None, "", "123 !?", "THE DOG", "ж", "x", "中文", "the dog " * 50]
    learned = [(100 + i, "the cat and the dog " * 9, "en", "s") for i in range(9)]
    for lang in ("en", None):  # with and without any label to learn from
        rows = [(i, t, None, "s") for i, t in enumerate(texts)] + [(i, t, lang, s) for i, t, _, s in learned]
        docs = frame(spark, rows)
        out = corpus_pipeline.language(spark, docs, None)
        assert out.columns == docs.columns
        assert sorted(r.doc_id for r in out.collect()) == [3, 4, 5, 6, 7, *range(100, 109)]


def test_language_filter_equals_sets():
    """The bit-sliced filter answers like one set per language, but for the chance of a false hit."""
    pick = np.random.default_rng(9)
    languages = tuple(f"l{i:02d}" for i in range(70))
    own = [pick.integers(0, 2**63, 200, dtype=np.uint64) for _ in languages]
    slots = language_id._empty_filter(200, len(languages))
    shift = np.uint64(64 - len(slots).bit_length() + 1)
    for i, grams in enumerate(own):
        for m in language_id._MULTIPLIERS:
            slots[(grams * np.uint64(m)) >> shift, i // 64] |= np.uint64(1 << (i % 64))
    model = language_id.Model(languages, slots, np.zeros(70), 0)
    for i in (0, 63, 64, 69):
        masks = model.probe(own[i])
        assert ((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()
    assert (model.probe(pick.integers(0, 2**63, 2000, dtype=np.uint64)) != 0).mean() < 0.5
