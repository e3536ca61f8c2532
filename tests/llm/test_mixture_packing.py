"""Mixture-controlled packing against its definition: every token once, full windows at their proportions."""

import collections
import random
import zlib

import numpy as np
import pytest

from postmill.llm import mixture_packing as M
from postmill.llm.queries import word_tokenizer

SCHEMA = "doc_id long, text string, source string, start long, _key string, n long, part int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, s, -1, "k", 5, 9) for i, t, s in rows], SCHEMA).repartition(parts, "text", "doc_id")


def rows_of(count, seed=4):
    pick = random.Random(seed)
    words = ["lorem", "ipsum", "dolor", "straße", "ΟΔΟΣ", "x1,", "it's", "über.", "日本"]
    sources = ["a", "b", "b", "b", "b", "b", "c", None, "Z", ""]
    return [(i, " ".join(pick.choice(words) for _ in range(pick.choice([0, 1, 5, 40, 300]))), pick.choice(sources)) for i in range(count)]


def checked(spark, rows, capacity, **options):
    """Pieces of ``rows``, after all that must hold of any packing."""
    tokenizer = word_tokenizer()
    pieces = M.pack_by_source(frame(spark, rows), tokenizer, capacity, **options).collect()
    ids = collections.defaultdict(list)
    for (i, text, source), data in zip(rows, tokenizer.encode([t for _, t, _ in rows]), strict=True):
        ids[i].append((source, data))
    for p in pieces:
        assert any(zlib.crc32(d[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 and len(d) == 4 * p.doc_tokens and p.source == s for s, d in ids[p.doc_id])
    covered = collections.Counter((p.doc_id, x) for p in pieces for x in range(p.start, p.start + p.length))
    assert covered == collections.Counter((i, x) for i, found in ids.items() for _, d in found for x in range(len(d) // 4))
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    sizes = {}
    for number, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        sizes[number] = at
    total = sum(sizes.values())
    assert all(n == capacity or n & (n - 1) == 0 and n < capacity for n in sizes.values())
    assert sum(n == capacity for n in sizes.values()) == total // capacity
    return pieces, sizes


@pytest.mark.parametrize("sequences", [1, 4])
def test_every_window_holds_the_proportions(spark, sequences):
    rows, capacity = rows_of(400), 64
    pieces, sizes = checked(spark, rows, capacity, window=capacity * sequences)
    by_source, windows = collections.Counter(), collections.defaultdict(collections.Counter)
    for p in pieces:
        by_source[p.source] += p.length
        windows[p.sequence_id // sequences][p.source] += p.length
    total, window = sum(by_source.values()), capacity * sequences
    assert len(by_source) == 6 and by_source["b"] > total / 3
    for number, found in windows.items():
        if number < total // window:
            assert sum(found.values()) == window
            for name, n in by_source.items():
                assert abs(found[name] - window * n / total) < 2


def test_other_weights_hold_until_a_source_runs_dry(spark):
    rows, capacity = rows_of(300, 9), 32
    weights = {"a": 1, "b": 1, "c": 1, None: 2, "Z": 1, "": 2}
    pieces, _ = checked(spark, rows, capacity, weights=weights)
    windows = collections.defaultdict(collections.Counter)
    for p in pieces:
        windows[p.sequence_id][p.source] += p.length
    for number in range(10):
        assert all(abs(windows[number][name] - capacity * w / 8) < 2 for name, w in weights.items())
    assert windows[max(n for n, w in windows.items() if sum(w.values()) == capacity)]["b"] == capacity
    with pytest.raises(ValueError):
        M.pack_by_source(frame(spark, rows), word_tokenizer(), capacity, weights={"a": 1})


def test_schedule_gives_every_token_once():
    pick = random.Random(2)
    for _ in range(200):
        k, window = pick.randint(1, 6), pick.choice([8, 16, 100])
        sizes = [pick.choice([1, 3, 50, 400, 10_000]) for _ in range(k)]
        weights = [pick.randint(1, 20) for _ in range(k)] if pick.random() < 0.6 else sizes
        if min(weights) * window < sum(weights):
            continue
        s = M.Schedule(sizes, weights, window)
        assert [s.of_queue(i, s.windows) for i in range(k)] == sizes
        for w in range(s.windows):
            given = [s.of_queue(i, w + 1) - s.of_queue(i, w) for i in range(k)]
            assert min(given) >= 0 and (sum(given) == window or w == s.windows - 1)
        i = pick.randrange(k)
        token = pick.randrange(sizes[i])
        w = s.holding(i, token)
        assert s.of_queue(i, w) <= token < s.of_queue(i, w + 1)


def test_sources_below_one_token_share_a_queue(spark):
    rows = [(i, "lorem " * 30, "big") for i in range(60)] + [(100, "a", "s1"), (101, "b", "s2"), (102, None, "s3")]
    pieces, _ = checked(spark, rows, 16)
    assert {p.source for p in pieces} == {"big", "s1", "s2", "s3"}
    place, sizes, _ = M.assigned_queues({"big": 1000, "s1": 2, "s2": 2, None: 500}, None, 100)
    assert place == {"big": (0, 0), "s1": (1, 0), "s2": (1, 2), None: (1, 4)} and sizes == [1000, 504]
    place, sizes, _ = M.assigned_queues({"big": 1000, "s1": 9, "s2": 9, None: 500}, None, 100)
    assert place == {"big": (0, 0), None: (1, 0), "s1": (2, 0), "s2": (2, 9)} and sizes == [1000, 500, 18]


def test_awkward_rows(spark):
    long = "wort " * 200_000
    rows = [(1, long, "a"), (1, "x", "a"), (1, "x", "a"), (None, None, None), (None, "", "b"), (7, " \n", "b")]
    pieces, sizes = checked(spark, rows, 2048)
    assert sum(sizes.values()) == 200_001 + 2 + 2 + 3 and len(sizes) == 200_008 // 2048 + bin(200_008 % 2048).count("1")
    assert M.pack_by_source(frame(spark, []), word_tokenizer()).collect() == []


def test_ids_are_those_of_the_library():
    import unicodedata

    pick, tokenizer = random.Random(1), word_tokenizer(None)
    letters = [chr(c) for c in range(32, 0x3000) if unicodedata.category(chr(c)) != "Cn"] + list("ΣσςΟΔΣ'.,! \n\t") * 60
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(1, 12))) for _ in range(20_000)] + ["ΟΔΟΣ", "ΟΔΟΣ. ΣΑΣ'S", "wörd, WORD. straße! é."]
    got = tokenizer.encode(texts)
    library = tokenizer._words.tokenizer
    assert all(np.frombuffer(b, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids for t, b in zip(texts, got, strict=True))
