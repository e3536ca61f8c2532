"""Runs of words against brute force, chunk by chunk as well as at once, and the registered query against its rules."""

import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from postmill.llm import periodic_runs as P
from postmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(24, 3 * q) and not any(all(w[x] == w[x + p] for x in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out)


def some_words(pick, kind, n):
    if kind == "binary":
        return [pick.randrange(2) for _ in range(n)]
    if kind == "fibonacci":
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == "tail":
        w, a = [pick.randrange(50) for _ in range(n)], pick.randrange(n)
        p = 1 + (n - a) // (3 + pick.randrange(8))
        return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    w = []
    while len(w) < n:
        if kind == "blocks":
            w += [pick.randrange(3) for _ in range(pick.randint(1, 40))] * pick.randint(1, 6)
        else:
            w += [0] * pick.randint(1, 30) + [1] * pick.randint(0, 2)
    return w


@pytest.mark.parametrize("kind", ["binary", "fibonacci", "tail", "blocks", "stretches"])
@pytest.mark.parametrize("chunk", [7, 16, 1 << 16])
def test_runs_against_brute_force(kind, chunk, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", chunk)
    pick, found = random.Random(kind + str(chunk)), 0
    for n in (0, 1, 23, 24, 25, 64, 150, 300) * 4:
        words = some_words(pick, kind, n) if n else []
        want = brute_runs(words)
        found += len(want)
        assert P.runs(np.array(words, np.int64)) == want
    assert found or kind == "binary"


def test_long_texts_stay_quick():
    one, pick = np.zeros(1_000_000, np.int64), np.random.default_rng(1)
    texts = [one, np.arange(1_000_000), np.tile(np.arange(100_000), 10), pick.integers(0, 2, 300_000), np.tile(np.repeat([0, 1], 1000), 200)]
    started = time.time()
    assert P.runs(texts[0]) == [(0, 1_000_000, 1)]
    assert P.runs(texts[1]) == []
    assert P.runs(texts[2]) == [(0, 1_000_000, 100_000)]
    P.runs(texts[3])
    assert (0, 400_000, 2000) in P.runs(texts[4])
    assert time.time() - started < 60


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    spans = brute_runs(words)
    best = max(spans, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, size, p in spans for i in range(s + p, s + size)}
    lines = "".join(f"{s},{size},{p}\n" for s, size, p in spans)
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        doc_id, len(spans), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest(),
    )


def test_query_against_brute_force(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(i, t) for i, t in rows if len((t or "").split()) < 700]
    awkward = [(None, "a b c " * 30), (None, None), (10**12, ""), (5, " \t\n"), (5, "x " * 24), (5, "x " * 24), (6, "x " * 23), (7, "\x1cy z " * 40), (8, "ä ö  ü\n" * 50)]
    tens = [i for i in range(100_000, 100_400) if zlib.crc32(str(i).encode()) % 10 == 0]
    awkward += [(i, " ".join(f"w{x}" for x in range(3 + i % 90))) for i in tens]
    folder = str(tmp_path)
    given = spark.createDataFrame([(i, t, 1, "c") for i, t in rows + awkward], "doc_id long, text string, runs int, words string")
    given.repartition(3).write.parquet(f"{folder}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op12_periodic_runs"](spark, folder).collect()]
    want = [expected(i, t) for i, t in rows + awkward]
    assert sum(w[1] > 0 for w in want) > 30
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_other_columns_stay(spark):
    docs = spark.createDataFrame([(i, "u v " * 20 + str(i), 3, "k") for i in range(30)] + [(99, None, 4, None)], "id int, body string, start int, _words string")
    out = P.with_runs(docs, "body").collect()
    assert {(r.id, r.body, r.start, r._words) for r in out} == {tuple(r) for r in docs.collect()}
    assert all(r.collapsed == f"u v {r.id}" and [tuple(x) for x in r.runs] == [(0, 40, 2)] and r.n_words == 41 for r in out if r.id < 99)
    assert [(r.n_words, r.runs, r.collapsed) for r in out if r.id == 99] == [(0, [], "")]
    assert P.with_runs(docs.limit(0), "body").collect() == []
