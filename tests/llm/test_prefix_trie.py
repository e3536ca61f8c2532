"""The trie of conversations against SQL, with blocks so small that intervals cross many of them."""

import collections
import hashlib
import random

import duckdb
import pytest

from postmill.llm import conversations, prefix_trie
from postmill.llm.oracle import ORACLE
from postmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, place int, key string"


def compared(spark, folder):
    got = QUERIES["op11_conversation_trie"](spark, folder)
    db = duckdb.connect()
    files = f"{folder}/conversations.parquet"
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{files if folder == SF else files + '/*.parquet'}')")
    result = db.execute(ORACLE["op11_conversation_trie"])
    names = [c[0] for c in result.description]
    assert sorted(got.columns) == sorted(names)
    rows = [tuple(r) for r in got.select(*names).collect()]
    assert collections.Counter(rows) == collections.Counter(result.fetchall())
    return rows


def conversations_of(seed):
    pick, rows = random.Random(seed), []
    for conv in [*range(0, 330), *range(505, 530), 10_000_000_000, 10_000_000_007, -5, -205]:
        for turn in range(pick.choice([1, 1, 2, 3, 4, 6, 9])):
            rows.append((conv, None if turn == 0 and pick.random() < 0.3 else turn, pick.choice(["user", "user", None, ""]), pick.choice(["a", "b", "b", "", None, "häß"])))
    for turn in range(120):
        rows += [(600, turn, "u", "long"), (601, turn, "u", "long" if turn < 100 else "other"), (602, turn, "u", "long")]
    rows += [(603, 2, "u", "tie"), (603, 2, "a", "tie"), (603, 2, "u", "tie"), (None, 0, "u", "of no conversation")]
    return rows


@pytest.mark.parametrize("block", [2, 7, 4096])
def test_trie_against_sql(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    given = spark.createDataFrame([(*r, 1, "k") for r in conversations_of(block)], SCHEMA)
    given.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    rows = compared(spark, str(tmp_path))
    assert len(rows) > 500


def test_given_conversations(spark):
    compared(spark, SF)


def test_empty_table_and_copies_only(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert QUERIES["op11_conversation_trie"](spark, f"{tmp_path}/none").collect() == []
    copies = [(i, t, "u", f"t{t}", 1, "k") for i in range(700, 800) for t in range(3)]
    spark.createDataFrame(copies, SCHEMA).write.parquet(f"{tmp_path}/copies/conversations.parquet")
    rows = compared(spark, f"{tmp_path}/copies")
    assert len(rows) == 4


def test_plain_trie(spark):
    """Hand-made: x, xy (twice), xz, and one empty sequence."""
    code = {c: hashlib.md5(c.encode()).digest() for c in "xyz"}
    rows = [(b"".join(code[c] for c in s), [ord(c) for c in s], n, least) for s, n, least in (("x", 1, 5), ("xy", 2, 3), ("xz", 1, 9), ("", 1, 7))]
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, "key binary, sizes array<long>, members long, least long")).collect()
    got = {(r.node, r.depth): (r.parent, r.n_members, r.n_children, r.n_leaves, r.saved, r.ending) for r in found}
    assert got == {
        (3, 0): (None, 5, 1, 2, 3 * ord("x") + ord("y"), 7), (3, 1): (3, 4, 2, 2, 3 * ord("x") + ord("y"), 5),
        (3, 2): (3, 2, 0, 1, ord("y"), 3), (9, 2): (3, 1, 0, 1, 0, 9),
    }


def test_digests_of_large_groups(spark):
    ids = {"big": list(range(-5, 9000)), "two": [10**12, 7], "one": [3]}
    rows = [(k.encode(), i) for k, own in ids.items() for i in own]
    random.Random(1).shuffle(rows)
    members = spark.createDataFrame(rows, "seq binary, id long").repartition(6)
    got = {bytes(r.seq).decode(): (r.least, r.n, r.digest) for r in conversations.joined_id_digests(members).collect()}
    assert got == {k: (min(own), len(own), hashlib.sha256(",".join(map(str, sorted(own))).encode()).hexdigest()) for k, own in ids.items()}
