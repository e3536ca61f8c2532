"""What a step frees does not stay with its worker, which outlives the task."""

import os

import pytest

from postmill.llm.common import released, with_columns
from postmill.llm.queries import word_tokenizer
from pyspark.sql import types as T


def resident() -> int:
    with open("/proc/self/statm") as file:
        return int(file.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20


def wasteful(pinned):
    """A step that frees 200 MB below a block that stays, which keeps a plain worker from giving them back."""

    def step(batches):
        texts = [bytes(2000) for _ in range(100_000)]
        pinned.append(bytes(3000))
        for batch in batches:
            yield len(texts), batch

    return step


@pytest.mark.skipif(not os.path.exists("/proc/self/statm"), reason="needs /proc")
def test_a_step_gives_memory_back():
    pinned, before = [], resident()
    assert len(list(released(wasteful(pinned))([1, 2]))) == 2
    assert resident() - before < 60


def test_a_step_that_fails_lets_go_as_well():
    gone = []

    def broken(batches):
        yield 1
        raise ValueError

    with pytest.raises(ValueError):
        list(released(broken, lambda: gone.append(1))([]))
    assert gone == [1]


def test_steps_and_tokenizers_end_with_it(spark):
    tokenizer = word_tokenizer()
    ids = tokenizer.encode(["one two", None])
    tokenizer.forget()
    assert tokenizer._words is None and tokenizer.encode(["one two", None]) == ids
    rows = with_columns(spark.range(5), [T.StructField("b", T.LongType())], lambda batches: ([b.column(0)] for b in batches)).collect()
    assert sorted((r.id, r.b) for r in rows) == [(i, i) for i in range(5)]
