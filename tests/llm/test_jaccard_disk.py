"""What the Jaccard join keeps on disk: no shuffle files of steps that are done, no tables but its result, few copies of members."""

import glob
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from postmill.llm import jaccard_join
from postmill.operators.ordering import materialize
from postmill.session import run_scope


def shuffle_files(spark):
    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    earlier, setting = shuffle_files(spark), spark.conf.get(name, None)
    counts = spark.range(5000).groupBy((F.col("id") % 100).alias("k")).count().join(spark.range(100).withColumnRenamed("id", "k").repartition(5), "k")
    table = materialize(counts.repartition(3, "count"), "counts")
    assert table.agg(F.sum("count")).first()[0] == 5000 and spark.conf.get(name, None) == setting
    until = time.time() + 20
    while (left := {f for f in shuffle_files(spark) - earlier if os.path.getsize(f) > 500}) and time.time() < until:
        time.sleep(0.2)
    assert not left


def test_the_join_leaves_one_table(spark):
    pick = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:k] + ["other"] + base[k + 1:]) for k in range(0, 60, 6)] + [" ".join(pick.choice(base) for _ in range(30)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    with run_scope(spark) as folder:
        got = jaccard_join.similar_classes(docs)
        assert got.filter("component_id = 0").count() == 10
        left = [x for x in os.listdir(folder.removeprefix("file:")) if not x.startswith(".")]
        assert len(left) == 1 and left[0].startswith("classes-")


def test_sets_that_share_a_passage_only_are_set_aside(spark):
    pick = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join(passage + [f"x{pick.random()}" for _ in range(40)]) for _ in range(30)]
    texts += [texts[0] + " end", texts[1] + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    sets = materialize(jaccard_join._sets(docs, 5, 75), "sets")
    assert jaccard_join._linkable(sets, 75).count() == 32
    small = materialize(sets.select("c", "id", "n"), "small")
    assert sorted(r.id for r in jaccard_join._likely_linked(docs, small, 5, 75).collect()) == [0, 1, 30, 31]


@pytest.mark.parametrize("probing, cells", [(0, 0), (1, 40 + 10), (9, 40 * 3 + 9 * 10), (40, 800)])
def test_members_of_a_large_bucket_are_copied_by_blocks_of_those_that_probe(spark, probing, cells, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    members = [(1, 2 * c, 100, c, c < probing, b"") for c in range(40)] + [(s, 2, 100, 1, True, b"") for s in range(2, 6)]
    split = materialize(spark.createDataFrame(members, "sig long, c long, n long, label long, probe boolean, profile binary"), "split")
    placed, rows = jaccard_join._placed(split)
    found = placed.filter("sig = 1").collect()
    assert len(found) == cells and rows == placed.count() == cells + 4
    asked = {(r.i, r.j, r.c) for r in found if r.left}
    met = {(c, r.c) for i, j, c in asked for r in found if r.right and (r.i, r.j) == (i, j)}
    assert met == {(2 * a, 2 * b) for a in range(probing) for b in range(40)}
