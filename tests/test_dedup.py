import pytest
from pyspark.sql import functions as F

from postmill.operators import dedup
from postmill.operators.ordering import attach_group, spread, with_position

FILES = [
    ("/a/1.txt", "x"), ("/a/2.txt", "y"), ("/b/1.txt", "x"), ("/b/3.txt", "x"), ("/c/1.txt", "z"), ("/c/9.csv", "x"),
    ("/c/M.TXT", "x"), ("/d/5.txt", "y"), ("/e/6.txt", ""), ("/e/7.txt", ""),
]


@pytest.fixture(params=[1, 64])
def files(spark, request):
    return spark.createDataFrame(FILES, "path string, text string").repartition(request.param)


def paths(df, *columns):
    return sorted(tuple(r) if columns else r.path for r in (df.select(*columns) if columns else df).collect())


def test_groups_and_survivors(files):
    prints = dedup.fingerprints(files)
    assert prints.count() == 8
    assert paths(dedup.removed_files(prints)) == ["/b/1.txt", "/b/3.txt", "/d/5.txt", "/e/7.txt"]
    assert paths(dedup.keep_first(files)) == ["/a/1.txt", "/a/2.txt", "/c/1.txt", "/e/6.txt"]
    assert dedup.duplicate_summary(prints).first().asDict() == {"duplicate_sets": 3, "files": 7, "removed": 4}
    lines = [r.value for r in dedup.removal_lines(dedup.removed_files(prints)).orderBy("value").collect()]
    assert lines[0] == "Deleted duplicate file: /b/1.txt"


@pytest.mark.parametrize("hot", [1_000_000, 3, 2, 1])
def test_duplicate_sets_do_not_depend_on_splitting(files, hot):
    sets = dedup.duplicate_sets(dedup.fingerprints(files), hot=hot)
    assert paths(sets, "path", "copies", "first_path") == [
        ("/a/1.txt", 3, "/a/1.txt"), ("/a/2.txt", 2, "/a/2.txt"), ("/b/1.txt", 3, "/a/1.txt"), ("/b/3.txt", 3, "/a/1.txt"),
        ("/d/5.txt", 2, "/a/2.txt"), ("/e/6.txt", 2, "/e/6.txt"), ("/e/7.txt", 2, "/e/6.txt"),
    ]


def test_dedup_is_idempotent(files):
    once = dedup.keep_first(files)
    assert paths(dedup.keep_first(once)) == paths(once)
    assert dedup.duplicate_summary(dedup.fingerprints(once)).first().duplicate_sets == 0


def test_stored_hash_is_used(files):
    stored = files.select("path", F.md5("text").alias("hash"))
    assert paths(dedup.removed_files(dedup.fingerprints(stored))) == paths(dedup.removed_files(dedup.fingerprints(files)))


def test_last_file_of_a_name_stands_for_it(files):
    named = files.select("path", F.substring_index("path", "/", -1).alias("file_name"))
    assert paths(dedup.last_per_name(named)) == [
        "/a/2.txt", "/b/3.txt", "/c/1.txt", "/c/9.csv", "/c/M.TXT", "/d/5.txt", "/e/6.txt", "/e/7.txt"
    ]
    assert paths(dedup.surviving_paths(files)) == ["/a/2.txt", "/c/1.txt", "/c/9.csv", "/c/M.TXT", "/e/6.txt"]
    assert "/a/1.txt" in paths(dedup.surviving_paths(files, collapse=False))


def test_hot_key_is_split_over_tasks(spark):
    members = spark.range(40_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("u")
    )
    groups = members.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = attach_group(members, groups, "k", "u", "n", hot=1000)
    assert joined.count() == 40_000
    assert joined.filter("k = 'hot'").agg(F.countDistinct("u")).first()[0] == 13_334
    assert joined.filter("k = 'hot' and n <> 13334").isEmpty()


@pytest.mark.parametrize("parts", [1, 64])
def test_positions(spark, parts):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")).repartition(parts)
    numbered = with_position(df, ["v"], "n", start=1)
    assert numbered.filter("n <> v + 1").isEmpty() and numbered.count() == 5000
    assert with_position(df.limit(0), ["v"], "n").count() == 0


def test_spread_leaves_wide_tables_alone(spark):
    wide = spark.range(0, 100, 1, 16)
    assert spread(wide, "id") is wide
    assert spread(spark.range(0, 100, 1, 1), "id").rdd.getNumPartitions() == 4
