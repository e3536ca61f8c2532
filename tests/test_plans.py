"""Plans that must stay the way they are."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from conftest import SF
from postmill.operators import dedup, selection, timeline
from workload.tables import board, raw_messages


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def stored(spark, tmp_path):
    df = spark.range(100).select(
        F.timestamp_seconds(F.lit(990_000_000) + F.col("id") * 3600).cast("timestamp_ntz").alias("DateTime"),
        F.col("id").cast("string").alias("Message-ID"), F.lit("a").alias("From"), F.lit("s").alias("Subject"),
        F.lit("long body").alias("Body"),
    )
    df.write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


def test_day_range_and_columns_reach_the_scan(stored):
    picked = timeline.on_days(stored, date(2001, 5, 17), date(2001, 5, 18)).select("From")
    text = plan(picked)
    assert "GreaterThanOrEqual(DateTime,2001-05-17" in text and "LessThan(DateTime,2001-05-19" in text
    assert "ReadSchema: struct<DateTime:timestamp_ntz,From:string>" in text


def test_keyset_page_reaches_the_scan_and_is_a_top_k(stored):
    text = plan(selection.page_after(stored, (datetime(2001, 5, 17), "5")).select("Subject"))
    assert "GreaterThanOrEqual(DateTime,2001-05-17" in text and "TakeOrderedAndProject" in text
    assert "TakeOrderedAndProject" in plan(selection.page(stored, 2, 10))


def test_unused_columns_are_not_cleaned(spark):
    text = board(spark, SF).groupBy("From").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "script" not in text and "title" not in text and "x-cc" not in text.lower()


def test_survivors_are_found_on_keys(spark):
    text = plan(dedup.surviving_paths(raw_messages(spark, SF).withColumn("hash", F.md5("path")).drop("text")))
    assert "Body" not in text


def test_daily_counts_are_computed_once(stored):
    df = timeline.daily_volume(stored)
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_word_pairs_are_counted_in_one_pass(spark, tmp_path):
    """One scan of the texts, also where one word owns most pairs; the likelihood is worked out once."""
    from postmill.operators.vocabulary import cloud_weights

    spark.range(4000).select(
        F.concat_ws(" ", F.lit("hot"), F.concat(F.lit("w"), (F.col("id") % 700).cast("string")), F.lit("hot"), F.lit("pair")).alias("text")
    ).write.parquet(str(tmp_path / "t"))
    df = cloud_weights(spark.read.parquet(str(tmp_path / "t")), "text")
    text = plan(df)
    assert text.count("LN(") + text.count("ln(") <= 8 and "tokens" not in text
    assert [r.word for r in df.head(2)] == ["hot", "hot pair"]


def test_texts_of_a_bucketed_corpus_are_not_shuffled(spark, tmp_path):
    import re

    from postmill.plans.corpus import corpus_to_records
    from postmill.sources.files import compact

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files = compact(raw_messages(spark, SF).select("path", "text"), str(tmp_path / "files"), 4, "plan_files")
        for df in (corpus_to_records(files), corpus_to_records(files, number="n")):
            df.collect()
            text = plan(df)
            moved = [line for line in text.splitlines() if "Exchange" in line]
            assert moved and "SortMergeJoin" in text
            tree = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            below = re.findall(r"Exchange hashpartitioning[^\n]*\n(?:[^\n]*\n){1,6}", tree)
            assert below and not any("text#" in part for part in below)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS plan_files")
