"""Value counts, words, timeline, selection and paging."""

import random
from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from postmill.operators import selection, timeline, values, vocabulary

ROWS = [
    ("m1", "01.05.2001 10:00:00", "b", "Hello World", "x"),
    ("m2", "03.05.2001 23:59:59", "a", "hello again.", ""),
    ("m3", "03.05.2001 09:00:00", "b", None, None),
    ("m4", "bad", "c", "worlds", "y"),
    ("m5", "03.05.2001 09:00:00", None, "Boss bosses x 42", "z"),
    ("m6", "04.05.2001 00:00:00", "", "the the the", "q"),
]


@pytest.fixture(params=[1, 16])
def mail(spark, request):
    return spark.createDataFrame(ROWS, "`Message-ID` string, Date string, From string, Subject string, Body string").repartition(request.param)


@pytest.fixture()
def timed(mail):
    return timeline.with_time(mail)


def ids(df):
    return [r["Message-ID"] for r in df.collect()]


def test_top_values(mail):
    assert [tuple(r) for r in values.top_values(mail, "From", 2, "n").collect()] == [("b", 2), ("", 1)]
    assert [r.From for r in values.distinct_values(mail, "From").collect()] == ["", "a", "b", "c"]
    assert [r.From for r in values.distinct_values(mail, "From", "(unknown)").collect()] == ["", "(unknown)", "a", "b", "c"]


def test_equality_filter(mail):
    listed = values.mail_list(mail.withColumn("To", F.lit("t")))
    assert listed.columns == ["Date", "Sender", "Recipient", "Subject", "Body"]
    assert values.row_count(values.equal_to(listed, "Sender", "b")).first().emails == 2
    assert values.equal_to(listed, "Sender").count() == 6


def test_words(mail):
    top = [tuple(r) for r in vocabulary.top_words(mail, "Subject", 3).collect()]
    assert top == [("the", 3), ("hello", 2), ("42", 1)]


def test_cloud(mail):
    rows = {r.word: (r.frequency, r.weight) for r in vocabulary.cloud_weights(mail, "Subject", pairs=False).collect()}
    assert rows == {
        "hello": (2, 1.0), "world": (2, 1.0), "boss": (1, 0.5), "bosses": (1, 0.5), "x": (1, 0.5)
    }
    plain = vocabulary.cloud_weights(mail, "Subject", k=1, stop_words=(), merge_plurals=False, pairs=False).collect()
    assert [tuple(r) for r in plain] == [("the", 3, 1.0)]


def test_cloud_pairs(spark):
    texts = ["new york offices"] * 20 + ["new york office 7 and"] * 5 + [f"w{i} new" for i in range(40)] + [f"york v{i}" for i in range(3)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = {r.word: r.frequency for r in vocabulary.cloud_weights(df, "t").collect()}
    assert rows["new york"] == 25 and rows["york office"] == 25
    assert rows["new"] == 40 and "york" not in rows and "office" not in rows and "and" not in rows and "7" not in rows
    assert "w1 new" not in rows and rows["w1"] == 1
    assert vocabulary.cloud_weights(df.limit(0), "t").isEmpty()


def test_date_column(mail, timed):
    assert timeline.date_like_columns(mail.withColumn("sentTime", F.lit(1))) == ["Date", "sentTime"]
    with pytest.raises(ValueError):
        timeline.first_date_column(mail.drop("Date"))
    assert ids(timeline.in_time_order(timed)) == ["m1", "m3", "m5", "m2", "m6"]
    assert tuple(timeline.time_bounds(timed).first()) == (date(2001, 5, 1), date(2001, 5, 4))


def test_filters(spark, timed):
    assert sorted(ids(timeline.on_days(timed, date(2001, 5, 1), date(2001, 5, 3)))) == ["m1", "m2", "m3", "m5"]
    assert sorted(ids(timeline.from_senders(timed, ["b", "(unknown)"]))) == ["m1", "m3"]
    frame = spark.createDataFrame([("b",), ("b",), (None,), ("a",)], "s string")
    assert sorted(ids(timeline.from_senders(timed, frame))) == ["m1", "m2", "m3"]
    assert sorted(ids(timeline.subject_matches(timed, "HELL|boss"))) == ["m1", "m2", "m5"]
    assert ids(timeline.subject_matches(timed, "again.", literal=True)) == ["m2"]
    assert timeline.subject_matches(timed, "gain..", literal=True).isEmpty()
    assert timeline.subject_matches(timed, "") is timed
    picked = timeline.select_mail(timed, date(2001, 5, 3), date(2001, 5, 3), ["a", "b"], "o")
    assert ids(picked) == ["m2"]


def test_timeline_points(timed):
    assert [r.From for r in timeline.timeline_points(timed).collect()] == [None, "", "a", "b", "b"]


def test_daily_volume(timed):
    got = [(r.day.day, r.emails) for r in timeline.daily_volume(timed).collect()]
    assert got == [(1, 1), (2, 0), (3, 3), (4, 1)]
    assert timeline.daily_volume(timed.limit(0)).count() == 0


def test_weekday_hour(timed):
    got = [tuple(r) for r in timeline.weekday_hour(timed).collect()]
    assert got == [(1, "Tuesday", 10, 1), (3, "Thursday", 9, 2), (3, "Thursday", 23, 1), (4, "Friday", 0, 1)]
    grid = timeline.weekday_hour_grid(timed).collect()
    assert len(grid) == 168 and sum(r.emails for r in grid) == 5 and grid[0].day_of_week == "Monday"


@pytest.mark.parametrize("shallow", [0, 10_000])
def test_positions(timed, shallow):
    rows = selection.rows_at(timed, [3, 0, 99], shallow=shallow).collect()
    assert sorted((r.position, r["Message-ID"]) for r in rows) == [(0, "m1"), (3, "m2")]
    filled = selection.working_set(timed, [3], minimum=3, shallow=shallow)
    assert sorted(r.position for r in filled.collect()) == [0, 1, 3]
    assert selection.rows_at(timed, [], shallow=shallow).isEmpty()
    assert ids(selection.working_set(timed)) == ["m1"]
    assert [r.position for r in selection.working_set(timed, [99], minimum=1, shallow=shallow).collect()] == [0]
    places = timed.sparkSession.createDataFrame([(3,), (0,), (3,), (99,)], "place int")
    framed = selection.rows_at(timed, places, shallow=shallow).collect()
    assert sorted((r.position, r["Message-ID"]) for r in framed) == [(0, "m1"), (3, "m2")]


def test_paging(timed):
    assert ids(selection.page(timed, 1, 2)) == ["m1", "m3"]
    assert ids(selection.page(timed, 2, 2)) == ["m5", "m2"]
    assert ids(selection.page(timed, 3, 2)) == ["m6"]
    assert [ids(selection.page(timed, n, 2, shallow=0)) for n in (1, 2, 3, 4)] == [["m1", "m3"], ["m5", "m2"], ["m6"], []]
    last = (datetime(2001, 5, 3, 9), "m3")
    assert ids(selection.page_after(timed, last, 2)) == ["m5", "m2"]
    assert tuple(selection.page_count(timed, 2).first()) == (5, 3)
    with pytest.raises(ValueError):
        selection.page(timed, 0)


def tied_frame(spark, seed=0):
    """Few different keys, null among them, rows equal in full, and columns named like those used inside."""
    pick = random.Random(seed)
    rows = [(pick.choice([None, 1, 1, 2, 3]), pick.choice(["a", "a", None]), pick.choice(["x", "y", "z", None]), -7, -8, {"k": 1}) for _ in range(120)]
    rows += [(2, "a", "x", -7, -8, {"k": 1})] * 60
    return spark.createDataFrame(rows, "k int, tie string, value string, position int, _first int, m map<string,int>").repartition(4)


def test_tied_rows_meet_each_place_once(spark, monkeypatch):
    monkeypatch.setattr(selection, "_PLACES", 7)
    df, order = tied_frame(spark), ("k", "tie")

    def plain(rows):
        return Counter((r.k, r.tie, r.value, r._first, str(r.m)) for r in rows)

    places = spark.range(200).select("id")
    by_place = {r.position: r for r in selection.rows_at(df, places, order).collect()}
    assert sorted(by_place) == list(range(180)) and plain(by_place.values()) == plain(df.collect())
    keys = [(by_place[i].k, by_place[i].tie) for i in range(180)]
    assert keys == sorted(keys, key=lambda k: (k[0] is not None, k[0] or 0, k[1] is not None, k[1] or ""))
    for asked in ([0], [5, 6, 60], [0, 179, 500], list(range(180))):
        deep, shallow = (selection.rows_at(df, asked, order, shallow=s).collect() for s in (0, 10_000))
        assert sorted(r.position for r in deep) == sorted(r.position for r in shallow) == [i for i in asked if i < 180]
        assert all(plain([r]) == plain([by_place[r.position]]) for r in [*deep, *shallow])
    for number in (1, 3, 18, 19):
        deep, shallow = (selection.page(df, number, 10, order, shallow=s).collect() for s in (0, 10_000))
        assert plain(deep) == plain(shallow) == plain(by_place[i] for i in range(number * 10 - 10, min(180, number * 10)))
        assert all(r.position == -7 for r in [*deep, *shallow])
    four = spark.createDataFrame([(1,), (1,), (1,), (2,)], "v int")
    assert [selection.page(four, 1, 4, ["v"], shallow=s).count() for s in (0, 10_000)] == [4, 4]
    assert [selection.rows_at(four, [0], ["v"], shallow=s).count() for s in (0, 10_000)] == [1, 1]


@pytest.mark.parametrize("shallow", [0, 10_000])
def test_working_set_counts_only_places_that_exist(timed, shallow):
    for chosen, minimum, want in (([99, 1], 3, [0, 1, 2]), ([4, 2], 1, [2, 4]), ([98, 99], 2, [0, 1]), ([0, 50], 9, [0, 1, 2, 3, 4]), ([-3, 2], 2, [0, 2])):
        found = selection.working_set(timed, chosen, minimum, shallow=shallow)
        assert sorted(r.position for r in found.collect()) == want
        assert set(found.columns) == {*timed.columns, "position"}


def test_detail(timed):
    rows = {r.title: r for r in selection.detail(timed).collect()}
    assert rows["2001-05-01 10:00 — Hello World"].body == "x"
    assert rows["2001-05-03 09:00 — (no subject)"].body == "_No content available_"
    assert rows["2001-05-03 23:59 — hello again."].body == "_No content available_"
    assert rows["2001-05-03 09:00 — Boss bosses x 42"]["from"] == ""
    assert "to" not in selection.detail(timed).columns
    content = selection.detail(timed.drop("Body").withColumn("Content", F.lit("c")).withColumn("To", F.lit("t")))
    assert {(r.body, r.to) for r in content.collect()} == {("c", "t")}
