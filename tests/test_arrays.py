"""JSON arrays cut into byte ranges: nothing is lost at a cut, and what is broken comes back as a reject."""

import json
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from postmill.schema import RECORD, RECORD_FIELDS
from postmill.session import run_scope
from postmill.sources import arrays
from postmill.sources.records import read_json
from workload.queries import array_rejects

NESTED = "Subject string, Body string, inner struct<a:string, list:array<struct<b:int>>>"


@pytest.fixture()
def small_splits(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0b")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def records_of(count, seed=1):
    pick = random.Random(seed)
    bits = ["}", "{", '"', "\\", '\\"', "},{", "]", "[", "ü", "日本", "\n", "\t", "text ", "{}{}", "}\\", " ", ""]
    return [
        {
            "Subject": "".join(pick.choice(bits) for _ in range(pick.randint(0, 12))),
            "Body": pick.choice([None, "".join(pick.choice(bits) for _ in range(pick.randint(0, 120)))]),
            "inner": pick.choice([None, {"a": pick.choice(bits), "list": [{"b": i} for i in range(pick.randint(0, 4))]}]),
        }
        for i in range(count)
    ]


def canonical(rows):
    return Counter(json.dumps(r.asDict(True) if hasattr(r, "asDict") else r, sort_keys=True) for r in rows)


@pytest.mark.parametrize("form", [{"indent": 2, "ensure_ascii": False}, {"separators": (",", ":")}, {}])
def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits, form):
    rows = records_of(120)
    (tmp_path / "a.json").write_text(json.dumps(rows, **form))
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(NESTED)
    good, bad = arrays.read_json_array(spark, str(tmp_path / "a.json"), schema, number="n")
    assert spark.read.text(str(tmp_path / "a.json"), lineSep="}").rdd.getNumPartitions() > 8
    assert bad.collect() == []
    found = sorted(good.collect(), key=lambda r: r.n)
    assert [r.n for r in found] == list(range(1, 121))
    assert [json.loads(json.dumps({k: v for k, v in r.asDict(True).items() if k != "n"})) for r in found] == rows
    whole = read_json(spark, str(tmp_path / "a.json"), schema=schema)
    assert canonical(whole.collect()) == canonical(good.drop("n").collect())


def test_several_files_and_broken_ones(spark, tmp_path, small_splits):
    texts = {
        "good": '[{"Subject": "1"}, {"Subject": "2"}]\n', "none": " [ ] ", "cut": '[{"Subject": "3"}, {"Subject": "4", "Bo', "open": '[{"Subject": "5"}, {"Subject": "6"}',
        "brace": '[{"Subject": "7"}}, {"Subject": "8"}]', "comma": '[{"Subject": "9"} {"Subject": "10"}]', "value": '[1, {"Subject": "11"}]', "word": '[{"Subject": oops}, {"Subject": "12"}]',
        "plain": "no json", "quote": '[{"Subject": "13"}, {"Subject": "14}, {"Subject": "15"}]', "behind": '[{"Subject": "16"}] x',
    }
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        (tmp_path / "in" / name).write_text(text)
    (tmp_path / "in" / "blank").write_text("")
    good, bad = arrays.read_json_array(spark, str(tmp_path / "in"), RECORD)
    assert good.columns == list(RECORD_FIELDS)
    rejects = {(r.path.rsplit("/", 1)[1], r.text) for r in bad.collect()}
    assert {r.Subject for r in good.collect()} == {"1", "2", "3", "5", "7", "9", "12", "13", "16"}
    assert rejects == {
        ("cut", ', {"Subject": "4", "Bo'), ("open", ', {"Subject": "6"'), ("brace", ""), ("comma", ' {"Subject": "10"}'), ("value", '[1, {"Subject": "11"}'),
        ("word", '[{"Subject": oops}'), ("plain", "no json"), ("quote", ', {"Subject": "14'), ("behind", "] x"),
    }


def test_round_trip_as_arrays(spark, tmp_path):
    df = spark.createDataFrame([(f"s{i}", None if i % 3 else '}"{', i) for i in range(50)], "Subject string, Body string, n int").repartition(4)
    arrays.write_json_array(df, str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("part=*/*.txt"))
    assert len(files) == 4 and sum(len(json.loads(f.read_text())) for f in files) == 50
    assert all(set(r) == {"Subject", "Body", "n"} for f in files for r in json.loads(f.read_text()))
    good, bad = arrays.read_json_array(spark, str(tmp_path / "out"), df.schema)
    assert bad.isEmpty() and canonical(good.collect()) == canonical(df.collect())
    arrays.write_json_array(df.filter(F.lit(False)), str(tmp_path / "none"))
    assert not list((tmp_path / "none").glob("part=*"))


def test_records_over_many_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrays, "CHUNK", 40)
    from pyspark.sql.types import StructType

    rows = records_of(150, seed=2) + [{"Subject": "long", "Body": "{}\\}\"" * 200, "inner": {"a": "}", "list": [{"b": i} for i in range(300)]}}]
    texts = {"whole": json.dumps(rows + rows[:3]), "cut": json.dumps(rows)[:-40], "quote": json.dumps(rows[:9])[:-1] + ', {"Subject": "x}' + ' {"a": 1},' * 90}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    good, bad = arrays.read_json_array(spark, str(tmp_path), StructType.fromDDL(NESTED), number="n")
    found = Counter((r.n, json.dumps({k: v for k, v in r.asDict(True).items() if k != "n"}, sort_keys=True)) for r in good.collect())
    lists = [rows + rows[:3], rows[:-1], rows[:9]]
    assert found == Counter((i + 1, json.dumps(r, sort_keys=True)) for part in lists for i, r in enumerate(part))
    rejects = {r.path.rsplit("/", 1)[1]: r.text for r in bad.collect()}
    assert rejects.keys() == {"cut", "quote"} and rejects["quote"] == ', {"Subject": "x' and rejects["cut"].startswith(', {"Subject": "long"')


def folder_sizes(folder):
    return {place.name: sum(f.stat().st_size for f in place.rglob("*") if f.is_file()) for place in Path(folder.removeprefix("file:")).iterdir()}


def test_texts_are_written_once_on_the_way(spark, tmp_path):
    pick = random.Random(3)
    rows = [(f"s{i}", "".join(pick.choice("abcdefgh ") for _ in range(20_000))) for i in range(60)]
    df = spark.createDataFrame(rows, "Subject string, Body string").repartition(3)
    with run_scope(spark) as folder:
        arrays.write_json_array(df, str(tmp_path / "out"))
        good, bad = arrays.read_json_array(spark, str(tmp_path / "out"), df.schema)
        assert bad.isEmpty() and canonical(good.collect()) == canonical(df.collect())
        sizes = folder_sizes(folder)
    chunks = sum(n for name, n in sizes.items() if name.startswith("chunks-"))
    assert sum(sizes.values()) - chunks < chunks / 5


def test_rejects_are_written_by_many_tasks(spark, tmp_path):
    docs = spark.range(0, 40, 1, 4).selectExpr("id AS doc_id", "IF(id = 7, NULL, concat('te\"}xt ', id)) AS text")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    held = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")
    try:
        with run_scope(spark) as folder:
            found = Counter(tuple(r) for r in array_rejects(spark, str(tmp_path)).collect())
            written = list(Path(folder.removeprefix("file:")).glob("broken-*/**/*.txt"))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", held)
    assert len(written) == 4
    wanted = [("reject", f'{{"Subject": {i} oops}}') if i % 10 == 0 else ("record", None if i == 7 else f'te"}}xt {i}') for i in range(40)]
    assert found == Counter(wanted)
    docs.filter("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert array_rejects(spark, str(tmp_path / "none")).collect() == []
