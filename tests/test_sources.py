import json

import pytest
from pyspark.sql import functions as F

from postmill.plans.corpus import corpus_to_records, process_records, run_cleaning
from postmill.operators.dedup import fingerprints, removed_files
from postmill.schema import RECORD, RECORD_FIELDS
from postmill.sources import records as R
from postmill.sources.files import compact, scan_corpus, scan_files, unread_files
from postmill.sources.sinks import report_path, write_records, write_removals, write_skips

MAIL = "Message-ID: <{0}>\nDate: Mon, 14 May 2001 16:39:00 -0700 (PDT)\nFrom: A <a@x>\nTo: b@x;c@x\nSubject: S {0}\n\n> body {0}\n"


@pytest.fixture()
def corpus(tmp_path):
    files = {
        "in/1": MAIL.format(1).encode(), "in/2.": MAIL.format(2).encode(), "in/10.txt": MAIL.format(10).encode(),
        "sent/a. 12": MAIL.format(12).replace("\n", "\r\n").encode(), "sent/b.TXT": b"\xffSubject: \xc3\xbc\n\nx\xc3",
        "sent/c.csv": b"no mail", "sent/deep/1": MAIL.format(1).encode(), "sent/deep/3.txt": MAIL.format(1).encode(),
        "sent/4": b"Subject: only\n\n", "sent/5": b"\n", "sent/x+y %41": b"Subject: p\n\np",
    }
    for name, content in files.items():
        path = tmp_path / "corpus" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(tmp_path / "corpus")


def test_scan(spark, corpus):
    everything = {r.file_name for r in scan_files(spark, corpus, eligible_only=False).collect()}
    assert everything == {"1", "2.", "10.txt", "a. 12", "b.TXT", "c.csv", "3.txt", "4", "5", "x+y %41"}
    found = {r.path.split("/corpus/")[1]: r.text for r in scan_files(spark, corpus).collect()}
    assert set(found) == {"in/1", "in/10.txt", "sent/a. 12", "sent/b.TXT", "sent/deep/1", "sent/deep/3.txt", "sent/4", "sent/5", "sent/x+y %41"}
    assert found["sent/b.TXT"] == "Subject: ü\n\nx"
    assert "\r" not in found["sent/a. 12"] and found["sent/a. 12"] == MAIL.format(12)


def test_files_and_rejects_are_the_listing(spark, tmp_path):
    root = tmp_path / "all"
    for name, content in {"1": b"A: 1\n\nx", "2": b"", "_3": b"h", "d/.4": b"h", "_d/5": b"h", "d/6": b"y" * 5000, "d/7.csv": b"z", "8 +%41": b""}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)

    def short(path):
        return path.split("/all/")[1]

    for eligible in (False, True):
        scan = scan_corpus(spark, str(root), eligible_only=eligible, largest=4000)
        files = {short(r.path): (r.file_name, r.text) for r in scan.files.collect()}
        rejects = {short(r.path): (r.length, r.reason) for r in scan.rejects.collect()}
        listing = {short(r.path) for r in scan.listing.collect()}
        assert len(listing) == 8 and listing >= set(files) | set(rejects) and not set(files) & set(rejects)
        assert files["2"] == ("2", "") and files["8 +%41"] == ("8 +%41", "") and files["1"][1] == "A: 1\n\nx"
        assert rejects["_3"] == (1, "hidden name") and rejects["d/6"] == (5000, "too large") and "_d/5" in rejects
        if not eligible:
            assert set(files) | set(rejects) == listing
        written = compact(scan.files, str(tmp_path / f"table{eligible}"))
        assert unread_files(scan, written, eligible).isEmpty()
        lost = unread_files(scan, written.filter("file_name <> '1'"), eligible).collect()
        assert [(short(r.path), r.reason) for r in lost] == [("1", "unreadable")]
    # The two empty files are copies of each other, and one of them is a record.
    assert corpus_to_records(scan_corpus(spark, str(root), largest=4000).files).count() == 2


def test_malformed_json_is_loud_or_listed(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('[{"Subject": "a", "Content": "c", "n": 1}, {"Body": "b"}]')
    bad.write_text('[{"Subject": "x"}, {"Body": ')
    kept = R.read_json(spark, str(good), extra=True)
    assert kept.columns == [*RECORD_FIELDS, "Content", "n"]
    assert sorted((r.Subject, r.Content, r.n) for r in kept.collect() if r.Subject) == [("a", "c", 1)]
    with pytest.raises(Exception):
        R.read_json(spark, str(bad)).collect()
    records, rejects = R.read_json_with_rejects(spark, [str(good), str(bad)])
    assert records.columns == list(RECORD_FIELDS) and {r.Subject for r in records.collect()} == {"a", None}
    assert [r.path.endswith("bad.json") for r in rejects.collect()] == [True]


def test_names_are_tested_before_contents_are_read(spark, corpus):
    plan = scan_files(spark, corpus).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_compact_keeps_a_hash(spark, corpus, tmp_path):
    table = compact(scan_files(spark, corpus), str(tmp_path / "table"))
    plan = fingerprints(table)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,hash:string>" in plan
    assert table.filter(F.col("hash") != F.md5("text")).isEmpty()


def test_corpus_to_clean_records(spark, corpus, tmp_path):
    files = compact(scan_files(spark, corpus), str(tmp_path / "table"))
    records = corpus_to_records(files)
    # deep/1 and deep/3 repeat the content of in/1, and the blank file stays.
    assert {r.SourceFile for r in records.collect()} == {"1.txt", "10.txt", "a. 12.txt", "b.TXT", "4.txt", "5.txt", "x+y %41.txt"}
    unmerged = corpus_to_records(files, rename=False, dedup=False, collapse=False)
    assert sorted(r.SourceFile for r in unmerged.collect()) == ["1", "1", "10.txt", "3.txt", "4", "5", "a. 12", "b.TXT", "x+y %41"]
    plain = corpus_to_records(files, rename=False, dedup=False, collapse=False, number="n")
    assert sorted(r.n for r in plain.collect()) == list(range(1, 10))
    last = corpus_to_records(files, rename=False, dedup=False).filter("SourceFile = '1'").collect()
    assert len(last) == 1 and last[0].path.endswith("sent/deep/1")

    numbered = corpus_to_records(files, number="email_number")
    order = [r.SourceFile for r in numbered.orderBy("email_number").collect()]
    assert order == ["1.txt", "4.txt", "5.txt", "10.txt", "a. 12.txt", "b.TXT", "x+y %41.txt"]

    run = run_cleaning(numbered, str(tmp_path / "out"), json_export=True)
    assert run.summary.first().asDict() == {
        "total": 7, "processed": 5, "skipped": 2, "skipped_at_validation": 1, "skipped_on_error": 1, "success_rate": 71.43
    }
    cleaned = {r.SourceFile: r for r in run.cleaned.collect()}
    assert cleaned["1.txt"].Body == "body 1" and cleaned["1.txt"].Date == "14.05.2001 16:39:00"
    assert cleaned["1.txt"].From == "A a@x" and cleaned["1.txt"].To == "b@x, c@x"
    assert {r.source_file: r.email_number for r in run.skipped.collect()} == {"4.txt": 2, "5.txt": 3}
    report = spark.read.json(report_path(str(tmp_path / "out")))
    assert report.count() == 2
    exported = R.read_json(spark, str(tmp_path / "out/json"), array=False)
    assert exported.columns == list(RECORD_FIELDS) and exported.count() == 5


def test_a_new_name_does_not_replace_a_file(spark):
    files = spark.createDataFrame([("/a/1", "A: 1\n\nx"), ("/a/1.txt", "A: 1\n\ny"), ("/b/1", "A: 1\n\nx")], "path string, text string")
    both = corpus_to_records(files, collapse=False, number="n").orderBy("n").collect()
    assert [(r.n, r.path, r.SourceFile, r.Body) for r in both] == [(1, "/a/1", "1.txt", "x"), (2, "/a/1.txt", "1.txt", "y")]
    assert [r.path for r in corpus_to_records(files).collect()] == ["/a/1.txt"]


def test_empty_corpus(spark, tmp_path):
    none = spark.createDataFrame([], "path string, text string")
    run = run_cleaning(corpus_to_records(none, number="email_number"), str(tmp_path / "out"))
    assert run.summary.first().total == 0 and run.cleaned.isEmpty() and run.skipped.isEmpty()


def test_json_array_and_order_of_fields(spark, tmp_path):
    path = tmp_path / "refined.json"
    path.write_text(json.dumps([{"Subject": "ü", "Date": "d"}, {"Body": "b", "X-cc": None}], indent=2, ensure_ascii=False))
    df = R.read_json(spark, str(path))
    assert df.columns == list(RECORD_FIELDS) and df.count() == 2
    assert {r.Subject for r in df.collect()} == {"ü", None}
    (tmp_path / "empty.json").write_text("[]")
    with pytest.raises(ValueError):
        R.require_rows(R.read_json(spark, str(tmp_path / "empty.json")))


def test_flatten(spark, tmp_path):
    path = tmp_path / "nested.json"
    path.write_text('[{"a": 1, "b": {"c": {"d.e": 2}, "f": [{"g": 1}]}}, {"a": 2}]')
    df = R.flatten(R.read_json(spark, str(path), schema=None))
    assert df.columns == ["a", "b.c.d.e", "b.f"]
    assert sorted(tuple(r)[:2] for r in df.collect()) == [(1, 2), (2, None)]


def test_column_checks(spark):
    df = spark.createDataFrame([], RECORD)
    assert R.missing_columns(df) == [] and R.require_columns(df) is df
    assert R.record_keys(df) == list(RECORD_FIELDS)
    with pytest.raises(ValueError, match="X-To"):
        R.require_columns(df.drop("X-To"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("ü", "b")], "Subject string, Body string")
    for form in ("parquet", "json"):
        write_records(df, str(tmp_path / form), form)
        assert spark.read.format(form).load(str(tmp_path / form)).select("Subject", "Body").collect() == df.collect()
    with pytest.raises(ValueError):
        write_records(df, str(tmp_path / "x"), "csv")
    assert "ü" in "".join(p.read_text() for p in (tmp_path / "json").glob("*.json"))
    assert write_skips(df, str(tmp_path / "skips")) and (tmp_path / "skips").exists()
    assert not write_skips(df.limit(0), str(tmp_path / "skips"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "skips")).isEmpty()
    assert report_path("a/clean.json") == "a/clean_skipped_report.json"
    files = spark.createDataFrame([("/1.txt", "x"), ("/2.txt", "x")], "path string, text string")
    write_removals(removed_files(fingerprints(files)), str(tmp_path / "log"))
    assert [r.value for r in spark.read.text(str(tmp_path / "log")).collect()] == ["Deleted duplicate file: /2.txt"]
    write_removals(removed_files(fingerprints(files.limit(0))), str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 0


def test_one_narrow_stage(spark):
    df = spark.createDataFrame([], RECORD)
    plan = process_records(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
