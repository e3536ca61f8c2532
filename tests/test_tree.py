"""Listing and reading by executors, and what a run leaves behind."""

import os

import pytest
from pyspark.sql import functions as F

from postmill.operators.ordering import with_position
from postmill.plans.corpus import corpus_to_records, run_cleaning
from postmill.session import remove, run_scope, shared_dir
from postmill.sources import tree
from postmill.sources.files import list_files, scan_corpus

MAIL = "Message-ID: <{0}>\nFrom: a@x\nSubject: S {0}\n\nbody {0}\n"


@pytest.fixture()
def corpus(tmp_path):
    root = tmp_path / "corpus"
    files = {"1": MAIL.format(1).encode(), "in/2.txt": b"Subject: \xff\xc3\xbc\r\n\r\nx", "in/3": b"", "in/deep/er/4.": MAIL.format(4).encode(),
             "in/no.csv": b"no", ".hidden": b"h", "_d/5": b"h", "in/x+y %41": b"A: b\n\np", "in/big": b"z" * 5000}
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    for i in range(30):
        (root / f"many/d{i % 3}").mkdir(parents=True, exist_ok=True)
        (root / f"many/d{i % 3}/{i}.txt").write_text(MAIL.format(100 + i))
    (root / "empty/of/files").mkdir(parents=True)
    os.symlink(root / "nowhere", root / "in/gone")
    os.symlink(root, root / "in/loop")
    return str(root)


def short(path):
    return path.split("/corpus/")[1]


def test_every_level_is_listed(spark, corpus):
    found = {short(r.path): (r.length, r.problem) for r in tree.list_tree(spark, corpus).collect()}
    assert found["in/big"] == (5000, None) and found["in/3"] == (0, None) and found[".hidden"] == (1, None)
    assert found["in/gone"][0] is None and "No such file" in found["in/gone"][1]
    assert len(found) == 40 and "in/loop" not in found
    remove(spark, f"{corpus}/in/gone")
    driver = {(r.path, r.length) for r in list_files(spark, f"{corpus}/many").collect()}
    assert driver == {(r.path, r.length) for r in tree.list_tree(spark, f"file:{corpus}/many/").collect()}
    problems = [r.problem for r in tree.list_tree(spark, f"{corpus}/none").collect()]
    assert len(problems) == 1 and "No such file" in problems[0]


@pytest.mark.parametrize("eligible", [True, False])
def test_ingest_keeps_the_reason_of_each_failure(spark, corpus, tmp_path, eligible, monkeypatch):
    monkeypatch.setattr(tree, "TASK_FILES", 7)
    scan = tree.ingest(spark, corpus, str(tmp_path / f"out{eligible}"), eligible, largest=4000)
    files = {short(r.path): r for r in scan.files.collect()}
    rejects = {short(r.path): (r.length, r.reason) for r in scan.rejects.collect()}
    assert files["in/2.txt"].text == "Subject: ü\n\nx" and files["in/3"].text == "" and files["in/x+y %41"].file_name == "x+y %41"
    no_mail = {"in/no.csv", "in/deep/er/4."}
    assert len(files) == 34 + 2 * (not eligible) and bool(no_mail & set(files)) != eligible
    assert rejects["in/big"] == (5000, "too large") and rejects["_d/5"][1] == "hidden name"
    assert rejects["in/gone"][1].startswith("unreadable: ") and "No such file" in rejects["in/gone"][1]
    listing = {short(r.path) for r in scan.listing.collect()}
    assert set(files) | set(rejects) | (no_mail if eligible else set()) == listing
    assert scan.files.filter(F.col("hash") != F.md5("text")).isEmpty()
    assert corpus_to_records(scan.files).count() >= 30


def test_a_file_that_goes_between_listing_and_reading_is_a_reject(spark, corpus):
    listing = tree.list_tree(spark, f"{corpus}/many")
    os.remove(f"{corpus}/many/d0/0.txt")
    os.remove(f"{corpus}/many/d1/1.txt")
    os.mkdir(f"{corpus}/many/d1/1.txt")
    rows = {short(r.path): r for r in tree.read_listed(listing).collect()}
    bad = {name for name, r in rows.items() if r.problem}
    assert bad == {"many/d0/0.txt", "many/d1/1.txt"} and len(rows) == 30
    assert all(r.content is None for r in rows.values() if r.problem) and bytes(rows["many/d2/2.txt"].content).startswith(b"Message-ID: <102>")


def test_ingest_agrees_with_the_lazy_scan(spark, corpus, tmp_path):
    os.remove(f"{corpus}/in/gone")
    lazy, whole = scan_corpus(spark, f"{corpus}/many"), tree.ingest(spark, f"{corpus}/many", str(tmp_path / "o"))
    columns = ["path", "file_name", "text"]
    assert sorted(map(tuple, lazy.files.select(columns).collect())) == sorted(map(tuple, whole.files.select(columns).collect()))
    assert not tree.opens("viewfs://store/in")
    with pytest.raises(ValueError):
        tree.ingest(spark, "viewfs://store/in", str(tmp_path / "x"))


def test_a_run_leaves_nothing_but_its_outputs(spark, corpus, tmp_path):
    outer = shared_dir(spark)
    before = set(os.listdir(outer))
    with run_scope(spark) as folder:
        assert shared_dir(spark) == folder
        scan = tree.ingest(spark, corpus, str(tmp_path / "files"))
        records = corpus_to_records(scan.files, number="email_number")
        run_cleaning(records, str(tmp_path / "clean"))
        with run_scope(spark) as inner:
            assert inner.startswith(folder) and with_position(scan.files.select("path"), ["path"], "n").count() == 35
        assert os.path.isdir(folder) and not os.path.isdir(inner)
    assert shared_dir(spark) == outer and set(os.listdir(outer)) == before
    assert spark.read.parquet(str(tmp_path / "clean/records")).count() > 0
    with pytest.raises(RuntimeError), run_scope(spark) as folder:
        with_position(spark.range(3), ["id"], "n").count()
        raise RuntimeError
    assert set(os.listdir(outer)) == before
