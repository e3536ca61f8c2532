"""Runs that stop half-way never show, and runs done twice are the same run."""

import json
import os

import pytest
from pyspark.sql import functions as F

from postmill.plans import committed
from postmill.schema import RECORD


def records(spark, subjects):
    rows = [tuple({"Subject": s, "Body": f"> body {s}" if s else "", "Message-ID": str(i)}.get(f.name, "") for f in RECORD.fields) for i, s in enumerate(subjects)]
    return spark.createDataFrame(rows, RECORD).withColumn("email_number", F.col("`Message-ID`").cast("bigint"))


def subjects(run):
    return sorted(r.Subject for r in run.tables.cleaned.collect())


def test_readers_see_whole_runs_only(spark, tmp_path, monkeypatch):
    place = str(tmp_path / "out")
    assert committed.current_run(spark, place) is None
    first = committed.commit_run(records(spark, ["a", "b", ""]), place, "one")
    assert subjects(first) == ["a", "b"] and first.manifest["counts"]["total"] == 3 and first.manifest["counts"]["report"] == 1
    assert subjects(committed.current_run(spark, place)) == ["a", "b"]

    # The run stops when its tables are there but nothing vouches for them.
    with monkeypatch.context() as patched:
        patched.setattr(committed, "counted", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            committed.commit_run(records(spark, ["c"]), place, "two")
    assert os.path.isdir(f"{place}/runs/two/tables/records") and not os.path.exists(f"{place}/runs/two/manifest.json")
    assert subjects(committed.current_run(spark, place)) == ["a", "b"]

    # It stops between the manifest and the pointer.
    swap = committed.swap_small

    def stopping(spark, path, value):
        if path.endswith("current.json"):
            raise RuntimeError("stopped")
        swap(spark, path, value)

    with monkeypatch.context() as patched:
        patched.setattr(committed, "swap_small", stopping)
        with pytest.raises(RuntimeError):
            committed.commit_run(records(spark, ["c", "d"]), place, "two")
    assert subjects(committed.current_run(spark, place)) == ["a", "b"]

    # Done again, it is whole; its tables are those of the attempt that was whole.
    with monkeypatch.context() as patched:
        patched.setattr(committed, "run_cleaning", lambda *_: pytest.fail("cleaned twice"))
        again = committed.commit_run(records(spark, ["c", "d"]), place, "two")
    assert subjects(again) == subjects(committed.current_run(spark, place)) == ["c", "d"]
    assert json.load(open(f"{place}/current.json")) == {"run": "two"}

    with pytest.raises(ValueError):
        committed.drop_run(spark, place, "two")
    committed.drop_run(spark, place, "one")
    assert not os.path.exists(f"{place}/runs/one") and subjects(committed.current_run(spark, place)) == ["c", "d"]
    with pytest.raises(ValueError):
        committed.commit_run(records(spark, []), place, "../three")


def test_an_empty_run_and_counts_that_differ(spark, tmp_path):
    place = str(tmp_path / "out")
    run = committed.commit_run(records(spark, ["x"]).filter(F.lit(False)), place, "none")
    assert run.manifest["counts"]["total"] == 0 and run.tables.cleaned.isEmpty()
    tables = committed.commit_run(records(spark, ["a", ""]), place, "some").tables
    with pytest.raises(RuntimeError):
        committed.counted(tables, tables.skipped.limit(0))
