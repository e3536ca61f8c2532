import pytest
from pyspark.sql import functions as F

from postmill.operators import quality
from postmill.plans.corpus import cleaned_records, process_records
from postmill.schema import RECORD, RECORD_FIELDS, SKIP


def record(**values):
    names = {n.replace("-", "_"): n for n in RECORD_FIELDS}
    row = dict.fromkeys(RECORD_FIELDS, "")
    row.update({names[k]: v for k, v in values.items()})
    return tuple(row[n] for n in RECORD_FIELDS)


@pytest.fixture()
def records(spark):
    rows = [
        record(Message_ID="1", Subject="s", Body="> b", Date="4 May 2001 01:02:03", From="A <a@b>", X_From="A <a@b>"),
        record(Message_ID="2", Subject=" ", Body="", From="C <c@d>"),
        record(Message_ID="3", Subject="only", Body="", Date="5 May 2001 01:02:03"),
        record(Message_ID="4", Subject="", Body=" \t"),
        record(Message_ID="5", Subject="s", Body=" \t"),
        record(Message_ID=None, Subject=None, Body=None, From=None),
    ]
    return spark.createDataFrame(rows, RECORD).withColumn("email_number", F.monotonically_increasing_id() + 1)


def routes(df):
    return {r["Message-ID"]: r.route for r in df.collect()}


def test_routes(records):
    assert routes(quality.with_route(records)) == {
        "1": "cleaned", "2": "validation", "3": "processing_error", "4": "validation", "5": "cleaned", None: "validation"
    }
    assert routes(quality.with_route(records, "keep"))["3"] == "cleaned"
    with pytest.raises(ValueError):
        quality.with_route(records, "other")


def test_validation_errors(records):
    got = {r["Message-ID"]: r.validation_errors for r in quality.validation_errors(records).collect()}
    assert got["1"] == [] and got["3"] == [] and got["2"] == ["Both subject and body are empty"]


def test_skip_report(records):
    skips = quality.skipped_report(quality.with_route(records))
    assert [(f.name, f.dataType) for f in skips.schema] == [(f.name, f.dataType) for f in SKIP.fields]
    rows = {r.message_id: r for r in skips.collect()}
    assert set(rows) == {"2", "3", "4", "Unknown"}
    assert rows["2"].subject == "[EMPTY]" and rows["2"]["from"] == "C <c@d>"
    assert rows["2"].skip_reason == "Validation failed: Both subject and body are empty"
    assert rows["3"].skip_reason == "Processing error: not enough values to unpack (expected 5, got 0)"
    assert rows["3"].validation_errors is None and rows["3"].has_subject and rows["3"].subject_length == 4
    assert rows["3"].date == "5 May 2001 01:02:03"
    assert rows["Unknown"]["from"] == "Unknown" and rows["Unknown"].source_file == ""
    counts = {(r.skip_stage, r.emails) for r in quality.skips_by_reason(skips).collect()}
    assert counts == {("validation", 3), ("processing_error", 1)}
    detail = {r.message_id: r for r in quality.skip_details(skips).collect()}
    assert detail["3"].skip_stage == "PROCESSING_ERROR" and detail["3"].validation_errors is None
    assert detail["2"].has_body == "false" and detail["2"].body_length == "0"


def test_summary(records):
    summary = quality.run_summary(quality.with_route(records)).first().asDict()
    assert summary == {
        "total": 6, "processed": 2, "skipped": 4, "skipped_at_validation": 3, "skipped_on_error": 1, "success_rate": 33.33
    }
    empty = quality.run_summary(quality.with_route(records.limit(0))).first()
    assert empty.total == 0 and empty.success_rate is None


def test_cleaned_records(records):
    rows = {r["Message-ID"]: r for r in cleaned_records(records).collect()}
    assert set(rows) == {"1", "5"}
    assert rows["1"].Body == "b" and rows["5"].Body == ""
    assert rows["1"].Date == "04.05.2001 01:02:03" and rows["1"].From == "A a@b" and rows["1"]["X-From"] == "A <a@b>"
    assert "email_number" in rows["1"]
    kept = {r["Message-ID"]: r.Body for r in cleaned_records(records, "keep").collect()}
    assert kept == {"1": "b", "3": "", "5": ""}


def test_processing_leaves_skipped_records_alone(records):
    rows = {r["Message-ID"]: r for r in process_records(records).collect()}
    assert rows["3"].Date == "5 May 2001 01:02:03" and rows["3"].audit is None
    assert rows["2"].From == "C <c@d>" and rows["1"].audit.final_length == 1
    assert rows["5"].audit.cleaning_steps and rows["5"].Body == ""
    assert len(rows) == 6
