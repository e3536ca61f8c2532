"""Every registered query: ``name -> (spark, sf_dir) -> DataFrame``.

Days and timestamps are shown as strings and step lists as joined text, so that results compare by value.
"""

from __future__ import annotations

from datetime import date
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import body as B
from postmill.functions.fields import clean_addresses, european_date
from postmill.functions.names import base_name, is_mail_file, txt_name
from postmill.functions.text import lenient_utf8
from postmill.operators import dedup, quality, selection, timeline, values, vocabulary
from postmill.operators.clean import clean_text, clean_text_audited
from postmill.operators.ordering import spread, with_position
from postmill.operators.parse import parse_messages
from postmill.plans import committed
from postmill.plans.corpus import corpus_to_records, natural_order, process_records, run_cleaning
from postmill.schema import HEADER_FIELDS, RECORD, RECORD_FIELDS, SKIP, quoted
from postmill.session import shared_dir
from postmill.sources import tree
from postmill.sources.arrays import read_json_array, write_array_lines, write_json_array
from postmill.sources.files import HIDDEN, compact, is_hidden
from postmill.sources.records import flatten, read_json, read_json_with_rejects, record_keys, require_columns, require_rows
from postmill.sources.sinks import report_path, write_records, write_removals
from workload.tables import board, document_files, mail, mail_numbers, raw_messages, table

SENDER = "User 46 u46@click.example.com"
SENDERS = (SENDER, "User 8 u8@error.example.com", "User 1 u1@view.example.com")
FROM_DAY, TO_DAY = date(2024, 1, 1), date(2024, 1, 2)
KEYWORD = "ER|on"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"), "doc_id")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "pages"), "page_id")


def _shown_time(df: DataFrame) -> DataFrame:
    return df.withColumn("DateTime", F.date_format("DateTime", "yyyy-MM-dd HH:mm:ss"))


def _timed(spark: SparkSession, d: str) -> DataFrame:
    return timeline.with_time(board(spark, d))


# --- value counts and words -------------------------------------------------------------------------------------


def top_senders(spark, d):
    return values.top_values(board(spark, d), "From", 10, "email_count").withColumnRenamed("From", "sender")


def subject_word_freq(spark, d):
    return vocabulary.top_words(board(spark, d), "Subject")


def conversation_word_freq(spark, d):
    return vocabulary.top_words(table(spark, d, "conversations"), "text")


def document_words(spark, d):
    return vocabulary.word_counts(_documents(spark, d), "text")


def word_cloud_weights(spark, d):
    return vocabulary.cloud_weights(board(spark, d), "Subject", pairs=False)


def word_cloud_pairs(spark, d):
    return vocabulary.cloud_weights(table(spark, d, "conversations"), "text").select("word", "frequency")


def sender_domain(spark, d):
    return values.distinct_values(values.mail_list(board(spark, d)), "Sender")


def recipient_domain_placeholder(spark, d):
    df = board(spark, d).withColumn("To", F.nullif(F.col("To"), F.lit("")))
    return values.distinct_values(df, "To", "(unknown)")


def sender_filter(spark, d):
    return values.equal_to(values.mail_list(require_columns(board(spark, d))), "Sender", SENDER)


def sender_filter_count(spark, d):
    return values.row_count(values.equal_to(values.mail_list(board(spark, d)), "Sender", SENDER))


def mail_list_all(spark, d):
    return values.equal_to(values.mail_list(board(spark, d)), "Sender", values.ALL)


def full_view(spark, d):
    return board(spark, d).drop("doc_id")


# --- timeline ---------------------------------------------------------------------------------------------------


def date_parse(spark, d):
    return _shown_time(timeline.in_time_order(_timed(spark, d)).select("Message-ID", "DateTime"))


def date_inferred(spark, d):
    """The raw date header: its first value decides in which form all are read."""
    found = timeline.with_inferred_time(mail(spark, d), "Date", ("doc_id",))
    return _shown_time(found.select("doc_id", "DateTime"))


def date_inferred_mixed(spark, d):
    """A column of several forms, read day first or month first as its first readable value has it."""
    day = F.col("o_orderdate")
    forms = [F.lit("unknown"), F.date_format(day, "dd/MM/yyyy"), F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "MM/dd/yyyy")]
    text = F.element_at(F.array(*forms), (F.col("o_orderkey") % 4 + 1).cast("int"))
    orders = table(spark, d, "orders").select("o_orderkey", text.alias("order_date"))
    return _shown_time(timeline.with_inferred_time(orders, order=("o_orderkey",)).select("o_orderkey", "DateTime"))


def subject_pattern_search(spark, d):
    """Python's word class, which takes in the superscript and leaves out combining marks."""
    df = board(spark, d).select("Message-ID", "Subject")
    marked = df.withColumn("Subject", F.concat("Subject", F.when(F.col("Subject").contains("a"), "m²").otherwise("x\u0301²")))
    return timeline.subject_matches(marked, r"(?P<word>[^\W\d_]+)²\Z")


def time_bounds(spark, d):
    return timeline.time_bounds(_timed(spark, d)).select(
        F.col("min_date").cast("string").alias("min_date"), F.col("max_date").cast("string").alias("max_date")
    )


def range_sender_keyword_filter(spark, d):
    df = _timed(spark, d)
    chosen = values.distinct_values(df, "From").filter(F.col("From").rlike("@(click|error)"))
    picked = timeline.select_mail(df, FROM_DAY, TO_DAY, chosen, KEYWORD)
    return _shown_time(picked.select("Message-ID", "DateTime", "From", "Subject"))


def sender_list_filter(spark, d):
    picked = timeline.select_mail(_timed(spark, d), FROM_DAY, TO_DAY, SENDERS)
    return _shown_time(picked.select("Message-ID", "DateTime", "From"))


def subject_literal_search(spark, d):
    return timeline.subject_matches(board(spark, d), "er.", literal=True).select("Message-ID", "Subject")


def timeline_points(spark, d):
    return _shown_time(timeline.timeline_points(_timed(spark, d)))


def overview(spark, d):
    return _shown_time(selection.overview(_timed(spark, d)))


def page_2(spark, d):
    return _shown_time(selection.overview(selection.page(_timed(spark, d), 2)))


def page_after_first(spark, d):
    df = _timed(spark, d)
    last = selection.page(df.select(*selection.TIME_ORDER), 1).collect()[-1]  # one page of keys
    return _shown_time(selection.overview(selection.page_after(df, tuple(last))))


def page_count(spark, d):
    return selection.page_count(_timed(spark, d))


def detail_format(spark, d):
    return selection.detail(_timed(spark, d))


def working_set_default(spark, d):
    return _shown_time(selection.overview(selection.working_set(_timed(spark, d))))


def working_set_topup(spark, d):
    picked = selection.working_set(_timed(spark, d), (5, 9), minimum=4)
    return _shown_time(picked.select("position", "Message-ID", "DateTime"))


def page_deep(spark, d):
    return _shown_time(selection.overview(selection.page(_timed(spark, d), 3, shallow=0)))


def working_set_frame(spark, d):
    """Rows at the places that another table names."""
    places = table(spark, d, "documents").select("doc_id")
    return _shown_time(selection.rows_at(_timed(spark, d), places)).select("position", quoted("Message-ID"), "DateTime")


def tied_positions(spark, d):
    """Places in an order that very many rows share."""
    places = table(spark, d, "documents").select("doc_id")
    found = selection.rows_at(table(spark, d, "conversations").drop("text"), places, ("role", "turn"))
    return found.select("position", "role", "turn")


def tied_rows_once(spark, d):
    """Whole rows at every place of an order with two values: each comes once."""
    turns = table(spark, d, "conversations")
    return selection.rows_at(turns, spark.range(turns.count()), ("role",)).drop("position")


def tied_page(spark, d):
    return selection.page(table(spark, d, "orders"), 7, 40, ("o_orderstatus", "o_orderpriority"), shallow=0).select("o_orderstatus", "o_orderpriority")


def working_set_deep(spark, d):
    df = _timed(spark, d).select("Message-ID", "DateTime")
    picked = selection.working_set(df, (3, 60, 140), shallow=0)
    return _shown_time(picked.select("position", "Message-ID", "DateTime"))


def daily_volume(spark, d):
    return timeline.daily_volume(_timed(spark, d)).withColumn("day", F.col("day").cast("string"))


def daily_volume_gapfilled(spark, d):
    orders = table(spark, d, "orders")
    return timeline.daily_volume(orders, "o_orderdate").withColumn("day", F.col("day").cast("string"))


def daily_volume_events(spark, d):
    return timeline.daily_volume(table(spark, d, "events"), "ts").withColumn("day", F.col("day").cast("string"))


def weekday_hour(spark, d):
    return timeline.weekday_hour(table(spark, d, "events"), "ts")


def weekday_hour_mail(spark, d):
    return timeline.weekday_hour(_timed(spark, d))


def weekday_hour_dense(spark, d):
    return timeline.weekday_hour_grid(_timed(spark, d))


# --- fields and bodies ------------------------------------------------------------------------------------------


def clean_address_fields(spark, d):
    names = ("From", "To", "X-cc", "X-bcc")
    return mail(spark, d).select("doc_id", *[clean_addresses(F.col(quoted(n))).alias(n) for n in names])


def european_dates(spark, d):
    return mail(spark, d).select("doc_id", european_date(F.col("Date")).alias("Date"))


def _steps(df: DataFrame, column: str, *steps) -> DataFrame:
    for step in steps:
        df = df.withColumn(column, step(F.col(column)))
    return df


def _body_step(*steps):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _steps(mail(spark, d).select("doc_id", "Body"), "Body", *steps)

    return query


def list_lines(spark, d):
    lines = F.split(F.col("Body"), "\n", -1)
    found = F.size(F.filter(lines, B.is_list_line))
    return mail(spark, d).select("doc_id", found.alias("list_lines"))


def changed_lines(spark, d):
    return mail(spark, d).select("doc_id", B.count_line_starts(F.col("Body")).alias("lines_modified"))


def clean_html_pages(spark, d):
    return _steps(_pages(spark, d).select("page_id", "html"), "html", *B.TAG_STEPS)


def clean_symbol_pages(spark, d):
    return _steps(_pages(spark, d).select("page_id", "html"), "html", *B.TAG_STEPS, B.drop_symbol_lines)


def _cleaned(df: DataFrame, column: str, *keys: str) -> DataFrame:
    return df.select(*keys, clean_text(F.col(column)).alias("cleaned_body"))


def clean_body_full(spark, d):
    return _cleaned(mail(spark, d), "Body", "doc_id")


def clean_pages_full(spark, d):
    return _cleaned(_pages(spark, d), "html", "page_id")


def clean_conversations_full(spark, d):
    return _cleaned(table(spark, d, "conversations"), "text", "conv_id", "turn")


def _audit(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.select(key, clean_text_audited(F.col(column)).alias("audit")).select(
        key,
        F.array_join("audit.cleaning_steps", " | ").alias("cleaning_steps"),
        "audit.original_length",
        "audit.final_length",
        "audit.reduction_percent",
    )


def clean_audit(spark, d):
    return _audit(mail(spark, d), "doc_id", "Body")


def clean_audit_pages(spark, d):
    return _audit(_pages(spark, d), "page_id", "html")


# --- validation and reports -------------------------------------------------------------------------------------


def validate_route(spark, d):
    df = quality.validation_errors(quality.with_route(mail(spark, d)))
    return df.select("doc_id", "route", F.array_join("validation_errors", ", ").alias("validation_errors"))


def validate_route_keep(spark, d):
    return quality.with_route(mail(spark, d), subject_only="keep").select("doc_id", "route")


def record_profile(spark, d):
    return quality.profile(mail(spark, d)).select(
        "doc_id", "message_id", "source_file", "sender", "sent", "shown_subject", "has_subject", "has_body",
        "subject_length", "body_length",
    )


def _skips(spark, d):
    skipped = quality.with_route(mail(spark, d)).filter(F.col("route") != quality.CLEANED)
    return quality.skipped_report(skipped.join(mail_numbers(spark, d), "doc_id"))


def skipped_report(spark, d):
    return _skips(spark, d).withColumn(
        "validation_errors", F.coalesce(F.array_join("validation_errors", ", "), F.lit("-"))
    )


def skip_details(spark, d):
    return quality.skip_details(_skips(spark, d)).fillna("-", ["validation_errors"])


def skips_by_reason(spark, d):
    df = mail(spark, d).withColumn("email_number", F.lit(None).cast("bigint"))
    return quality.skips_by_reason(quality.skipped_report(quality.with_route(df)))


def run_summary(spark, d):
    return quality.run_summary(quality.with_route(mail(spark, d)))


def process_mail(spark, d):
    return process_records(mail(spark, d)).select(
        "doc_id", "route", "Date", "From", "To", "X-cc", "X-bcc", "Subject", "Body",
        F.coalesce(F.array_join("audit.cleaning_steps", " | "), F.lit("-")).alias("cleaning_steps"),
    )


# --- duplicates and files ---------------------------------------------------------------------------------------


def _prints(spark, d):
    return dedup.fingerprints(document_files(spark, d))


def content_fingerprint(spark, d):
    return _prints(spark, d)


def duplicate_sets(spark, d):
    return dedup.duplicate_sets(_prints(spark, d))


def duplicate_sets_split(spark, d):
    """Sets that hold more than a thousandth of all files are split."""
    prints = _prints(spark, d)
    return dedup.duplicate_sets(prints, hot=max(2, prints.count() // 1000))


def dedup_keep_first(spark, d):
    return dedup.keep_first(document_files(spark, d))


def dedup_removed(spark, d):
    return dedup.removed_files(_prints(spark, d))


def dedup_report(spark, d):
    return dedup.removal_lines(dedup.removed_files(_prints(spark, d)))


def dup_summary(spark, d):
    return dedup.duplicate_summary(_prints(spark, d))


def eligible_files(spark, d):
    return raw_messages(spark, d).select("path").filter(is_mail_file(base_name(F.col("path"))))


def _document_tree(spark, d):
    """Every document as lines of text files in a tree of folders by source and language; the place of the tree."""
    folder = _folder(spark, "tree")
    docs = table(spark, d, "documents").select("source", "lang", F.coalesce("text", F.lit("")).alias("value"))
    docs.write.partitionBy("source", "lang").text(folder)
    return folder


def _by_folder(df):
    part = F.regexp_extract("path", "/source=([^/]*)/lang=([^/]*)/", 0)
    return df.withColumn("folder", F.replace(part, F.lit("__HIVE_DEFAULT_PARTITION__"), F.lit("-"))).groupBy("folder")


def corpus_listing(spark, d):
    """Bytes of mail files by folder, from a listing by executors."""
    found = tree.list_tree(spark, _document_tree(spark, d)).filter(is_mail_file(base_name(F.col("path"))) & ~is_hidden(F.col("path")))
    return _by_folder(found).agg(F.sum("length").alias("bytes"))


def corpus_ingest(spark, d):
    """Files listed, read and written in one pass: lines and characters by folder, and nothing rejected but hidden names."""
    scan = tree.ingest(spark, _document_tree(spark, d), _folder(spark, "ingested"))
    texts = scan.files.withColumn("lines", F.size(F.split("text", "\n", -1)) - 1)
    lost = scan.rejects.filter(F.col("reason") != HIDDEN).select("path", F.lit("").alias("text"), F.lit(-1).alias("lines"))
    both = texts.select("path", "text", "lines").unionByName(lost)
    return _by_folder(both).agg(F.sum("lines").alias("lines"), F.sum(F.length("text")).alias("characters"))


def normalized_names(spark, d):
    return raw_messages(spark, d).select("path", txt_name(F.col("path")).alias("file_name"))


def basename_collapse(spark, d):
    paths = raw_messages(spark, d).select("path", base_name(F.col("path")).alias("file_name"))
    return dedup.last_per_name(paths)


def collapsed_files(spark, d):
    paths = raw_messages(spark, d).select("path", base_name(F.col("path")).alias("file_name"))
    return dedup.collapsed_files(paths)


def natural_positions(spark, d):
    files = raw_messages(spark, d).select("path", base_name(F.col("path")).alias("SourceFile"))
    return with_position(files, natural_order(), "email_number", start=1)


def corpus_counts(spark, d):
    files = raw_messages(spark, d)
    found = files.agg(F.count_if(is_mail_file(base_name(F.col("path")))).alias("files_found"))
    saved = corpus_to_records(files).agg(F.count(F.lit(1)).alias("records_saved"))
    kept = dedup.surviving_paths(files.filter(is_mail_file(base_name(F.col("path")))), collapse=False, name=txt_name)
    lost = dedup.collapsed_files(kept.withColumn("file_name", txt_name(F.col("path")))).agg(F.count(F.lit(1)).alias("files_collapsed"))
    # Single-row aggregates side by side.
    names = ("files_found", "records_saved", "files_collapsed")
    rows = found.unionByName(saved, allowMissingColumns=True).unionByName(lost, allowMissingColumns=True)
    return rows.agg(*[F.max(n).alias(n) for n in names])


def lenient_decode(spark, d):
    docs = table(spark, d, "documents")
    broken = F.concat(
        F.encode(F.regexp_replace("text", "\n", "\r\n"), "utf-8"),
        F.unhex(F.lit("FFC3")),
        F.encode(F.lit("\rend"), "utf-8"),
    )
    return docs.select("doc_id", lenient_utf8(broken).alias("text"))


# --- parsing and whole jobs -------------------------------------------------------------------------------------


def parse_headers(spark, d):
    return parse_messages(raw_messages(spark, d), keep=("doc_id",)).select("doc_id", *map(quoted, HEADER_FIELDS))


def parse_body(spark, d):
    return parse_messages(raw_messages(spark, d), keep=("doc_id",)).select("doc_id", "Body")


def parse_record(spark, d):
    return parse_messages(raw_messages(spark, d), keep=("doc_id",))


def refined_records(spark, d):
    return corpus_to_records(raw_messages(spark, d))


def refined_records_all_names(spark, d):
    return corpus_to_records(raw_messages(spark, d), collapse=False)


def refined_records_bucketed(spark, d):
    """The same records from a table bucketed by path, whose texts stay where they are."""
    folder = _folder(spark, "files")
    files = compact(raw_messages(spark, d).select("path", "text"), folder, 16, folder.rsplit("/", 1)[1].replace("-", "_"))
    return corpus_to_records(files)


def corpus_to_clean(spark, d):
    records = corpus_to_records(raw_messages(spark, d), number="email_number")
    return process_records(records, audit=None).select(
        "email_number", "path", "SourceFile", "route", "Date", "From", "To", "Subject", "Body"
    )


def flatten_props(spark, d):
    events = table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("props"))
    return flatten(events).toDF("event_id", "props_k")


def records_roundtrip(spark, d):
    """Records written as JSON lines and read back with the record schema."""
    folder = f"{shared_dir(spark)}/records-{uuid4().hex}"
    write_records(mail(spark, d).select(*map(quoted, RECORD_FIELDS)), folder, "json")
    return read_json(spark, folder, array=False, schema=RECORD)


def array_roundtrip(spark, d):
    """Records written as files of one JSON array each and read back by byte ranges."""
    folder = _folder(spark, "arrays")
    write_json_array(mail(spark, d).select(*map(quoted, RECORD_FIELDS)), folder)
    return read_json_array(spark, folder)[0]


def array_rejects(spark, d):
    """Of arrays in which every tenth record is broken, the other records; nothing else is lost with them."""
    folder = _folder(spark, "broken")
    docs = table(spark, d, "documents").select("doc_id", F.struct(F.col("text").alias("Subject")).alias("record"))
    value = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit('{"Subject": '), F.col("doc_id").cast("string"), F.lit(" oops}")))
    # Every task writes an array of its own; the byte ranges of these files are what tasks share afterwards.
    write_array_lines(docs.select(F.coalesce(value, F.to_json("record")).alias("value")), folder)
    records, rejects = read_json_array(spark, folder)
    shown = records.select(F.lit("record").alias("kind"), F.col("Subject").alias("value"))
    return shown.union(rejects.select(F.lit("reject"), F.regexp_replace("text", r"\A[\s,\[]*", "")))


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


def cleaned_table(spark, d):
    """The cleaned table of a whole run, read back."""
    records = corpus_to_records(raw_messages(spark, d), number="email_number")
    return run_cleaning(records, _folder(spark, "clean")).cleaned.select(
        "email_number", "path", "SourceFile", "Date", "From", "To", "Subject", "Body"
    )


def skip_report_file(spark, d):
    """The skip report of a whole run, read back."""
    folder = _folder(spark, "run")
    run_cleaning(mail(spark, d).join(mail_numbers(spark, d), "doc_id"), folder)
    read = spark.read.schema(SKIP).json(report_path(folder))
    return read.withColumn("validation_errors", F.coalesce(F.array_join("validation_errors", ", "), F.lit("-")))


def committed_run(spark, d):
    """The cleaned table of a run that was committed, after a second run was begun under the same name."""
    place = _folder(spark, "runs")
    records = mail(spark, d).join(mail_numbers(spark, d), "doc_id").drop("doc_id")
    committed.commit_run(records, place, "first")
    committed.commit_run(records.limit(0), place, "first")
    return committed.current_run(spark, place).tables.cleaned.select("email_number", *[quoted(c) for c in ("Message-ID", "Date", "From", "Subject", "Body")])


def removal_report_file(spark, d):
    folder = _folder(spark, "removals")
    write_removals(dedup.removed_files(_prints(spark, d)), folder)
    return spark.read.text(folder)


def json_extra_fields(spark, d):
    """Records with a field beyond the schema, written as JSON lines and read back with it."""
    folder = _folder(spark, "extra")
    write_records(mail(spark, d).select(*map(quoted, RECORD_FIELDS), F.col(quoted("X-Origin")).alias("Content")), folder, "json")
    return read_json(spark, folder, array=False, extra=True)


def json_rejects(spark, d):
    """Lines that are no JSON come back as rejects, the others as records."""
    folder = _folder(spark, "lines")
    docs = table(spark, d, "documents")
    broken = F.concat(F.lit('{"Subject": "'), F.col("doc_id").cast("string"))
    good = F.to_json(F.struct(F.col("text").alias("Subject")))
    docs.select(F.when(F.col("doc_id") % 10 == 0, broken).otherwise(good).alias("value")).write.text(folder)
    records, rejects = read_json_with_rejects(spark, folder, array=False)
    shown = records.select(F.lit("record").alias("kind"), F.col("Subject").alias("value"))
    return shown.union(rejects.select(F.lit("reject"), "text"))


def checked_records(spark, d):
    """The input guards let a complete, filled table through."""
    return require_rows(require_columns(board(spark, d))).select(quoted("Message-ID"))


def record_key_counts(spark, d):
    """The top-level fields of the records, and how many records fill each."""
    df = board(spark, d).drop("doc_id")
    keys = record_keys(df)
    filled = df.agg(*[F.count_if(F.col(quoted(k)) != "").alias(k) for k in keys])
    return filled.unpivot([], [quoted(k) for k in keys], "key", "filled")


QUERIES = {
    q.__name__: q
    for q in (
        top_senders, subject_word_freq, conversation_word_freq, document_words, word_cloud_weights, word_cloud_pairs,
        sender_domain,
        recipient_domain_placeholder, sender_filter, sender_filter_count, mail_list_all, full_view, date_parse,
        time_bounds, range_sender_keyword_filter, sender_list_filter, subject_literal_search, timeline_points,
        overview, page_2, page_after_first, page_count, detail_format, working_set_default, working_set_topup,
        working_set_deep, daily_volume, daily_volume_gapfilled, daily_volume_events, weekday_hour, weekday_hour_mail,
        weekday_hour_dense, clean_address_fields, european_dates, list_lines, changed_lines, clean_html_pages,
        clean_symbol_pages, clean_body_full, clean_pages_full, clean_conversations_full, clean_audit,
        clean_audit_pages, validate_route, validate_route_keep, record_profile, skipped_report, skip_details,
        skips_by_reason, run_summary, process_mail, content_fingerprint, duplicate_sets, duplicate_sets_split,
        dedup_keep_first, dedup_removed, dedup_report, dup_summary, eligible_files, normalized_names,
        basename_collapse, natural_positions, corpus_counts, lenient_decode, parse_headers, parse_body, parse_record,
        refined_records, refined_records_all_names, corpus_to_clean, flatten_props, records_roundtrip, page_deep,
        working_set_frame, collapsed_files, cleaned_table, skip_report_file, removal_report_file, json_extra_fields,
        json_rejects, checked_records, record_key_counts, refined_records_bucketed, corpus_listing, corpus_ingest,
        array_roundtrip, array_rejects, committed_run, date_inferred, date_inferred_mixed, subject_pattern_search,
        tied_positions, tied_rows_once, tied_page,
    )
}
QUERIES |= {
    "clean_qp": _body_step(B.decode_escapes),
    "clean_whitespace": _body_step(B.squeeze_spaces),
    "clean_control": _body_step(B.drop_controls),
    "clean_leading": _body_step(B.strip_line_starts, B.drop_leading_blank_lines),
    "clean_html": _body_step(*B.TAG_STEPS),
    "clean_mojibake": _body_step(B.repair_mojibake),
    "clean_symbol_lines": _body_step(B.drop_symbol_lines, B.drop_quote_marks, B.drop_empty_bullets),
    "clean_final": _body_step(B.left_trim_lines, B.squeeze_punctuation, B.strip),
}
