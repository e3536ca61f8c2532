"""Raw files listed and read by the executors.

The folders of one level are listed by tasks, which write what they find to a table; the folders among it are the next
level. Paths never pass through the driver, so that a corpus of any number of files is listed as fast as its storage
answers. Reading takes the listed paths, opens each file once and turns what fails into a reject with its message.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.names import base_name, is_mail_file
from postmill.functions.text import lenient_utf8
from postmill.session import shared_dir
from postmill.sources.files import HIDDEN, LARGEST, REJECT, TOO_LARGE, UNREAD, Scan, is_hidden

FOUND = "path string, length long, folder boolean, problem string"
READ = "path string, length long, content binary, problem string"
#: Bytes and files that one reading task is meant to take.
TASK_BYTES, TASK_FILES = 128 << 20, 20_000
#: Rows and bytes after which a task hands on what it has.
BATCH_ROWS, BATCH_BYTES = 10_000, 32 << 20


def opens(uri: str) -> bool:
    """Whether tasks can open files below ``uri`` by themselves: mounted paths and stores that Arrow knows."""
    try:
        return bool(_store(uri))
    except (pa.ArrowException, OSError, ValueError):
        return False


def _local(uri: str) -> str | None:
    """The plain path of a local or mounted file, else None."""
    return re.sub(r"^file:(//)?(?=/)", "", uri) if uri.startswith(("/", "file:")) else None


def _store(uri: str) -> tuple[fs.FileSystem, str, str]:
    """``(file system, path in it, what precedes such a path in a full one)``."""
    if (path := _local(uri)) is not None:
        return fs.LocalFileSystem(), path, "file:"
    system, path = fs.FileSystem.from_uri(uri)
    return system, path, uri[: uri.index(path)] if path in uri else uri.split("/", 3)[0] + "//"


def _entries(uri: str) -> Iterator[tuple[str, int | None, bool, str | None]]:
    """What one folder holds. Links to folders are not followed, so that no loop is."""
    if (path := _local(uri)) is not None:
        with os.scandir(path) as found:
            for entry in found:
                full = "file:" + entry.path
                try:
                    folder = entry.is_dir(follow_symlinks=False)
                    if not folder and entry.is_dir():
                        continue
                    yield full, None if folder else entry.stat().st_size, folder, None
                except OSError as error:
                    yield full, None, False, str(error)
        return
    system, path, before = _store(uri)
    for info in system.get_file_info(fs.FileSelector(path)):
        folder = info.type == fs.FileType.Directory
        yield before + info.path, None if folder else info.size, folder, None


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "length", "folder", "problem"])

    rows: list[tuple] = []
    for given in batches:
        for folder in given.column(0).to_pylist():
            try:
                for entry in _entries(folder):
                    rows.append(entry)
                    if len(rows) >= BATCH_ROWS:
                        yield batch(rows)
                        rows = []
            except (OSError, pa.ArrowException) as error:
                rows.append((folder, None, False, str(error)))
    yield batch(rows)


def list_tree(spark: SparkSession, directory: str) -> DataFrame:
    """``(path, length, problem)`` of every file below ``directory``, empty ones and hidden names included.

    A folder or file that can't be looked at is a row with a null length and the reason as ``problem``. There is one job for
    each level of folders; the driver counts folders, and holds none.
    """
    place = f"{shared_dir(spark).rstrip('/')}/listing-{uuid4().hex}"
    cores = spark.sparkContext.defaultParallelism
    frontier, level, folders = spark.createDataFrame([(directory.rstrip("/") or "/",)], "path string"), 0, 1
    while folders:
        found = frontier.repartition(max(1, min(folders, 8 * cores))).mapInArrow(_list, FOUND)
        found.write.parquet(f"{place}/level={level}")
        listed = spark.read.schema(FOUND).parquet(f"{place}/level={level}")
        frontier = listed.filter("folder").select("path")
        level, folders = level + 1, frontier.count()
    return spark.read.schema(FOUND).parquet(*[f"{place}/level={i}" for i in range(level)]).filter("not folder").drop("folder")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "length", "content", "problem"])

    rows, held = [], 0
    for given in batches:
        for path, length in zip(given.column(0).to_pylist(), given.column(1).to_pylist(), strict=True):
            if rows and held + (length or 0) > BATCH_BYTES:
                yield batch(rows)
                rows, held = [], 0
            try:
                system, inside, _ = _store(path)
                with system.open_input_stream(inside) as stream:
                    content, problem = stream.read(), None
            except (OSError, pa.ArrowException) as error:
                content, problem = None, str(error)
            rows.append((path, length if content is None else len(content), content, problem))
            held += len(content or b"")
    yield batch(rows)


def read_listed(listing: DataFrame) -> DataFrame:
    """``(path, length, content, problem)`` for ``(path, length)``: each file opened once, by tasks of about equal bytes.

    A file that can't be read has no content and the error's message as its problem.
    """
    size = listing.agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files")).first()
    tasks = max(1, -(-(size.bytes or 0) // TASK_BYTES), -(-size.files // TASK_FILES))
    if size.files > 1:
        tasks = max(tasks, min(size.files, listing.sparkSession.sparkContext.defaultParallelism))
    return listing.select("path", "length").repartition(int(tasks), "path").mapInArrow(_read, READ)


def ingest(spark: SparkSession, directory: str, destination: str, eligible_only: bool = True, largest: int = LARGEST) -> Scan:
    """List, read and write a corpus in one pass, as :class:`Scan` over the written tables.

    ``files`` are ``(path, file_name, text, hash)``, lenient UTF-8 with an MD5 of the text; ``rejects`` keep the reason: a
    hidden name, a file above ``largest`` bytes, or the message of what went wrong. Files and rejects together are the
    listing, but for names that are no mail where only mail is asked for. Texts are read once and written once; every
    file that can be read is there whatever happens to the others.
    """
    if not opens(directory):
        raise ValueError(f"tasks can't open {directory}; scan_corpus reads what only Spark opens")
    place = destination.rstrip("/")
    listing = list_tree(spark, directory)
    # The names of folders that failed say nothing about the files in them, so those rows always stay.
    wanted = listing.filter(is_mail_file(base_name(F.col("path"))) | F.col("problem").isNotNull()) if eligible_only else listing
    named = F.concat(F.lit(f"{UNREAD}: "), F.col("problem"))
    reason = F.when(F.col("problem").isNotNull(), named).when(is_hidden(F.col("path")), HIDDEN).when(F.col("length") > largest, TOO_LARGE)
    judged = wanted.withColumn("reason", reason)
    early = judged.filter("reason is not null").select("path", "length", "reason")
    early.write.mode("overwrite").parquet(f"{place}/rejects/stage=listing")
    read = read_listed(judged.filter("reason is null"))
    texts = read.select(
        F.when(F.col("problem").isNull(), "files").otherwise("rejects").alias("state"), "path", "length",
        base_name(F.col("path")).alias("file_name"), lenient_utf8(F.col("content")).alias("text"), named.alias("reason"),
    ).withColumn("hash", F.md5("text"))
    texts.write.mode("overwrite").partitionBy("state").parquet(f"{place}/read")
    table = spark.read.schema(texts.schema).parquet(f"{place}/read")
    files = table.filter("state = 'files'").select("path", "file_name", "text", "hash")
    late = table.filter("state = 'rejects'").select("path", "length", "reason")
    rejects = spark.read.schema(REJECT).parquet(f"{place}/rejects/stage=listing").unionByName(late)
    return Scan(files, rejects, listing.select("path", "length"))
