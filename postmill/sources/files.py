"""The raw corpus: one row per message file, and one row for each file that cannot become one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.names import base_name, is_mail_file
from postmill.functions.text import lenient_utf8

#: Files above this size are rejected instead of ending the job; Spark cannot read more into one value.
LARGEST = 2**31 - 1 - 2**20
LISTED = "path string, length long"
REJECT = "path string, length long, reason string"
HIDDEN, TOO_LARGE, UNREAD = "hidden name", "too large", "unreadable"


@dataclass(frozen=True)
class Scan:
    """``files``: ``(path, file_name, text)``; ``rejects``: ``(path, length, reason)``; ``listing``: ``(path, length)``.

    Files and rejects together are the listing, but for names that are no mail when only mail was asked for.
    """

    files: DataFrame
    rejects: DataFrame
    listing: DataFrame


def is_hidden(path: Column) -> Column:
    """Names, or names of the folder right above, that Spark's readers leave out."""
    return base_name(path).rlike(r"\A[._]") | path.rlike(r"/[._][^/]*/[^/]*\z")


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """``(path, length)`` of every file below ``directory``, empty ones and hidden names included.

    Spark's own listing leaves those out. Like it, this one is read on the driver, one call per folder and names only.
    """
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(directory)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found, open_folders = [], [root]
    while open_folders:
        for entry in system.listStatus(open_folders.pop()):
            if entry.isDirectory():
                open_folders.append(entry.getPath())
            else:
                found.append((entry.getPath().toString(), entry.getLen()))
    return spark.createDataFrame(found, LISTED)


def scan_corpus(
    spark: SparkSession, directory: str, eligible_only: bool = True, largest: int = LARGEST, skip_unreadable: bool = False
) -> Scan:
    """All files below ``directory``: those that can be read, and those that cannot with the reason.

    Names are tested on file metadata, so files that do not belong are never opened. Empty files are rows with an empty
    text. Hidden names (``.``, ``_``) and files above ``largest`` bytes are rejects. A file that cannot be read ends the
    job; with ``skip_unreadable`` it is left out, and :func:`unread_files` names it once the files have been written.
    """
    listing = list_files(spark, directory)
    mail = is_mail_file(base_name(F.col("path")))
    wanted = listing.filter(mail) if eligible_only else listing
    hidden = is_hidden(F.col("path"))
    reason = F.when(hidden, HIDDEN).when(F.col("length") > largest, TOO_LARGE)
    rejects = wanted.withColumn("reason", reason).filter("reason is not null").select("path", "length", "reason")
    empty = wanted.filter((F.col("length") == 0) & ~hidden)
    empty = empty.select("path", base_name(F.col("path")).alias("file_name"), F.lit("").alias("text"))
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if skip_unreadable:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    files = reader.load(directory).filter(F.col("length") <= largest)
    # The metadata name is URI-encoded; a plus sign stands for itself there.
    name = F.try_url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    if eligible_only:
        files = files.filter(is_mail_file(name))
    read = files.select("path", name.alias("file_name"), lenient_utf8(F.col("content")).alias("text"))
    return Scan(read.unionByName(empty), rejects, listing)


def scan_files(spark: SparkSession, directory: str, eligible_only: bool = True) -> DataFrame:
    """The ``files`` of :func:`scan_corpus`."""
    return scan_corpus(spark, directory, eligible_only).files


def unread_files(scan: Scan, written: DataFrame, eligible_only: bool = True) -> DataFrame:
    """Files that were listed but neither written nor rejected, as rejects; an anti join on paths."""
    listing = scan.listing.filter(is_mail_file(base_name(F.col("path")))) if eligible_only else scan.listing
    seen = written.select("path").unionByName(scan.rejects.select("path"))
    return listing.join(seen, "path", "left_anti").withColumn("reason", F.lit(UNREAD))


def compact(files: DataFrame, destination: str, buckets: int = 0, name: str | None = None) -> DataFrame:
    """Write the scanned corpus once as Parquet with a content ``hash`` and return the table.

    Millions of small files are slow to list and open; everything after this step reads the table, and duplicate
    detection reads only ``path`` and ``hash``. With ``buckets`` and a catalog ``name`` the table is bucketed by path:
    survivors and record numbers then come to the texts, and the texts are not shuffled again.
    """
    if not buckets:
        files.withColumn("hash", F.md5("text")).write.mode("overwrite").parquet(destination)
        return files.sparkSession.read.parquet(destination)
    if not name:
        raise ValueError("a bucketed table needs a name")
    # Without a shuffle of its own every task would write a file into each bucket.
    hashed = files.repartition(buckets, "path").withColumn("hash", F.md5("text"))
    hashed.write.mode("overwrite").bucketBy(buckets, "path").sortBy("path").option("path", destination).saveAsTable(name)
    return files.sparkSession.table(name)
