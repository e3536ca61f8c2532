"""Exact-content duplicates and same-name files.

Groups are never collected: a group of copies may hold a third of the corpus. Survivors come from ``min``/``max`` of the
path, which combines on the map side, and the wide rows meet the survivors in one semi or anti join on the unique
path. Paths decide every tie, so the outcome does not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.names import base_name
from postmill.operators.ordering import attach_group

# --- fixed values -----------------------------------------------------------------------------------------------
REMOVAL_LINE = "Deleted duplicate file: "
# --- end of fixed values ----------------------------------------------------------------------------------------

#: File name that stands for a path.
Naming = Callable[[Column], Column]

#: Copies of one content that a single join task should take.
HOT_COPIES = 1_000_000


def fingerprints(files: DataFrame, text: str = "text", name: Naming = base_name) -> DataFrame:
    """``(path, hash)`` of ``.txt`` files; the only columns later steps shuffle.

    ``name`` gives the file name that counts for a path. A ``hash`` column stored when the corpus was compacted is used
    as it is, so the text is not read again.
    """
    named = files.filter(name(F.col("path")).endswith(".txt"))
    value = F.col("hash") if "hash" in files.columns else F.md5(F.col(text))
    return named.select("path", value.alias("hash"))


def content_groups(prints: DataFrame) -> DataFrame:
    """One row per content: number of copies and the path that survives."""
    return prints.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path"))


def duplicate_sets(prints: DataFrame, hot: int = HOT_COPIES) -> DataFrame:
    """Every file that shares its content with another: ``(hash, copies, first_path, path)``, one row per file."""
    groups = content_groups(prints).filter(F.col("copies") > 1)
    return attach_group(prints, groups, "hash", "path", "copies", hot).select("hash", "copies", "first_path", "path")


def duplicate_summary(prints: DataFrame) -> DataFrame:
    """Number of duplicate sets, of files in them and of files to remove."""
    return content_groups(prints).filter(F.col("copies") > 1).agg(
        F.count(F.lit(1)).alias("duplicate_sets"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("files"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("removed"),
    )


def keep_first(files: DataFrame, text: str = "text") -> DataFrame:
    """The ``.txt`` files left after removing duplicates."""
    first = content_groups(fingerprints(files, text)).select(F.col("first_path").alias("path"))
    return files.join(first, "path", "left_semi")


def removed_files(prints: DataFrame) -> DataFrame:
    """``(path, hash)`` of every copy but the first."""
    first = content_groups(prints).select(F.col("first_path").alias("path"))
    return prints.join(first, "path", "left_anti")


def removal_lines(removed: DataFrame) -> DataFrame:
    """The removal report, one line of text per removed file."""
    return removed.select(F.concat(F.lit(REMOVAL_LINE), F.col("path")).alias("value"))


def last_per_name(paths: DataFrame, name: str = "file_name") -> DataFrame:
    """``path`` of the one file that stands for each base name: the last in path order."""
    return paths.groupBy(name).agg(F.max("path").alias("path")).select("path")


def collapsed_files(paths: DataFrame, name: str = "file_name") -> DataFrame:
    """``(path, name, kept_path)`` of every file that :func:`last_per_name` leaves out, and which one stands for it."""
    kept = paths.groupBy(name).agg(F.max("path").alias("kept_path"), F.count(F.lit(1)).alias("_files"))
    kept = kept.filter("_files > 1").drop("_files")
    return paths.select("path", name).join(kept, name).filter(F.col("path") != F.col("kept_path")).select("path", name, "kept_path")


def surviving_paths(
    files: DataFrame, text: str = "text", collapse: bool = True, name: Naming = base_name
) -> DataFrame:
    """Paths left after content dedup of ``.txt`` files and, optionally, the collapse by file name.

    Works on keys only, so a corpus needs a single shuffle of its wide rows afterwards.
    """
    others = files.filter(~name(F.col("path")).endswith(".txt")).select("path")
    first = content_groups(fingerprints(files, text, name)).select(F.col("first_path").alias("path"))
    paths = first.unionByName(others)
    return last_per_name(paths.withColumn("file_name", name(F.col("path")))) if collapse else paths
