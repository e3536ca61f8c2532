"""Structured records: JSON or Parquet input, checks and flattening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.schema import BOARD_FIELDS, RECORD, quoted


BROKEN = "_broken"


def read_json(
    spark: SparkSession, path: str, array: bool = True, schema: T.StructType | None = RECORD, extra: bool = False
) -> DataFrame:
    """Records from JSON, one array per file (``array``) or one object per line; malformed input ends the job.

    The explicit schema keeps field order; inference (``schema=None``) would sort the fields by name. ``extra`` keeps
    fields beyond the schema, which takes one more pass over the input. An array file cannot be split, so large inputs
    should come as lines or be rewritten as Parquet.
    """
    if schema and extra:
        found = spark.read.json(path, multiLine=array, mode="FAILFAST").schema
        schema = T.StructType([*schema.fields, *[f for f in found.fields if f.name not in schema.names]])
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=array, mode="FAILFAST")


def read_json_with_rejects(
    spark: SparkSession, path: str, array: bool = True, schema: T.StructType = RECORD
) -> tuple[DataFrame, DataFrame]:
    """Records, and ``(path, text)`` of what is no JSON: the line, or the whole file where files hold arrays."""
    fields = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    rows = spark.read.schema(fields).json(path, multiLine=array, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN)
    rows = rows.withColumn("_file", F.col("_metadata.file_path"))
    good = rows.filter(F.col(BROKEN).isNull()).drop(BROKEN, "_file")
    # Spark refuses to read the broken text alone, so a field is looked at as well.
    looked = F.length(F.concat(F.lit("-"), F.coalesce(F.col(quoted(schema.names[0])).cast("string"), F.lit("")))) > 0
    bad = rows.filter(F.col(BROKEN).isNotNull() & looked)
    return good, bad.select(F.col("_file").alias("path"), F.col(BROKEN).alias("text"))


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs become dotted top-level columns; arrays and maps stay as they are."""

    def leaves(fields, access: str, title: str):
        for field in fields:
            inner = f"{access}.{quoted(field.name)}" if access else quoted(field.name)
            name = f"{title}.{field.name}" if title else field.name
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType.fields, inner, name)
            else:
                yield F.col(inner).alias(name)

    return df.select(*leaves(df.schema.fields, "", ""))


def missing_columns(df: DataFrame, expected: Sequence[str] = BOARD_FIELDS) -> list[str]:
    return [name for name in expected if name not in df.columns]


def require_columns(df: DataFrame, expected: Sequence[str] = BOARD_FIELDS) -> DataFrame:
    missing = missing_columns(df, expected)
    if missing:
        raise ValueError(f"missing expected columns: {missing}")
    return df


def require_rows(df: DataFrame) -> DataFrame:
    """The frame itself, or an error if it has no rows."""
    if df.isEmpty():
        raise ValueError("the input holds no records")
    return df


def record_keys(df: DataFrame) -> list[str]:
    """Top-level field names of the records."""
    return df.columns
