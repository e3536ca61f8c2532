"""Raw messages to structured records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.headers import header_field, header_lines, message_body, split_message
from postmill.functions.names import base_name
from postmill.operators.dedup import Naming
from postmill.schema import HEADER_FIELDS


def parse_messages(
    files: DataFrame, text: str = "text", keep: tuple[str, ...] = (), name: Naming = base_name
) -> DataFrame:
    """One record per file: the header fields, ``Body`` and ``SourceFile``. Total, narrow and without Python.

    ``keep`` names input columns to carry along, such as ``path`` for lineage; ``name`` gives the file name of a path.
    """
    lines = files.withColumn("_parts", split_message(F.col(text))).withColumn("_lines", header_lines(F.col("_parts")))
    return lines.select(
        *keep,
        *[header_field(F.col("_lines"), field).alias(field) for field in HEADER_FIELDS],
        message_body(F.col("_parts")).alias("Body"),
        name(F.col("path")).alias("SourceFile"),
    )
