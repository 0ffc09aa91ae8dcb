"""Rows told apart by where they stand, so that whole rows can be kept or dropped whatever their ids are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlens.session import cut

ROW = "__row"


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a column ``__row`` that no two of them share and that stays the same each time they are read.

    A table that is read from files names a row by its file and its place there; nothing is copied. What comes from anywhere else
    is written once with a number.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and "_metadata" not in docs.columns:
        try:
            placed = docs.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(ROW))
            placed.schema
            return placed
        except Exception as e:  # not every kind of file has places
            if "UNRESOLVED_COLUMN" not in str(e) and "FIELD_NOT_FOUND" not in str(e):
                raise
    return cut(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
