"""File manifests: path, size and content hash, and verification against a stored manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlens.sources import filesets


def build_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path relative to the folder, size, sha256) of its files, of any size; equal names in different folders stay apart."""
    return filesets.digests(spark, path, glob)


def content_manifest(df: DataFrame, path: Column, content: Column, *keep: str) -> DataFrame:
    """Manifest over contents held in a table; one line for each row, with the columns to ``keep``."""
    raw = content.cast("binary")
    return df.select(path.alias("path"), F.octet_length(raw).cast("long").alias("size"), F.sha2(raw, 256).alias("sha256"), *keep)


def verify_manifest(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """missing / unexpected / size / hash differences by one full outer join."""
    a = actual.select("path", F.col("size").alias("a_size"), F.col("sha256").alias("a_hash"))
    e = expected.select("path", F.col("size").alias("e_size"), F.col("sha256").alias("e_hash"))
    status = (F.when(F.col("a_hash").isNull(), "missing").when(F.col("e_hash").isNull(), "unexpected")
              .when(F.col("a_size") != F.col("e_size"), "size differs").when(F.col("a_hash") != F.col("e_hash"), "hash differs")
              .otherwise("ok"))
    return a.join(e, "path", "full_outer").select("path", status.alias("status"))
