"""Execution timelines: CSV ingest with unit scaling, filtered export in trace-event JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlens import schema as sc
from guardlens.functions import exprs as X

COLUMNS = ("timestamp", "hostname", "rank", "stream", "op_type", "op_name", "op_phase")


def read_timeline(spark: SparkSession, path: str, unit: str, hostname: Column | None = None) -> DataFrame:
    """Headerless CSV; ``unit`` is ns or us; the host name comes from the parent folder."""
    df = spark.read.schema(sc.TIMELINE_CSV).csv(path)
    host = F.element_at(F.split(F.input_file_name(), "/"), -2) if hostname is None else hostname
    return scaled(df.withColumn("hostname", host), unit)


def scaled(df: DataFrame, unit: str) -> DataFrame:
    """Timestamps in microseconds."""
    if unit not in ("ns", "us"):
        raise ValueError(f"unknown unit {unit!r}")
    ts = F.col("timestamp")
    if unit == "ns":  # nanoseconds of today are beyond what a double holds exactly
        ts = F.call_function("div", ts - F.pmod(ts, F.lit(1000).cast("long")), F.lit(1000).cast("long"))
    return df.withColumn("timestamp", ts).select(*COLUMNS)


def trace_events(timeline: DataFrame, ranks: tuple[int, ...] | None = None, start: int | None = None,
                 end: int | None = None, names: Mapping[str, str] | None = None) -> DataFrame:
    """Begin / end records of the trace-event format for a rank and time selection."""
    d = timeline
    if ranks is not None:
        d = d.where(F.col("rank").isin(*ranks))
    if start is not None:
        d = d.where(F.col("timestamp") >= start)
    if end is not None:
        d = d.where(F.col("timestamp") < end)
    phase = F.when(F.lower("op_phase").contains("begin"), "B").when(F.lower("op_phase").contains("end"), "E").otherwise("i")
    return d.select(X.marker_name("op_name", names=names).alias("name"), F.col("op_type").alias("cat"), phase.alias("ph"),
                    F.col("timestamp").alias("ts"), F.col("rank").alias("pid"), F.col("stream").alias("tid"),
                    F.struct("hostname", X.epoch_text("timestamp").alias("time")).alias("args"))


def export(timeline: DataFrame, path: str, **selection) -> None:
    """Gzip JSON lines, one trace event per line, one file per partition."""
    trace_events(timeline, **selection).write.mode("overwrite").option("compression", "gzip").json(path)
