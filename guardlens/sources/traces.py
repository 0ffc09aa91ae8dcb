"""Event traces and tensor-state dumps: readers, rank union, logical relations, sinks, summaries.

Layout for large fleets: ``run`` and ``hookpoint`` are partition columns (a check reads only the
folders of its hookpoints) and files are sorted by event_id, so min/max statistics prune ranges.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlens import schema as sc
from guardlens.functions import exprs as X

KEY_OFFSET = 10 ** 9
RANK_FILE = r"coredump_dp(\d+)_tp(\d+)_pp(\d+)_cp(\d+)"


def read_trace(spark: SparkSession, path: str | Sequence[str], hookpoints: Iterable[str] | None = None,
               run_column: bool = False) -> DataFrame:
    fields = list(sc.ENVELOPE.fields) + ([T.StructField("run", sc.S)] if run_column else [])
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.schema(T.StructType(fields)).parquet(*paths)
    return df if hookpoints is None else df.where(X.hookpoint_in(hookpoints))


def read_trace_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON event per line with the payload as an object or as text."""
    return spark.read.schema(sc.ENVELOPE).json(path)


def write_trace(df: DataFrame, path: str, mode: str = "append") -> None:
    """Rows of one folder are range-clustered by event_id; a hot hookpoint spans many files."""
    (df.repartitionByRange("run", "hookpoint", "event_id").sortWithinPartitions("run", "hookpoint", "event_id")
     .write.mode(mode).partitionBy("run", "hookpoint").parquet(path))


def union_runs(traces: Mapping[str, DataFrame]) -> DataFrame:
    """UNION ALL of traces, each tagged with its run name."""
    return reduce(DataFrame.unionByName, [d.withColumn("run", F.lit(n)) for n, d in traces.items()])


def read_ranks(spark: SparkSession, path: str, schema: T.StructType, folder: str = r"/rank=(\d+)/") -> DataFrame:
    """One scan over the folders of all ranks; run names come from the files' paths, so a fleet of any size is one relation."""
    rank = F.regexp_extract(F.col("_metadata.file_path"), folder, 1)
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    return rows.select("*", F.concat(F.lit("rank"), rank).alias("run"))


def union_ranks_with_offset(traces: Sequence[DataFrame], key: str = "event_id", offset: int = KEY_OFFSET) -> DataFrame:
    """UNION ALL of per-rank traces; rank i keeps unique ids by adding i * offset.

    An id outside [0, offset) would meet another rank's ids and fails the query.
    """
    def shifted(i: int) -> Column:
        ok = (F.col(key) >= 0) & (F.col(key) < offset)
        bad = F.raise_error(F.concat(F.lit(f"{key} outside the offset {offset}: "), F.col(key).cast("string"))).cast("long")
        return F.when(F.col(key).isNull() | ok, F.lit(i * offset).cast("long") + F.col(key)).otherwise(bad)

    return reduce(DataFrame.unionByName, [d.withColumn(key, shifted(i)) for i, d in enumerate(traces)])


def rank_columns(file_name: Column, pattern: str = RANK_FILE, axes: Sequence[str] = ("dp", "tp", "pp", "cp")) -> list[Column]:
    """Parallel ranks from a per-rank file name."""
    return [F.regexp_extract(file_name, pattern, i + 1).try_cast("int").alias(a) for i, a in enumerate(axes)]


def read_state(spark: SparkSession, path: str | Sequence[str], ranks_from_name: bool = False) -> DataFrame:
    """Typed tensor-state dump from parquet (step, stage, data JSON)."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.schema(sc.STATE_DUMP).parquet(*paths)
    if ranks_from_name:
        name = F.input_file_name()
        return typed_state(df.select("*", *[c.alias(f"f_{a}") for a, c in zip(("dp", "tp", "pp", "cp"), rank_columns(name))]))
    return typed_state(df)


def typed_state(dump: DataFrame) -> DataFrame:
    """step, stage, every data field as a typed column; ranks fall back to the file name's."""
    d = dump.withColumn("d", F.from_json("data", sc.STATE_DATA))
    cols = []
    for f in sc.STATE_DATA.fields:
        c = F.col("d").getField(f.name)
        if f"f_{f.name}" in dump.columns:
            c = F.coalesce(c, F.col(f"f_{f.name}"))
        cols.append(c.alias(f.name))
    return d.select("step", "stage", *cols)


# Rows each logical relation selects by data type or stage.
def relation_conditions() -> dict[str, Column]:
    t, s = F.lower(F.coalesce("type", F.lit(""))), F.col("stage")
    return {
        "tensor_state": F.col("cksum").isNotNull() & s.startswith("model-"),
        "grad_state": F.col("grad_cksum").isNotNull() | s.contains("grad"),
        "optimizer_state": F.col("state_key").isNotNull() | s.contains("optimizer-state"),
        "call_event": s.startswith("call"),
        "comm_event": s.startswith("comm"),
        "topology_lineage": (t == "parallel_metadata") | F.col("param_sharded").isNotNull(),
        "checkpoint_state": s.contains("checkpoint") | s.contains("save") | s.contains("load"),
        "loss_event": s.contains("loss"),
    }


def logical_relations(state: DataFrame) -> dict[str, DataFrame]:
    """Eight logical relations as selections over one typed dump."""
    return {n: state.where(c) for n, c in relation_conditions().items()}


def relation_sizes(state: DataFrame) -> DataFrame:
    """Rows per logical relation in one pass."""
    conds = relation_conditions()
    g = state.agg(*[F.count_if(c).alias(n) for n, c in conds.items()])
    return g.select(F.inline(F.array(*[F.struct(F.lit(n).alias("relation"), F.col(n).alias("n_rows")) for n in conds])))


def register_relations(state: DataFrame) -> list[str]:
    rel = logical_relations(state)
    for name, df in rel.items():
        df.createOrReplaceTempView(name)
    return list(rel)


# Names of the same lifecycle point in the different vocabularies.
STAGE_ALIAS = {
    "model-before-backward": "module.fwd.post", "model-after-backward": "module.bwd",
    "model-before-optimizer-step": "optim.step.pre", "model-after-optimizer-step": "optim.step.post",
    "main-grad-in-backward": "module.bwd", "training-batch": "dataloader.batch", "parallel-metadata": "build.snapshot",
    "optimizer-state": "optim.step.post",
}


def stream_trace(spark: SparkSession, path: str, schema: T.StructType = sc.ENVELOPE, max_files: int | None = None,
                 **options: str) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    for k, v in options.items():
        r = r.option(k, v)
    return r.parquet(path)


def trace_summary(trace: DataFrame) -> DataFrame:
    """Per hookpoint: events, first and last step, distinct steps and ranks."""
    return trace.groupBy("hookpoint").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("step").alias("min_step"), F.max("step").alias("max_step"),
        F.count_distinct("step").alias("n_steps"), F.count_distinct("rank").alias("n_ranks"))


def dump_summary(state: DataFrame, step: str = "step", stage: str = "stage", name: str = "name") -> DataFrame:
    return state.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(step).alias("n_steps"),
                     F.count_distinct(stage).alias("n_stages"), F.count_distinct(name).alias("n_params"),
                     F.min(step).alias("min_step"), F.max(step).alias("max_step"))


def json_key_catalog(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Top-level JSON keys with the number of rows that carry them, over all rows."""
    keys = df.select(*by, F.explode(F.json_object_keys(column)).alias("json_key"))
    return keys.groupBy(*by, "json_key").agg(F.count(F.lit(1)).alias("n_rows"))


def table_catalog(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    rows = [(t, i, f.name, f.dataType.simpleString()) for t, d in tables.items() for i, f in enumerate(d.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string")


def write_results(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append", partition: Sequence[str] = ()) -> None:
    w = df.write.mode(mode)
    if partition:
        w = w.partitionBy(*partition)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    elif fmt == "json":
        w.json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown result format {fmt!r}")


def read_results(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "csv") -> DataFrame:
    """Headered CSV or JSON lines with a declared schema (no inference pass)."""
    r = spark.read.schema(schema)
    return r.option("header", "true").csv(path) if fmt == "csv" else r.json(path)
