"""Session defaults.

Nothing here overrides what a cluster already sets: a deployment passes its own
master, shuffle partitions and checkpoint folder and these are kept.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # plans are large: do not record a Python call site for every column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g",
                  app: str = "guardlens") -> SparkSession:
    """Single-machine session for tests and the bench; a cluster uses spark-submit."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(partitions))
         .config("spark.driver.memory", memory))
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_fallback_root: str | None = None


def work_folder(spark: SparkSession, name: str) -> str:
    """New folder for intermediate tables and stream state.

    Lives under the shared folder the cluster names in ``spark.checkpoint.dir``; only where that
    is unset and all runs on one machine (tests) a local temporary folder takes its place.
    """
    global _fallback_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _fallback_root is None:
            _fallback_root = tempfile.mkdtemp(prefix="guardlens-")
        root = _fallback_root
    return f"{root.rstrip('/')}/guardlens-{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result once to the shared folder and continue from the table.

    Used where a plan refers to the same expensive input several times; the table also cuts the
    lineage, so a lost executor re-reads files instead of recomputing.
    """
    spark = df.sparkSession
    path = work_folder(spark, name)
    for made in _scratch:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ROWS_A_TASK = 1 << 18


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows dealt by their keys over as many tasks as ``rows`` of the input need.

    For groups about as many as rows: a task's table of groups then has one size whatever the input, where a fixed number of
    shuffle partitions would let it grow.
    """
    return df.repartition(max(1, -(-rows // ROWS_A_TASK)), *keys)


_scratch: list[list[str]] = []


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The folders that ``cut`` makes inside the block, for ``discard`` once nothing unwritten reads them."""
    made: list[str] = []
    _scratch.append(made)
    try:
        yield made
    finally:
        _scratch[:] = [m for m in _scratch if m is not made]


def discard(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete folders of this library, through the file system that holds them."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not path.getName().startswith("guardlens-"):
            raise ValueError(f"{folder} is not a folder of this library")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
