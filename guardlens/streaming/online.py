"""Online checking with Structured Streaming.

Row checks run on the micro-batch only. State that spans batches (last value per rank, trailing
buffer, violation snapshot) is kept as small tables in a shared folder, one sub-folder per batch
id, so a replayed batch overwrites its own output: results are exactly-once and survive a lost
executor or driver. Ordered state is *tails only* (at most the trailing window per key); the
rows of a batch are scanned with the two-level ordered functions, so one hot rank does not become
one task, as a keyed state function in Python would.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlens import schema as sc
from guardlens.functions import exprs as X
from guardlens.functions import ordered
from guardlens.operators import relational as R
from guardlens.operators.spec import ALL_GUARDS, Check, for_hookpoints, row_violations, violations, with_run


def stream_violations(stream: DataFrame, checks: Sequence[Check], watermark: str = "1 hour", time: str = "ts",
                      guards: frozenset[str] = ALL_GUARDS) -> DataFrame:
    """Row-check violations of a stream, each (check, event, entity, issue) emitted once.

    The built-in duplicate filter keeps its state within the watermark, so events later than that are dropped;
    ``incremental.IncrementalRunner`` keeps them.
    """
    rows = [c for c in checks if c.findings is not None]
    if time not in stream.columns and "ts_ns" in stream.columns:
        stream = stream.withColumn(time, F.timestamp_micros(F.floor(F.col("ts_ns") / 1000).cast("long")))
    keys = [k for k in ("run", "rank", "event_id") if k in stream.columns]
    marked = stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keys)
    return row_violations(marked, rows, guards)


def stream_replica_equality(stream: DataFrame, entity: Sequence[str], value: str, time: str = "ts",
                            watermark: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Disagreeing entities per window. min <> max is an exact distinct test with constant state."""
    g = (stream.withWatermark(time, watermark).groupBy(F.window(time, width), *entity)
         .agg(F.count(F.lit(1)).alias("n_rows"), F.min(value).alias("min_value"), F.max(value).alias("max_value")))
    return g.where(F.col("min_value") != F.col("max_value")).select(
        F.col("window.start").alias("window_start"), *entity, "n_rows", "min_value", "max_value")


def stream_step_counts(stream: DataFrame, keys: Sequence[str], guard: Column, limit: int = 1, time: str = "ts",
                       watermark: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Keys with more than ``limit`` guarded events in a window."""
    g = (stream.where(guard).withWatermark(time, watermark).groupBy(F.window(time, width), *keys)
         .agg(F.count(F.lit(1)).alias("n")))
    return g.where(F.col("n") > limit).select(F.col("window.start").alias("window_start"), *keys, "n")


def sample_every(df: DataFrame, keys: Sequence[str], order: str, rate: float, span: int = 1 << 20) -> DataFrame:
    """Every K-th event per key in event order, K = round(1 / rate), rate clamped to [0, 1]."""
    rate = min(max(float(rate), 0.0), 1.0)
    if rate == 0.0:
        return df.where(F.lit(False))
    if rate == 1.0:
        return df
    k = max(int(round(1.0 / rate)), 1)
    d = ordered.with_ordinal(df, ordered.Order(tuple(keys), order, (), span), "__n")
    return d.where(F.pmod(F.col("__n") - 1, F.lit(k)) == 0).drop("__n")


def sample_by_hash(df: DataFrame, key: str, rate: float) -> DataFrame:
    """Stateless form for streams: a key is kept whole if its hash lies in the first ``rate`` of the range."""
    rate = min(max(float(rate), 0.0), 1.0)
    return df.where(X.hash_order(0, key) < rate * (1 << 32))


def sample_hooks(df: DataFrame, rates: dict[str, float], key: str = "event_id") -> DataFrame:
    """The share ``rates`` says of the events of each named hookpoint, by the same hash as ``sample_by_hash``; all of the others."""
    keep = F.lit(True)
    for hook, rate in rates.items():
        kept = X.hash_order(0, key) < min(max(float(rate), 0.0), 1.0) * (1 << 32)
        keep = keep & (~F.col("hookpoint").eqNullSafe(hook) | kept)
    return df.where(keep) if rates else df


def replay_first_tick(found: DataFrame, every: int, keys: Sequence[str] = ("check_id",), order: str = "event_id") -> DataFrame:
    """First tick at which each key's violation surfaces when events arrive ``every`` per tick."""
    return found.groupBy(*keys).agg(F.min(F.ceil(F.col(order) / F.lit(every))).cast("long").alias("first_tick"))


def violations_per_tick(found: DataFrame, every: int, order: str = "event_id") -> DataFrame:
    d = found.withColumn("tick", F.ceil(F.col(order) / F.lit(every)).cast("long"))
    return d.groupBy("check_id", "tick").agg(F.count_distinct(order).alias("n_new"))


def trailing_anomalies(metrics: DataFrame, keys: Sequence[str], order: str, loss: str, grad_norm: str, window: int = 20,
                       spike: float = 10.0, span: int = 1 << 20) -> DataFrame:
    """First anomaly signals per key: non-finite loss, non-finite gradient norm, loss above
    spike x trailing median, gradient norm above spike x trailing maximum.

    Returns every flagged row with its signal; full windows only for the spike signals.
    """
    o = ordered.Order(tuple(keys), order, (), span)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf")))
    d = ordered.trailing(metrics, o, window, {
        "base_n": F.count(F.lit(1)), "base_median": F.percentile(loss, 0.5), "base_max": F.max(grad_norm)})
    full = F.col("base_n") == window
    signal = (F.when(F.col(loss).isNotNull() & ~finite(loss), "loss_nan")
              .when(F.col(grad_norm).isNotNull() & ~finite(grad_norm), "grad_nan")
              .when(full & (F.col("base_median") > 0) & (F.col(loss) > F.col("base_median") * spike), "loss_spike")
              .when(full & (F.col("base_max") > 0) & (F.col(grad_norm) > F.col("base_max") * spike), "gradnorm_spike"))
    return d.withColumn("signal", signal).where(F.col("signal").isNotNull()).drop("base_n")


SIGNAL_ORDER = ("loss_nan", "grad_nan", "loss_spike", "gradnorm_spike")


def first_signal(flagged: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Verdict per key: the strongest signal kind present, and where it first appears."""
    p = F.lit(len(SIGNAL_ORDER))
    for i, s in enumerate(SIGNAL_ORDER):
        p = F.when(F.col("signal") == s, F.lit(i)).otherwise(p)
    return flagged.withColumn("__p", p).groupBy(*keys).agg(
        F.min_by("signal", F.struct("__p", order)).alias("trigger_signal"),
        F.min_by(order, F.struct("__p", order)).alias("trigger_at"))


class BatchState:
    """Versioned small tables in a shared folder: ``root/name/batch=<id>``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str, batch: int) -> str:
        return f"{self.root}/{name}/batch={batch}"

    def write(self, name: str, batch: int, df: DataFrame, partition: Sequence[str] = ()) -> DataFrame:
        w = df.write.mode("overwrite")
        (w.partitionBy(*partition) if partition else w).parquet(self.path(name, batch))
        return self.read(name, batch, df)

    def read(self, name: str, batch: int, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name, batch)).select(*like.columns)

    def previous(self, name: str, batch: int, like: DataFrame) -> DataFrame | None:
        return self.read(name, batch - 1, like) if batch > 0 else None

    def all(self, name: str, schema) -> DataFrame:
        """All batches; ``batch`` is a partition column and is left out."""
        d = self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        return d.drop("batch")


class OnlineMonotonic:
    """Counter progress across micro-batches; state is one tail row per key."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], order: str, value: str, span: int = 1 << 20):
        self.state, self.keys, self.order, self.value, self.span = BatchState(spark, root), list(keys), order, value, span

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        cols = [*self.keys, self.order, self.value]
        rows = batch.where(F.col(self.value).isNotNull()).select(*cols)
        old = self.state.previous("tails", batch_id, rows)
        seen = rows.withColumn("is_new", F.lit(True))
        if old is not None:
            seen = seen.unionByName(old.withColumn("is_new", F.lit(False)))
        o = ordered.Order(tuple(self.keys), self.order, (), self.span)
        d = ordered.with_previous(seen, self.value, o, "prev")
        bad = d.where(F.col("is_new") & ~(F.col(self.value) > F.col("prev"))).select(*cols, "prev")
        self.state.write("violations", batch_id, bad)
        tails = R.top_k(seen.select(*cols), self.keys, 1, F.desc(self.order))
        self.state.write("tails", batch_id, tails)


class OnlineTrailing:
    """Trailing-baseline anomalies across micro-batches; state is the last ``window`` rows per key."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], order: str, loss: str, grad_norm: str,
                 window: int = 20, spike: float = 10.0):
        self.state, self.keys, self.order = BatchState(spark, root), list(keys), order
        self.loss, self.grad_norm, self.window, self.spike = loss, grad_norm, window, spike

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        cols = list(dict.fromkeys([*self.keys, self.order, self.loss, self.grad_norm]))
        rows = batch.select(*cols)
        old = self.state.previous("tails", batch_id, rows)
        seen = rows.withColumn("is_new", F.lit(True))
        if old is not None:
            seen = seen.unionByName(old.withColumn("is_new", F.lit(False)))
        flagged = trailing_anomalies(seen, self.keys, self.order, self.loss, self.grad_norm, self.window, self.spike)
        self.state.write("anomalies", batch_id, flagged.where("is_new").select(*cols, "signal"))
        self.state.write("tails", batch_id, R.top_k(seen.select(*cols), self.keys, self.window, F.desc(self.order)))


class OnlineRunner:
    """Rule evaluation per micro-batch with new / retired violations and tick metrics.

    Only checks bound to a hookpoint of the batch are planned. Row checks read the batch. Frame
    checks need history: the batch is appended to the trace table and they are re-evaluated over
    the runs the batch touched, then compared with the snapshot of the tick before.
    """

    KEYS = ["check_id", "run", "rank", "event_id", "entity", "issue"]

    def __init__(self, spark: SparkSession, root: str, checks: Sequence[Check], guards: frozenset[str] = ALL_GUARDS,
                 sample_rates: dict[str, float] | None = None):
        self.spark, self.checks, self.guards = spark, list(checks), guards
        self.state = BatchState(spark, root)
        self.sample_rates = sample_rates or {}

    def _sampled(self, df: DataFrame) -> DataFrame:
        return sample_hooks(df, self.sample_rates)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        # partitioned by hookpoint, so a re-evaluated frame check reads only its own hookpoints
        trace = self.state.write("trace", batch_id, self._sampled(with_run(batch)), ["hookpoint"])
        # at most one row per hookpoint name of the trace format
        stats = trace.groupBy("hookpoint").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last")).collect()
        active = for_hookpoints(self.checks, [r.hookpoint for r in stats])
        rows = [c for c in active if c.findings is not None]
        frames = [c for c in active if c.frame is not None]
        parts = []
        if rows:
            parts.append(violations(trace, rows, self.guards).select(*self.KEYS))
        history = self.state.all("trace", trace.schema)
        old = self._snapshot(batch_id - 1)
        touched = trace.select("run").distinct()
        if frames:
            now = violations(history.join(touched, "run", "left_semi"), frames, self.guards).select(*self.KEYS).distinct()
            ids = [c.check_id for c in frames]
            kept = old.where(~F.col("check_id").isin(*ids)).unionByName(
                old.where(F.col("check_id").isin(*ids)).join(touched, "run", "left_anti")) if old is not None else None
            current = now if kept is None else now.unionByName(kept)
        else:
            current = old
        if current is not None:
            current = self.state.write("snapshot", batch_id, current)
            if old is None:
                parts.append(current)
                retired = current.where(F.lit(False))
            else:
                parts.append(_null_safe_anti(current, old, self.KEYS))
                retired = _null_safe_anti(old, current, self.KEYS)
            self.state.write("retired", batch_id, retired)
        if parts:
            new = self.state.write("new", batch_id, reduce(DataFrame.unionByName, parts))
            n_new = new.count()
        else:
            n_new = 0
        metrics = self.spark.createDataFrame(
            [(batch_id, sum(r.n for r in stats), len(active), n_new, max((r["last"] for r in stats), default=None))],
            "tick long, n_new_events long, n_rules_evaluated int, n_new_violations long, last_event_id long")
        self.state.write("metrics", batch_id, metrics)

    def _snapshot(self, batch_id: int) -> DataFrame | None:
        """Frame-check violations after the given tick; None until a frame check has run."""
        if batch_id < 0:
            return None
        fields = {f.name: f for f in sc.VIOLATION.fields}
        schema = sc.T.StructType([fields[k] for k in self.KEYS])
        try:
            return self.spark.read.schema(schema).parquet(self.state.path("snapshot", batch_id))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None


def _null_safe_anti(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    r = b.select(*[F.col(k).alias(f"__r_{k}") for k in keys])
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return a.join(r, cond, "left_anti")


def run_batches(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str) -> list[int]:
    """Drive a handler over all available data, one micro-batch after the other.

    Returns the wall time of the recent batches in milliseconds.
    """
    q = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return [p["durationMs"]["triggerExecution"] for p in q.recentProgress if p["numInputRows"] > 0]


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
