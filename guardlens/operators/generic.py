"""Relation-operator families: each returns the rows that break the relation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlens.functions import ordered
from guardlens.operators import state

equality_across_replicas = state.replica_equality

# Catalog of obligations and the operator family each belongs to.
CATALOG: tuple[tuple[str, str, str], ...] = (
    ("T01", "cross-rank-replica-equality", "equality_across_ranks"),
    ("T02", "logged-metric-reduction-consistency", "equality_across_ranks"),
    ("T03", "config-invariant-execution-equivalence", "reference_equivalence"),
    ("T04", "spec-reference-conformance", "reference_equivalence"),
    ("T05", "designated-dtype-fidelity", "dtype_preservation"),
    ("T06", "storage-dtype-interpretation-match", "dtype_preservation"),
    ("T07", "gradient-accumulation-conservation", "conservation"),
    ("T08", "scale-factor-consistency", "value_scaling_consistency"),
    ("T09", "gradient-norm-computation-fidelity", "value_scaling_consistency"),
    ("T10", "producer-consumer-completion-ordering", "ordering"),
    ("T11", "checkpoint-restore-state-equality", "restoration_after_reload"),
    ("T12", "checkpoint-save-completeness", "count_frequency_match"),
    ("T13", "dataloader-bookkeeping-reset", "restoration_after_reload"),
    ("T14", "scaling-scalar-finiteness", "boundedness"),
    ("T15", "counter-monotonic-progress", "monotonicity"),
    ("T16", "positional-encoding-position-fidelity", "index_consistency"),
    ("T17", "loss-parameter-gradient-connectivity", "gradient_flow"),
    ("T18", "configured-value-effectiveness", "config_effectiveness"),
    ("T19", "packed-sequence-attention-isolation", "exclusivity"),
    ("T20", "padding-loss-exclusion", "exclusivity"),
    ("T21", "overflow-skip-step-validity", "count_frequency_match"),
    ("T22", "parameter-update-effectiveness", "update_effectiveness"),
    ("T23", "unrelated-operation-state-preservation", "state_preservation"),
    ("T24", "intra-run-recomputation-determinism", "determinism"),
    ("T25", "sharded-layout-conformance", "sharding_layout_consistency"),
    ("T26", "exactly-once-side-effect", "count_frequency_match"),
    ("T27", "init-distribution-conformance", "value_scaling_consistency"),
    ("T28", "master-working-weight-copy-fidelity", "copy_consistency"),
    ("T29", "router-gate-probability-range-validity", "boundedness"),
    ("T30", "static-attention-pattern-mass-exclusion", "exclusivity"),
    ("T31", "sort-key-order-conformance", "ordering"),
    ("T32", "pipeline-layer-partition-conformance", "structural_integrity"),
    ("T33", "supervision-label-index-range-validity", "boundedness"),
    ("T34", "training-step-budget-data-sufficiency", "count_frequency_match"),
    ("T35", "frozen-parameter-update-exclusion", "exclusivity"),
)


def catalog(spark) -> DataFrame:
    return spark.createDataFrame(list(CATALOG), "template_id string, name string, relation_operator string")


def catalog_template(template_id: str) -> tuple[str, str, str]:
    for t in CATALOG:
        if t[0] == template_id:
            return t
    raise ValueError(f"unknown catalog template {template_id!r}")


def reference_equivalence(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str,
                          rel_tol: float = 1e-5) -> DataFrame:
    """Full outer comparison by key: missing on one side, or relative difference above tolerance."""
    l = left.select(*keys, F.col(value).alias("left_value"))  # noqa: E741
    r = right.select(*keys, F.col(value).alias("right_value"))
    j = l.withColumn("__l", F.lit(1)).join(r.withColumn("__r", F.lit(1)), list(keys), "full_outer")
    diff = F.abs(F.col("left_value") - F.col("right_value")) > F.abs(F.col("right_value")) * rel_tol
    status = (F.when(F.col("__l").isNull(), "missing_left").when(F.col("__r").isNull(), "missing_right")
              .when(F.col("left_value").isNull() != F.col("right_value").isNull(), "differs")
              .when(diff, "differs"))
    return j.withColumn("status", status).where(F.col("status").isNotNull()).drop("__l", "__r")


def dtype_preservation(before: DataFrame, after: DataFrame, keys: Sequence[str], dtype: str) -> DataFrame:
    b = before.select(*keys, F.col(dtype).alias("dtype_before"))
    a = after.select(*keys, F.col(dtype).alias("dtype_after"))
    return b.join(a, list(keys)).where(~F.col("dtype_before").eqNullSafe(F.col("dtype_after")))


def round_trip_drift(df: DataFrame, before: Column, after: Column, rel: float = 1e-6) -> DataFrame:
    """Value changed by a cast / offload round trip beyond the relative drift allowed."""
    drift = F.abs(before - after) / F.greatest(F.abs(before), F.lit(1e-12))
    return df.withColumn("rel_drift", drift).where(F.col("rel_drift") > rel)


def stale_copy(df: DataFrame, cached: Column, actual: Column, absolute: float = 1e-6) -> DataFrame:
    """Rows whose cached value is off the value it stands for by more than an absolute tolerance; a missing or NaN side is stale too
    unless both are."""
    known = cached.isNotNull() & ~F.isnan(cached), actual.isNotNull() & ~F.isnan(actual)
    gap = F.abs(cached - actual)
    bad = F.when(known[0] & known[1], gap > absolute).otherwise(known[0] | known[1])
    return df.withColumn("gap", F.when(known[0] & known[1], gap)).where(bad)


def conservation(parts: DataFrame, totals: DataFrame, keys: Sequence[str], part: Column, total: str,
                 rel_tol: float = 1e-6) -> DataFrame:
    """Parts summed per key (combined before the shuffle) against the declared total."""
    s = parts.groupBy(*keys).agg(F.sum(part).alias("parts_sum"), F.count(F.lit(1)).alias("n_parts"))
    j = s.join(totals.select(*keys, F.col(total).alias("total")), list(keys))
    return j.where(F.abs(F.col("parts_sum") - F.col("total")) > F.abs(F.col("total")) * rel_tol)


def value_scaling(df: DataFrame, value: Column, factor: Column, expected: Column, lo: float = 0.5,
                  hi: float = 1.5) -> DataFrame:
    """Ratio of the scaled value to the expected one outside [lo, hi]."""
    return (df.withColumn("scale_ratio", (value * factor) / F.nullif(expected, F.lit(0.0)))
            .where(~F.col("scale_ratio").between(lo, hi)))


def ordering(first: DataFrame, second: DataFrame, keys: Sequence[str], first_time: str, second_time: str) -> DataFrame:
    """Keys where the second event starts before the last first event has completed."""
    a = first.groupBy(*keys).agg(F.max(first_time).alias("first_done"))
    b = second.groupBy(*keys).agg(F.min(second_time).alias("second_start"))
    return a.join(b, list(keys)).where(F.col("second_start") < F.col("first_done"))


def sort_order(df: DataFrame, key: str, order: ordered.Order) -> DataFrame:
    """Rows whose sort key is below the preceding row's key."""
    return ordered.with_previous(df, key, order, "prev_key").where(F.col(key) < F.col("prev_key"))


def restoration(saved: DataFrame, loaded: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """State that differs (or vanished) after a reload."""
    s = saved.select(*keys, F.struct(*values).alias("saved"))
    l = loaded.select(*keys, F.struct(*values).alias("loaded"))  # noqa: E741
    return s.join(l, list(keys), "left").where(~F.col("saved").eqNullSafe(F.col("loaded")))


def counter_reset(df: DataFrame, order: ordered.Order, counter: str, boundary: Column, start: int = 0) -> DataFrame:
    """First row after each boundary must carry the start value again."""
    d = ordered.with_previous(df.withColumn("__bd", boundary.cast("int")), "__bd", order, "__prev_bd")
    return d.where((F.col("__prev_bd") == 1) & (F.col(counter) != start)).drop("__bd", "__prev_bd")


def count_match(df: DataFrame, keys: Sequence[str], expected: int | DataFrame, name: str = "expected") -> DataFrame:
    """Keys whose row count differs from a literal or from a joined expectation."""
    c = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    if isinstance(expected, DataFrame):
        j = c.join(expected, list(keys), "full_outer").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
        return j.where(~F.col("n_rows").eqNullSafe(F.col(name)))
    return c.where(F.col("n_rows") != expected).withColumn(name, F.lit(expected).cast("long"))


def boundedness(df: DataFrame, value: str, lo: float | None, hi: float | None) -> DataFrame:
    v = F.col(value)
    bad = F.isnan(v.cast("double"))
    if lo is not None:
        bad = bad | (v < lo)
    if hi is not None:
        bad = bad | (v > hi)
    return df.where(v.isNotNull() & bad)


def monotonicity(df: DataFrame, value: str, order: ordered.Order, strict: bool = True) -> DataFrame:
    d = ordered.with_previous(df.where(F.col(value).isNotNull()), value, order, "prev_value")
    return d.where(~(F.col(value) > F.col("prev_value")) if strict else F.col(value) < F.col("prev_value"))


def index_consistency(df: DataFrame, position: str, order: ordered.Order) -> DataFrame:
    """Positions must count 0,1,2,… inside each group, starting again at every boundary."""
    return (ordered.with_ordinal(df, order, "__ord").withColumn("expected_position", (F.col("__ord") - 1).cast("long"))
            .where(F.col(position) != F.col("expected_position")).drop("__ord"))


def nonzero_expected(df: DataFrame, value: str, guard: Column | None = None) -> DataFrame:
    """Gradient flow / update effectiveness: zero where the guard demands an effect."""
    c = F.col(value) == 0
    return df.where(c if guard is None else c & guard)


def config_effectiveness(states: DataFrame, config: DataFrame, keys: Sequence[str], flag: str, effect: Column) -> DataFrame:
    """Configuration switched on but the state shows no effect (implication)."""
    on = config.where(F.col(flag)).select(*keys, flag)
    return states.join(on, list(keys)).where(~F.coalesce(effect, F.lit(False)))


def exclusivity(df: DataFrame, keys: Sequence[str], masked: Column, value: Column) -> DataFrame:
    """Masked rows must contribute nothing: non-zero sums under the mask, per key."""
    g = df.groupBy(*keys).agg(F.sum(F.when(masked, value)).alias("masked_sum"), F.count_if(masked).alias("n_masked"))
    return g.where(F.col("masked_sum") != 0)


def state_preservation(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys present in both snapshots whose value changed (also determinism / copy fidelity)."""
    b = before.select(*keys, F.col(value).alias("before"))
    a = after.select(*keys, F.col(value).alias("after"))
    return b.join(a, list(keys)).where(~F.col("before").eqNullSafe(F.col("after")))


def layout_conformance(shards: DataFrame, full: DataFrame, keys: Sequence[str], shard_size: str, full_size: str) -> DataFrame:
    """Shard sizes must add up to the full size."""
    s = shards.groupBy(*keys).agg(F.sum(shard_size).alias("shards_total"), F.count(F.lit(1)).alias("n_shards"))
    return (s.join(full.select(*keys, F.col(full_size).alias("full_total")), list(keys))
            .where(F.col("shards_total") != F.col("full_total")))


def structural_integrity(df: DataFrame, keys: Sequence[str], part: str, declared: DataFrame, name: str) -> DataFrame:
    """Distinct parts per key against a declared count."""
    n = df.groupBy(*keys).agg(F.count_distinct(part).alias("n_parts"))
    return n.join(declared, list(keys)).where(F.col("n_parts") != F.col(name))
