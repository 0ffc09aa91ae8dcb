"""Topology, feature and schema guards.

A constraint library is a short Python list known at planning time, so guards compile to
columns over the table of runs: one narrow projection per fleet, no pairing join.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlens.functions import exprs as X

GUARD_TEXT = r"^\s*(>=|<=|!=|==|=|>|<)\s*(.+?)\s*$"
NON_TOPOLOGY_KEYS = ("stage", "phase", "dtype", "_skip")

# Category each parallel axis switches on, and the categories always on.
AXIS_CATEGORY = {"dp": "data_parallel", "tp": "tensor_parallel", "pp": "pipeline_parallel", "ep": "expert_parallel",
                 "cp": "context_parallel"}
ALWAYS_CATEGORIES = ("model_integrity", "training_progress")


@dataclass(frozen=True)
class Constraint:
    name: str
    category: str = "model_integrity"
    kind: str = "consistency"
    guards: Mapping[str, str] = field(default_factory=dict)
    requires: tuple[tuple[str, str], ...] = ()
    parent: str | None = None
    level: int = 0


def parse_guard(text: str) -> tuple[str, str] | None:
    m = re.match(GUARD_TEXT, str(text))
    if not m:
        return None
    op = "==" if m.group(1) == "=" else m.group(1)
    return op, m.group(2).strip("'\"")


def guard_column(actual: Column, text: str) -> Column:
    """Guard known at planning time. Unparsable text passes; NULL (unknown key) passes."""
    parsed = parse_guard(text)
    if parsed is None:
        return F.lit(True)
    op, raw = parsed
    try:
        return F.coalesce(_compare(actual.try_cast("double"), op, F.lit(float(raw))), F.lit(True))
    except ValueError:
        have, want = F.lower(actual.cast("string")), F.lit(raw.lower())
        return F.coalesce({"==": have == want, "!=": have != want}.get(op, F.lit(False)), F.lit(True))


def _compare(a: Column, op: str, b: Column) -> Column:
    return {"==": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def guard_holds(actual: Column, text: Column) -> Column:
    """Guard text held in data: compare numerically when both sides are numbers, else as text."""
    op = F.regexp_extract(text, GUARD_TEXT, 1)
    raw = F.regexp_replace(F.regexp_extract(text, GUARD_TEXT, 2), r"^['\"]|['\"]$", "")
    a, b = actual.try_cast("double"), raw.try_cast("double")
    s, t = F.lower(actual.cast("string")), F.lower(raw)
    num = (F.when(op.isin("=", "=="), a == b).when(op == "!=", a != b).when(op == ">", a > b)
           .when(op == ">=", a >= b).when(op == "<", a < b).when(op == "<=", a <= b))
    txt = F.when(op.isin("=", "=="), s == t).when(op == "!=", s != t).when(op != "", F.lit(False))
    return F.coalesce(F.when((op == "") | actual.isNull(), F.lit(True)).when(a.isNotNull() & b.isNotNull(), num).otherwise(txt), F.lit(True))


def constraint_holds(c: Constraint, axes: Iterable[str]) -> Column:
    known = set(axes)
    cond = F.lit(True)
    for key, text in c.guards.items():
        if key in NON_TOPOLOGY_KEYS or key.startswith("pi_") or key not in known:
            continue
        cond = cond & guard_column(F.col(key), text)
    return cond


def skip_flag(c: Constraint, columns: Iterable[str]) -> Column:
    """Name-based skips: tied weights, sequence parallelism and sharded optimizers."""
    name, cols = c.name.lower(), set(columns)
    skip = F.lit(False)
    if ("weight_tying" in name or "权重共享" in name) and "untie_embeddings" in cols:
        skip = skip | F.col("untie_embeddings")
    if ("sequence_parallel" in name or "序列并行" in name) and "sequence_parallel" in cols:
        skip = skip | ~F.col("sequence_parallel")
    if ("zero" in name or "distributed_optimizer" in name) and "distributed_optimizer" in cols:
        skip = skip | ~F.col("distributed_optimizer")
    return F.coalesce(skip, F.lit(False))


def category_active(category: str, axes: Iterable[str]) -> Column:
    if category in ALWAYS_CATEGORIES:
        return F.lit(True)
    for axis, cat in AXIS_CATEGORY.items():
        if cat == category:
            return (F.col(axis) > 1) if axis in set(axes) else F.lit(False)
    return F.lit(True)


def applicable(runs: DataFrame, library: Sequence[Constraint], axes: Sequence[str], keep: Sequence[str] = ("run",),
               by_category: bool = False, skips: bool = False) -> DataFrame:
    """(run, constraint) pairs whose guards hold: one projection over the runs."""
    items = []
    for c in library:
        ok = constraint_holds(c, axes)
        if by_category:
            ok = ok & category_active(c.category, axes)
        if skips:
            ok = ok & ~skip_flag(c, runs.columns)
        items.append(F.when(ok, F.struct(F.lit(c.name).alias("constraint"), F.lit(c.category).alias("category"))))
    return runs.select(*keep, F.inline(F.filter(F.array(*items), lambda x: x.isNotNull())))


def active_categories(runs: DataFrame, axes: Sequence[str], keep: Sequence[str] = ("run",)) -> DataFrame:
    cats = [F.lit(c) for c in ALWAYS_CATEGORIES] + [F.when(F.col(a) > 1, F.lit(AXIS_CATEGORY[a])) for a in axes]
    return runs.select(*keep, F.explode(F.filter(F.array(*cats), lambda x: x.isNotNull())).alias("category"))


def parallel_degrees(ranks: DataFrame, by: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Degree of each axis: highest rank number + 1, 1 where the axis is absent."""
    return ranks.groupBy(*by).agg(*[(F.coalesce(F.max(a), F.lit(0)) + 1).cast("long").alias(f"{a}_size") for a in axes])


def schema_gaps(spark, library: Sequence[Constraint], captured: DataFrame) -> DataFrame:
    """Required (hookpoint, path) pairs that the captured profile lacks, per constraint."""
    need = [(c.name, h, p) for c in library for h, p in c.requires]
    req = spark.createDataFrame(need, "constraint string, hookpoint string, path string")
    return req.join(captured.select("hookpoint", "path").distinct(), ["hookpoint", "path"], "left_anti")


def stripped(guards: Column | str, mode: str) -> Column:
    """Guard map without topology guards (``no_topo``), without the others (``no_precond``) or empty."""
    topo = lambda k: k.isin(*AXIS_CATEGORY) | k.isin("sp", "zero_stage") | k.startswith("pi_")
    if mode == "no_topo":
        return F.map_filter(guards, lambda k, v: ~topo(k))
    if mode == "no_precond":
        return F.map_filter(guards, lambda k, v: topo(k))
    if mode == "none":
        return F.map_filter(guards, lambda k, v: F.lit(False))
    raise ValueError(f"unknown mode {mode!r}")


def strip_guards(constraints: DataFrame, column: str, mode: str) -> DataFrame:
    return constraints.withColumn(column, stripped(column, mode))


def guard_audit(records: DataFrame, keys: Sequence[str], size: str, equal: str) -> DataFrame:
    """Per key: records, skipped by the group-size guard, checked and unequal, with totals."""
    from guardlens.operators.relational import rollup_totals
    s, e = F.col(size), F.col(equal)
    return rollup_totals(records, keys, {
        "n_records": F.count(F.lit(1)), "n_skipped": F.count_if(s <= 1), "n_checked": F.count_if(s > 1),
        "n_unequal": F.count_if((s > 1) & (e == F.lit(False))),
        "n_skipped_unequal": F.count_if((s <= 1) & (e == F.lit(False)))})


def lineage(states: DataFrame, name: str, sharded: Column) -> DataFrame:
    """Replicated / sharded flag per parameter: sharded when any of its rows is marked so."""
    return states.groupBy(name).agg(F.max(sharded.cast("int")).alias("__s")).select(
        name, F.when(F.col("__s") == 1, "shard").otherwise("replica").alias("placement"))


def with_lineage(states: DataFrame, table: DataFrame, name: str, placement: str) -> DataFrame:
    return states.join(table.where(F.col("placement") == placement).select(name), name, "left_semi")


def parameter_label(name: Column, tp_sharded: Column, expert: Column) -> Column:
    return (F.when(expert | F.lower(name).contains("expert"), "expert_local").when(tp_sharded, "shard")
            .otherwise("replica"))


def module_labels(cls: Column) -> dict[str, Column]:
    return {"is_router": X.contains_any(cls, ("Router", "TopK")), "is_moe_layer": X.contains_any(cls, ("SwitchMLP", "MoE")),
            "is_tp_linear": X.contains_any(cls, ("ParallelLinear",)),
            "is_transformer_layer": X.contains_any(cls, ("TransformerLayer",))}


def feature_passive(rows: DataFrame, flags: DataFrame, by: Sequence[str], flag: str) -> DataFrame:
    """Rows of runs that declare the feature; runs without the flag are passive."""
    return rows.join(flags.where(F.col(flag)).select(*by), list(by), "left_semi")


def feature_status(rows: DataFrame, flags: DataFrame, by: Sequence[str], flag: str, violated: Column) -> DataFrame:
    """(by, n_violations, status): ``passive`` where the feature is off, undeclared (no flag row, or a null flag) or never seen in a row;
    else ``fail`` or ``pass``."""
    on = flags.groupBy(*by).agg(F.max(F.coalesce(F.col(flag), F.lit(False))).alias("__on"))
    seen = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.count_if(violated).alias("__bad"))
    j = on.join(seen, list(by), "full")
    active = F.coalesce("__on", F.lit(False)) & (F.coalesce("__n", F.lit(0)) > 0)
    n = F.when(active, F.col("__bad")).otherwise(0).cast("long")
    return j.select(*by, n.alias("n_violations"), F.when(~active, "passive").when(n > 0, "fail").otherwise("pass").alias("status"))
