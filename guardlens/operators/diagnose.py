"""Violations to explanations: context slices, outliers, constraint trees, root causes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlens import schema as sc
from guardlens.functions import exprs as X
from guardlens.functions import ordered
from guardlens.operators.relational import majority_minority
from guardlens.session import cut

EVENT_KEY = ("run", "rank", "event_id")  # every rank numbers its own events


def expand(violations: DataFrame, trace: DataFrame, fields: Sequence[str] = (
        "module_name", "module_class", "module_id", "callsite")) -> DataFrame:
    """Each violation with the envelope and the locating fields of its source event."""
    p = F.from_json("payload", sc.payload_schema(fields))
    src = trace.select(*EVENT_KEY, "hookpoint", F.col("step").alias("suspect_step"), p.alias("p"))
    j = violations.select("check_id", *EVENT_KEY, "entity", "issue", "observed").join(src, list(EVENT_KEY))
    return j.select("check_id", "run", "event_id", "hookpoint", "suspect_step", F.col("rank").alias("suspect_rank"), "entity", "issue",
                    "observed", *[F.col("p").getField(f).alias(f) for f in fields])


EVIDENCE_FIELDS: dict[str, tuple[str, ...]] = {
    "T0-clip-grad-bounded": ("fn", "max_norm", "pre_norm", "post_norm", "ratio"),
    "T0-no-nan-inf": ("inputs", "output", "outputs"),
    "T0-norm-output-unit-rms": ("output", "is_normalizer"),
    "T0-softmax-degenerate": ("output",),
    "T0-optim-step-counter-monotonic": ("optimizer_class", "state_step_max", "state_step_min"),
    "T0-initial-lr-present": ("scheduler_class", "last_epoch", "param_groups"),
    "T1-replica-cksum-equal": ("cross_rank_cksums",),
    "T1-expert-bias-fp32": ("semantic",),
}


def _evidence(check_id: str, p: Column) -> Column:
    d = X.json_detail
    if check_id == "T0-clip-grad-bounded":
        return d(fn=p.fn, max_norm=p.max_norm, pre_norm=p.pre_norm, post_norm=p.post_norm, ratio=p.ratio)
    if check_id == "T0-no-nan-inf":
        return d(n_inputs=F.coalesce(F.greatest(F.size(p.inputs), F.lit(0)), F.lit(0)),
                 n_outputs=F.when(p.output.isNotNull(), 1).otherwise(F.greatest(F.size(p.outputs), F.lit(0))))
    if check_id == "T0-norm-output-unit-rms":
        return d(shape=p.output.shape, l2_norm=p.output.l2_norm, is_normalizer=p.is_normalizer)
    if check_id == "T0-softmax-degenerate":
        return d(shape=p.output.shape, abs_max=X.first_nonzero(p.output.abs_max, p.output.max), l2_norm=p.output.l2_norm)
    if check_id == "T0-optim-step-counter-monotonic":
        return d(optimizer_class=p.optimizer_class, state_step_max=p.state_step_max, state_step_min=p.state_step_min)
    if check_id == "T0-initial-lr-present":
        missing = F.filter(p.param_groups, lambda g: ~F.coalesce(g.has_initial_lr, F.lit(False)))
        return d(scheduler_class=p.scheduler_class, last_epoch=p.last_epoch,
                 param_groups_missing_initial_lr=F.transform(missing, lambda g: g["index"]))
    if check_id == "T1-replica-cksum-equal":
        bad = F.get(F.filter(p.cross_rank_cksums, lambda r: (F.coalesce(r.group_size, F.lit(1).cast("long")) > 1)
                             & (r.all_equal == F.lit(False))), F.lit(0))
        return d(param_name=bad["name"], group_size=bad.group_size, gathered_cksums=bad.gathered_cksums,
                 outlier_rank=outlier_in_list(bad.gathered_cksums))
    return d(expert_bias_dtype=p.semantic.expert_bias_dtype, is_router=p.semantic.is_router)


def bug_evidence(violations: DataFrame, trace: DataFrame) -> DataFrame:
    """Check-specific evidence as JSON; checks without a projection get NULL."""
    fields = sorted({f for fs in EVIDENCE_FIELDS.values() for f in fs})
    p = F.col("p")
    src = trace.select(*EVENT_KEY, F.from_json("payload", sc.payload_schema(fields)).alias("p"))
    out = F.lit(None).cast("string")
    for cid in EVIDENCE_FIELDS:
        out = F.when(F.col("check_id") == cid, _evidence(cid, p)).otherwise(out)
    return violations.join(src, list(EVENT_KEY)).select("check_id", *EVENT_KEY, out.alias("evidence"))


def outlier_in_list(values: Column) -> Column:
    """Position of the unique minority value inside one (short) list, else NULL."""
    distinct = F.array_distinct(values)
    counted = F.transform(distinct, lambda v: F.struct(
        F.size(F.filter(values, lambda x: x == v)).alias("c"), (-F.array_position(values, v)).alias("neg")))
    rarest, most = F.array_min(counted), F.array_max(F.transform(counted, lambda s: s.c))
    ok = (F.size(distinct) > 1) & (F.size(values) > 2) & (rarest.c < most)
    return F.when(ok, (-rarest.neg - 1).cast("int"))


def outlier_replica(df: DataFrame, keys: Sequence[str], value: str, position: str) -> DataFrame:
    return majority_minority(df, keys, value, position)


def context_slice(violations: DataFrame, trace: DataFrame, by: Sequence[str], before: int = 6, after: int = 6,
                  span: int = 1 << 20) -> DataFrame:
    """Up to ``before``/``after`` neighbouring events with the same key, in event order.

    ``by`` is the key that makes events comparable, e.g. (run, module_id) or (run, hookpoint). The rank is always part
    of it: ids of different ranks have no order.
    """
    by = list(dict.fromkeys([*by, "rank"]))
    o = ordered.Order(tuple(by), "event_id", (), span)
    marks = violations.select(*by, "event_id", F.col("event_id").alias("violation_id"), "check_id")
    return ordered.neighbours(trace, o, before, after, marks, ["check_id", "violation_id"])


def context_events(violations: DataFrame, trace: DataFrame, before: int = 6, after: int = 6,
                   span: int = 1 << 20) -> DataFrame:
    """Context by module where the violating event names one, else by hookpoint.

    The trace is first restricted to the keys of the violations, so only their modules and
    hookpoints are numbered.
    """
    module = F.from_json("payload", sc.payload_schema(["module_id"])).getField("module_id")
    by_hook, by_module = F.concat(F.lit("h:"), "hookpoint"), F.concat(F.lit("m:"), F.col("__mid").cast("string"))
    t = trace.select(*EVENT_KEY, "step", "hookpoint", module.alias("__mid"))
    marks = violations.select("check_id", *EVENT_KEY).join(t, list(EVENT_KEY)).select(
        "check_id", *EVENT_KEY, F.coalesce(by_module, by_hook).alias("key"))
    marks = cut(marks, "marks")
    keyed = t.select(*EVENT_KEY, "step", "hookpoint",
                     F.explode(F.array_compact(F.array(by_hook, by_module))).alias("key"))
    keyed = keyed.join(marks.select("run", "rank", "key").distinct(), ["run", "rank", "key"], "left_semi")
    return context_slice(marks, keyed, ("run", "key"), before, after, span)


def hypothesis(check_id: Column, where: Column, step: Column, rank: Column, detail: Column) -> Column:
    """One sentence naming the suspected location."""
    # Suspected cause per check.
    causes = {
        "T0-clip-grad-bounded": "the clip path likely returned without scaling",
        "T0-no-nan-inf": "trace upstream events for the source",
        "T0-norm-output-unit-rms": "check eps placement and L2 versus RMS form",
        "T0-softmax-degenerate": "likely top-k before softmax over a size-1 dimension",
        "T0-optim-step-counter-monotonic": "bias correction never advances",
        "T0-initial-lr-present": "the optimizer configuration forgot initial_lr",
        "T1-replica-cksum-equal": "initialisation likely used the wrong generator",
        "T1-expert-bias-fp32": "a cast reached a parameter that should be excluded",
    }
    return F.concat_ws("", F.lit("violation of "), check_id, F.lit(" at "), where,
                       F.when(step.isNotNull(), F.concat(F.lit(" step "), step.cast("string"))),
                       F.when(rank.isNotNull(), F.concat(F.lit(" rank "), rank.cast("string"))),
                       F.when(detail.isNotNull(), F.concat(F.lit(": "), detail)),
                       F.concat(F.lit("; "), X.map_label(check_id, causes)))


# -- constraint tree -----------------------------------------------------------------------

# Stage names and check targets with their keywords, most specific first.
STAGES = ("model-before-backward", "model-after-backward", "model-before-optimizer-step", "model-after-optimizer-step",
          "main-grad-in-backward")
TARGETS = (("optimizer_state_dict", ("optimizer_state_dict",)), ("optimizer_state", ("optimizer_state", "优化器状态")),
           ("main_grad", ("main_grad", "主梯度", "main-grad")), ("grad", ("grad_cksum", "梯度cksum", "梯度校验")),
           ("cksum", ("cksum", "校验和")), ("requires_grad", ("requires_grad",)), ("dtype", ("dtype", "数据类型")),
           ("shape", ("shape", "形状")), ("distribution", ("distribution", "statistic", "分布", "统计", "均值", "方差")),
           ("bitwise", ("bitwise", "位级")), ("parameter", ("parameter", "参数一致", "参数属性")))
CRITICAL = ("cksum", "checksum", "梯度", "grad", "optimizer")
HIGH = ("shape", "dtype", "requires_grad", "同步", "sync")
ADVICE = (("cksum", "check parameter synchronisation of the stage"), ("checksum", "check parameter synchronisation of the stage"),
          ("dtype", "check mixed precision settings across ranks"), ("shape", "check model initialisation across ranks"),
          ("requires_grad", "check parameter freezing across ranks"), ("grad", "check gradient synchronisation in backward"),
          ("optimizer", "check optimizer initialisation and state synchronisation"))


def stage_of(name: Column, stage_condition: Column | None = None) -> Column:
    out = F.lit(None).cast("string")
    for s in reversed(STAGES):
        out = F.when(F.lower(name).contains(s), F.lit(s)).otherwise(out)
    if stage_condition is not None:
        out = F.coalesce(out, F.nullif(F.regexp_extract(stage_condition, "'([^']+)'", 1), F.lit("")))
    return F.coalesce(out, F.lit("general"))


def target_of(name: Column, description: Column | None = None) -> Column:
    text = F.lower(F.concat_ws(" ", name, description) if description is not None else name)
    out = F.lit("general")
    for t, words in reversed(TARGETS):
        out = F.when(X.contains_any(text, words), F.lit(t)).otherwise(out)
    return out


def cluster(constraints: DataFrame, name: str = "name", description: str | None = None) -> DataFrame:
    """Two-level hierarchy edges: every constraint under a parent per (stage, target).

    The parent is named by the common prefix of its children, which needs only the extremes.
    """
    c = constraints.withColumn("stage", stage_of(F.col(name))).withColumn(
        "target", target_of(F.col(name), F.col(description) if description else None))
    parents = c.groupBy("stage", "target").agg(F.min(name).alias("__lo"), F.max(name).alias("__hi"),
                                               F.count(F.lit(1)).alias("n_children"))
    prefix = X.common_prefix("__lo", "__hi")
    parents = parents.select("stage", "target", "n_children", F.concat_ws("|", "stage", "target").alias("parent"),
                             prefix.alias("common_name"))
    return c.join(parents, ["stage", "target"])


def drill_down(parents: DataFrame, evaluate_children: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Coarse to fine: children are evaluated only under failed parents.

    The restriction is a semi join inside one plan, so nothing is collected between levels.
    """
    return evaluate_children(parents.where(F.col("status") == "fail"))


def parent_status(children: DataFrame, parent: str = "parent", status: str = "status") -> DataFrame:
    s = F.col(status)
    return children.groupBy(parent).agg(
        F.when(F.max((s == "fail").cast("int")) == 1, "fail").when(F.max((s == "error").cast("int")) == 1, "error")
        .otherwise("pass").alias(status))


def with_ancestors(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, ancestor, distance) pairs by repeated joins, up to the roots or to ``depth`` levels.

    Edges: node, parent. Each round joins the frontier with the edge table and stores it; the rounds end when a
    frontier is empty. A node that is its own ancestor is an error.
    """
    e = edges.where(F.col("parent").isNotNull()).select("node", "parent")
    step = e.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
    frontier = e.select("node", F.col("parent").alias("ancestor")).withColumn("distance", F.lit(1))
    out, d = frontier, 1
    while depth is None or d < depth:
        d += 1
        frontier = cut(frontier.select("node", F.col("ancestor").alias("parent")).join(step, "parent")
                       .select("node", F.col("up").alias("ancestor"), F.lit(d).alias("distance")), "ancestors")
        if frontier.isEmpty():
            break
        if not frontier.where(F.col("node") == F.col("ancestor")).isEmpty():
            raise ValueError("the edges have a cycle")
        out = out.unionByName(frontier)
    return out


def severity(name: Column, path_length: Column) -> Column:
    low = F.lower(name)
    return (F.when(X.contains_any(low, CRITICAL), "critical").when(X.contains_any(low, HIGH), "high")
            .when(path_length > 2, "medium").otherwise("low"))


def root_causes(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """Failed leaves, and failed inner nodes none of whose children failed.

    nodes: node, parent, name, level, status. Adds the failed path length, whether every child
    passed, and the severity.
    """
    kids = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("status") == "fail").alias("n_failed_children"),
        F.count_if(F.col("status") == "pass").alias("n_passed_children"))
    failed = nodes.where(F.col("status") == "fail")
    leaf = failed.join(kids, "node", "left").fillna(0, ["n_children", "n_failed_children", "n_passed_children"])
    leaf = leaf.where(F.col("n_failed_children") == 0)
    anc = with_ancestors(nodes, depth).join(
        failed.select(F.col("node").alias("ancestor")), "ancestor").groupBy("node").agg(
        F.count(F.lit(1)).alias("n_failed_ancestors"), F.max_by("ancestor", "distance").alias("chain_start"))
    j = leaf.join(anc, "node", "left").fillna(0, ["n_failed_ancestors"])
    length = (F.col("n_failed_ancestors") + 1).cast("long")
    return j.select("node", "name", "level", length.alias("path_length"),
                    F.coalesce("chain_start", "node").alias("chain_start"),
                    (F.col("n_children") == F.col("n_passed_children")).alias("children_all_pass"),
                    severity(F.col("name"), length).alias("severity"))


def level_statistics(nodes: DataFrame) -> DataFrame:
    s = F.col("status")
    return nodes.groupBy("level").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if(s == "pass").alias("n_pass"), F.count_if(s == "fail").alias("n_fail"),
        F.count_if(s == "error").alias("n_error"), F.count_if(s.isNull()).alias("n_unchecked"))


def recommendations(causes: DataFrame, name: str = "name") -> DataFrame:
    """One advice per root cause by keyword, first match wins; duplicates are dropped."""
    low, out = F.lower(F.col(name)), F.lit("check consistency of the stage")
    for word, text in reversed(ADVICE):
        out = F.when(low.contains(word), F.lit(text)).otherwise(out)
    return causes.select(F.col(name).alias("constraint"), out.alias("advice")).distinct()


def tree_report(nodes: DataFrame) -> DataFrame:
    """Per parent: child counts by status and an indented text line."""
    s = F.col("status")
    g = nodes.where(F.col("parent").isNotNull()).groupBy("parent").agg(
        F.count(F.lit(1)).alias("n_children"), F.count_if(s == "fail").alias("n_fail"), F.count_if(s == "pass").alias("n_pass"))
    line = F.format_string("%s [%d children, %d fail, %d pass]", "parent", "n_children", "n_fail", "n_pass")
    return g.withColumn("line", line)


def label_map(column: Column, mapping: Mapping[str, str]) -> Column:
    return X.map_label(column, mapping)
