"""Schema profiling, candidate constraints, healthy-run validation and baselines.

Candidate lists are bounded by the *schema* (paths x relation types, capped per hypothesis),
never by the data, so they are planned on the driver and become columns of one aggregate.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlens.functions import exprs as X
from guardlens.functions import ordered
from guardlens.functions import quantiles as Q
from guardlens.functions.sqlfuncs import JsonLeaves
from guardlens.operators.candidates import GUARD, NON_STANDARD, candidate_failures
from guardlens.operators.spec import OPS, with_run
from guardlens.session import cut

# Fields whose constraints are kept without further evidence.
GENUINE_FIELDS = ("all_equal", "has_nan", "has_inf", "has_initial_lr", "preserve_rng_state", "expert_bias_dtype",
                  "post_norm", "rms", "n_parameters", "n_modules", "state_step_max", "state_step_min")
COMPANIONS = (("post_norm", "max_norm", "<="), ("post_norm", "pre_norm", "<="), ("lr", 0, ">"), ("learning_rate", 0, ">"))


# -- profile -------------------------------------------------------------------------------

def schema_profile(trace: DataFrame, hookpoint: str = "hookpoint", payload: str = "payload",
                   key: str = "event_id") -> DataFrame:
    """(hookpoint, path, type, n_events): leaf paths of every payload, whole table.

    Payloads are counted per structural type inside the JVM by hash aggregation; one
    representative payload per distinct structure is then fetched by key and walked in Python.
    """
    raw = F.col(payload)
    clean = F.when(raw.contains("NaN") | raw.contains("Infinity"), F.regexp_replace(raw, NON_STANDARD, "0.5")).otherwise(raw)

    def shape_of(c: str) -> Column:
        # never NULL: a NULL test would be pushed below and parse every payload a second time
        kind = F.regexp_replace(F.schema_of_variant(F.try_parse_json(c)),
                                r"DECIMAL\(\d+, ?\d+\)|BIGINT|DOUBLE|FLOAT", "NUMBER")
        return F.coalesce(kind, F.lit(""))

    docs = trace.select(F.col(hookpoint).alias("hookpoint"), F.col(key).alias("__key"), clean.alias("doc"))
    counted = (docs.select("hookpoint", "__key", shape_of("doc").alias("shape"))
               .groupBy("hookpoint", "shape").agg(F.count(F.lit(1)).alias("n"), F.min("__key").alias("__key")))
    # a stored flag: a condition on the shape itself would be inferred for the documents too and parse every payload again
    counted = cut(counted.withColumn("parsed", F.col("shape") != ""), "payload-shapes").where("parsed").drop("parsed")
    # fetch one document per shape by its key; keys may repeat across runs, so the shape is tested again
    found = docs.join(counted.select("hookpoint", "__key").distinct(), ["hookpoint", "__key"], "left_semi")
    found = found.select("hookpoint", "doc", shape_of("doc").alias("shape")).dropDuplicates(["hookpoint", "shape"])
    shapes = found.join(counted, ["hookpoint", "shape"])
    leaves = shapes.lateralJoin(JsonLeaves(F.col("doc").outer()))
    return leaves.groupBy("hookpoint", "path", "type").agg(F.sum("n").alias("n_events"))


def resolve_hookpoints(profile: DataFrame, hints: Sequence[str]) -> DataFrame:
    """Hookpoints related to the hints by prefix either way; all of them when none matches."""
    hooks = profile.select("hookpoint").distinct()
    cond = F.lit(False)
    for h in hints:
        cond = cond | F.col("hookpoint").startswith(h) | F.lit(h).startswith(F.col("hookpoint"))
    flagged = hooks.withColumn("hit", cond)
    any_hit = flagged.agg(F.max("hit").alias("any_hit"))
    return flagged.where(F.col("hit") | ~any_hit.scalar()).select("hookpoint")


def resolve_fields(profile: DataFrame, dimension: str) -> DataFrame:
    """Best-tier field matches per hookpoint: exact path, then path suffix, then leaf name."""
    path = F.col("path")
    leaf = F.element_at(F.split(path, r"\."), -1)
    tier = (F.when(path == f"$.{dimension}", 1).when(path.endswith(f".{dimension}"), 2)
            .when(leaf.contains(dimension), 3))
    p = profile.select("hookpoint", "path").distinct().withColumn("tier", tier).where(F.col("tier").isNotNull())
    best = p.groupBy("hookpoint").agg(F.min("tier").alias("tier"))
    return p.join(best, ["hookpoint", "tier"]).select("hookpoint", "path", "tier")


# -- candidates ----------------------------------------------------------------------------

@dataclass(frozen=True)
class Candidate:
    candidate_id: str
    relation: str
    hookpoint: str
    field: str
    op: str = ">"
    value: object = 0
    value_is_field: bool = False

    @property
    def head(self) -> str:
        return self.field


CANDIDATE_SCHEMA = ("candidate_id string, relation string, hookpoint string, field string, op string, "
                    "value string, value_is_field boolean")

RELATIONS = ("monotonic", "positive", "stat_positive", "nonzero", "all_equal")


def parametric_candidates(profile: DataFrame, relations: Sequence[str] = RELATIONS,
                          cap: int | None = None) -> DataFrame:
    """Candidates for every (hookpoint, field) of the profile; list elements are skipped.

    All are returned, unless the caller caps them per (relation, hookpoint); ``n_dropped`` then says how many
    candidates of the group are left out.
    """
    name = F.regexp_replace("path", r"^\$\.", "")
    number = F.col("type") == "number"
    stat = number & F.col("path").rlike(r"l2_norm|\.max|\.min|_norm")
    rules = {"monotonic": (number, "csm", "", "increasing", None), "positive": (number, "pfc", "_positive", ">", "0"),
             "stat_positive": (stat, "tsb", "_positive", ">", "0"), "nonzero": (number, "sp", "_nonzero", ">", "0"),
             "all_equal": (F.col("path").endswith(".all_equal"), "cre", "", "==", "true")}
    items = []
    # fixed values: the forms of candidate ids ("hyp/...", here and in shape_candidates), by which results are compared
    for r in relations:
        cond, code, suffix, op, value = rules[r]
        items.append(F.when(cond, F.struct(
            F.concat(F.lit(f"hyp/param/{code}/"), F.col("hookpoint"), F.lit("/"), name, F.lit(suffix)).alias("candidate_id"),
            F.lit(r).alias("relation"), F.col("hookpoint"), name.alias("field"), F.lit(op).alias("op"),
            F.lit(value).cast("string").alias("value"), F.lit(False).alias("value_is_field"))))
    c = (profile.where(~F.col("path").contains("[*]"))
         .select(F.inline(F.filter(F.array(*items), lambda x: x.isNotNull()))))
    c = c.dropDuplicates(["candidate_id"])
    if cap is None:
        return c
    group = Window.partitionBy("relation", "hookpoint")
    return (c.withColumn("__rn", F.row_number().over(group.orderBy("candidate_id")))
            .withColumn("n_dropped", F.greatest(F.count(F.lit(1)).over(group) - cap, F.lit(0)))
            .where(F.col("__rn") <= cap).drop("__rn"))


def shape_candidates(profile: DataFrame) -> DataFrame:
    """Six shape-specific enumerators over the profile; a candidate of several fields has a row for each."""
    paths = profile.groupBy("hookpoint").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    has = lambda p: F.array_contains("paths", p)
    ends = lambda s: F.exists("paths", lambda p: p.endswith(s))
    hook = F.col("hookpoint")

    def guard(scope, fld, op, value):
        return F.struct(F.lit(scope).alias("scope"), F.lit(fld).alias("field"), F.lit(op).alias("op"), F.lit(value).alias("value"))

    def cand(cond, cid, relation, fld, op, value, is_field=False, only=None, walk=False):
        return F.when(cond, F.struct(cid.alias("candidate_id"), F.lit(relation).alias("relation"), hook.alias("hookpoint"),
                                     F.lit(fld).alias("field"), F.lit(op).alias("op"),
                                     F.lit(value).cast("string").alias("value"), F.lit(is_field).alias("value_is_field"),
                                     (F.lit(None) if only is None else only).cast(GUARD).alias("guard"), F.lit(walk).alias("walk")))

    # Names of the enumerated constraints, as other tools of the trace format know them.
    items = [cand((hook == "build.snapshot") & has("$.cross_rank_cksums[*].all_equal"),
                  F.lit("hyp/cross_rank_equal/replica_cksum"), "all_equal", "cross_rank_cksums[*].all_equal", "==", "true",
                  only=guard("element", "group_size", ">", "1"))]
    for left, right, op in COMPANIONS:
        cond = has(f"$.{left}") & (has(f"$.{right}") if isinstance(right, str) else F.lit(True))
        items.append(cand(cond, F.concat(F.lit("hyp/pfc/"), hook, F.lit(f"/{left}_{op}_{right}")), "companion", left, op,
                          str(right), isinstance(right, str)))
    for f in ("has_nan", "has_inf"):
        items.append(cand(ends(".has_nan") & ends(f".{f}"), F.concat(F.lit("hyp/tsb/no_nan_inf/"), hook), "no_nan_inf", f, "==", "false", walk=True))
    for f in ("state_step_max", "state_step_min"):
        items.append(cand((hook == "optim.step.post") & has(f"$.{f}"), F.concat(F.lit("hyp/csm/"), hook, F.lit(f"/{f}")),
                          "monotonic", f, "increasing", None))
    for f in ("n_parameters", "n_modules"):
        items.append(cand((hook == "build.snapshot") & has("$.model.n_parameters") & has("$.model.n_modules"),
                          F.lit("hyp/sp/build_has_modules"), "nonzero", f"model.{f}", ">", "0"))
    items.append(cand((hook == "scheduler.init") & has("$.last_epoch") & has("$.param_groups[*].has_initial_lr"),
                      F.lit("hyp/cond/scheduler_resume_initial_lr"), "conditional", "param_groups[*].has_initial_lr",
                      "==", "true", only=guard("payload", "last_epoch", "!=", "-1")))
    return paths.select(F.inline(F.filter(F.array(*items), lambda x: x.isNotNull())))


def _typed(paths: Iterable[str]) -> T.StructType:
    """Nested schema of doubles for dotted numeric paths."""
    tree: dict = {}
    for p in paths:
        node = tree
        parts = p.split(".")
        for part in parts[:-1]:
            node = node.setdefault(part, {})
        node.setdefault(parts[-1], {})

    def build(n: dict) -> T.StructType:
        return T.StructType([T.StructField(k, build(v) if v else T.DoubleType()) for k, v in sorted(n.items())])
    return build(tree)


def _is_number(value: object) -> bool:
    try:
        float(value)  # type: ignore[arg-type]
        return True
    except (TypeError, ValueError):
        return False


def failure_counts(trace: DataFrame, candidates: Sequence[Candidate], span: int = 1 << 20) -> DataFrame:
    """Violations of a few given candidates on every trace (``run``): (candidate_id, run, n_violations).

    All bound candidates are conditional counts of a single aggregate over one parse; each
    monotonic candidate adds one two-level pass. Candidates on lists and texts are interpreted; mined tables of
    candidates go to ``candidates.candidate_failures`` as they are.
    """
    t = with_run(trace)
    runs = None
    bounds = [c for c in candidates if c.op in OPS and "[*]" not in c.field and (c.value_is_field or _is_number(c.value))]
    mono = [c for c in candidates if c.relation == "monotonic"]
    others = [c for c in candidates if c not in bounds and c not in mono]
    parts = []
    if bounds:
        fields = {c.field for c in bounds} | {str(c.value) for c in bounds if c.value_is_field}
        parsed = t.select("run", "hookpoint", F.from_json("payload", _typed(fields)).alias("p"))
        aggs = []
        for i, c in enumerate(bounds):
            rhs = X.field("p", str(c.value)) if c.value_is_field else F.lit(float(c.value))
            bad = ~OPS[c.op](X.field("p", c.field), rhs)
            aggs.append(F.count_if((F.col("hookpoint") == c.hookpoint) & bad).alias(f"v{i}"))
        wide = parsed.groupBy("run").agg(*aggs)
        rows = F.array(*[F.struct(F.lit(c.candidate_id).alias("candidate_id"), F.col(f"v{i}").alias("n_violations"))
                         for i, c in enumerate(bounds)])
        parts.append(wide.select("run", F.inline(rows)).select("candidate_id", "run", "n_violations"))
    if mono or others:
        runs = t.select("run").distinct()
    if others:
        table = t.sparkSession.createDataFrame([(c.candidate_id, c.relation, c.hookpoint, c.field, c.op, None if c.value is None else str(c.value), c.value_is_field)
                                                for c in others], CANDIDATE_SCHEMA)
        found = candidate_failures(t, table, span=span).select("candidate_id", "run", F.col("n_violations").alias("n"))
        every = runs.select("run", F.explode(F.array(*[F.lit(c.candidate_id) for c in others])).alias("candidate_id"))
        parts.append(every.join(found, ["candidate_id", "run"], "left").select("candidate_id", "run", F.coalesce("n", F.lit(0)).cast("long").alias("n_violations")))
    for c in mono:
        rank = ["rank"] if "rank" in t.columns else []
        v = (t.where(F.col("hookpoint") == c.hookpoint)
             .select("run", *rank, "event_id", X.field(F.from_json("payload", _typed([c.field])), c.field).alias("v"))
             .where(F.col("v").isNotNull()))
        d = ordered.with_previous(v, "v", ordered.Order(("run", *rank), "event_id", (), span), "pv")
        n = d.where(~(F.col("v") > F.col("pv"))).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
        parts.append(runs.join(n, "run", "left").select(F.lit(c.candidate_id).alias("candidate_id"), "run",
                                                        F.coalesce("n", F.lit(0)).cast("long").alias("n_violations")))
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out


def validate(counts: DataFrame, allowed: int = 0) -> DataFrame:
    """Accepted iff the candidate stays within the allowance on every healthy trace."""
    return counts.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("n_traces"), F.count_if(F.col("n_violations") > 0).alias("n_fired"),
        F.max("n_violations").alias("max_violations"), F.sum("n_violations").alias("total_violations"),
        (F.max("n_violations") <= allowed).alias("accepted"))


def learned_tolerance(samples: DataFrame, by: Sequence[str], value: str, pct: float = 99.0,
                      method: str = "index_n_minus_1") -> DataFrame:
    """pct-th value of a field over healthy traces, exact rank pick."""
    return Q.exact_quantile(samples, list(by), value, pct / 100.0, "tolerance", method)


def heuristic_filter(candidates: DataFrame) -> DataFrame:
    """Keep constraints on known semantic fields, drop literal numeric thresholds, keep the rest."""
    genuine = F.col("field").isin(*GENUINE_FIELDS)
    literal = ~F.col("value_is_field") & F.col("value").try_cast("double").isNotNull()
    return candidates.withColumn("keep", genuine | ~literal).withColumn(
        "reason", F.when(genuine, "known semantic field").when(literal, "literal threshold").otherwise("default keep"))


def clean_run_gate(counts: DataFrame, sizes: DataFrame, g: float, keys: Sequence[str] = ("run",)) -> DataFrame:
    """Rules that return more than a share g of a clean run's rows are rejected."""
    share = F.col("n_violations").cast("double") / F.col("n_rows")
    return counts.join(sizes, list(keys)).withColumn("share", share).withColumn("rejected", F.col("share") > g)


def accept_gate(candidates: DataFrame, min_counterexamples: int = 2, min_confidence: float = 0.8) -> DataFrame:
    """First failed admission condition, or accept.

    Expects has_schema, has_topo, has_precond, template_id, n_counterexamples, n_holding,
    confidence, probe_rows.
    """
    reason = (F.when(~F.col("has_schema"), "schema predicate missing").when(~F.col("has_topo"), "topology guard missing")
              .when(~F.col("has_precond"), "precondition missing").when(F.col("template_id").isNull(), "no template")
              .when(F.col("n_holding") > 0, "counterexample holds")
              .when(F.col("n_counterexamples") < min_counterexamples, "too few counterexamples")
              .when(F.col("confidence") < min_confidence, "low confidence")
              .when(F.col("probe_rows").isNull(), "probe not run").when(F.col("probe_rows") > 0, "probe fired"))
    return candidates.withColumn("reject_reason", reason).withColumn("accepted", reason.isNull())


def funnel(stage_flags: DataFrame, by: Sequence[str], stages: Sequence[str]) -> DataFrame:
    """Survivors per stage (a row survives a stage when it passed it and all before), long form."""
    passed, aggs = F.lit(True), []
    for s in stages:
        passed = passed & F.col(s)
        aggs.append(F.count_if(passed).alias(s))
    g = stage_flags.groupBy(*by).agg(F.count(F.lit(1)).alias("candidates"), *aggs)
    names = ["candidates", *stages]
    rows = F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(n).alias("stage"), F.col(n).alias("n_kept"),
                              (F.col(n) / F.nullif(F.col(names[max(i - 1, 0)]).cast("double"), F.lit(0.0))).alias("kept_fraction"))
                     for i, n in enumerate(names)])
    return g.select(*by, F.inline(rows))


def seeded_sample(candidates: DataFrame, by: Sequence[str], key: str, n: int, seed: int) -> DataFrame:
    """Deterministic sample of n rows per group: hash order, cut per task before the shuffle."""
    from guardlens.operators.relational import top_k
    return top_k(candidates.withColumn("__h", X.hash_order(seed, key)), by, n, "__h", key).drop("__h")


def evaluation_matrix(counts: DataFrame, runs: DataFrame, kind: str = "kind") -> DataFrame:
    """Per candidate: bug traces and clean traces on which it fires."""
    fired = F.col("n_violations") > 0
    return counts.join(runs, "run").groupBy("candidate_id").agg(
        F.count_if(fired & (F.col(kind) == "bug")).alias("bug_fires"),
        F.count_if(fired & (F.col(kind) == "clean")).alias("clean_fires"),
        F.sum("n_violations").alias("n_violations"))


# -- baselines --------------------------------------------------------------------------------

def learned_ranges(df: DataFrame, config: str, fields: Sequence[str]) -> DataFrame:
    """min / max / constant per (config, field) in long form: one aggregate over one scan."""
    aggs = [a for f in fields for a in (F.min(f).cast("double").alias(f"{f}__lo"), F.max(f).cast("double").alias(f"{f}__hi"))]
    g = df.groupBy(config).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}__lo").alias("lo"), F.col(f"{f}__hi").alias("hi"))
                     for f in fields])
    return g.select(config, F.inline(rows))


def leave_one_out(ranges: DataFrame, config: str) -> DataFrame:
    """Envelope of all *other* configurations per field, and whether they agree on a constant.

    Leaving one out changes an extreme only for its unique holder, so the two most extreme values
    per field are enough: combinable aggregates and a join on the field, no window over configurations.
    """
    top = ranges.groupBy("field").agg(F.min("lo").alias("__lo1"), F.max("hi").alias("__hi1"))
    d = ranges.join(top, "field")
    at_lo, at_hi = F.col("lo") == F.col("__lo1"), F.col("hi") == F.col("__hi1")
    second = d.groupBy("field").agg(F.count_if(at_lo).alias("__nlo"), F.count_if(at_hi).alias("__nhi"),
                                    F.min(F.when(~at_lo, F.col("lo"))).alias("__lo2"),
                                    F.max(F.when(~at_hi, F.col("hi"))).alias("__hi2"))
    j = d.join(second, "field")
    lo = F.when(at_lo & (F.col("__nlo") == 1), F.col("__lo2")).otherwise(F.col("__lo1"))
    hi = F.when(at_hi & (F.col("__nhi") == 1), F.col("__hi2")).otherwise(F.col("__hi1"))
    return j.select(config, "field", lo.alias("lo"), hi.alias("hi")).withColumn("is_constant", F.col("lo") == F.col("hi"))


def loo_false_positives(df: DataFrame, config: str, fields: Sequence[str]) -> DataFrame:
    """Range and constant rules learned on other configurations, fired on the held-out one."""
    learned = leave_one_out(learned_ranges(df, config, fields), config)
    wide = learned.groupBy(config).agg(*[a for f in fields for a in (
        F.max(F.when(F.col("field") == f, F.col("lo"))).alias(f"{f}__lo"),
        F.max(F.when(F.col("field") == f, F.col("hi"))).alias(f"{f}__hi"))])
    j = df.select(config, *fields).join(wide, config)
    aggs = []
    for f in fields:
        lo, hi, v = F.col(f"{f}__lo"), F.col(f"{f}__hi"), F.col(f).cast("double")
        aggs += [F.count_if(v.isNotNull() & lo.isNotNull()).alias(f"{f}__n"),
                 F.count_if((lo < hi) & ((v < lo) | (v > hi))).alias(f"{f}__range"),
                 F.count_if((lo == hi) & (v != lo)).alias(f"{f}__constant")]
    g = j.groupBy(config).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("rule"), F.col(f"{f}__n").alias("n_evaluations"),
                              F.col(f"{f}__{k}").alias("n_fires")) for f in fields for k in ("range", "constant")])
    return g.select(config, F.inline(rows))


def rank_agreement(df: DataFrame, config: str, group: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(config, field, n_groups, n_unequal): groups such as (run, step) in which a field is reported, and those whose ranks differ in it.

    Smallest and largest value tell agreement, so a group of any size is a few numbers.
    """
    ends = [a for f in fields for a in (F.min(f).alias(f"{f}__lo"), F.max(f).alias(f"{f}__hi"))]
    per = df.groupBy(config, *group).agg(*ends)
    counts = [a for f in fields for a in (F.count(f"{f}__lo").alias(f"{f}__n"), F.count_if(F.col(f"{f}__lo") != F.col(f"{f}__hi")).alias(f"{f}__bad"))]
    g = per.groupBy(config).agg(*counts)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}__n").alias("n_groups"), F.col(f"{f}__bad").alias("n_unequal")) for f in fields])
    return g.select(config, F.inline(rows)).where("n_groups > 0")


def rank_equal_baseline(df: DataFrame, config: str, group: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rules "ranks agree on this field" learned on the other configurations, fired on the held-out one.

    The learned set is the intersection over the other configurations. A field is in it iff as many of them support it as report it,
    which two counts per field tell; leaving one out takes its own support away.
    """
    found = rank_agreement(df, config, group, fields)
    holds = (F.col("n_unequal") == 0).cast("long")
    support = found.groupBy("field").agg(F.count(F.lit(1)).alias("n_with"), F.sum(holds).alias("n_support"))
    j = found.join(support, "field")
    learned = (F.col("n_with") > 1) & (F.col("n_support") - holds == F.col("n_with") - 1)
    return j.select(config, "field", F.lit("rank_equal").alias("rule"), F.col("n_groups").alias("n_evaluations"),
                    F.when(learned, F.col("n_unequal")).otherwise(0).cast("long").alias("n_fires"), learned.alias("learned"))


def false_positives_per_million(*results: DataFrame) -> DataFrame:
    """Fires and evaluations of all held-out configurations by kind of rule, and fires per million evaluations."""
    both = None
    for r in results:
        part = r.select("rule", "n_evaluations", "n_fires")
        both = part if both is None else both.unionByName(part)
    return both.groupBy("rule").agg(F.sum("n_evaluations").alias("n_evaluations"), F.sum("n_fires").alias("n_fires")).withColumn(
        "per_million", F.col("n_fires") * F.lit(1e6) / F.nullif(F.col("n_evaluations").cast("double"), F.lit(0.0)))


def coverage_by_size(cases: DataFrame, template: str) -> DataFrame:
    """Share of cases covered by the k most frequent templates, for every k.

    The window runs over templates, already reduced from cases.
    """
    c = cases.where(F.col(template).isNotNull()).groupBy(template).agg(F.count(F.lit(1)).alias("n_cases"))
    total = cases.agg(F.count(F.lit(1)).alias("t"))
    w = Window.orderBy(F.desc("n_cases"), template)
    return c.select(template, "n_cases", F.row_number().over(w).cast("long").alias("k"),
                    (F.sum("n_cases").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
                     / total.scalar()).alias("coverage"))


def stage_gaps(constraints: DataFrame, text: str, stages: Mapping[str, Sequence[str]]) -> DataFrame:
    """Constraints per training stage by keyword; stages with none are reported uncovered."""
    names = list(stages)
    low = F.lower(F.col(text))
    aggs = [F.count_if(X.contains_any(low, [k.lower() for k in stages[s]])).alias(s) for s in names]
    g = constraints.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("n_constraints"), (F.col(s) > 0).alias("covered"))
                     for s in names])
    return g.select(F.inline(rows))


def with_value(c: Candidate, value: float) -> Candidate:
    """Re-emit a bound with a learned threshold."""
    return replace(c, value=value, value_is_field=False)
