"""Rule library over the event trace.

Row rules are expressions over the typed payload and share one scan. Rules that need run-wide
configuration or ordering are frame rules: configuration is reduced to one row per run (the
reduction combines before the shuffle) and joined on ``run``; the optimizer broadcasts it when
its measured size is small.

``topo_guard`` and ``precondition`` are separate, so an ablation arm switches one kind off
without a second copy of the library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlens.functions import exprs as X
from guardlens.functions import ordered
from guardlens.functions import quantiles as Q
from guardlens.session import cut
from guardlens.operators.spec import (Check, Predicate, Bound, Scope, compile_predicate, fail_each, fail_if, finding,
                                      monotonic_frame, tensor_summaries)

KEYS = ["run", "rank", "step", "event_id"]

# Class lists, operator names and thresholds of the rule definitions.
HEAD_RATIO_LIMIT = 10.0
CLIP_SLACK = 0.01
GRAD_EXPLOSION = 1e10
TOKEN_DISPERSION_LIMIT = 100.0
RMS_RANGE = (0.5, 2.0)
TOKEN_ID_LIMIT = 2 ** 20
BLOCK_DEVIATION_LIMIT = 100.0
CASTING_CLASSES = ("_GenericAlias", "Identity", "Embedding", "ToFloat", "ToHalf", "AutocastWrapper")
PARAMETER_CLASSES = ("Linear", "Embedding", "RMSNorm", "LayerNorm", "MoEMLP", "Conv2d", "Conv1d", "MoELinearRouter")
ROUTER_HINTS = ("Router", "Gate", "TopK", "MoEGate", "ExpertSelector")
GRADIENT_COLLECTIVES = ("all_reduce", "reduce_scatter", "reduce", "all_gather", "all_gather_into_tensor",
                        "all_to_all", "all_to_all_single")
PARALLEL_ROLES = ("ep", "tp", "dp", "pp", "cp", "sp")
OUTPUT_SKIP_CLASSES = ("RMSNorm", "LayerNorm", "Identity", "RotaryEmbedding", "FSDPMoELinearRouter",
                       "MoELinearRouter", "FSDPEmbedding", "FSDPLMHead", "TorchAttentionBackend")
GRAD_SKIP_CLASSES = ("RMSNorm", "LayerNorm", "Identity", "RotaryEmbedding", "Attention", "TorchAttentionBackend",
                     "FSDPMoELinearRouter", "MoELinearRouter")
NAN_HOOKPOINTS = ("module.fwd.pre", "module.fwd.post", "module.bwd", "optim.step.pre", "optim.step.post",
                  "comm.pre", "comm.post", "build.snapshot")


def _p(name: str):
    return lambda p: X.field(p, name)


# -- row rules ---------------------------------------------------------------------------

def _attention_heads(p: Column) -> Column:
    r = p.max_to_min_ratio
    bad = r.isNotNull() & (F.coalesce(p.any_zero_head, F.lit(False)) | (r == F.lit(X.INF))
                           | ((r > HEAD_RATIO_LIMIT) & ~F.isnan(r)))
    return fail_if(bad, p.module_name, "per-head ratio", r)


def _grad_norm(p: Column) -> Column:
    issue = X.magnitude_issue(p.total_grad_l2, GRAD_EXPLOSION)
    return fail_if(p.total_grad_l2.isNotNull() & issue.isNotNull(), "total_grad_l2", issue, p.total_grad_l2)


def _initial_lr(p: Column) -> Column:
    return fail_each(p.param_groups, lambda g: ~F.coalesce(g.has_initial_lr, F.lit(False)),
                     lambda g: finding(g.index, "initial_lr missing", p.last_epoch))


def _has_modules(p: Column) -> Column:
    zero = F.lit(0).cast("long")
    n_p, n_m = F.coalesce(p.model.n_parameters, zero), F.coalesce(p.model.n_modules, zero)
    return fail_if((n_p == 0) | (n_m == 0), "model", "empty model", F.least(n_p, n_m))


def _token_dispersion(p: Column) -> Column:
    t = p.per_token
    ratio = t.max / t.median
    return fail_if((t.median > 0) & t.max.isNotNull() & (ratio > TOKEN_DISPERSION_LIMIT), "per_token",
                   "max/median", ratio)


def _grad_output_alive(p: Column) -> Column:
    dead = F.exists(p.grad_output, lambda g: F.coalesce(g.l2_norm == 0.0, F.lit(False)))
    return fail_if(dead, p.module_name, "zero grad_output", F.lit(0.0))


def _no_nan_inf(p: Column) -> Column:
    f = F.lit(False)
    hit = F.exists(tensor_summaries(p, NAN_FIELDS),
                   lambda t: F.coalesce(t.has_nan, f) | F.coalesce(t.has_inf, f))
    return fail_if(hit, p.module_name, "nan/inf")


NAN_FIELDS = ("inputs", "output", "outputs", "grad_input", "grad_output", "params", "tensor_pre", "tensor_post",
              "model")


def _norm_rms(p: Column) -> Column:
    r = X.rms(p.output.l2_norm, p.output.shape)
    lo, hi = RMS_RANGE
    ok = (r >= lo) & (r <= hi) & ~F.isnan(r)
    return fail_if((F.size(p.output.shape) > 0) & r.isNotNull() & ~ok, p.module_class, "rms", r)


def _lr_positive(p: Column) -> Column:
    return fail_each(p.optimizer.param_groups, lambda g: g.lr.isNull() | (g.lr <= 0),
                     lambda g: finding(g.index, F.when(g.lr.isNull(), "lr missing").otherwise("lr not positive"), g.lr))


def _update_applied(p: Column) -> Column:
    d, n = p.total_param_delta_l2, F.coalesce(p.n_params_unchanged_with_grad, F.lit(0).cast("long"))
    issue = F.when(d == 0.0, "no update").when(n > 0, "frozen with gradient")
    return fail_if(d.isNotNull() & issue.isNotNull(), p.optimizer_class, issue,
                   F.when(d == 0.0, d).otherwise(n.cast("double")))


def _is_router_scope(p: Column) -> Column:
    return (F.col("hookpoint") == "functional.softmax") | X.contains_any(F.coalesce(p.module_class, F.lit("")),
                                                                         ROUTER_HINTS)


def _softmax(p: Column) -> Column:
    empty = F.array().cast("array<" + _tensor_type() + ">")
    extra = F.when(F.col("hookpoint") == "module.fwd.post", F.coalesce(p.outputs, empty)).otherwise(empty)
    cands = F.concat(F.array(p.output), extra)

    def degenerate(t: Column) -> Column:
        peak = X.first_nonzero(t.abs_max, t.max)
        return t.isNotNull() & X.one_hot(t.l2_norm, peak, t.shape)

    return fail_each(cands, degenerate, lambda t: finding(p.module_class, X.one_hot_kind(t.shape), t.l2_norm))


def _tensor_type() -> str:
    from guardlens import schema as sc
    return sc.TENSOR.simpleString()


def _token_ids(p: Column) -> Column:
    ids = p.input_ids
    peak = X.first_nonzero(ids.abs_max, ids.max)
    items = F.array(
        F.when(peak.isNotNull() & (ids.min < 0), finding("input_ids", "negative", ids.min)),
        F.when(peak > TOKEN_ID_LIMIT, finding("input_ids", "absurdly large", peak)))
    return F.filter(items, lambda x: x.isNotNull())


def _replicas(name: str):
    def f(p: Column) -> Column:
        return fail_each(X.field(p, name), lambda r: r.all_equal == F.lit(False),
                         lambda r: finding(r["name"], "replicas differ", r.group_size))
    return f


def _replicas_guarded(name: str):
    def f(p: Column) -> Column:
        one = F.lit(1).cast("long")
        return fail_each(X.field(p, name),
                         lambda r: (F.coalesce(r.group_size, one) > 1) & (r.all_equal == F.lit(False)),
                         lambda r: finding(r["name"], "replicas differ", r.group_size))
    return f


def _expert_bias(p: Column) -> Column:
    s = p.semantic
    return fail_if(s.expert_bias_dtype != "float32", p.module_class, s.expert_bias_dtype)


def _expert_bias_open(p: Column) -> Column:
    d = F.coalesce(p.semantic.expert_bias_dtype, F.lit("missing"))
    return fail_if(d != "float32", p.module_class, d)


def _group_sizes(min_declared: int | None):
    def f(p: Column) -> Column:
        def per_framework(e: Column) -> Column:
            roles = []
            for role in PARALLEL_ROLES:
                want = F.element_at(e.value, F.lit(f"{role}_size_declared")).try_cast("double").try_cast("long")
                have = F.element_at(e.value, F.lit(f"{role}_size_actual")).try_cast("double").try_cast("long")
                bad = want != have
                if min_declared is not None:
                    bad = bad & (want > min_declared)
                roles.append(F.when(bad, finding(F.concat_ws(".", e.key, F.lit(role)), "group size", have)))
            return F.filter(F.array(*roles), lambda x: x.isNotNull())
        return F.flatten(F.transform(F.map_entries(p.framework_invariants), per_framework))
    return f


def _loss_reduction(p: Column) -> Column:
    return fail_if(p.reduction.isNotNull() & ~p.reduction.isin("mean"), p.fn, p.reduction)


# -- frame rules ---------------------------------------------------------------------------

def _declared(parsed: DataFrame, value: Column, order: Column, agg, name: str) -> DataFrame:
    """One declared value per run, picked by event order."""
    return parsed.groupBy("run").agg(agg(value, order).alias(name)).where(F.col(name).isNotNull())


def _run_flag(parsed: DataFrame, cond: Column) -> DataFrame:
    """Runs in which the condition holds at least once."""
    return parsed.where(cond).select("run").distinct()


def _checkpoint_rng(parsed: DataFrame, guards: frozenset[str]) -> DataFrame:
    p = F.col("p")
    bad = parsed.where((F.col("hookpoint") == "checkpoint.call") & (p.preserve_rng_state == F.lit(False)))
    if "precond" in guards:
        source = F.col("hookpoint").isin("build.snapshot", "module.fwd.post")
        named = F.exists(p.model.parameters, lambda q: F.coalesce(F.lower(q.getField("name")).contains("dropout"), F.lit(False)))
        dropout = p.module_class.contains("Dropout") | F.coalesce(named, F.lit(False))
        bad = bad.join(_run_flag(parsed, source & dropout), "run", "left_semi")
    return bad.select(*KEYS, p["function"].alias("entity"), F.lit("preserve_rng_state=false").alias("issue"),
                      F.lit(None).cast("double").alias("observed"))


def _eval_mode(parsed: DataFrame, guards: frozenset[str]) -> DataFrame:
    p = F.col("p")
    bad = parsed.where((F.col("hookpoint") == "module.fwd.pre") & (p.grad_enabled == F.lit(False))
                       & (p.training == F.lit(True)))
    if "precond" in guards:
        bad = bad.join(_run_flag(parsed, F.col("hookpoint") == "checkpoint.call"), "run", "left_anti")
        many = bad.groupBy("run").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= 2).select("run")
        bad = bad.join(many, "run", "left_semi")
    return bad.select(*KEYS, p.module_name.alias("entity"), F.lit("training under no_grad").alias("issue"),
                      F.lit(None).cast("double").alias("observed"))


def _comm_dtype(parsed: DataFrame, guards: frozenset[str]) -> DataFrame:
    p = F.col("p")
    declared_in_row = F.filter(
        F.transform(F.map_values(p.framework_invariants), lambda m: F.element_at(m, F.lit("training_dtype"))),
        lambda v: v.isNotNull() & (v != ""))
    snap = parsed.where(F.col("hookpoint") == "build.snapshot")
    declared = _declared(snap.withColumn("__d", F.get(declared_in_row, F.lit(0))),
                         F.col("__d"), F.when(F.col("__d").isNotNull(), F.col("event_id")), F.min_by, "declared")
    comm = parsed.where((F.col("hookpoint") == "comm.post") & p.tensor_post.dtype.isNotNull()
                        & (p.tensor_post.dtype != ""))
    if "precond" in guards:
        joined = comm.where(p.op.isin(*GRADIENT_COLLECTIVES)).join(declared, "run")
    else:
        joined = comm.join(declared, "run", "left").withColumn("declared", F.coalesce("declared", F.lit("bfloat16")))
    got, want = X.dtype_name(p.tensor_post.dtype), X.dtype_name(F.col("declared"))
    return joined.where(got != want).select(*KEYS, p.op.alias("entity"), F.concat_ws("!=", got, want).alias("issue"),
                                            F.lit(None).cast("double").alias("observed"))


def block_uniformity(records: DataFrame, by: list[str], block: str, value: str, limit: float = BLOCK_DEVIATION_LIMIT,
                     min_records: int = 3, min_blocks: int = 4, sample: str = "event_id") -> DataFrame:
    """Blocks whose median departs from the median over all blocks of the same group.

    Level one is an exact bracketed median (a hot class is never held in one buffer); level two
    has one row per block.
    """
    med = Q.exact_median(records, [*by, block], value, "block_median")
    first = records.groupBy(*by, block).agg(F.min(sample).alias("sample_id"))
    med = med.where(F.col("n") >= min_records)
    cross = (med.groupBy(*by).agg(F.percentile("block_median", 0.5).alias("cross_median"),
                                  F.count(F.lit(1)).alias("n_blocks"))
             .where((F.col("n_blocks") >= min_blocks) & (F.col("cross_median") > 0)))
    dev = X.symmetric_ratio("block_median", "cross_median")
    return (med.join(cross, by).withColumn("deviation", dev).where(F.col("deviation") > limit)
            .join(first, [*by, block])
            .select(*by, block, "n", "n_blocks", "block_median", "cross_median", "deviation", "sample_id"))


def _block_rule(hook: str, skip: tuple[str, ...], value, issue: str):
    def frame(parsed: DataFrame, guards: frozenset[str]) -> DataFrame:
        p = F.col("p")
        cls = p.module_class
        idx = X.block_index(p.module_name)
        keep = cls.isNotNull() & (cls != "")
        if "precond" in guards:
            keep = keep & ~F.regexp_replace(cls, '^"+|"+$', "").isin(*skip) & idx.isNotNull()
        else:
            idx = F.coalesce(idx, F.lit(-1))
        v = value(p)
        rec = parsed.where((F.col("hookpoint") == hook) & keep & v.isNotNull()).select(
            "run", "rank", "step", "event_id", cls.alias("module_class"), idx.alias("block"), v.alias("value"))
        bad = block_uniformity(cut(rec, "block-records"), ["run", "module_class"], "block", "value")
        return bad.select("run", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("int").alias("step"),
                          F.col("sample_id").alias("event_id"),
                          F.concat_ws("#", "module_class", F.col("block").cast("string")).alias("entity"),
                          F.lit(issue).alias("issue"), F.col("deviation").alias("observed"))
    return frame


def _output_l2(p: Column) -> Column:
    v = p.output.l2_norm
    return F.when((v > 0) & ~F.isnan(v), v)


def _grad_ratio(p: Column) -> Column:
    gi, go = F.get(p.grad_input, F.lit(0)).l2_norm, F.get(p.grad_output, F.lit(0)).l2_norm
    return F.when(~F.isnan(gi) & ~F.isnan(go) & (go > 0), gi / go)


def _layer_count(parsed: DataFrame, guards: frozenset[str]) -> DataFrame:
    meg = F.element_at(F.col("p").framework_invariants, F.lit("megatron"))

    def last(key: str):
        has = F.map_contains_key(meg, F.lit(key))
        return F.max_by(F.element_at(meg, F.lit(key)), F.when(has, F.col("event_id")))

    snap = parsed.where((F.col("hookpoint") == "build.snapshot") & meg.isNotNull())
    cfg = snap.groupBy("run").agg(last("num_layers").alias("declared"),
                                  last("pipeline_model_parallel_size").alias("pp"),
                                  last("n_transformer_layers_in_local_module").alias("local"),
                                  F.max("event_id").alias("event_id"))
    pp = F.greatest(F.coalesce(F.col("pp").try_cast("long"), F.lit(1).cast("long")), F.lit(1).cast("long"))
    total, want = F.col("local").try_cast("long") * pp, F.col("declared").try_cast("long")
    return cfg.where(total != want).select(
        "run", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("int").alias("step"), "event_id",
        F.lit("num_layers").alias("entity"),
        F.concat_ws(" ", F.lit("declared"), F.col("declared"), F.lit("actual"), total.cast("string")).alias("issue"),
        total.cast("double").alias("observed"))


def _multi_forward(parsed: DataFrame, guards: frozenset[str]) -> DataFrame:
    p = F.col("p")
    root = parsed.where((F.col("hookpoint") == "module.fwd.pre") & (p.module_name.isNull() | (p.module_name == "")))
    steps = (root.groupBy("run", "step").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("event_id"))
             .where(F.col("n") > 1))
    if "precond" in guards:
        ds = F.element_at(p.framework_invariants, F.lit("deepspeed"))
        fragile = ((F.element_at(ds, F.lit("offload_optimizer")) == "true")
                   & (F.element_at(ds, F.lit("gradient_accumulation_steps")).try_cast("long") == 1)
                   & F.element_at(ds, F.lit("zero_stage")).try_cast("long").isin(1, 2))
        steps = steps.join(_run_flag(parsed, (F.col("hookpoint") == "build.snapshot") & fragile), "run", "left_semi")
    return steps.select("run", F.lit(None).cast("int").alias("rank"), "step", "event_id",
                        F.lit("root forward").alias("entity"), F.lit("forwards per step").alias("issue"),
                        F.col("n").cast("double").alias("observed"))


def residual_fallback(parsed: DataFrame, guards: frozenset[str], span: int = 1 << 20) -> DataFrame:
    """Block output nearer to the normalised than to the original input, from magnitudes only.

    The slots "last block input" and "last normalised value" are carried along event order in
    two passes. Whatever the slot held, it is empty after a block closes, so the first pass does
    not depend on the second.
    """
    p, hp = F.col("p"), F.col("hookpoint")
    free = "precond" not in guards
    is_block = F.lit(True) if free else F.coalesce(p.semantic.is_residual_block, F.lit(False))
    is_norm = F.lit(True) if free else F.coalesce(p.module_class.contains("Norm"), F.lit(False))
    first_in = F.get(p.inputs, F.lit(0))
    d = parsed.where(hp.isin("module.fwd.pre", "module.fwd.post")).select(
        *KEYS, p.module_class.alias("cls"),
        ((hp == "module.fwd.pre") & is_block & first_in.isNotNull()).alias("opens"), first_in.l2_norm.alias("in_l2"),
        ((hp == "module.fwd.post") & is_norm & p.output.isNotNull()).alias("norms"),
        ((hp == "module.fwd.post") & is_block & p.output.isNotNull() & p.output.l2_norm.isNotNull()).alias("closes"),
        p.output.l2_norm.alias("out_l2"))
    d = cut(d, "block-events")
    o = ordered.Order(("run", "rank"), "event_id", (), span)
    d = ordered.carry_forward(d, F.when(F.col("opens"), F.col("in_l2")), o, "cur_in", inclusive=False,
                              is_set=F.col("opens") | F.col("closes"))
    sets = F.col("norms") & F.col("cur_in").isNotNull()
    done = F.col("closes") & F.col("cur_in").isNotNull()
    d = cut(d, "block-inputs")
    d = ordered.carry_forward(d, F.when(sets & ~done, F.col("out_l2")), o, "norm_before", inclusive=False, is_set=sets | done)
    cur_norm = F.when(sets, F.col("out_l2")).otherwise(F.col("norm_before"))
    d_in, d_norm = F.abs(F.col("out_l2") - F.col("cur_in")), F.abs(F.col("out_l2") - cur_norm)
    return d.where(done & (d_norm * 3 < d_in)).select(
        *KEYS, F.col("cls").alias("entity"), F.lit("nearer to normalised input").alias("issue"),
        d_norm.alias("observed"))


def _residual(parsed: DataFrame, guards: frozenset[str]) -> DataFrame:
    p = F.col("p")
    probes = parsed.where(F.col("hookpoint") == "residual.probe")
    bad = probes.where(p.d_to_normed_input < p.d_to_original_input).select(
        *KEYS, p.block_class.alias("entity"), F.lit("nearer to normalised input").alias("issue"),
        p.d_to_normed_input.alias("observed"))
    without = parsed.join(probes.select("run").distinct(), "run", "left_anti")
    return bad.unionByName(residual_fallback(without, guards))


def _router_attribute(parsed: DataFrame, guards: frozenset[str]) -> DataFrame:
    p = F.col("p")
    rows = parsed.where((F.col("hookpoint") == "module.fwd.post")
                        & (p.semantic.has_calculate_per_token_loss == F.lit(False)))
    if "precond" in guards:
        meg = F.element_at(p.framework_invariants, F.lit("megatron"))
        has = F.map_contains_key(meg, F.lit("calculate_per_token_loss"))
        flag = _declared(parsed.where(F.col("hookpoint") == "build.snapshot"),
                         F.element_at(meg, F.lit("calculate_per_token_loss")), F.when(has, F.col("event_id")),
                         F.max_by, "flag").where(~F.lower("flag").isin("false", "0", "0.0", ""))
        rows = rows.where(p.semantic.is_router).join(flag.select("run"), "run", "left_semi")
    return rows.select(*KEYS, p.module_class.alias("entity"), F.lit("attribute missing").alias("issue"),
                       F.lit(None).cast("double").alias("observed"))


def _sqrt_decay(parsed: DataFrame, guards: frozenset[str]) -> DataFrame:
    """Early slope more than twice the late slope over samples sorted by progress."""
    p = F.col("p")
    s = parsed.where((F.col("hookpoint") == "decay.probe") & p.progress.isNotNull() & p["result"].isNotNull()).select(
        "run", "event_id", p.progress.alias("x"), p["result"].alias("y"),
        F.floor(p.progress * 1e9).cast("long").alias("k"))
    n = s.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id")).where(F.col("n") >= 5)
    d = ordered.with_ordinal(s, ordered.Order(("run",), "k", ("x", "event_id"), 1_000_000), "i").join(n, "run")
    q = F.floor(F.col("n") / 4)
    early_end = F.greatest(F.lit(2), q)
    late_start = F.greatest(F.col("n") - q, F.col("n") - 2) + 1
    at = lambda c, pos: F.max(F.when(F.col("i") == pos, F.col(c)))
    g = d.groupBy("run", "n", "last_id").agg(
        at("x", F.lit(1)).alias("x0"), at("y", F.lit(1)).alias("y0"),
        at("x", early_end).alias("x1"), at("y", early_end).alias("y1"),
        at("x", late_start).alias("x2"), at("y", late_start).alias("y2"),
        at("x", F.col("n")).alias("x3"), at("y", F.col("n")).alias("y3"))
    slope = lambda a, b: F.abs((F.col(f"y{b}") - F.col(f"y{a}")) / F.greatest(F.col(f"x{b}") - F.col(f"x{a}"), F.lit(1e-9)))
    g = g.withColumn("s_early", slope(0, 1)).withColumn("s_late", slope(2, 3))
    return g.where(F.col("s_early") > F.col("s_late") * 2).select(
        "run", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("int").alias("step"),
        F.col("last_id").alias("event_id"), F.lit("decay").alias("entity"),
        F.lit("early slope exceeds late slope").alias("issue"), F.col("s_early").alias("observed"))


def _dtype_join(parsed: DataFrame, guards: frozenset[str]) -> DataFrame:
    """Output dtype equals one of the input dtypes of the same forward call.

    Pre and post events of one module are paired by occurrence number inside (run, rank, step,
    module); occurrence numbers are computed with the two-level ordinal.
    """
    p, hp = F.col("p"), F.col("hookpoint")
    o = ordered.Order(("run", "rank", "step", "module_id"), "event_id")
    pre = parsed.where((hp == "module.fwd.pre") & p.module_id.isNotNull()).select(
        *KEYS, p.module_id.alias("module_id"),
        F.transform(F.filter(p.inputs, lambda t: t.dtype.isNotNull()), lambda t: t.dtype).alias("in_dtypes"))
    post = parsed.where((hp == "module.fwd.post") & p.module_id.isNotNull() & p.output.dtype.isNotNull())
    if "precond" in guards:
        post = post.where(~X.contains_any(F.coalesce(p.module_class, F.lit("")), CASTING_CLASSES))
    # numbering must see every post event of the module, so the class scope is applied per module
    post = post.select(*KEYS, p.module_id.alias("module_id"), p.module_class.alias("cls"),
                       p.output.dtype.alias("out_dtype"))
    pre = ordered.with_ordinal(pre, o, "occ").drop("event_id")
    post = ordered.with_ordinal(post, o, "occ")
    j = post.join(pre, ["run", "rank", "step", "module_id", "occ"])
    bad = (F.size("in_dtypes") > 0) & ~F.array_contains("in_dtypes", F.col("out_dtype"))
    return j.where(bad).select(*KEYS, F.col("cls").alias("entity"),
                               F.concat_ws("->", F.array_join("in_dtypes", "|"), "out_dtype").alias("issue"),
                               F.lit(None).cast("double").alias("observed"))


# -- what a run must show for a rule to apply: without it the rule is passive ------------------

def _on(hook: str, cond=None):
    """Events of a hookpoint, optionally those that meet a condition on the payload."""
    return (lambda p: F.col("hookpoint") == hook) if cond is None else (lambda p: (F.col("hookpoint") == hook) & F.coalesce(cond(p), F.lit(False)))


def _any_declared(key: str):
    return lambda p: F.exists(F.map_values(p.framework_invariants), lambda m: F.coalesce(F.element_at(m, F.lit(key)), F.lit("")) != "")


def _declares(framework: str, *keys: str):
    def cond(p: Column) -> Column:
        m = F.element_at(p.framework_invariants, F.lit(framework))
        out = F.lit(True)
        for k in keys:
            out = out & F.element_at(m, F.lit(k)).isNotNull()
        return out
    return cond


def _switched_on(framework: str, key: str):
    return lambda p: ~F.lower(F.element_at(F.element_at(p.framework_invariants, F.lit(framework)), F.lit(key))).isin("false", "0", "0.0", "")


def _grouped(name: str):
    return lambda p: F.exists(X.field(p, name), lambda r: F.coalesce(r.group_size, F.lit(1).cast("long")) > 1)


# -- the library ---------------------------------------------------------------------------------

def _no_findings(p: Column) -> Column:
    return fail_if(F.lit(False))


RULES: tuple[Check, ...] = (
    Check("T0-attention-head-uniformity", ("attention.fwd.post",),
          fields=("max_to_min_ratio", "any_zero_head", "module_name"), findings=_attention_heads),
    Check("T0-checkpoint-preserve-rng", ("checkpoint.call", "build.snapshot", "module.fwd.post"),
          frame_fields=("preserve_rng_state", "function", "module_class", "model"), needs=((_on("checkpoint.call"), 1),),
          frame=_checkpoint_rng),
    Check("T0-clip-grad-bounded", ("utils.clip_grad.post",), fields=("post_norm", "max_norm", "fn"),
          template="T09", findings=lambda p: fail_if(p.post_norm > p.max_norm * (1 + CLIP_SLACK), "post_norm",
                                                     "above max_norm", p.post_norm)),
    Check("T0-dtype-propagation", ("module.fwd.post",), fields=("module_class", "output"),
          applies=lambda p: p.output.dtype.isNotNull() & (p.output.dtype != ""),
          precondition=lambda p: ~X.contains_any(F.coalesce(p.module_class, F.lit("")), CASTING_CLASSES),
          findings=_no_findings, description="counts checkable outputs; the joined form is tier 1"),
    Check("T0-evaluator-eval-mode", ("module.fwd.pre", "checkpoint.call"),
          frame_fields=("grad_enabled", "training", "module_name"), needs=((_on("module.fwd.pre"), 1),), veto=_on("checkpoint.call"),
          frame=_eval_mode),
    Check("T0-grad-norm-finite", ("optim.step.pre",), fields=("total_grad_l2",), findings=_grad_norm),
    Check("T0-initial-lr-present", ("scheduler.init",), fields=("last_epoch", "param_groups"), template="T11",
          precondition=lambda p: F.coalesce(p.last_epoch, F.lit(-1).cast("long")) != -1, findings=_initial_lr),
    Check("T0-build-has-modules", ("build.snapshot",), fields=("model",), template="T32", findings=_has_modules),
    Check("T0-loss-per-token-dispersion", ("loss.call",), fields=("per_token",),
          precondition=lambda p: ~F.coalesce(p.per_token.all_ignored, F.lit(False)), findings=_token_dispersion),
    Check("T0-loss-reduction-mode-correct", ("loss.call",), fields=("reduction", "fn"), findings=_loss_reduction),
    Check("T0-module-grad-output-alive", ("module.bwd",), tier=1, fields=("module_class", "module_name", "grad_output"),
          precondition=lambda p: p.module_class.isin(*PARAMETER_CLASSES), findings=_grad_output_alive),
    Check("T0-no-nan-inf", NAN_HOOKPOINTS, fields=("module_name", *NAN_FIELDS), findings=_no_nan_inf),
    Check("T0-norm-output-unit-rms", ("module.fwd.post",), fields=("is_normalizer", "output", "module_class"),
          template="T04", precondition=lambda p: p.is_normalizer, findings=_norm_rms),
    Check("T0-optim-lr-positive", ("build.snapshot",), fields=("optimizer",), template="T14", findings=_lr_positive),
    Check("T0-optim-step-counter-monotonic", ("optim.step.post",), frame_fields=("state_step_max",), needs=((_on("optim.step.post", lambda p: p.state_step_max.isNotNull()), 2),),
          template="T15",
          frame=monotonic_frame("state_step_max")),
    Check("T0-param-update-applied", ("optim.step.post",),
          fields=("total_param_delta_l2", "n_params_unchanged_with_grad", "optimizer_class"), findings=_update_applied),
    Check("T0-softmax-degenerate", ("module.fwd.post", "functional.softmax"),
          fields=("module_class", "output", "outputs"), template="T17", precondition=_is_router_scope,
          findings=_softmax),
    Check("T0-token-id-in-vocab", ("dataloader.batch",), fields=("input_ids",), findings=_token_ids),
    Check("T1-buffer-replica-cksum-equal", ("build.snapshot",), tier=1, fields=("cross_rank_buffer_cksums",),
          needs=((_on("build.snapshot", _grouped("cross_rank_buffer_cksums")), 1),),
          findings=_replicas_guarded("cross_rank_buffer_cksums")),
    Check("T1-comm-dtype-matches-training", ("comm.post", "build.snapshot"), tier=1,
          frame_fields=("op", "tensor_post", "framework_invariants"), needs=((_on("build.snapshot", _any_declared("training_dtype")), 1),),
          frame=_comm_dtype),
    Check("T1-expert-bias-fp32", ("module.fwd.post",), tier=1, fields=("semantic", "module_class"), template="T05",
          needs=((_on("module.fwd.post", lambda p: p.semantic.is_router & p.semantic.expert_bias_dtype.isNotNull()), 1),),
          precondition=lambda p: p.semantic.is_router, findings=_expert_bias),
    Check("T1-fwd-output-block-uniformity", ("module.fwd.post",), tier=1,
          frame_fields=("module_class", "module_name", "output"),
          frame=_block_rule("module.fwd.post", OUTPUT_SKIP_CLASSES, _output_l2, "block output deviates")),
    Check("T1-grad-flow-block-uniformity", ("module.bwd",), tier=1,
          frame_fields=("module_class", "module_name", "grad_input", "grad_output"),
          frame=_block_rule("module.bwd", GRAD_SKIP_CLASSES, _grad_ratio, "block gradient ratio deviates")),
    Check("T1-grad-replica-cksum-equal", ("optim.step.pre",), tier=1, fields=("cross_rank_grad_cksums",),
          findings=_replicas_guarded("cross_rank_grad_cksums")),
    Check("T1-jitter-preserves-dtype", ("jitter.probe",), tier=1, template="T05",
          fields=("dtypes_match", "module_class", "output_dtype"),
          findings=lambda p: fail_if(p.dtypes_match == F.lit(False), p.module_class, p.output_dtype)),
    Check("T1-layer-count-strict", ("build.snapshot",), tier=1, frame_fields=("framework_invariants",),
          needs=((_on("build.snapshot", _declares("megatron", "num_layers")), 1), (_on("build.snapshot", _declares("megatron", "n_transformer_layers_in_local_module")), 1)),
          frame=_layer_count),
    Check("T1-multi-backward-per-step-fragile-config", ("module.fwd.pre", "build.snapshot"), tier=1,
          frame_fields=("module_name", "framework_invariants"), frame=_multi_forward),
    Check("T1-process-group-size-correct", ("build.snapshot",), tier=1, fields=("framework_invariants",),
          findings=_group_sizes(1)),
    Check("T1-replica-cksum-equal", ("build.snapshot",), tier=1, fields=("cross_rank_cksums",), template="T01",
          findings=_replicas_guarded("cross_rank_cksums")),
    Check("T1-residual-stream-preserved", ("residual.probe", "module.fwd.pre", "module.fwd.post"), tier=1,
          needs=((lambda p: (F.col("hookpoint") == "residual.probe") | F.coalesce(p.semantic.is_residual_block, F.lit(False)), 1),),
          template="T23", frame_fields=("d_to_original_input", "d_to_normed_input", "block_class", "module_class",
                                        "semantic", "inputs", "output"), frame=_residual),
    Check("T1-router-has-calculate-per-token-loss", ("module.fwd.post", "build.snapshot"), tier=1,
          frame_fields=("semantic", "module_class", "framework_invariants"), needs=((_on("build.snapshot", _switched_on("megatron", "calculate_per_token_loss")), 1), (_on("module.fwd.post", lambda p: p.semantic.is_router), 1)),
          frame=_router_attribute),
    Check("T1-sqrt-decay-front-loaded", ("decay.probe",), tier=1, frame_fields=("progress", "result"),
          needs=((_on("decay.probe", lambda p: p.progress.isNotNull() & p["result"].isNotNull()), 5),),
          frame=_sqrt_decay),
)

RULES_BY_ID = {r.check_id: r for r in RULES}

# The output dtype of a forward call against the dtypes it was given.
DTYPE_JOIN = Check("T1-dtype-propagation-joined", ("module.fwd.pre", "module.fwd.post"), tier=1,
                   frame_fields=("module_id", "module_class", "inputs", "output"), frame=_dtype_join)


def arm(name: str) -> tuple[tuple[Check, ...], frozenset[str]]:
    """Rules and active guards of an ablation arm (``full``, ``no_topo``, ``no_precond``)."""
    from dataclasses import replace

    from guardlens.operators.spec import ARMS
    guards = ARMS[name]
    swaps = {}
    if name == "no_topo":
        swaps = {"T1-replica-cksum-equal": _replicas("cross_rank_cksums"),
                 "T1-buffer-replica-cksum-equal": _replicas("cross_rank_buffer_cksums"),
                 "T1-grad-replica-cksum-equal": _replicas("cross_rank_grad_cksums"),
                 "T1-process-group-size-correct": _group_sizes(None)}
    if name == "no_precond":
        swaps = {"T1-expert-bias-fp32": _expert_bias_open}
    rules = tuple(replace(r, findings=swaps[r.check_id]) if r.check_id in swaps else r for r in RULES)
    return rules, guards


# -- declarative specs: 13 predicates with the same intent as their rules -------------------------

SPECS: tuple[Predicate, ...] = (
    Predicate("T0-build-has-modules", "path", Scope(("build.snapshot",), path="$.model"),
              Bound(fields=("n_parameters", "n_modules"), op=">", value=0), template="T32"),
    Predicate("T0-clip-grad-bounded", "flat", Scope(("utils.clip_grad.post",)),
              Bound(fields=("post_norm",), op="<=", value="max_norm", value_is_field=True, rel=CLIP_SLACK),
              template="T09"),
    Predicate("T0-initial-lr-present", "path", Scope(("scheduler.init",), path="$.param_groups[*]"),
              Bound(kind="equality", fields=("has_initial_lr",), value=True), template="T11",
              precondition=lambda p, row: p.last_epoch != -1, fields=("last_epoch",)),
    Predicate("T0-no-nan-inf", "walk", Scope(NAN_HOOKPOINTS, walk=True),
              Bound(kind="equality", fields=("has_nan", "has_inf"), value=False)),
    Predicate("T0-norm-output-unit-rms", "signature", Scope(("module.fwd.post",), path="$.output", signature=True),
              Bound(fields=("rms",), conditions=((">=", RMS_RANGE[0]), ("<=", RMS_RANGE[1]))), template="T04",
              precondition=lambda p, row: p.is_normalizer, fields=("is_normalizer",)),
    Predicate("T0-optim-lr-positive", "path", Scope(("build.snapshot",), path="$.optimizer.param_groups[*]"),
              Bound(fields=("lr",), op=">", value=0), template="T14"),
    Predicate("T0-optim-step-counter-monotonic", "monotonic", Scope(("optim.step.post",)),
              Bound(kind="monotonic", fields=("state_step_max",)), template="T15"),
    Predicate("T0-softmax-degenerate", "signature",
              Scope(("module.fwd.post", "functional.softmax"), path="$.output", signature=True),
              Bound(kind="equality", fields=("one_hot",), value=False), template="T17",
              precondition=lambda p, row: _is_router_scope(p), fields=("module_class",)),
    Predicate("T0-token-id-in-vocab", "path", Scope(("dataloader.batch",), path="$.input_ids"),
              Bound(fields=("max",), op="<=", value=TOKEN_ID_LIMIT)),
    Predicate("T1-expert-bias-fp32", "flat", Scope(("module.fwd.post",)),
              Bound(kind="equality", fields=("semantic.expert_bias_dtype",), value="float32"), tier=1, template="T05",
              precondition=lambda p, row: p.semantic.is_router & p.semantic.expert_bias_dtype.isNotNull()),
    Predicate("T1-jitter-preserves-dtype", "flat", Scope(("jitter.probe",)),
              Bound(kind="equality", fields=("dtypes_match",), value=True), tier=1, template="T05"),
    Predicate("T1-replica-cksum-equal", "path", Scope(("build.snapshot",), path="$.cross_rank_cksums[*]"),
              Bound(kind="equality", fields=("all_equal",), value=True), tier=1, template="T01",
              precondition=lambda p, row: row.group_size > 1),
    Predicate("T1-residual-stream-preserved", "flat", Scope(("residual.probe",)),
              Bound(fields=("d_to_normed_input",), op=">=", value="d_to_original_input", value_is_field=True), tier=1,
              template="T23"),
)


def spec_checks() -> list[Check]:
    return [compile_predicate(s) for s in SPECS]
