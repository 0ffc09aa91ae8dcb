"""Fault matrix and buggy / clean pairs for the rule library."""

import math

import pytest

from guardlens.operators import rules as R
from guardlens.operators import spec as S


def ts(**kw):
    return {"dtype": "float32", "shape": [8, 4], **kw}


BUILD = {"model": {"n_parameters": 5, "n_modules": 3}}
DROP = ("module.fwd.post", {"module_class": "Dropout"})
FRAG = {"framework_invariants": {"deepspeed": {"offload_optimizer": True, "gradient_accumulation_steps": 1, "zero_stage": 2}}}


def rep(**kw):
    return {"cross_rank_cksums": [{"name": "w", "local_cksum": 1, "gathered_cksums": [1, 2, 2, 2], **kw}]}


def blocks(values, hook="module.fwd.post"):
    out = []
    for b, v in enumerate(values):
        for _ in range(3):
            if hook == "module.fwd.post":
                p = {"module_class": "MLP", "module_name": f"blocks.{b}.mlp", "output": ts(l2_norm=v)}
            else:
                p = {"module_class": "MLP", "module_name": f"blocks.{b}.mlp", "grad_input": [ts(l2_norm=v)],
                     "grad_output": [ts(l2_norm=1.0)]}
            out.append((hook, p))
    return out


def resid(norm, out):
    sem = {"semantic": {"is_residual_block": True}, "module_class": "Block"}
    return [("module.fwd.pre", {**sem, "inputs": [ts(l2_norm=10.0)]}),
            ("module.fwd.post", {"module_class": "RMSNorm", "output": ts(l2_norm=norm)}),
            ("module.fwd.post", {**sem, "output": ts(l2_norm=out)})]


CASES = [
    ("T0-no-nan-inf", [("module.fwd.post", {"output": ts(has_nan=True)})], 1),
    ("T0-no-nan-inf", [("optim.step.pre", {"params": [ts(), ts(has_inf=True)]})], 1),
    ("T0-no-nan-inf", [("comm.post", {"tensor_post": ts(has_nan=True)})], 1),
    ("T0-no-nan-inf", [("build.snapshot", {"model": {"parameters": [{"name": "w", **ts(), "tensor_summary": ts(has_nan=True)}]}})], 1),
    ("T0-no-nan-inf", [("module.fwd.post", {"output": ts(has_nan=False)})], 0),
    ("T0-clip-grad-bounded", [("utils.clip_grad.post", {"max_norm": 1.0, "post_norm": 2.0})], 1),
    ("T0-clip-grad-bounded", [("utils.clip_grad.post", {"max_norm": 1.0, "post_norm": 1.005})], 0),
    ("T0-optim-lr-positive", [("build.snapshot", {"optimizer": {"param_groups": [{"index": 0, "lr": 0.0}, {"index": 1, "lr": -1.0}, {"index": 2}]}})], 3),
    ("T0-optim-lr-positive", [("build.snapshot", {"optimizer": {"param_groups": [{"index": 0, "lr": 0.1}]}})], 0),
    ("T0-build-has-modules", [("build.snapshot", {"model": {"n_parameters": 0, "n_modules": 2}})], 1),
    ("T0-build-has-modules", [("build.snapshot", {})], 1),
    ("T0-build-has-modules", [("build.snapshot", BUILD)], 0),
    ("T0-initial-lr-present", [("scheduler.init", {"last_epoch": 10, "param_groups": [{"index": 0, "has_initial_lr": False}, {"index": 1, "has_initial_lr": True}]})], 1),
    ("T0-initial-lr-present", [("scheduler.init", {"last_epoch": -1, "param_groups": [{"index": 0, "has_initial_lr": False}]})], 0),
    ("T0-token-id-in-vocab", [("dataloader.batch", {"input_ids": ts(max=5_000_000.0)})], 1),
    ("T0-token-id-in-vocab", [("dataloader.batch", {"input_ids": ts(max=2.0 ** 31 - 1, min=-1.0)})], 2),
    ("T0-token-id-in-vocab", [("dataloader.batch", {"input_ids": ts(max=2.0 ** 20, min=0.0)})], 0),
    ("T0-norm-output-unit-rms", [("module.fwd.post", {"is_normalizer": True, "output": ts(l2_norm=0.33 * math.sqrt(32))})], 1),
    ("T0-norm-output-unit-rms", [("module.fwd.post", {"is_normalizer": True, "output": ts(l2_norm=0.55 * math.sqrt(32))})], 0),
    ("T0-norm-output-unit-rms", [("module.fwd.post", {"is_normalizer": False, "output": ts(l2_norm=99.0)})], 0),
    ("T0-softmax-degenerate", [("module.fwd.post", {"module_class": "TopKRouter", "output": {"dtype": "f", "shape": [4, 1], "l2_norm": 2.0, "abs_max": 1.0}})], 1),
    ("T0-softmax-degenerate", [("functional.softmax", {"output": {"dtype": "f", "shape": [16, 1], "l2_norm": 4.0, "max": 1.0, "abs_max": 0.0}})], 1),
    ("T0-softmax-degenerate", [("module.fwd.post", {"module_class": "TopKRouter", "outputs": [{"dtype": "f", "shape": [4, 1], "l2_norm": 2.0, "abs_max": 1.0}]})], 1),
    ("T0-softmax-degenerate", [("module.fwd.post", {"module_class": "Linear", "output": {"dtype": "f", "shape": [4, 1], "l2_norm": 2.0, "abs_max": 1.0}})], 0),
    ("T0-optim-step-counter-monotonic", [("optim.step.post", {"state_step_max": v}) for v in (5, 5, 5)], 2),
    ("T0-optim-step-counter-monotonic", [("optim.step.post", {"state_step_max": v}) for v in (10, 8)], 1),
    ("T0-optim-step-counter-monotonic", [("optim.step.post", {"state_step_max": v}) for v in (1, 2, 3)], 0),
    ("T0-checkpoint-preserve-rng", [DROP, ("checkpoint.call", {"preserve_rng_state": False, "function": "f"})], 1),
    ("T0-checkpoint-preserve-rng", [("build.snapshot", {"model": {"parameters": [{"name": "Dropout.p"}]}}), ("checkpoint.call", {"preserve_rng_state": False})], 1),
    ("T0-checkpoint-preserve-rng", [("checkpoint.call", {"preserve_rng_state": False})], 0),
    ("T1-replica-cksum-equal", [("build.snapshot", rep(group_size=4, all_equal=False))], 1),
    ("T1-replica-cksum-equal", [("build.snapshot", rep(group_size=1, all_equal=False))], 0),
    ("T1-residual-stream-preserved", [("residual.probe", {"d_to_original_input": 5.0, "d_to_normed_input": 1.0})], 1),
    ("T1-residual-stream-preserved", [("residual.probe", {"d_to_original_input": 1.0, "d_to_normed_input": 5.0})], 0),
    ("T1-residual-stream-preserved", resid(1.0, 1.1), 1),
    ("T1-residual-stream-preserved", resid(1.0, 9.0), 0),
    ("T1-router-has-calculate-per-token-loss", [("build.snapshot", {"framework_invariants": {"megatron": {"calculate_per_token_loss": True}}}), ("module.fwd.post", {"semantic": {"is_router": True, "has_calculate_per_token_loss": False}})], 1),
    ("T1-router-has-calculate-per-token-loss", [("module.fwd.post", {"semantic": {"is_router": True, "has_calculate_per_token_loss": False}})], 0),
    ("T1-expert-bias-fp32", [("module.fwd.post", {"semantic": {"is_router": True, "expert_bias_dtype": "bfloat16"}})], 1),
    ("T1-expert-bias-fp32", [("module.fwd.post", {"semantic": {"is_router": True, "expert_bias_dtype": "float32"}})], 0),
    ("T1-layer-count-strict", [("build.snapshot", {"framework_invariants": {"megatron": {"num_layers": 24, "pipeline_model_parallel_size": 5, "n_transformer_layers_in_local_module": 4}}})], 1),
    ("T1-layer-count-strict", [("build.snapshot", {"framework_invariants": {"megatron": {"num_layers": 20, "pipeline_model_parallel_size": 5, "n_transformer_layers_in_local_module": 4}}})], 0),
    ("T1-jitter-preserves-dtype", [("jitter.probe", {"dtypes_match": False})], 1),
    ("T1-sqrt-decay-front-loaded", [("decay.probe", {"progress": i / 10, "result": 1 - (1 - i / 10) ** 2}) for i in range(10)], 1),
    ("T1-sqrt-decay-front-loaded", [("decay.probe", {"progress": i / 10, "result": (i / 10) ** 2}) for i in range(10)], 0),
    ("T0-attention-head-uniformity", [("attention.fwd.post", '{"max_to_min_ratio": Infinity, "any_zero_head": false}')], 1),
    ("T0-attention-head-uniformity", [("attention.fwd.post", {"max_to_min_ratio": 10.0})], 0),
    ("T0-grad-norm-finite", [("optim.step.pre", '{"total_grad_l2": NaN}'), ("optim.step.pre", '{"total_grad_l2": Infinity}'), ("optim.step.pre", {"total_grad_l2": 0.0}), ("optim.step.pre", {"total_grad_l2": 2e10}), ("optim.step.pre", {"total_grad_l2": 1.0})], 4),
    ("T0-evaluator-eval-mode", [("module.fwd.pre", {"grad_enabled": False, "training": True})] * 2, 2),
    ("T0-evaluator-eval-mode", [("module.fwd.pre", {"grad_enabled": False, "training": True})], 0),
    ("T0-evaluator-eval-mode", [("checkpoint.call", {})] + [("module.fwd.pre", {"grad_enabled": False, "training": True})] * 2, 0),
    ("T0-loss-per-token-dispersion", [("loss.call", {"per_token": {"median": 1.0, "max": 101.0}})], 1),
    ("T0-loss-per-token-dispersion", [("loss.call", {"per_token": {"median": 1.0, "max": 101.0, "all_ignored": True}})], 0),
    ("T0-loss-reduction-mode-correct", [("loss.call", {"reduction": "sum"}), ("loss.call", {"reduction": "mean"}), ("loss.call", {})], 1),
    ("T0-module-grad-output-alive", [("module.bwd", {"module_class": "Linear", "grad_output": [None, ts(l2_norm=0.0)]})], 1),
    ("T0-module-grad-output-alive", [("module.bwd", {"module_class": "Other", "grad_output": [ts(l2_norm=0.0)]})], 0),
    ("T0-param-update-applied", [("optim.step.post", {"total_param_delta_l2": 0.0}), ("optim.step.post", {"total_param_delta_l2": 1.0, "n_params_unchanged_with_grad": 2}), ("optim.step.post", {"total_param_delta_l2": 1.0})], 2),
    ("T1-comm-dtype-matches-training", [("build.snapshot", {"framework_invariants": {"fw": {"training_dtype": "bfloat16"}}}), ("comm.post", {"op": "all_reduce", "tensor_post": ts()}), ("comm.post", {"op": "broadcast", "tensor_post": ts()}), ("comm.post", {"op": "all_reduce", "tensor_post": {"dtype": "torch.bfloat16", "shape": [1]}})], 1),
    ("T1-comm-dtype-matches-training", [("comm.post", {"op": "all_reduce", "tensor_post": ts()})], 0),
    ("T1-process-group-size-correct", [("build.snapshot", {"framework_invariants": {"fw": {"tp_size_declared": 4, "tp_size_actual": 2, "dp_size_declared": 1, "dp_size_actual": 2}}})], 1),
    ("T1-multi-backward-per-step-fragile-config", [("build.snapshot", FRAG), ("module.fwd.pre", {"module_name": ""}), ("module.fwd.pre", {})], 1),
    ("T1-multi-backward-per-step-fragile-config", [("module.fwd.pre", {"module_name": ""}), ("module.fwd.pre", {})], 0),
    ("T1-fwd-output-block-uniformity", blocks([1.0, 1.0, 1.1, 500.0]), 1),
    ("T1-fwd-output-block-uniformity", blocks([1.0, 1.0, 500.0]), 0),
    ("T1-grad-flow-block-uniformity", blocks([1.0, 1.0, 1.1, 0.001], "module.bwd"), 1),
    ("T1-buffer-replica-cksum-equal", [("build.snapshot", {"cross_rank_buffer_cksums": [{"name": "b", "group_size": 2, "all_equal": False}]})], 1),
    ("T1-grad-replica-cksum-equal", [("optim.step.pre", {"cross_rank_grad_cksums": [{"name": "b", "group_size": 2, "all_equal": False}]})], 1),
]


def test_library_has_all_rules():
    assert len(R.RULES) == 32 and len(R.RULES_BY_ID) == 32 and len(R.SPECS) == 13


def test_fault_matrix(trace):
    """Every case becomes a run of one trace; all rules run over it together."""
    events, expected = [], {}
    for i, (rule, evs, n) in enumerate(CASES):
        expected[(f"case{i}", rule)] = n
        events += [(h, p, None, None, f"case{i}") for h, p in evs]
    got = {(r.run, r.check_id): r["n"] for r in S.violations(trace(*events), R.RULES).groupBy("run", "check_id")
           .count().withColumnRenamed("count", "n").collect()}
    wrong = {k: (n, got.get(k, 0)) for k, n in expected.items() if got.get(k, 0) != n}
    assert not wrong


def test_results_status(trace):
    t = trace(("utils.clip_grad.post", {"max_norm": 1.0, "post_norm": 2.0}), ("optim.step.post", {"state_step_max": 1}), ("optim.step.post", {"state_step_max": 2}))
    st = {r.check_id: (r.status, r.n_violations) for r in S.results(t, R.RULES).collect()}
    assert st["T0-clip-grad-bounded"] == ("fail", 1)
    assert st["T0-optim-step-counter-monotonic"] == ("pass", 0)
    assert st["T0-no-nan-inf"] == ("pass", 0)
    assert st["T1-jitter-preserves-dtype"] == ("passive", 0)


def test_results_error_and_passive(trace):
    snap = lambda **kw: ("build.snapshot", {"framework_invariants": {"megatron": kw}, "model": {"n_parameters": 3, "n_modules": 1}})
    comm = ("comm.post", {"op": "all_reduce", "tensor_post": {"dtype": "float32", "shape": [1]}})
    router = ("module.fwd.post", {"module_class": "R", "semantic": {"is_router": True, "has_calculate_per_token_loss": False}})
    runs = {"declared": [snap(training_dtype="bfloat16", calculate_per_token_loss="true"), comm, router],
            "undeclared": [snap(), comm, router],
            "off": [snap(training_dtype="float32", calculate_per_token_loss="false"), comm, router],
            "broken": [("loss.call", {"per_token": "no struct", "reduction": "mean"}), ("optim.step.pre", "{cut off"), ("scheduler.init", {"last_epoch": 1, "param_groups": [{"has_initial_lr": "?"}]})],
            "both": [("optim.step.pre", {"total_grad_l2": "x"}), ("optim.step.pre", {"total_grad_l2": float("nan")})]}
    t = trace(*[(h, p, None, None, run) for run, evs in runs.items() for h, p in evs])
    st = {(r.run, r.check_id): (r.status, r.n_violations, r.n_errors) for r in S.results(t, R.RULES).collect()}
    comm_rule, router_rule = "T1-comm-dtype-matches-training", "T1-router-has-calculate-per-token-loss"
    assert [st[run, comm_rule][0] for run in runs] == ["fail", "passive", "pass", "passive", "passive"]
    assert [st[run, router_rule][0] for run in runs] == ["fail", "passive", "passive", "passive", "passive"]
    # a payload is an error only of the checks that need what does not fit
    assert st["broken", "T0-loss-per-token-dispersion"] == ("error", 0, 1) and st["broken", "T0-loss-reduction-mode-correct"] == ("pass", 0, 0)
    assert st["broken", "T0-grad-norm-finite"] == ("error", 0, 1) and st["broken", "T0-initial-lr-present"] == ("error", 0, 1)
    assert st["both", "T0-grad-norm-finite"] == ("fail", 1, 1)


SPEC_CASES = {s.check_id: [(evs, n) for rule, evs, n in CASES if rule == s.check_id] for s in R.SPECS}


def test_specs_agree_with_rules(trace):
    events = []
    for i, (rule, evs, n) in enumerate(CASES):
        if rule in SPEC_CASES:
            events += [(h, p, None, None, f"case{i}") for h, p in evs]
    t = trace(*events)
    ids = set(SPEC_CASES)
    a = {(r.run, r.check_id, r.event_id) for r in S.violations(t, [x for x in R.RULES if x.check_id in ids]).collect()}
    b = {(r.run, r.check_id, r.event_id) for r in S.violations(t, R.spec_checks()).collect()}
    # Known scope differences of the declarative form: no outputs[] for softmax, no negative ids,
    # missing values pass, no magnitude fallback for residual blocks.
    extra = b - a
    assert not extra
    missing = {k[1] for k in a - b}
    assert missing <= {"T0-softmax-degenerate", "T0-build-has-modules", "T0-optim-lr-positive",
                       "T1-residual-stream-preserved", "T0-token-id-in-vocab"}


def test_fused_equals_single(trace):
    events = [(h, p, None, None, f"case{i}") for i, (_, evs, _) in enumerate(CASES) for h, p in evs]
    t = trace(*events)
    rows = [r for r in R.RULES if r.findings is not None]
    fused = sorted(map(tuple, S.violations(t, rows).collect()), key=str)
    single = []
    for r in rows[:6]:
        single += [tuple(x) for x in S.violations(t, [r]).collect()]
    ids = {r.check_id for r in rows[:6]}
    assert sorted(map(str, single)) == sorted(str(f) for f in fused if f[0] in ids)


@pytest.mark.parametrize("arm", ["no_topo", "no_precond"])
def test_guard_monotone(trace, arm):
    """Dropping a guard never removes a violation (group-shaped rules excepted)."""
    events = [(h, p, None, None, f"case{i}") for i, (_, evs, _) in enumerate(CASES) for h, p in evs]
    t = trace(*events)
    skip = {"T1-fwd-output-block-uniformity", "T1-grad-flow-block-uniformity", "T1-residual-stream-preserved"}
    rules, guards = R.arm(arm)
    full = {(r.run, r.check_id, r.event_id) for r in S.violations(t, R.RULES).collect() if r.check_id not in skip}
    less = {(r.run, r.check_id, r.event_id) for r in S.violations(t, rules, guards).collect()}
    assert full <= less
    assert len(less) > len(full)


def test_predicate_rejects_malformed():
    with pytest.raises(ValueError):
        S.Predicate("x", "path", S.Scope(("a",)), S.Bound(fields=("f",), op=">", value=0))
    with pytest.raises(ValueError):
        S.Predicate("x", "nope", S.Scope(("a",)), S.Bound(fields=("f",)))
    with pytest.raises(ValueError):
        S.Predicate("x", "flat", S.Scope(("a",)), S.Bound(kind="monotonic", fields=("f",)))
    with pytest.raises(ValueError):
        S.Bound(fields=("f",), op="~")
    with pytest.raises(ValueError):
        S.Bound(fields=())
    with pytest.raises(ValueError):
        S.Predicate("x", "path", S.Scope(("a",), path="model"), S.Bound(fields=("f",)))


def test_monotonic_is_per_rank(trace):
    evs = [("optim.step.post", {"state_step_max": v}, None, r) for v in (1, 2) for r in (0, 1)]
    t = trace(*evs)
    by_rank = S.violations(t, [R.RULES_BY_ID["T0-optim-step-counter-monotonic"]]).count()
    blind = S.Check("m", ("optim.step.post",), frame_fields=("state_step_max",),
                    frame=S.monotonic_frame("state_step_max", by=("run",)))
    assert by_rank == 0 and S.violations(t, [blind]).count() == 2
