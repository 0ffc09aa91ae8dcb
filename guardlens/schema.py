"""Fixed schemas: trace envelope, typed payload, state dump, timeline, result tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import types as T


def _st(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()

ENVELOPE = _st(event_id=L, step=I, rank=I, hookpoint=S, ts_ns=L, schema_version=I, payload=S)

TENSOR = _st(dtype=S, shape=T.ArrayType(L), device=S, l2_norm=D, has_nan=B, has_inf=B, abs_max=D,
             max=D, min=D, mean=D, std=D, zero_rate=D)

REPLICA = _st(name=S, local_cksum=S, gathered_cksums=T.ArrayType(S), all_equal=B, group_size=L)

PARAM = T.StructType([*TENSOR.fields, T.StructField("name", S), T.StructField("requires_grad", B),
                      T.StructField("is_leaf", B), T.StructField("tensor_summary", TENSOR),
                      T.StructField("semantic", T.MapType(S, S))])

PARAM_GROUP = _st(index=L, keys=T.ArrayType(S), lr=D, has_initial_lr=B, n_params=L)

MODEL = T.StructType([T.StructField("class", S), T.StructField("n_parameters", L), T.StructField("n_modules", L),
                      T.StructField("parameters", T.ArrayType(PARAM)),
                      T.StructField("active_adapters", T.ArrayType(S))])

SEMANTIC = _st(is_router=B, expert_bias_dtype=S, has_calculate_per_token_loss=B, is_residual_block=B,
               is_moe_layer=B, is_tp_linear=B, is_transformer_layer=B, replica_group_kind=S)

CALLSITE = _st(file=S, line=L, function=S)

PER_TOKEN = _st(n_total=L, n_ignored=L, mean=D, std=D, min=D, max=D, median=D, p99=D, all_ignored=B)

# One typed payload for every hookpoint. A plan parses only the top-level fields that its
# checks declare (``payload_schema``), so the JSON reader skips the rest.
PAYLOAD = _st(
    kind=S, module_class=S, module_id=L, module_name=S, is_normalizer=B, training=B, grad_enabled=B,
    inputs=T.ArrayType(TENSOR), output=TENSOR, outputs=T.ArrayType(TENSOR), semantic=SEMANTIC,
    grad_input=T.ArrayType(TENSOR), grad_output=T.ArrayType(TENSOR), params=T.ArrayType(TENSOR),
    model=MODEL, framework_invariants=T.MapType(S, T.MapType(S, S)),
    cross_rank_cksums=T.ArrayType(REPLICA), cross_rank_buffer_cksums=T.ArrayType(REPLICA),
    cross_rank_grad_cksums=T.ArrayType(REPLICA), optimizer=T.StructType([
        T.StructField("class", S), T.StructField("n_param_groups", L),
        T.StructField("param_groups", T.ArrayType(PARAM_GROUP))]),
    optimizer_class=S, param_groups=T.ArrayType(PARAM_GROUP), n_params=L, total_grad_l2=D, total_param_l2=D,
    total_param_delta_l2=D, max_param_delta_l2=D, n_params_unchanged=L, n_params_unchanged_with_grad=L,
    state_step_min=L, state_step_max=L, fn=S, max_norm=D, pre_norm=D, post_norm=D, ratio=D, callsite=CALLSITE,
    scheduler_class=S, last_epoch=L, op=S, group_size=L, tensor_pre=TENSOR, tensor_post=TENSOR, reduction=S,
    ignore_index=L, label_smoothing=D, input_shape=T.ArrayType(L), target_shape=T.ArrayType(L), input_dtype=S,
    aggregate_loss=D, per_token=PER_TOKEN, output_shape=T.ArrayType(L), n_heads=L, head_dim=L,
    per_head_l2=T.ArrayType(D), per_head_abs_max=T.ArrayType(D), min_head_l2=D, max_head_l2=D, mean_head_l2=D,
    max_to_min_ratio=D, any_zero_head=B, input_ids=TENSOR, function=S, preserve_rng_state=B, use_reentrant=B,
    kwargs_keys=T.ArrayType(S), dim=L, microbatch_idx_within_step=L, outer_step=L, output_dtype=S, dtypes_match=B,
    block_class=S, norm_class=S, d_to_original_input=D, d_to_normed_input=D, progress=D, result=D, initial_lr=D,
    decay_min_lr=D,
)


def payload_schema(fields: Iterable[str], tensor: Sequence[str] | None = None) -> T.StructType:
    """Payload fields to parse; of every tensor summary only the fields named by ``tensor``, if it is given."""
    wanted = set(fields)
    unknown = wanted - set(PAYLOAD.fieldNames())
    if unknown:
        raise ValueError(f"unknown payload fields: {sorted(unknown)}")
    found = T.StructType([f for f in PAYLOAD.fields if f.name in wanted])
    return found if tensor is None else narrow(found, set(tensor))


def narrow(t: T.DataType, names: set[str]) -> T.DataType:
    if isinstance(t, T.ArrayType):
        return T.ArrayType(narrow(t.elementType, names), t.containsNull)
    if not isinstance(t, T.StructType):
        return t
    own = set(TENSOR.fieldNames()) - names if set(TENSOR.fieldNames()) <= set(t.fieldNames()) else set()
    return T.StructType([T.StructField(f.name, narrow(f.dataType, names), f.nullable) for f in t.fields if f.name not in own])


STATE_DATA = _st(
    name=S, cksum=S, shape=T.ArrayType(L), type=S, requires_grad=B, grad_cksum=S, grad_shape=T.ArrayType(L),
    grad_type=S, param_sharded=B, param_full_replica=B, min=D, max=D, quantile_25=D, quantile_50=D, quantile_75=D,
    skewness=D, kurtosis=D, histogram_cksum=S, entropy=D, state_key=S, lr=D, param_group_idx=L,
    cpu_rng_state_cksum=S, cuda_rng_state_cksum=S, dp=I, tp=I, pp=I, cp=I, ep=I,
    tp_size=I, dp_size=I, pp_size=I, cp_size=I, ep_size=I)

STATE_DUMP = _st(step=I, stage=S, data=S)

TIMELINE_CSV = _st(timestamp=L, rank=I, stream=I, op_type=S, op_name=S, op_phase=S)

VIOLATION = _st(check_id=S, run=S, rank=I, step=I, event_id=L, entity=S, issue=S, observed=D)
VIOLATION_COLUMNS = VIOLATION.fieldNames()

# Hookpoint names are fixed values of the trace format.
HOOKPOINTS = (
    "attention.fwd.post", "build.snapshot", "checkpoint.call", "comm.post", "comm.pre", "dataloader.batch",
    "decay.probe", "functional.softmax", "grad_accum.backward", "jitter.probe", "loss.call", "module.bwd",
    "module.fwd.post", "module.fwd.pre", "optim.step.post", "optim.step.pre", "residual.probe", "scheduler.init",
    "utils.clip_grad.post", "utils.clip_grad.pre",
)
