"""Rule library over traces derived from whole tables (E)."""

from pyspark.sql import functions as F

from guardlens.operators import generic as G
from guardlens.operators import rules as R
from guardlens.operators import spec as S
from guardlens.plans.registry import query
from guardlens.plans.views import tensor_json

INF = float("inf")


def found(trace, *ids, checks=None, guards=S.ALL_GUARDS, digits=6):
    checks = checks or [R.RULES_BY_ID[i] for i in ids]
    observed = F.col("observed") if digits is None else F.round("observed", digits)
    return S.violations(trace, checks, guards).select("run", "event_id", "entity", "issue", observed.alias("observed"))


def kmap(**kv):
    return F.create_map(*[x for k, c in kv.items() for x in (F.lit(k), c.cast("string"))])


def attention(v):
    ratio = F.when(F.col("user_id") == 31, F.lit(INF)).otherwise(F.col("value") / 4)
    return v.events_as("attention.fwd.post", "events", "event_id", max_to_min_ratio=ratio, any_zero_head=F.col("user_id") % 29 == 0,
                       module_name=F.concat(F.lit("layers."), (F.col("user_id") % 8).cast("string")))


@query("e01_attention_head_uniformity", """
SELECT 'run' || CAST(event_id % 3 AS VARCHAR) AS run, event_id, 'layers.' || CAST(user_id % 8 AS VARCHAR) AS entity, 'per-head ratio' AS issue,
       ratio AS observed
FROM (SELECT *, CASE WHEN user_id = 31 THEN 'inf'::DOUBLE ELSE value / 4 END AS ratio FROM events)
WHERE ratio IS NOT NULL AND (user_id % 29 = 0 OR (ratio > 10 AND NOT isnan(ratio)))""")
def e01(v):
    """The ratio as it is: halves of the last digit are rounded differently by the two engines."""
    return found(attention(v), "T0-attention-head-uniformity", digits=None)


@query("e02_checkpoint_preserve_rng", """
WITH c AS (SELECT DISTINCT c_custkey % 3 AS r FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 3 <> 1)
SELECT 'run' || CAST(page_id % 3 AS VARCHAR) AS run, page_id + 1000000000 AS event_id, url AS entity, 'preserve_rng_state=false' AS issue, CAST(NULL AS DOUBLE) AS observed
FROM pages WHERE url LIKE 'https%' AND page_id % 3 IN (SELECT r FROM c)""")
def e02(v):
    calls = v.events_as("checkpoint.call", "pages", F.col("page_id") + 1000000000, key=F.col("page_id"),
                        preserve_rng_state=~F.col("url").startswith("https"), function=F.col("url"))
    cls = F.when((F.col("c_mktsegment") == "BUILDING") & (F.col("c_custkey") % 3 != 1), "Dropout").otherwise("Linear")
    return found(calls.unionByName(v.events_as("module.fwd.post", "customer", "c_custkey", module_class=cls)), "T0-checkpoint-preserve-rng")


def clip(v):
    return v.events_as("utils.clip_grad.post", "events", "event_id", max_norm=F.lit(40.0), post_norm=F.col("value"),
                       pre_norm=F.col("value") * 2, fn=F.lit("clip"), ratio=F.col("value") / 40.0)


@query("e03_clip_grad_bounded", """
SELECT 'run' || CAST(event_id % 3 AS VARCHAR) AS run, event_id, 'post_norm' AS entity, 'above max_norm' AS issue, round(value, 6) AS observed
FROM events WHERE value > 40.0 * 1.01""")
def e03(v):
    return found(clip(v), "T0-clip-grad-bounded")


@query("e04_dtype_propagation", """
SELECT 'run' || CAST(o_orderkey % 3 AS VARCHAR) AS run, 2 * o_orderkey + 1 AS event_id, 'Linear' AS entity,
       CASE WHEN o_orderstatus = 'F' THEN 'bfloat16' ELSE 'float32' END || '->' || CASE WHEN o_orderpriority < '3' THEN 'bfloat16' ELSE 'float32' END AS issue,
       CAST(NULL AS DOUBLE) AS observed
FROM orders WHERE (o_orderstatus = 'F') <> (o_orderpriority < '3')""")
def e04(v):
    key = F.col("o_orderkey")
    common = dict(key=key, module_id=F.col("o_custkey") % 50, module_class=F.lit("Linear"))
    din = F.when(F.col("o_orderstatus") == "F", "bfloat16").otherwise("float32")
    dout = F.when(F.col("o_orderpriority") < "3", "bfloat16").otherwise("float32")
    pre = v.events_as("module.fwd.pre", "orders", key * 2, inputs=F.array(tensor_json(dtype=din)), **common)
    post = v.events_as("module.fwd.post", "orders", key * 2 + 1, output=tensor_json(dtype=dout), **common)
    return found(pre.unionByName(post), checks=[R.DTYPE_JOIN])


@query("e05_evaluator_eval_mode", """
WITH b AS (SELECT event_id % 3 AS r, event_id, 'm' || CAST(user_id AS VARCHAR) AS entity FROM events WHERE value < 20 AND event_type = 'view')
SELECT 'run' || CAST(r AS VARCHAR) AS run, event_id, entity, 'training under no_grad' AS issue, CAST(NULL AS DOUBLE) AS observed
FROM b WHERE r <> 0 AND r IN (SELECT r FROM b GROUP BY r HAVING count(*) >= 2)""")
def e05(v):
    fwd = v.events_as("module.fwd.pre", "events", "event_id", grad_enabled=F.col("value") >= 20, training=F.col("event_type") == "view",
                      module_name=F.concat(F.lit("m"), F.col("user_id").cast("string")))
    ck = v.events_as("checkpoint.call", "pages", F.col("page_id") + 1000000000, key=F.lit(0), function=F.col("url"))
    return found(fwd.unionByName(ck), "T0-evaluator-eval-mode")


@query("e06_grad_norm_finite", """
WITH g AS (SELECT o_orderkey, CASE WHEN o_custkey % 50 = 1 THEN 'nan'::DOUBLE WHEN o_custkey % 52 = 1 THEN 'inf'::DOUBLE WHEN o_custkey % 51 = 1 THEN 0.0
  WHEN o_totalprice > 400000 THEN o_totalprice * 1e6 ELSE o_totalprice END AS g FROM orders),
i AS (SELECT *, CASE WHEN isnan(g) THEN 'NaN' WHEN isinf(g) THEN 'Inf' WHEN g = 0 THEN 'zero' WHEN g > 1e10 THEN 'explosion' END AS issue FROM g)
SELECT 'run' || CAST(o_orderkey % 3 AS VARCHAR) AS run, o_orderkey AS event_id, 'total_grad_l2' AS entity, issue, g AS observed FROM i WHERE issue IS NOT NULL""")
def e06(v):
    """The norm as it is: rounding changes numbers of twelve digits by their last bit in one engine."""
    c = F.col("o_custkey")
    g = (F.when(c % 50 == 1, F.lit(float("nan"))).when(c % 52 == 1, F.lit(INF)).when(c % 51 == 1, 0.0)
         .when(F.col("o_totalprice") > 400000, F.col("o_totalprice") * 1e6).otherwise(F.col("o_totalprice")))
    return found(v.events_as("optim.step.pre", "orders", "o_orderkey", total_grad_l2=g), "T0-grad-norm-finite", digits=None)


@query("e07_initial_lr_present", """
SELECT 'run' || CAST(o_orderkey % 3 AS VARCHAR) AS run, o_orderkey AS event_id, entity, 'initial_lr missing' AS issue, 10.0::DOUBLE AS observed FROM (
  SELECT o_orderkey, '0' AS entity FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT'
  UNION ALL SELECT o_orderkey, '1' FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority IN ('2-HIGH', '5-LOW'))""")
def e07(v):
    pri = F.col("o_orderpriority")
    groups = F.array(F.struct(F.lit(0).alias("index"), (pri != "1-URGENT").alias("has_initial_lr")),
                     F.struct(F.lit(1).alias("index"), F.when(pri == "5-LOW", F.lit(None).cast("boolean")).otherwise(pri != "2-HIGH").alias("has_initial_lr")))
    t = v.events_as("scheduler.init", "orders", "o_orderkey", last_epoch=F.when(F.col("o_orderstatus") == "F", -1).otherwise(10), param_groups=groups)
    return found(t, "T0-initial-lr-present")


@query("e08_build_has_modules", """
SELECT 'run' || CAST(p_partkey % 3 AS VARCHAR) AS run, p_partkey AS event_id, 'model' AS entity, 'empty model' AS issue, 0.0::DOUBLE AS observed
FROM part WHERE p_size = 1 OR p_type = 'PROMO'""")
def e08(v):
    m = F.struct((F.col("p_size") - 1).alias("n_parameters"), F.when(F.col("p_type") != "PROMO", F.length("p_name")).alias("n_modules"))
    return found(v.events_as("build.snapshot", "part", "p_partkey", model=m), "T0-build-has-modules")


@query("e09_loss_per_token_dispersion", """
SELECT 'run' || CAST(event_id % 3 AS VARCHAR) AS run, event_id, 'per_token' AS entity, 'max/median' AS issue, round((value * 10) / (user_id / 10.0), 6) AS observed
FROM events WHERE user_id > 0 AND event_type <> 'error' AND (value * 10) / (user_id / 10.0) > 100""")
def e09(v):
    pt = F.struct((F.col("user_id") / 10.0).alias("median"), (F.col("value") * 10).alias("max"), (F.col("event_type") == "error").alias("all_ignored"))
    return found(v.events_as("loss.call", "events", "event_id", per_token=pt), "T0-loss-per-token-dispersion")


@query("e10_loss_reduction_mode", """
SELECT 'run' || CAST(o_orderkey % 3 AS VARCHAR) AS run, o_orderkey AS event_id, 'cross_entropy' AS entity,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'sum' ELSE 'none' END AS issue, CAST(NULL AS DOUBLE) AS observed
FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""")
def e10(v):
    red = F.when(F.col("o_orderpriority") == "1-URGENT", "sum").when(F.col("o_orderpriority") == "5-LOW", "none").when(F.col("o_orderpriority") == "2-HIGH", "mean")
    return found(v.events_as("loss.call", "orders", "o_orderkey", reduction=red, fn=F.lit("cross_entropy")), "T0-loss-reduction-mode-correct")


@query("e11_module_grad_output_alive", """
SELECT 'run' || CAST(c_custkey % 3 AS VARCHAR) AS run, c_custkey AS event_id, c_name AS entity, 'zero grad_output' AS issue, 0.0::DOUBLE AS observed
FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal <= 0""")
def e11(v):
    """Balances up to zero are gradients of zero; without a balance there is no norm."""
    cls = F.when(F.col("c_mktsegment") == "BUILDING", "Linear").when(F.col("c_mktsegment") == "MACHINERY", "LayerNorm").otherwise("Attention")
    go = F.array(tensor_json(l2_norm=F.lit(1.0)), tensor_json(l2_norm=F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).when(F.col("c_acctbal") <= 0, 0.0)))
    return found(v.events_as("module.bwd", "customer", "c_custkey", module_class=cls, module_name=F.col("c_name"), grad_output=go), "T0-module-grad-output-alive")


@query("e12_no_nan_inf", """
SELECT 'run' || CAST(event_id % 3 AS VARCHAR) AS run, event_id, event_type AS entity, 'nan/inf' AS issue, CAST(NULL AS DOUBLE) AS observed
FROM events WHERE (event_type = 'view' AND value > 100) OR (event_type = 'error' AND value > 150) OR (event_type = 'click' AND user_id % 50 = 3)""")
def e12(v):
    t, val = F.col("event_type"), F.col("value")
    hook = F.when(t == "view", "module.fwd.post").when(t == "error", "optim.step.pre").when(t == "click", "build.snapshot").otherwise("comm.post")
    tr = v.events_as(hook, "events", "event_id", module_name=t, output=tensor_json(has_nan=(t == "view") & (val > 100)),
                     params=F.array(tensor_json(has_inf=F.lit(False)), tensor_json(has_inf=(t == "error") & (val > 150))),
                     model=F.struct(F.array(F.struct(F.lit("w").alias("name"), tensor_json(has_inf=(t == "click") & (F.col("user_id") % 50 == 3)).alias("tensor_summary"))).alias("parameters")))
    return found(tr, "T0-no-nan-inf")


def norm_trace(v):
    return v.events_as("module.fwd.post", v.tensor, "vec_id", is_normalizer=F.col("block") != 2, module_class=F.concat(F.lit("RMSNorm"), F.col("label").cast("string")),
                       output=tensor_json(l2_norm=F.col("l2") * F.col("label"), shape=F.col("shape")))


@query("e13_norm_output_unit_rms", """
SELECT 'run' || CAST(vec_id % 3 AS VARCHAR) AS run, vec_id AS event_id, 'RMSNorm' || CAST(label AS VARCHAR) AS entity, 'rms' AS issue,
       round(l2 * label / sqrt(CAST(shape[1] AS DOUBLE)), 6) AS observed
FROM v_tensor WHERE block <> 2 AND NOT (l2 * label / sqrt(CAST(shape[1] AS DOUBLE)) BETWEEN 0.5 AND 2.0)""")
def e13(v):
    return found(norm_trace(v), "T0-norm-output-unit-rms")


@query("e14_optim_lr_positive", """
SELECT 'run' || CAST(p_partkey % 3 AS VARCHAR) AS run, p_partkey AS event_id, entity, issue, round(observed, 6) AS observed FROM (
  SELECT p_partkey, '0' AS entity, 'lr not positive' AS issue, p_retailprice - 950 AS observed FROM part WHERE p_retailprice - 950 <= 0
  UNION ALL SELECT p_partkey, '1', 'lr missing', NULL FROM part WHERE p_size > 45)""")
def e14(v):
    g = F.array(F.struct(F.lit(0).alias("index"), (F.col("p_retailprice") - 950).alias("lr")),
                F.struct(F.lit(1).alias("index"), F.when(F.col("p_size") <= 45, F.lit(0.1)).alias("lr")))
    return found(v.events_as("build.snapshot", "part", "p_partkey", optimizer=F.struct(g.alias("param_groups"))), "T0-optim-lr-positive")


def counter(v):
    return v.events_as("optim.step.post", "events", "event_id", state_step_max=F.col("value").cast("long"), optimizer_class=F.lit("AdamW"))


@query("e15_optim_step_counter_monotonic", """
SELECT 'run' || CAST(event_id % 3 AS VARCHAR) AS run, event_id, 'state_step_max' AS entity, 'not increasing' AS issue, CAST(s AS DOUBLE) AS observed FROM (
  SELECT event_id, s, lag(s) OVER (PARTITION BY event_id % 3, event_id % 4 ORDER BY event_id) AS p FROM (SELECT event_id, CAST(trunc(value) AS BIGINT) AS s FROM events))
WHERE s <= p""")
def e15(v):
    return found(counter(v), "T0-optim-step-counter-monotonic")


@query("e16_param_update_applied", """
SELECT 'run' || CAST(c_custkey % 3 AS VARCHAR) AS run, c_custkey AS event_id, 'AdamW' AS entity,
       CASE WHEN c_acctbal <= 0 THEN 'no update' ELSE 'frozen with gradient' END AS issue, CASE WHEN c_acctbal <= 0 THEN 0.0 ELSE CAST(c_nationkey % 3 AS DOUBLE) END AS observed
FROM customer WHERE c_acctbal <= 0 OR c_nationkey % 3 > 0""")
def e16(v):
    t = v.events_as("optim.step.post", "customer", "c_custkey", total_param_delta_l2=F.greatest(F.col("c_acctbal"), F.lit(0.0)),
                    n_params_unchanged_with_grad=F.col("c_nationkey") % 3, optimizer_class=F.lit("AdamW"))
    return found(t, "T0-param-update-applied")


@query("e17_softmax_degenerate", """
SELECT 'run' || CAST(event_id % 3 AS VARCHAR) AS run, event_id, CASE WHEN event_type = 'view' THEN 'TopKRouter' END AS entity,
       CASE WHEN event_type = 'click' THEN 'trivial_size_1' ELSE 'one_hot' END AS issue, round(sqrt(user_id), 6) AS observed
FROM events WHERE event_type IN ('view', 'click') AND abs(round(value / 30) - 1) < 1e-3 AND abs(user_id - 8) < 8 * 0.05""")
def e17(v):
    t = F.col("event_type")
    shape = F.array(F.lit(8).cast("long"), F.when(t == "click", 1).otherwise(8).cast("long"))
    ts = tensor_json(shape=shape, l2_norm=F.sqrt(F.col("user_id").cast("double")), abs_max=F.lit(0.0), max=F.round(F.col("value") / 30))
    tr = v.events_as(F.when(t == "click", "functional.softmax").otherwise("module.fwd.post"), "events", "event_id",
                     module_class=F.when(t == "view", "TopKRouter").when(t == "error", "Linear"),
                     outputs=F.when(t == "view", F.array(ts)), output=F.when(t != "view", ts))
    return found(tr, "T0-softmax-degenerate")


@query("e18_token_id_in_vocab", """
SELECT 'run' || CAST(doc_id % 3 AS VARCHAR) AS run, doc_id AS event_id, 'input_ids' AS entity, issue, observed FROM (
  SELECT doc_id, 'negative' AS issue, -1.0::DOUBLE AS observed FROM documents WHERE lang = 'es'
  UNION ALL SELECT doc_id, 'absurdly large', CAST(n_chars AS DOUBLE) * 300 FROM documents WHERE n_chars * 300 > 1048576)""")
def e18(v):
    ids = tensor_json(max=F.col("n_chars").cast("double") * 300, min=F.when(F.col("lang") == "es", -1.0).otherwise(0.0))
    return found(v.events_as("dataloader.batch", "documents", "doc_id", input_ids=ids), "T0-token-id-in-vocab")


def replica_records(v, name, hook):
    r = F.array(F.struct(F.lit("w0").alias("name"), (F.col("o_custkey") % 4).alias("group_size"), (F.col("o_orderstatus") != "P").alias("all_equal")),
                F.struct(F.lit("w1").alias("name"), F.lit(8).cast("long").alias("group_size"), (F.col("o_orderpriority") != "1-URGENT").alias("all_equal")))
    return v.events_as(hook, "orders", "o_orderkey", **{name: r})


REPLICA_SQL = """
SELECT 'run' || CAST(o_orderkey % 3 AS VARCHAR) AS run, o_orderkey AS event_id, entity, 'replicas differ' AS issue, observed FROM (
  SELECT o_orderkey, 'w0' AS entity, CAST(o_custkey % 4 AS DOUBLE) AS observed FROM orders WHERE o_custkey % 4 > 1 AND o_orderstatus = 'P'
  UNION ALL SELECT o_orderkey, 'w1', 8.0 FROM orders WHERE o_orderpriority = '1-URGENT')"""


@query("e19_buffer_replica_cksum_equal", REPLICA_SQL)
def e19(v):
    return found(replica_records(v, "cross_rank_buffer_cksums", "build.snapshot"), "T1-buffer-replica-cksum-equal")


@query("e20_comm_dtype_matches_training", """
WITH c AS (SELECT c_custkey % 3 AS r, c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'bfloat16' WHEN 'AUTOMOBILE' THEN 'float32' ELSE NULL END AS d FROM customer),
d AS (SELECT r, arg_min(d, c_custkey) AS declared FROM c WHERE d IS NOT NULL GROUP BY r),
o AS (SELECT o_orderkey % 3 AS r, 1000000000 + o_orderkey AS event_id, CASE o_orderstatus WHEN 'F' THEN 'all_reduce' WHEN 'O' THEN 'broadcast' ELSE 'reduce' END AS op,
      CASE WHEN o_orderpriority < '3' THEN 'bfloat16' ELSE 'float32' END AS dt FROM orders)
SELECT 'run' || CAST(o.r AS VARCHAR) AS run, event_id, op AS entity, dt || '!=' || declared AS issue, CAST(NULL AS DOUBLE) AS observed
FROM o JOIN d ON o.r = d.r WHERE op <> 'broadcast' AND dt <> declared""")
def e20(v):
    seg = F.col("c_mktsegment")
    d = F.when(seg == "BUILDING", "torch.bfloat16").when(seg == "AUTOMOBILE", "float32")
    snap = v.events_as("build.snapshot", "customer", "c_custkey", framework_invariants=F.create_map(F.lit("fw"), F.map_filter(kmap(training_dtype=d, z=F.lit(1)), lambda k, x: x.isNotNull())))
    op = F.when(F.col("o_orderstatus") == "F", "all_reduce").when(F.col("o_orderstatus") == "O", "broadcast").otherwise("reduce")
    comm = v.events_as("comm.post", "orders", F.col("o_orderkey") + 1000000000, key=F.col("o_orderkey"), op=op,
                       tensor_post=tensor_json(dtype=F.when(F.col("o_orderpriority") < "3", "bfloat16").otherwise("torch.float32")))
    return found(snap.unionByName(comm), "T1-comm-dtype-matches-training")


@query("e21_expert_bias_fp32", """
SELECT 'run' || CAST(c_custkey % 3 AS VARCHAR) AS run, c_custkey AS event_id, 'TopKRouter' AS entity, 'bfloat16' AS issue, CAST(NULL AS DOUBLE) AS observed
FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000""")
def e21(v):
    sem = F.struct((F.col("c_mktsegment") == "BUILDING").alias("is_router"), F.when(F.col("c_acctbal") > 5000, "bfloat16").when(F.col("c_acctbal") > 0, "float32").alias("expert_bias_dtype"))
    return found(v.events_as("module.fwd.post", "customer", "c_custkey", module_class=F.lit("TopKRouter"), semantic=sem), "T1-expert-bias-fp32")


BLOCK_SQL = """
WITH r AS (SELECT vec_id, 'MLP' || CAST(label AS VARCHAR) AS cls, block, {value} AS x FROM v_tensor),
m AS (SELECT cls, block, median(x) AS bm, count(*) AS n, min(vec_id) AS first_id FROM r GROUP BY 1, 2 HAVING count(*) >= 3),
c AS (SELECT cls, median(bm) AS cm FROM m GROUP BY 1 HAVING count(*) >= 4)
SELECT 'run0' AS run, first_id AS event_id, m.cls || '#' || CAST(block AS VARCHAR) AS entity, '{issue}' AS issue, round(greatest(bm / cm, cm / bm), 6) AS observed
FROM m JOIN c ON m.cls = c.cls WHERE bm > 0 AND cm > 0 AND greatest(bm / cm, cm / bm) > 100"""
SCALED = "l2 * CASE WHEN label % 2 = 0 AND block = 4 THEN 1000 WHEN label = 3 AND block = 1 THEN 0.001 ELSE 1 END"


def scaled_l2():
    return F.col("l2") * F.when((F.col("label") % 2 == 0) & (F.col("block") == 4), 1000).when((F.col("label") == 3) & (F.col("block") == 1), 0.001).otherwise(1)


@query("e22_fwd_output_block_uniformity", BLOCK_SQL.format(value=SCALED, issue="block output deviates"))
def e22(v):
    t = v.events_as("module.fwd.post", v.tensor, "vec_id", key=F.lit(0), module_class=F.concat(F.lit("MLP"), F.col("label").cast("string")),
                    module_name=F.concat(F.lit("blocks."), F.col("block").cast("string"), F.lit(".mlp")), output=tensor_json(l2_norm=scaled_l2()))
    return found(t, "T1-fwd-output-block-uniformity")


@query("e23_grad_flow_block_uniformity", BLOCK_SQL.format(value=f"({SCALED}) / 2.0", issue="block gradient ratio deviates"))
def e23(v):
    t = v.events_as("module.bwd", v.tensor, "vec_id", key=F.lit(0), module_class=F.concat(F.lit("MLP"), F.col("label").cast("string")),
                    module_name=F.concat(F.lit("blocks."), F.col("block").cast("string"), F.lit(".mlp")),
                    grad_input=F.array(tensor_json(l2_norm=scaled_l2())), grad_output=F.array(tensor_json(l2_norm=F.lit(2.0))))
    return found(t, "T1-grad-flow-block-uniformity")


@query("e24_grad_replica_cksum_equal", REPLICA_SQL)
def e24(v):
    return found(replica_records(v, "cross_rank_grad_cksums", "optim.step.pre"), "T1-grad-replica-cksum-equal")


@query("e25_jitter_preserves_dtype", """
SELECT 'run' || CAST(o_orderkey % 3 AS VARCHAR) AS run, o_orderkey AS event_id, 'TopKRouter' AS entity, 'float32' AS issue, CAST(NULL AS DOUBLE) AS observed
FROM orders WHERE o_orderstatus = 'P'""")
def e25(v):
    return found(v.events_as("jitter.probe", "orders", "o_orderkey", dtypes_match=F.col("o_orderstatus") != "P", module_class=F.lit("TopKRouter"),
                             output_dtype=F.lit("float32")), "T1-jitter-preserves-dtype")


@query("e26_layer_count_strict", """
WITH c AS (SELECT c_custkey % 3 AS r, arg_max(c_nationkey, c_custkey) AS n, max(c_custkey) AS event_id,
                  arg_max(c_nationkey % 5, CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey END) AS pp FROM customer GROUP BY 1)
SELECT 'run' || CAST(r AS VARCHAR) AS run, event_id, 'num_layers' AS entity, 'declared ' || CAST(n AS VARCHAR) || ' actual ' || CAST(4 * greatest(pp, 1) AS VARCHAR) AS issue,
       CAST(4 * greatest(pp, 1) AS DOUBLE) AS observed FROM c WHERE n <> 4 * greatest(pp, 1)""")
def e26(v):
    m = F.map_filter(kmap(num_layers=F.col("c_nationkey"), n_transformer_layers_in_local_module=F.lit(4),
                          pipeline_model_parallel_size=F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") % 5)), lambda k, x: x.isNotNull())
    return found(v.events_as("build.snapshot", "customer", "c_custkey", framework_invariants=F.create_map(F.lit("megatron"), m)), "T1-layer-count-strict")


@query("e27_multi_backward_fragile_config", """
WITH f AS (SELECT DISTINCT c_custkey % 3 AS r FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 3 <> 2),
s AS (SELECT event_id % 3 AS r, event_id // 50 AS step, count(*) AS n, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT 'run' || CAST(r AS VARCHAR) AS run, event_id, 'root forward' AS entity, 'forwards per step' AS issue, CAST(n AS DOUBLE) AS observed
FROM s WHERE n > 1 AND r IN (SELECT r FROM f)""")
def e27(v):
    fwd = v.events_as("module.fwd.pre", "events", "event_id", step=F.expr("event_id div 50"),
                      module_name=F.when(F.col("event_type") != "view", F.col("event_type")).when(F.col("value") > 50, F.lit("")))
    ds = F.create_map(F.lit("offload_optimizer"), ((F.col("c_mktsegment") == "BUILDING") & (F.col("c_custkey") % 3 != 2)).cast("string"),
                      F.lit("gradient_accumulation_steps"), F.lit("1"), F.lit("zero_stage"), F.lit("2"))
    cfg = v.events_as("build.snapshot", "customer", F.col("c_custkey") + 1000000000, key=F.col("c_custkey"), framework_invariants=F.create_map(F.lit("deepspeed"), ds))
    return found(fwd.unionByName(cfg), "T1-multi-backward-per-step-fragile-config")


@query("e28_process_group_size", """
SELECT 'run' || CAST(p_partkey % 3 AS VARCHAR) AS run, p_partkey AS event_id, entity, 'group size' AS issue, observed FROM (
  SELECT p_partkey, 'fw.tp' AS entity, 2.0::DOUBLE AS observed FROM part WHERE p_size % 5 > 1 AND p_size % 5 <> 2
  UNION ALL SELECT p_partkey, 'fw.dp', CAST(p_size % 7 AS DOUBLE) FROM part WHERE p_size % 7 <> 4)""")
def e28(v):
    m = kmap(tp_size_declared=F.col("p_size") % 5, tp_size_actual=F.lit(2), dp_size_declared=F.lit(4), dp_size_actual=F.col("p_size") % 7)
    return found(v.events_as("build.snapshot", "part", "p_partkey", framework_invariants=F.create_map(F.lit("fw"), m)), "T1-process-group-size-correct")


@query("e29_replica_cksum_equal", REPLICA_SQL)
def e29(v):
    return found(replica_records(v, "cross_rank_cksums", "build.snapshot"), "T1-replica-cksum-equal")


@query("e30_residual_probe", """
SELECT 'run' || CAST(event_id % 3 AS VARCHAR) AS run, event_id, event_type AS entity, 'nearer to normalised input' AS issue, CAST(user_id AS DOUBLE) AS observed
FROM events WHERE user_id < value""")
def e30(v):
    return found(v.events_as("residual.probe", "events", "event_id", d_to_original_input=F.col("value"), d_to_normed_input=F.col("user_id").cast("double"),
                             block_class=F.col("event_type")), "T1-residual-stream-preserved")


@query("e30_residual_fallback", """
WITH e AS (SELECT event_id, event_id % 3 AS r, event_id % 4 AS k, event_type AS t, value AS x FROM events),
a AS (SELECT *, max(CASE WHEN t IN ('view', 'click') THEN event_id END) OVER (PARTITION BY r, k ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM e),
b AS (SELECT a.*, CASE WHEN p.t = 'view' THEN p.x END AS cur_in FROM a LEFT JOIN e p ON a.s = p.event_id),
c AS (SELECT *, (t = 'error' AND cur_in IS NOT NULL) AS sets, (t = 'click' AND cur_in IS NOT NULL) AS done FROM b),
d AS (SELECT *, max(CASE WHEN sets OR done THEN event_id END) OVER (PARTITION BY r, k ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s2 FROM c),
f AS (SELECT d.*, CASE WHEN p.sets THEN p.x END AS cur_norm FROM d LEFT JOIN c p ON d.s2 = p.event_id)
SELECT 'run' || CAST(r AS VARCHAR) AS run, event_id, 'Block' AS entity, 'nearer to normalised input' AS issue, round(abs(x - cur_norm), 6) AS observed
FROM f WHERE done AND abs(x - cur_norm) * 3 < abs(x - cur_in)""")
def e30_fallback(v):
    t = F.col("event_type")
    tr = v.events_as(F.when(t == "view", "module.fwd.pre").otherwise("module.fwd.post"), "events", "event_id",
                     module_class=F.when(t == "error", "RMSNorm").when(t.isin("view", "click"), "Block").otherwise("Linear"),
                     semantic=F.struct(t.isin("view", "click").alias("is_residual_block")),
                     inputs=F.when(t == "view", F.array(tensor_json(l2_norm=F.col("value")))), output=F.when(t != "view", tensor_json(l2_norm=F.col("value"))))
    return found(tr, "T1-residual-stream-preserved")


@query("e31_router_attribute", """
WITH f AS (SELECT c_custkey % 3 AS r, arg_max(c_acctbal > 3000, c_custkey) AS flag FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1)
SELECT 'run' || CAST(o_orderkey % 3 AS VARCHAR) AS run, 1000000000 + o_orderkey AS event_id, 'TopKRouter' AS entity, 'attribute missing' AS issue, CAST(NULL AS DOUBLE) AS observed
FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_orderkey % 3 IN (SELECT r FROM f WHERE flag)""")
def e31(v):
    m = F.map_filter(kmap(calculate_per_token_loss=F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal") > 3000), z=F.lit(1)), lambda k, x: x.isNotNull())
    cfg = v.events_as("build.snapshot", "customer", "c_custkey", framework_invariants=F.create_map(F.lit("megatron"), m))
    sem = F.struct((F.col("o_orderstatus") == "F").alias("is_router"), (F.col("o_orderpriority") != "1-URGENT").alias("has_calculate_per_token_loss"))
    fwd = v.events_as("module.fwd.post", "orders", F.col("o_orderkey") + 1000000000, key=F.col("o_orderkey"), module_class=F.lit("TopKRouter"), semantic=sem)
    return found(cfg.unionByName(fwd), "T1-router-has-calculate-per-token-loss")


@query("e32_sqrt_decay_front_loaded", """
WITH s AS (SELECT event_id % 3 AS r, event_id, user_id / 150.0 AS x, CASE WHEN event_id % 3 = 1 THEN value ELSE user_id * user_id / 100.0 END AS y FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY x, event_id) AS i, count(*) OVER (PARTITION BY r) AS n, max(event_id) OVER (PARTITION BY r) AS last_id FROM s),
g AS (SELECT r, any_value(last_id) AS event_id,
  abs((max(CASE WHEN i = greatest(2, n // 4) THEN y END) - max(CASE WHEN i = 1 THEN y END)) / greatest(max(CASE WHEN i = greatest(2, n // 4) THEN x END) - max(CASE WHEN i = 1 THEN x END), 1e-9)) AS s_early,
  abs((max(CASE WHEN i = n THEN y END) - max(CASE WHEN i = n - 1 THEN y END)) / greatest(max(CASE WHEN i = n THEN x END) - max(CASE WHEN i = n - 1 THEN x END), 1e-9)) AS s_late
  FROM o GROUP BY r)
SELECT 'run' || CAST(r AS VARCHAR) AS run, event_id, 'decay' AS entity, 'early slope exceeds late slope' AS issue, round(s_early, 6) AS observed FROM g WHERE s_early > 2 * s_late""")
def e32(v):
    u = F.col("user_id")
    return found(v.events_as("decay.probe", "events", "event_id", progress=u / 150.0, result=F.when(F.col("event_id") % 3 == 1, F.col("value")).otherwise(u * u / 100.0)),
                 "T1-sqrt-decay-front-loaded")


def fleet(v):
    """Several hookpoints in one trace: one scan serves every rule."""
    return (clip(v).unionByName(counter(v)).unionByName(attention(v)).unionByName(norm_trace(v))
            .unionByName(replica_records(v, "cross_rank_cksums", "build.snapshot")))


@query("e33_rule_results", """
WITH r AS (SELECT unnest(range(3)) AS r)
SELECT 'run' || CAST(r AS VARCHAR) AS run, 'T0-clip-grad-bounded' AS check_id, (SELECT count(*) FROM events WHERE event_id % 3 = r) AS n_scope,
       (SELECT count(*) FROM events WHERE event_id % 3 = r AND value > 40.4) AS n_violations, 'fail' AS status FROM r
UNION ALL SELECT 'run' || CAST(r AS VARCHAR), 'T0-norm-output-unit-rms', (SELECT count(*) FROM embeddings WHERE vec_id % 3 = r),
       (SELECT count(*) FROM v_tensor WHERE vec_id % 3 = r AND block <> 2 AND NOT (l2 * label / 8 BETWEEN 0.5 AND 2.0)), 'fail' FROM r
UNION ALL SELECT 'run' || CAST(r AS VARCHAR), 'T1-jitter-preserves-dtype', 0, 0, 'passive' FROM r
UNION ALL SELECT 'run' || CAST(r AS VARCHAR), 'T0-loss-reduction-mode-correct', 0, 0, 'passive' FROM r
UNION ALL SELECT 'run' || CAST(r AS VARCHAR), 'T0-build-has-modules', (SELECT count(*) FROM orders WHERE o_orderkey % 3 = r), (SELECT count(*) FROM orders WHERE o_orderkey % 3 = r), 'fail' FROM r""")
def e33(v):
    ids = ["T0-clip-grad-bounded", "T0-norm-output-unit-rms", "T1-jitter-preserves-dtype", "T0-loss-reduction-mode-correct", "T0-build-has-modules"]
    return S.results(fleet(v), [R.RULES_BY_ID[i] for i in ids]).select("run", "check_id", "n_scope", "n_violations", "status")


@query("e33_all_rules_fused")
def e33_all(v):
    return S.results(fleet(v), R.RULES)


VARIED_SQL = """
e AS (SELECT event_id, event_id % 3 AS r, event_id % 13 AS k, event_id % 4 AS rank, value AS x FROM events),
m AS (SELECT r, count(*) FILTER (WHERE s <= p) AS steps FROM (SELECT r, s, lag(s) OVER (PARTITION BY r, rank ORDER BY event_id) AS p FROM
  (SELECT event_id, r, rank, CASE WHEN r = 2 THEN CAST(trunc(x) AS BIGINT) ELSE event_id END AS s FROM e WHERE k = 1)) GROUP BY r),
g AS (SELECT r, count(*) FILTER (WHERE k = 0 AND x > 60.0 * 1.01) AS clip, count(*) FILTER (WHERE k = 1 AND x = 0) AS upd,
  count(*) FILTER (WHERE k = 2 AND r = 1 AND x > 90) AS overflow, count(*) FILTER (WHERE k = 3 AND r = 1) AS comm, count(*) FILTER (WHERE k = 4) AS lost,
  count(*) FILTER (WHERE k = 5 AND x >= 100) AS router, count(*) FILTER (WHERE k = 5 AND x > 150) AS bias, count(*) FILTER (WHERE k = 5 AND x > 200) AS nan,
  count(*) FILTER (WHERE k = 5 AND x < 50 AND NOT (x / sqrt(32) BETWEEN 0.5 AND 2.0)) AS rms, count(*) FILTER (WHERE k = 6 AND x >= 120) AS jitter, count(*) FILTER (WHERE k = 7 AND x / 20 > 10) AS heads,
  count(*) FILTER (WHERE k = 9 AND NOT x < 80) AS lr, count(*) FILTER (WHERE k = 10 AND x * 1000 > 1048576) AS ids,
  count(*) FILTER (WHERE k = 0) AS n0, count(*) FILTER (WHERE k = 1) AS n1, count(*) FILTER (WHERE k = 2) AS n2, count(*) FILTER (WHERE k = 4) AS n4, count(*) FILTER (WHERE k = 5) AS n5, count(*) FILTER (WHERE k = 6) AS n6,
  count(*) FILTER (WHERE k = 7) AS n7, count(*) FILTER (WHERE k = 8) AS n8, count(*) FILTER (WHERE k = 9) AS n9, count(*) FILTER (WHERE k = 10) AS n10, count(*) FILTER (WHERE k = 11) AS n11,
  count(*) FILTER (WHERE k = 5 AND NOT (x / sqrt(32) BETWEEN 0.5 AND 2.0)) AS rms_all, count(*) FILTER (WHERE k = 3 AND r > 0) AS comm_all,
  count(*) FILTER (WHERE k = 12 AND x < 50) AS residual FROM e GROUP BY r),
h AS (SELECT * FROM g JOIN m USING (r))"""

# Zeros, which few of the events have: a gradient norm of zero, and a zero gradient output of a class without parameters.
ZERO_SQL = """
z AS (SELECT r, count(*) FILTER (WHERE k = 2 AND x = 0) AS zero, count(*) FILTER (WHERE k = 8 AND x = 0) AS dead FROM e GROUP BY r)"""


def varied(v):
    """Every hookpoint of the rules, with declared, undeclared and switched-off configuration by run, and payloads of wrong types."""
    x, k = F.col("value"), F.col("event_id") % 13
    run = F.col("event_id") % 3
    hooks = ["utils.clip_grad.post", "optim.step.post", "optim.step.pre", "comm.post", "loss.call", "module.fwd.post", "jitter.probe", "attention.fwd.post",
             "module.bwd", "scheduler.init", "dataloader.batch", "module.fwd.pre", "residual.probe"]
    at = lambda i, c: F.when(k == i, c)
    overflow = (k == 2) & (run == 1) & (x > 90)
    t = v.events_as(
        F.element_at(F.array(*map(F.lit, hooks)), (k + 1).cast("int")), v.events.where(~overflow), "event_id",
        post_norm=at(0, x), max_norm=at(0, F.lit(60.0)), state_step_max=at(1, F.when(run == 2, x.cast("long")).otherwise(F.col("event_id"))), total_param_delta_l2=at(1, x),
        total_grad_l2=at(2, x), d_to_normed_input=at(12, x), d_to_original_input=at(12, F.lit(50.0)), op=at(3, F.lit("all_reduce")), tensor_post=at(3, tensor_json()),
        per_token=at(4, F.lit("lost")), reduction=at(4, F.lit("mean")), module_class=F.when(k.isin(5, 8), F.lit("TopKRouter")),
        semantic=at(5, F.struct(F.lit(True).alias("is_router"), (x < 100).alias("has_calculate_per_token_loss"), F.when(x > 150, "float16").otherwise("float32").alias("expert_bias_dtype"))),
        is_normalizer=at(5, x < 50), output=at(5, tensor_json(l2_norm=x, abs_max=F.lit(5.0), has_nan=x > 200)), dtypes_match=at(6, x < 120), max_to_min_ratio=at(7, x / 20), grad_output=at(8, F.array(tensor_json(l2_norm=x))),
        last_epoch=at(9, F.lit(3)), param_groups=at(9, F.array(F.struct((x < 80).alias("has_initial_lr")))), input_ids=at(10, tensor_json(max=x * 1000, min=F.lit(0.0))), grad_enabled=at(11, F.lit(True)))
    dtype = F.when(run == 0, "float32").when(run == 1, "bfloat16")
    snap = v.events_as("build.snapshot", v.events.where("event_id < 3"), F.col("event_id") + 1_000_000_000, key=F.col("event_id"),
                       framework_invariants=F.create_map(F.lit("megatron"), F.map_filter(F.create_map(F.lit("training_dtype"), dtype, F.lit("calculate_per_token_loss"), F.when(run == 1, "true").otherwise("false")), lambda _, y: y.isNotNull())),
                       model=F.struct(F.lit(5).alias("n_parameters"), F.when(run == 1, 0).otherwise(2).alias("n_modules")),
                       optimizer=F.struct(F.array(F.struct(F.when(run == 2, 0.0).otherwise(0.1).alias("lr"))).alias("param_groups")),
                       cross_rank_cksums=F.array(F.struct(F.lit("w").alias("name"), F.lit(2).alias("group_size"), (run != 0).alias("all_equal")),
                                                  F.struct(F.lit("alone").alias("name"), F.lit(1).alias("group_size"), F.lit(False).alias("all_equal"))))
    texts = v.events_as("optim.step.pre", v.events.where(overflow), "event_id", total_grad_l2=F.lit("overflow"))
    return t.unionByName(texts).unionByName(snap)


@query("e33_all_statuses", f"""
WITH {VARIED_SQL}, {ZERO_SQL},
u AS (SELECT r, unnest([
  {{'c': 'T0-attention-head-uniformity', 'v': heads, 'b': 0, 'n': n7}}, {{'c': 'T0-clip-grad-bounded', 'v': clip, 'b': 0, 'n': n0}}, {{'c': 'T0-dtype-propagation', 'v': 0, 'b': 0, 'n': n5}},
  {{'c': 'T0-evaluator-eval-mode', 'v': 0, 'b': 0, 'n': n11}}, {{'c': 'T0-grad-norm-finite', 'v': zero, 'b': overflow, 'n': n2}}, {{'c': 'T0-initial-lr-present', 'v': lr, 'b': 0, 'n': n9}},
  {{'c': 'T0-build-has-modules', 'v': CASE WHEN r = 1 THEN 1 ELSE 0 END, 'b': 0, 'n': 1}}, {{'c': 'T0-loss-per-token-dispersion', 'v': 0, 'b': lost, 'n': n4}}, {{'c': 'T0-loss-reduction-mode-correct', 'v': 0, 'b': 0, 'n': n4}},
  {{'c': 'T0-module-grad-output-alive', 'v': 0, 'b': 0, 'n': n8}}, {{'c': 'T0-no-nan-inf', 'v': nan, 'b': 0, 'n': 1}}, {{'c': 'T0-norm-output-unit-rms', 'v': rms, 'b': 0, 'n': n5}},
  {{'c': 'T0-optim-lr-positive', 'v': CASE WHEN r = 2 THEN 1 ELSE 0 END, 'b': 0, 'n': 1}}, {{'c': 'T0-optim-step-counter-monotonic', 'v': steps, 'b': 0, 'n': CASE WHEN n1 > 1 THEN 1 ELSE 0 END}}, {{'c': 'T0-param-update-applied', 'v': upd, 'b': 0, 'n': n1}},
  {{'c': 'T0-softmax-degenerate', 'v': 0, 'b': 0, 'n': n5}}, {{'c': 'T0-token-id-in-vocab', 'v': ids, 'b': 0, 'n': n10}}, {{'c': 'T0-checkpoint-preserve-rng', 'v': 0, 'b': 0, 'n': 0}},
  {{'c': 'T1-buffer-replica-cksum-equal', 'v': 0, 'b': 0, 'n': 0}}, {{'c': 'T1-comm-dtype-matches-training', 'v': comm, 'b': 0, 'n': CASE WHEN r < 2 THEN 1 ELSE 0 END}},
  {{'c': 'T1-expert-bias-fp32', 'v': bias, 'b': 0, 'n': n5}}, {{'c': 'T1-fwd-output-block-uniformity', 'v': 0, 'b': 0, 'n': n5}}, {{'c': 'T1-grad-flow-block-uniformity', 'v': 0, 'b': 0, 'n': n8}},
  {{'c': 'T1-grad-replica-cksum-equal', 'v': 0, 'b': 0, 'n': n2}}, {{'c': 'T1-jitter-preserves-dtype', 'v': jitter, 'b': 0, 'n': n6}}, {{'c': 'T1-layer-count-strict', 'v': 0, 'b': 0, 'n': 0}},
  {{'c': 'T1-multi-backward-per-step-fragile-config', 'v': 0, 'b': 0, 'n': 1}}, {{'c': 'T1-process-group-size-correct', 'v': 0, 'b': 0, 'n': 1}}, {{'c': 'T1-replica-cksum-equal', 'v': CASE WHEN r = 0 THEN 1 ELSE 0 END, 'b': 0, 'n': 1}},
  {{'c': 'T1-residual-stream-preserved', 'v': residual, 'b': 0, 'n': 1}}, {{'c': 'T1-router-has-calculate-per-token-loss', 'v': CASE WHEN r = 1 THEN router ELSE 0 END, 'b': 0, 'n': CASE WHEN r = 1 THEN n5 ELSE 0 END}},
  {{'c': 'T1-sqrt-decay-front-loaded', 'v': 0, 'b': 0, 'n': 0}}], recursive := true) FROM h JOIN z USING (r))
SELECT 'run' || CAST(r AS VARCHAR) AS run, c AS check_id, CAST(v AS BIGINT) AS n_violations, CAST(b AS BIGINT) AS n_errors,
  CASE WHEN v > 0 THEN 'fail' WHEN b > 0 THEN 'error' WHEN n = 0 THEN 'passive' ELSE 'pass' END AS status FROM u""")
def e33_statuses(v):
    """All 32 rules: pass, fail, passive and error, by run."""
    return S.results(varied(v), R.RULES).select("run", "check_id", "n_violations", "n_errors", "status")


@query("c17_specs_on_all_hookpoints", f"""
WITH {VARIED_SQL}, u AS (SELECT unnest([{{'c': 'T0-clip-grad-bounded', 'n': clip}}, {{'c': 'T0-initial-lr-present', 'n': lr}}, {{'c': 'T0-no-nan-inf', 'n': nan}}, {{'c': 'T0-norm-output-unit-rms', 'n': rms}},
  {{'c': 'T0-optim-step-counter-monotonic', 'n': steps}}, {{'c': 'T0-token-id-in-vocab', 'n': ids}}, {{'c': 'T1-expert-bias-fp32', 'n': bias}}, {{'c': 'T1-jitter-preserves-dtype', 'n': jitter}}, {{'c': 'T1-residual-stream-preserved', 'n': residual}},
  {{'c': 'T0-build-has-modules', 'n': CASE WHEN r = 1 THEN 1 ELSE 0 END}}, {{'c': 'T0-optim-lr-positive', 'n': CASE WHEN r = 2 THEN 1 ELSE 0 END}}, {{'c': 'T1-replica-cksum-equal', 'n': CASE WHEN r = 0 THEN 1 ELSE 0 END}}], recursive := true) FROM h)
SELECT c AS check_id, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY c HAVING sum(n) > 0""")
def c17_varied(v):
    """The declarative specs over every hookpoint: twelve of the thirteen fire."""
    return S.violations(varied(v), R.spec_checks()).groupBy("check_id").agg(F.count(F.lit(1)).alias("n"))


@query("c15_tiers_over_all_rules", f"""
WITH {VARIED_SQL}, {ZERO_SQL}, t AS (SELECT sum(clip + upd + lr + nan + rms + steps + ids + heads + zero) + 2 AS low, sum(comm + bias + jitter + residual) + 1 + sum(CASE WHEN r = 1 THEN router ELSE 0 END) AS high FROM h JOIN z USING (r))
SELECT 0 AS tier, CAST(low AS BIGINT) AS n_violations FROM t UNION ALL SELECT 1, CAST(low + high AS BIGINT) FROM t""")
def c15_tiers(v):
    """Violations found with the rules of tier 0, and with those of tier 1 added."""
    t, out = varied(v), None
    for tier in (0, 1):
        d = S.violations(t, S.in_tier(R.RULES, tier)).agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(tier).alias("tier"), "n_violations")
        out = d if out is None else out.unionByName(d)
    return out


@query("e34_guard_arms", """
SELECT 'full' AS arm, (SELECT count(*) FROM v_tensor WHERE block <> 2 AND NOT (l2 * label / 8 BETWEEN 0.5 AND 2.0)) AS norm_rms,
  (SELECT count(*) FROM orders WHERE o_custkey % 4 > 1 AND o_orderstatus = 'P') + (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS replicas
UNION ALL SELECT 'no_topo', (SELECT count(*) FROM v_tensor WHERE block <> 2 AND NOT (l2 * label / 8 BETWEEN 0.5 AND 2.0)),
  (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') + (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT')
UNION ALL SELECT 'no_precond', (SELECT count(*) FROM v_tensor WHERE NOT (l2 * label / 8 BETWEEN 0.5 AND 2.0)),
  (SELECT count(*) FROM orders WHERE o_custkey % 4 > 1 AND o_orderstatus = 'P') + (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT')""")
def e34(v):
    t = norm_trace(v).unionByName(replica_records(v, "cross_rank_cksums", "build.snapshot"))
    ids = ("T0-norm-output-unit-rms", "T1-replica-cksum-equal")
    out = None
    for name in S.ARMS:
        rules, guards = R.arm(name)
        d = S.violations(t, [r for r in rules if r.check_id in ids], guards).withColumn("arm", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out.groupBy("arm").agg(F.count_if(F.col("check_id") == ids[0]).alias("norm_rms"), F.count_if(F.col("check_id") == ids[1]).alias("replicas"))


@query("e34_arms_over_all_rules", f"""
WITH {VARIED_SQL}, {ZERO_SQL}, b AS (SELECT arm, unnest([{{'c': 'T0-grad-norm-finite', 'n': zero}}, {{'c': 'T0-module-grad-output-alive', 'n': CASE WHEN arm = 'no_precond' THEN dead ELSE 0 END}},
  {{'c': 'T0-clip-grad-bounded', 'n': clip}}, {{'c': 'T0-param-update-applied', 'n': upd}}, {{'c': 'T0-initial-lr-present', 'n': lr}}, {{'c': 'T0-no-nan-inf', 'n': nan}},
  {{'c': 'T0-norm-output-unit-rms', 'n': CASE WHEN arm = 'no_precond' THEN rms_all ELSE rms END}}, {{'c': 'T0-optim-step-counter-monotonic', 'n': steps}}, {{'c': 'T0-token-id-in-vocab', 'n': ids}}, {{'c': 'T0-attention-head-uniformity', 'n': heads}},
  {{'c': 'T1-comm-dtype-matches-training', 'n': CASE WHEN arm = 'no_precond' THEN comm_all ELSE comm END}}, {{'c': 'T1-expert-bias-fp32', 'n': bias}}, {{'c': 'T1-jitter-preserves-dtype', 'n': jitter}}, {{'c': 'T1-residual-stream-preserved', 'n': residual}},
  {{'c': 'T1-router-has-calculate-per-token-loss', 'n': CASE WHEN arm = 'no_precond' OR r = 1 THEN router ELSE 0 END}}, {{'c': 'T0-build-has-modules', 'n': CASE WHEN r = 1 THEN 1 ELSE 0 END}}, {{'c': 'T0-optim-lr-positive', 'n': CASE WHEN r = 2 THEN 1 ELSE 0 END}},
  {{'c': 'T1-replica-cksum-equal', 'n': CASE WHEN r = 0 THEN 1 ELSE 0 END + CASE WHEN arm = 'no_topo' THEN 1 ELSE 0 END}},
  {{'c': 'T1-multi-backward-per-step-fragile-config', 'n': CASE WHEN arm = 'no_precond' AND n11 > 1 THEN 1 ELSE 0 END}}], recursive := true) FROM h JOIN z USING (r), (VALUES ('full'), ('no_topo'), ('no_precond')) a(arm))
SELECT arm, c AS check_id, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY 1, 2 HAVING sum(n) > 0""")
def e34_all(v):
    """All rules under each guard arm: what topology guards and preconditions keep from firing."""
    t, out = varied(v), None
    for name in S.ARMS:
        rules, guards = R.arm(name)
        d = S.violations(t, rules, guards).groupBy("check_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("arm"), "check_id", "n")
        out = d if out is None else out.unionByName(d)
    return out


@query("e35_invocation_frequency", """
SELECT step, count(*) AS n_rows, 10 AS expected FROM v_trace WHERE hookpoint = 'view' GROUP BY step HAVING count(*) <> 10""")
def e35_freq(v):
    d = v.trace.where(F.col("hookpoint") == "view")
    return G.count_match(d, ["step"], 10).select("step", "n_rows", F.col("expected").cast("int").alias("expected"))


@query("e35_cross_rank_metric", """
WITH m AS (SELECT run, step, rank, min(value) AS x FROM v_trace GROUP BY 1, 2, 3)
SELECT a.run, a.step, a.rank, a.x AS value, b.x AS rank0 FROM m a JOIN m b ON a.run = b.run AND a.step = b.step AND b.rank = 0 WHERE a.rank > 0 AND abs(a.x - b.x) > 1e-9""")
def e35_metric(v):
    m = v.trace.groupBy("run", "step", "rank").agg(F.min("value").alias("value"))
    first = m.where(F.col("rank") == 0).select("run", "step", F.col("value").alias("rank0"))
    return (m.where(F.col("rank") > 0).join(first, ["run", "step"]).where(F.abs(F.col("value") - F.col("rank0")) > 1e-9)
            .select("run", "step", "rank", "value", "rank0"))


@query("e35_round_trip_drift", """
SELECT o_orderkey, round(abs(o_totalprice - CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE)) / greatest(abs(o_totalprice), 1e-12), 12) AS rel_drift
FROM orders WHERE abs(o_totalprice - CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE)) / greatest(abs(o_totalprice), 1e-12) > 1e-8""")
def e35_drift(v):
    d = G.round_trip_drift(v.orders, F.col("o_totalprice"), F.col("o_totalprice").cast("float").cast("double"), 1e-8)
    return d.select("o_orderkey", F.round("rel_drift", 12).alias("rel_drift"))


@query("e35_init_std_band", """
SELECT label, round(stddev_samp(l2), 8) AS sd FROM v_tensor GROUP BY label HAVING stddev_samp(l2) NOT BETWEEN 0.09 * 0.5 AND 0.09 * 1.5""")
def e35_std(v):
    g = v.tensor.groupBy("label").agg(F.stddev_samp("l2").alias("sd"))
    return g.where(~F.col("sd").between(0.09 * 0.5, 0.09 * 1.5)).select("label", F.round("sd", 8).alias("sd"))


@query("e35_loss_divisor", """
SELECT l_returnflag, l_linenumber, round(avg(l_extendedprice) / avg(l_quantity) / 1000, 6) AS ratio FROM lineitem GROUP BY 1, 2
HAVING avg(l_extendedprice) / avg(l_quantity) / 1000 NOT BETWEEN 0.5 AND 2.0""")
def e35_div(v):
    g = v.lineitem.groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_extendedprice").alias("a"), F.avg("l_quantity").alias("b"))
    return G.value_scaling(g, F.col("a"), F.lit(1.0), F.col("b") * 1000, 0.5, 2.0).select(
        "l_returnflag", "l_linenumber", F.round("scale_ratio", 6).alias("ratio"))


@query("e35_cached_against_actual", """
WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) END AS cached, o_totalprice AS actual FROM orders)
SELECT o_orderkey, round(abs(cached - actual), 9) AS gap FROM c WHERE cached IS NULL OR abs(cached - actual) > 1e-3""")
def e35_cached(v):
    """A copy kept in single precision against the value itself, by absolute tolerance; every fiftieth copy is missing."""
    cached = F.when(F.col("o_orderkey") % 50 != 0, F.col("o_totalprice").cast("float").cast("double"))
    return G.stale_copy(v.orders, cached, F.col("o_totalprice"), 1e-3).select("o_orderkey", F.round("gap", 9).alias("gap"))
