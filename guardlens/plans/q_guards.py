"""Guards over fleets of runs derived from the tables (D)."""

from pyspark.sql import functions as F

from guardlens.operators import guards as D
from guardlens.operators import mining as J
from guardlens.plans.q_rules import replica_records
from guardlens.plans.registry import query

# The fleet: one run per order, its parallel degrees and flags read from the order.
LIBRARY = (
    D.Constraint("dp_param_equal", "data_parallel", guards={"dp": "> 1"}),
    D.Constraint("tp_norm_equal", "tensor_parallel", guards={"tp": ">1", "sequence_parallel": "= false"}),
    D.Constraint("pp_layers", "pipeline_parallel", guards={"pp": ">= 2", "stage": "= 'x'"}),
    D.Constraint("any_health", "model_integrity", guards={}),
    D.Constraint("single_rank_only", "training_progress", guards={"dp": "<= 1", "tp": "!= 2"}),
    D.Constraint("odd_text", "model_integrity", guards={"dp": "around two", "unknown": "> 9"}),
    D.Constraint("weight_tying_equal", "model_integrity", guards={}),
    D.Constraint("sequence_parallel_norm", "tensor_parallel", guards={}),
    D.Constraint("zero_state_partition", "data_parallel", guards={}),
)
AXES = ("dp", "tp", "pp")


def runs(v):
    return v.orders.select(F.col("o_orderkey").alias("run"), (F.col("o_custkey") % 4).alias("dp"), (F.col("o_orderkey") % 3).alias("tp"),
                           F.length("o_orderstatus").cast("long").alias("pp"), (F.col("o_orderstatus") == "F").alias("sequence_parallel"),
                           (F.col("o_orderpriority") == "1-URGENT").alias("untie_embeddings"), (F.col("o_orderpriority") > "3").alias("distributed_optimizer"))


RUNS_SQL = """r AS (SELECT o_orderkey AS run, o_custkey % 4 AS dp, o_orderkey % 3 AS tp, CAST(length(o_orderstatus) AS BIGINT) AS pp, o_orderstatus = 'F' AS sp,
  o_orderpriority = '1-URGENT' AS untie, o_orderpriority > '3' AS dopt FROM orders)"""


@query("d01_topology_prune", f"""
WITH {RUNS_SQL}
SELECT run, 'dp_param_equal' AS "constraint" FROM r WHERE dp > 1 UNION ALL SELECT run, 'tp_norm_equal' FROM r WHERE tp > 1 AND NOT sp
UNION ALL SELECT run, 'pp_layers' FROM r WHERE pp >= 2 UNION ALL SELECT run, 'any_health' FROM r
UNION ALL SELECT run, 'single_rank_only' FROM r WHERE dp <= 1 AND tp <> 2 UNION ALL SELECT run, 'odd_text' FROM r
UNION ALL SELECT run, 'weight_tying_equal' FROM r UNION ALL SELECT run, 'sequence_parallel_norm' FROM r UNION ALL SELECT run, 'zero_state_partition' FROM r""")
def d01(v):
    return D.applicable(runs(v), LIBRARY, [*AXES, "sequence_parallel"]).select("run", "constraint")


@query("d02_guard_grammar", f"""
WITH {RUNS_SQL}, g AS (SELECT run, dp, CASE tp WHEN 0 THEN '>= 2' WHEN 1 THEN '!= 3' ELSE 'nonsense' END AS t, tp FROM r)
SELECT t AS guard, count(*) AS n_runs, count(*) FILTER (WHERE CASE tp WHEN 0 THEN dp >= 2 WHEN 1 THEN dp <> 3 ELSE TRUE END) AS n_hold FROM g GROUP BY 1""")
def d02(v):
    text = F.when(F.col("tp") == 0, ">= 2").when(F.col("tp") == 1, "!= 3").otherwise("nonsense")
    r = runs(v).withColumn("guard", text)
    return r.groupBy("guard").agg(F.count(F.lit(1)).alias("n_runs"), F.count_if(D.guard_holds(F.col("dp"), F.col("guard"))).alias("n_hold"))


@query("d03_category_selection", f"""
WITH {RUNS_SQL} SELECT run, 'model_integrity' AS category FROM r UNION ALL SELECT run, 'training_progress' FROM r
UNION ALL SELECT run, 'data_parallel' FROM r WHERE dp > 1 UNION ALL SELECT run, 'tensor_parallel' FROM r WHERE tp > 1 UNION ALL SELECT run, 'pipeline_parallel' FROM r WHERE pp > 1""")
def d03(v):
    return D.active_categories(runs(v), AXES)


@query("d04_skip_flags", f"""
WITH {RUNS_SQL} SELECT run, 'weight_tying_equal' AS "constraint" FROM r WHERE NOT untie UNION ALL SELECT run, 'sequence_parallel_norm' FROM r WHERE sp
UNION ALL SELECT run, 'zero_state_partition' FROM r WHERE dopt""")
def d04(v):
    return D.applicable(runs(v), LIBRARY[6:], AXES, skips=True).select("run", "constraint")


NEEDS = (D.Constraint("k_present", requires=(("error", "$.k"),)), D.Constraint("loss_present", requires=(("error", "$.loss"), ("view", "$.k"))),
         D.Constraint("missing_hook", requires=(("no.such", "$.k"),)))


@query("d05_schema_applicability", """
SELECT 'loss_present' AS "constraint", 'error' AS hookpoint, '$.loss' AS path FROM (SELECT count(*) FROM events)
UNION ALL SELECT 'missing_hook', 'no.such', '$.k' FROM (SELECT count(*) FROM events)""")
def d05(v):
    return D.schema_gaps(v.spark, NEEDS, J.schema_profile(v.trace)).select("constraint", "hookpoint", "path")


@query("d06_parallel_degrees", """
SELECT l_returnflag, max(l_suppkey % 4) + 1 AS tp_size, CAST(max(l_linenumber) + 1 AS BIGINT) AS dp_size FROM lineitem GROUP BY 1""")
def d06(v):
    r = v.lineitem.select("l_returnflag", (F.col("l_suppkey") % 4).alias("tp"), F.col("l_linenumber").alias("dp"))
    return D.parallel_degrees(r, ["l_returnflag"], ["tp", "dp"])


@query("d07_replica_group_guard", "SELECT o_custkey % 4 AS group_size, count(*) AS n FROM orders WHERE o_custkey % 4 > 1 GROUP BY 1")
def d07(v):
    r = v.orders.select((F.col("o_custkey") % 4).alias("group_size"))
    return r.where(F.col("group_size") > 1).groupBy("group_size").agg(F.count(F.lit(1)).alias("n"))


@query("d08_guard_audit", """
WITH e AS (SELECT o_orderkey % 3 AS run, o_orderkey % 4 AS rank, o_custkey % 4 AS g, o_orderstatus <> 'P' AS eq FROM orders
  UNION ALL SELECT o_orderkey % 3, o_orderkey % 4, 8, o_orderpriority <> '1-URGENT' FROM orders)
SELECT CASE WHEN grouping(run) = 1 THEN 'TOTAL' ELSE 'run' || CAST(run AS VARCHAR) END AS run, CASE WHEN grouping(rank) = 1 THEN 'TOTAL' ELSE CAST(rank AS VARCHAR) END AS rank,
  count(*) AS n_records, count(*) FILTER (WHERE g <= 1) AS n_skipped, count(*) FILTER (WHERE g > 1) AS n_checked, count(*) FILTER (WHERE g > 1 AND NOT eq) AS n_unequal,
  count(*) FILTER (WHERE g <= 1 AND NOT eq) AS n_skipped_unequal FROM e GROUP BY ROLLUP (run, rank)""")
def d08(v):
    from guardlens import schema as sc
    t = replica_records(v, "cross_rank_cksums", "build.snapshot")
    r = t.select("run", "rank", F.inline(F.from_json("payload", sc.payload_schema(["cross_rank_cksums"])).getField("cross_rank_cksums")))
    return D.guard_audit(r, ["run", "rank"], "group_size", "all_equal")


@query("d09_guard_stripping", """
WITH c AS (SELECT o_orderkey, 1 AS topo, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS pre FROM orders)
SELECT o_orderkey, CAST(pre AS INTEGER) AS n_no_topo, CAST(topo AS INTEGER) AS n_no_precond, 0 AS n_none FROM c""")
def d09(v):
    m = F.map_filter(F.create_map(F.lit("dp"), F.lit("> 1"), F.lit("stage"), F.lit("= a"), F.lit("phase"), F.when(F.col("o_orderstatus") == "F", F.lit("= b"))),
                     lambda k, x: x.isNotNull())
    c = v.orders.select("o_orderkey", m.alias("guards"))
    return c.select("o_orderkey", *[F.size(D.stripped("guards", m)).alias(f"n_{m}") for m in ("no_topo", "no_precond", "none")])


@query("d10_lineage", """
WITH p AS (SELECT name, max(CASE WHEN dtype = 'O' AND qty > 45 THEN 1 ELSE 0 END) AS s FROM v_state GROUP BY 1)
SELECT count(*) AS n_rows, count(DISTINCT v_state.name) AS n_names FROM v_state JOIN p ON v_state.name = p.name WHERE p.s = 0""")
def d10(v):
    lin = D.lineage(v.state, "name", (F.col("dtype") == "O") & (F.col("qty") > 45))
    return D.with_lineage(v.state, lin, "name", "replica").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("name").alias("n_names"))


@query("d11_semantic_labels", """
SELECT CASE WHEN p_type = 'PROMO' OR lower(p_name) LIKE '%gear%' THEN 'expert_local' WHEN p_size > 25 THEN 'shard' ELSE 'replica' END AS kind,
       p_type LIKE '%SMALL%' AS is_router, count(*) AS n FROM part GROUP BY 1, 2""")
def d11(v):
    name = F.when(F.lower("p_name").contains("gear"), F.concat(F.lit("experts."), "p_name")).otherwise(F.col("p_name"))
    kind = D.parameter_label(name, F.col("p_size") > 25, F.col("p_type") == "PROMO")
    cls = F.when(F.col("p_type").contains("SMALL"), F.lit("TopKRouter")).otherwise(F.col("p_type"))
    return v.part.groupBy(kind.alias("kind"), D.module_labels(cls)["is_router"].alias("is_router")).agg(F.count(F.lit(1)).alias("n"))


@query("d12_feature_passivity", """
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def d12(v):
    flags = v.customer.select(F.col("c_custkey").alias("o_custkey"), (F.col("c_mktsegment") == "BUILDING").alias("flag"))
    return D.feature_passive(v.orders.where(F.col("o_orderstatus") == "F"), flags, ["o_custkey"], "flag").select("o_orderkey")


@query("d12_feature_status", """
WITH f AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment = 'BUILDING' END AS flag FROM customer WHERE c_custkey % 5 <> 0),
o AS (SELECT o_custkey AS k, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS bad FROM orders GROUP BY 1)
SELECT coalesce(f.k, o.k) AS o_custkey, CASE WHEN flag AND n > 0 THEN bad ELSE 0 END AS n_violations, CASE WHEN NOT coalesce(flag AND n > 0, FALSE) THEN 'passive' WHEN bad > 0 THEN 'fail' ELSE 'pass' END AS status
FROM f FULL JOIN o ON f.k = o.k""")
def d12_status(v):
    """Flags are missing for some customers and null for others: both are undeclared, so passive."""
    k = F.col("c_custkey")
    flags = v.customer.where(k % 5 != 0).select(k.alias("o_custkey"), F.when(k % 3 != 0, F.col("c_mktsegment") == "BUILDING").alias("flag"))
    return D.feature_status(v.orders, flags, ["o_custkey"], "flag", F.col("o_orderstatus") == "F")


@query("d13_schema_tier_gate", """
SELECT t AS tier, count(*) AS n_fields, count(*) FILTER (WHERE ok) AS n_captured FROM (
  SELECT 0 AS t, (SELECT count(*) > 0 FROM events WHERE event_type = 'click' AND json_extract_string(props, '$.k') IS NOT NULL) AS ok UNION ALL SELECT 0, FALSE
  UNION ALL SELECT 1, (SELECT count(*) > 0 FROM events WHERE event_type = 'view' AND json_extract_string(props, '$.k') IS NOT NULL)) GROUP BY 1""")
def d13(v):
    need = v.spark.createDataFrame([(0, "click", "$.k"), (0, "click", "$.output.l2_norm"), (1, "view", "$.k")], "tier int, hookpoint string, path string")
    got = J.schema_profile(v.trace).select("hookpoint", "path").distinct().withColumn("ok", F.lit(1))
    return need.join(got, ["hookpoint", "path"], "left").groupBy("tier").agg(F.count(F.lit(1)).alias("n_fields"), F.count("ok").alias("n_captured"))
