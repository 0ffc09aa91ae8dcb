"""User extension surface (N)."""

from pyspark.sql import functions as F

from guardlens.functions import sqlfuncs
from guardlens.operators import rules as R
from guardlens.operators import spec as S
from guardlens.plans.q_rules import clip
from guardlens.plans.registry import query


@query("n01_registered_check", "SELECT 'user-big-preclip' AS check_id, event_id, value * 2 AS observed FROM events WHERE value * 2 > 150")
def n01(v):
    reg = sqlfuncs.CheckRegistry(R.RULES)

    @reg.check("user-big-preclip", hookpoints=("utils.clip_grad.post",), fields=("pre_norm",))
    def big(parsed):
        p = F.col("p")
        return parsed.where(p.pre_norm > 150).select("run", "rank", "step", "event_id", F.lit("pre_norm").alias("entity"), F.lit("large").alias("issue"), p.pre_norm.alias("observed"))

    return S.violations(clip(v), [reg["user-big-preclip"]]).select("check_id", "event_id", "observed")


@query("n02_column_builder", "SELECT event_id, value AS observed FROM events WHERE value > 40 AND value * 2 < 100")
def n02(v):
    c = S.Check("user-column", ("utils.clip_grad.post",), fields=("post_norm", "pre_norm"), precondition=lambda p: p.pre_norm < 100,
                findings=lambda p: S.fail_if(p.post_norm > 40, "post_norm", "large", p.post_norm))
    return S.violations(clip(v), [c]).select("event_id", "observed")


@query("n03_sql_functions", """
SELECT vec_id, shape[1] * 2 AS numel, round(l2 / sqrt(CAST(shape[1] * 2 AS DOUBLE)), 8) AS rms, abs(l2 * l2 - 1) < 0.05 AS one_hot, block AS idx, round(greatest(l2 / 2.0, 2.0 / l2), 8) AS dev FROM v_tensor""")
def n03(v):
    sqlfuncs.register_sql_functions(v.spark)
    t = v.tensor.withColumn("s", F.array(F.element_at("shape", 1), F.lit(2).cast("long"))).withColumn("name", F.concat(F.lit("m.blocks."), F.col("block").cast("string"), F.lit(".x")))
    return t.selectExpr("vec_id", "gl_numel(s) AS numel", "round(gl_rms(l2, s), 8) AS rms", "gl_one_hot(l2, 1.0D, 1L) AS one_hot", "gl_block_index(name) AS idx", "round(gl_deviation(l2, 2.0D), 8) AS dev")


@query("n04_json_leaves", """
SELECT '$.k' AS path, 'number' AS type, count(*) AS n FROM events""")
def n04(v):
    return sqlfuncs.leaf_counts(v.events, "props")


@query("n05_stateful_detector", """
SELECT event_id, v AS value, p AS prev FROM (SELECT event_id, user_id AS v, lag(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events) WHERE v <= p""")
def n05(v):
    from guardlens.plans.q_streaming import drained, third
    from guardlens.streaming.online import OnlineMonotonic
    t = v.events.select("event_type", "event_id", F.col("user_id").alias("value"))
    h, _ = drained(v, t, third(v), "n05", lambda root: OnlineMonotonic(v.spark, root, ["event_type"], "event_id", "value", span=1000))
    return h.state.all("violations", "event_type string, event_id long, value long, prev long").select("event_id", "value", "prev")


@query("n06_leave_one_out_ranges", """
WITH r AS (SELECT l_suppkey AS config, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1),
o AS (SELECT config, (SELECT min(lo) FROM r b WHERE b.config <> a.config) AS lo, (SELECT max(hi) FROM r b WHERE b.config <> a.config) AS hi FROM r a)
SELECT config, 'l_extendedprice' AS field, lo, hi, lo = hi AS is_constant FROM o""")
def n06(v):
    from guardlens.operators import mining as J
    return J.leave_one_out(J.learned_ranges(v.lineitem.withColumnRenamed("l_suppkey", "config"), "config", ["l_extendedprice"]), "config")
