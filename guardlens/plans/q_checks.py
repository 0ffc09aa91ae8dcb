"""Declarative checks over the derived trace (C)."""

from dataclasses import replace

from pyspark.sql import functions as F

from guardlens.operators import rules as R
from guardlens.operators import spec as S
from guardlens.plans.q_rules import clip, counter, fleet, norm_trace, replica_records
from guardlens.plans.registry import query
from guardlens.plans.views import tensor_json


def ids(trace, pr):
    return S.violations(trace, [S.compile_predicate(pr)]).select("event_id")


def flat(bound, scope=("utils.clip_grad.post",), **kw):
    return S.Predicate("q", "flat", S.Scope(scope), bound, **kw)


@query("c01_check_flat", "SELECT event_id FROM events WHERE NOT (value <= 40.0) AND event_id IS NOT NULL")
def c01(v):
    return ids(clip(v), flat(S.Bound(fields=("post_norm",), op="<=", value=40.0)))


@query("c02_check_path", """
SELECT o_orderkey AS event_id, count(*) AS n FROM (SELECT o_orderkey FROM orders WHERE o_custkey % 4 > 1 AND o_orderstatus = 'P'
  UNION ALL SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1""")
def c02(v):
    pr = next(s for s in R.SPECS if s.check_id == "T1-replica-cksum-equal")
    return ids(replica_records(v, "cross_rank_cksums", "build.snapshot"), pr).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query("c03_check_walk", "SELECT event_id FROM events WHERE value > 90 OR user_id % 40 = 7")
def c03(v):
    t = v.events_as("module.fwd.pre", "events", "event_id", inputs=F.array(tensor_json(has_nan=F.col("value") > 90), tensor_json(has_nan=F.col("value") > 95)),
                    output=tensor_json(has_nan=F.col("user_id") % 40 == 7))
    return ids(t, next(s for s in R.SPECS if s.check_id == "T0-no-nan-inf"))


@query("c04_check_signature", """
SELECT vec_id AS event_id FROM v_tensor WHERE block <> 2 AND NOT (l2 * label / 8 >= 0.5 AND l2 * label / 8 <= 2.0)""")
def c04(v):
    return ids(norm_trace(v), next(s for s in R.SPECS if s.check_id == "T0-norm-output-unit-rms"))


MONO = "SELECT event_id FROM (SELECT event_id, s, lag(s) OVER (PARTITION BY {p} ORDER BY event_id) AS q FROM (SELECT event_id, CAST(trunc(value) AS BIGINT) AS s FROM events)) WHERE s <= q"


@query("c05_check_monotonic", MONO.format(p="event_id % 3, event_id % 4"))
def c05(v):
    return ids(counter(v), next(s for s in R.SPECS if s.check_id == "T0-optim-step-counter-monotonic"))


@query("c05_check_monotonic_rank_blind", MONO.format(p="event_id % 3"))
def c05_blind(v):
    c = S.Check("q", ("optim.step.post",), frame_fields=("state_step_max",), frame=S.monotonic_frame("state_step_max", span=500, by=("run",)))
    return S.violations(counter(v), [c]).select("event_id")


@query("c06_bound_operators", """
SELECT 'lt' AS op, count(*) AS n FROM events WHERE NOT value < 40 UNION ALL SELECT 'le', count(*) FROM events WHERE NOT value <= 40
UNION ALL SELECT 'gt', count(*) FROM events WHERE NOT value > 40 UNION ALL SELECT 'ge', count(*) FROM events WHERE NOT value >= 40
UNION ALL SELECT 'eq', count(*) FROM events WHERE NOT value = 40 UNION ALL SELECT 'ne', count(*) FROM events WHERE NOT value <> 40""")
def c06(v):
    names = {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "eq": "==", "ne": "!="}
    checks = [replace(S.compile_predicate(flat(S.Bound(fields=("post_norm",), op=o, value=40.0))), check_id=n) for n, o in names.items()]
    return S.results(clip(v), checks).groupBy(F.col("check_id").alias("op")).agg(F.sum("n_violations").alias("n"))


@query("c07_bound_field", "SELECT event_id FROM events WHERE value > 40.0 * 1.01")
def c07(v):
    return ids(clip(v), next(s for s in R.SPECS if s.check_id == "T0-clip-grad-bounded"))


@query("c08_bound_range", "SELECT event_id FROM events WHERE NOT (value >= 10 AND value <= 60)")
def c08(v):
    return ids(clip(v), flat(S.Bound(fields=("post_norm",), conditions=((">=", 10.0), ("<=", 60.0)))))


@query("c09_equality", "SELECT o_orderkey AS event_id FROM orders WHERE o_orderpriority NOT IN ('2-HIGH', '3-MEDIUM')")
def c09(v):
    red = F.when(F.col("o_orderpriority") == "2-HIGH", "mean").when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority"))
    t = v.events_as("loss.call", "orders", "o_orderkey", reduction=red)
    return ids(t, flat(S.Bound(kind="equality", fields=("reduction",), value="mean"), ("loss.call",)))


@query("c09_equality_strict_null", "SELECT o_orderkey AS event_id FROM orders WHERE o_orderpriority <> '2-HIGH'")
def c09_strict(v):
    red = F.when(F.col("o_orderpriority") == "2-HIGH", "mean").when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority"))
    t = v.events_as("loss.call", "orders", "o_orderkey", reduction=red)
    return ids(t, flat(S.Bound(kind="equality", fields=("reduction",), value="mean", strict_null=True), ("loss.call",)))


@query("c10_present", "SELECT o_orderkey AS event_id FROM orders WHERE o_orderpriority = '3-MEDIUM' OR o_orderstatus = 'F'")
def c10(v):
    t = v.events_as("loss.call", "orders", "o_orderkey", reduction=F.when(F.col("o_orderpriority") != "3-MEDIUM", F.lit("x")),
                    fn=F.when(F.col("o_orderstatus") != "F", F.lit("f")))
    return ids(t, flat(S.Bound(kind="present", fields=("reduction", "fn")), ("loss.call",)))


@query("c11_tolerance", "SELECT event_id FROM events WHERE NOT (value <= 40.0 + 40.0 * 0.1 + 2.5)")
def c11(v):
    return ids(clip(v), flat(S.Bound(fields=("post_norm",), op="<=", value="max_norm", value_is_field=True, rel=0.1, absolute=2.5)))


@query("c12_precondition", "SELECT event_id FROM events WHERE value > 40 AND value * 2 > 150")
def c12(v):
    return ids(clip(v), flat(S.Bound(fields=("post_norm",), op="<=", value=40.0), precondition=lambda p, row: p.pre_norm > 150, fields=("pre_norm",)))


@query("c12_precondition_exists", """
SELECT event_id FROM events WHERE value > 40 AND event_id % 3 IN (SELECT DISTINCT c_custkey % 3 FROM customer WHERE c_custkey % 3 <> 1)""")
def c12_exists(v):
    runs = v.customer.select(F.concat(F.lit("run"), (F.col("c_custkey") % 3).cast("string")).alias("run")).where(F.col("run") != "run1").distinct()
    bad = S.violations(clip(v), [S.compile_predicate(flat(S.Bound(fields=("post_norm",), op="<=", value=40.0)))])
    return bad.join(runs, "run", "left_semi").select("event_id")


@query("c13_run_many_samples", """
WITH x AS (SELECT 'T0-clip-grad-bounded' AS check_id, event_id % 3 AS r, event_id FROM events WHERE value > 40.4
  UNION ALL SELECT 'T0-norm-output-unit-rms', vec_id % 3, vec_id FROM v_tensor WHERE block <> 2 AND NOT (l2 * label / 8 BETWEEN 0.5 AND 2.0)),
s AS (SELECT *, row_number() OVER (PARTITION BY check_id, r ORDER BY event_id) AS k FROM x)
SELECT check_id, 'run' || CAST(r AS VARCHAR) AS run, event_id, CAST(k AS INTEGER) AS sample_no FROM s WHERE k <= 3""")
def c13(v):
    checks = [R.RULES_BY_ID["T0-clip-grad-bounded"], R.RULES_BY_ID["T0-norm-output-unit-rms"]]
    return S.sample_violations(S.violations(fleet(v), checks), 3).select("check_id", "run", "event_id", "sample_no")


@query("c14_violation_ids", "SELECT 'run' || CAST(event_id % 3 AS VARCHAR) AS run, event_id FROM events WHERE value > 40.4")
def c14(v):
    return S.violation_ids(S.violations(fleet(v), R.spec_checks()), "T0-clip-grad-bounded")


@query("c15_tier_filter", """
SELECT tier, CAST(n AS BIGINT) AS n_checks, (SELECT count(*) FROM events WHERE value > 40.4) AS n_clip FROM (VALUES (0, 17), (1, 32)) t(tier, n)""")
def c15(v):
    out = None
    for tier in (0, 1):
        checks = S.in_tier(R.RULES, tier)
        d = S.row_violations(clip(v), [c for c in checks if c.findings is not None and "utils.clip_grad.post" in c.hookpoints]).agg(
            F.count(F.lit(1)).alias("n_clip")).select(F.lit(tier).alias("tier"), F.lit(len(checks)).cast("long").alias("n_checks"), "n_clip")
        out = d if out is None else out.unionByName(d)
    return out


@query("c16_arm_selection", """
SELECT 'full' AS arm, count(*) AS n FROM v_tensor WHERE block <> 2 AND NOT (l2 * label / 8 BETWEEN 0.5 AND 2.0)
UNION ALL SELECT 'no_precond', count(*) FROM v_tensor WHERE NOT (l2 * label / 8 BETWEEN 0.5 AND 2.0)""")
def c16(v):
    out = None
    for a in ("full", "no_precond"):
        _, guards = R.arm(a)
        d = S.violations(norm_trace(v), [R.RULES_BY_ID["T0-norm-output-unit-rms"]], guards).agg(F.count(F.lit(1)).alias("n")).select(F.lit(a).alias("arm"), "n")
        out = d if out is None else out.unionByName(d)
    return out


@query("c17_registry_specs", """
WITH clip AS (SELECT count(*) AS n FROM events WHERE value > 40.4), norm AS (SELECT count(*) AS n FROM v_tensor WHERE block <> 2 AND NOT (l2 * label / 8 BETWEEN 0.5 AND 2.0)),
rep AS (SELECT count(*) FILTER (WHERE o_custkey % 4 > 1 AND o_orderstatus = 'P') + count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n FROM orders),
mono AS (SELECT count(*) AS n FROM (SELECT s, lag(s) OVER (PARTITION BY event_id % 3, event_id % 4 ORDER BY event_id) AS q FROM (SELECT event_id, CAST(trunc(value) AS BIGINT) AS s FROM events)) WHERE s <= q)
SELECT 'T0-clip-grad-bounded' AS check_id, n FROM clip UNION ALL SELECT 'T0-norm-output-unit-rms', n FROM norm
UNION ALL SELECT 'T1-replica-cksum-equal', n FROM rep UNION ALL SELECT 'T0-optim-step-counter-monotonic', n FROM mono""")
def c17(v):
    return S.violations(fleet(v), R.spec_checks()).groupBy("check_id").agg(F.count(F.lit(1)).alias("n"))
