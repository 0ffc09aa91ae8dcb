"""Profiling and constraint mining (J)."""

from pyspark.sql import functions as F

from guardlens.operators import candidates as C
from guardlens.operators import mining as J
from guardlens.operators import state as S
from guardlens.plans.registry import query
from guardlens.plans.views import tensor_json
from guardlens.session import cut


def healthy(v):
    """Clip and optimizer events of three runs; run2 breaks what run0 and run1 keep."""
    return v.events_as(F.when(F.col("event_type") == "view", "optim.step.post").otherwise("utils.clip_grad.post"), "events", "event_id",
                       max_norm=F.lit(400.0), post_norm=F.when(F.col("event_type") != "view", F.when(F.col("event_id") % 3 == 2, F.col("value") * 8).otherwise(F.least(F.col("value"), F.lit(400.0)))),
                       pre_norm=F.col("value") * 2, state_step_max=F.when(F.col("event_type") == "view", F.when(F.col("event_id") % 3 == 2, F.col("value").cast("long")).otherwise(F.col("event_id"))),
                       output=F.when(F.col("event_type") == "view", tensor_json(l2_norm=F.col("value"), has_nan=F.lit(False))),
                       note=F.when(F.col("value") > 300, F.col("event_type")))


@query("j01_schema_profile", """
WITH e AS (SELECT CASE WHEN event_type = 'view' THEN 'optim.step.post' ELSE 'utils.clip_grad.post' END AS hookpoint, event_type = 'view' AS o, value FROM events)
SELECT hookpoint, '$.max_norm' AS path, 'number' AS type, count(*) AS n_events FROM e GROUP BY 1 UNION ALL SELECT hookpoint, '$.pre_norm', 'number', count(*) FROM e GROUP BY 1
UNION ALL SELECT hookpoint, '$.post_norm', 'number', count(*) FROM e WHERE NOT o GROUP BY 1 UNION ALL SELECT hookpoint, '$.state_step_max', 'number', count(*) FROM e WHERE o GROUP BY 1
UNION ALL SELECT hookpoint, '$.output.l2_norm', 'number', count(*) FROM e WHERE o GROUP BY 1 UNION ALL SELECT hookpoint, '$.output.has_nan', 'bool', count(*) FROM e WHERE o GROUP BY 1
UNION ALL SELECT hookpoint, '$.output.dtype', 'string', count(*) FROM e WHERE o GROUP BY 1 UNION ALL SELECT hookpoint, '$.output.shape[*]', 'number', count(*) FROM e WHERE o GROUP BY 1
UNION ALL SELECT hookpoint, '$.note', 'string', count(*) FROM e WHERE value > 300 GROUP BY 1""")
def j01(v):
    return J.schema_profile(healthy(v))


@query("j02_resolve_hookpoints", "SELECT DISTINCT event_type AS hookpoint FROM events WHERE event_type IN ('click', 'purchase')")
def j02(v):
    return J.resolve_hookpoints(v.trace.select("hookpoint"), ["cli", "purchase.post"])


@query("j02_resolve_hookpoints_fallback", "SELECT DISTINCT event_type AS hookpoint FROM events")
def j02_all(v):
    return J.resolve_hookpoints(v.trace.select("hookpoint"), ["nothing"])


@query("j03_resolve_fields", """
SELECT DISTINCT CASE WHEN event_type = 'view' THEN 'optim.step.post' ELSE 'utils.clip_grad.post' END AS hookpoint, CASE WHEN event_type = 'view' THEN '$.output.l2_norm' ELSE p END AS path,
  CASE WHEN event_type = 'view' THEN 2 ELSE 3 END AS tier FROM events, (VALUES ('$.l2_norm_none')) x(p) WHERE event_type = 'view'""")
def j03(v):
    return J.resolve_fields(J.schema_profile(healthy(v)), "l2_norm")


PATHS = """p AS (SELECT DISTINCT CASE WHEN event_type = 'view' THEN 'optim.step.post' ELSE 'utils.clip_grad.post' END AS h, unnest(CASE WHEN event_type = 'view'
  THEN ['max_norm', 'pre_norm', 'state_step_max', 'output.l2_norm'] ELSE ['max_norm', 'pre_norm', 'post_norm'] END) AS f FROM events)"""


@query("j04_parametric_candidates", f"""
WITH {PATHS} SELECT 'hyp/param/csm/' || h || '/' || f AS candidate_id, 'monotonic' AS relation FROM p UNION ALL SELECT 'hyp/param/pfc/' || h || '/' || f || '_positive', 'positive' FROM p
UNION ALL SELECT 'hyp/param/tsb/' || h || '/' || f || '_positive', 'stat_positive' FROM p WHERE regexp_matches('$.' || f, 'l2_norm|\\.max|\\.min|_norm') UNION ALL SELECT 'hyp/param/sp/' || h || '/' || f || '_nonzero', 'nonzero' FROM p""")
def j04(v):
    return J.parametric_candidates(J.schema_profile(healthy(v))).select("candidate_id", "relation")


@query("j05_shape_candidates", """
SELECT DISTINCT unnest(CASE WHEN event_type = 'view' THEN ['hyp/tsb/no_nan_inf/optim.step.post', 'hyp/csm/optim.step.post/state_step_max']
  ELSE ['hyp/pfc/utils.clip_grad.post/post_norm_<=_max_norm', 'hyp/pfc/utils.clip_grad.post/post_norm_<=_pre_norm'] END) AS candidate_id FROM events""")
def j05(v):
    return J.shape_candidates(J.schema_profile(healthy(v))).select("candidate_id")


CANDIDATES = (J.Candidate("post<=max", "companion", "utils.clip_grad.post", "post_norm", "<=", "max_norm", True),
              J.Candidate("post<=pre", "companion", "utils.clip_grad.post", "post_norm", "<=", "pre_norm", True),
              J.Candidate("post>0", "positive", "utils.clip_grad.post", "post_norm", ">", 0),
              J.Candidate("l2>50", "positive", "optim.step.post", "output.l2_norm", ">", 50),
              J.Candidate("steps", "monotonic", "optim.step.post", "state_step_max", "increasing", None))

COUNTS_SQL = """
e AS (SELECT event_id % 3 AS r, event_id, event_id % 4 AS rank, event_type = 'view' AS o, value, CASE WHEN event_id % 3 = 2 THEN value * 8 ELSE least(value, 400.0) END AS post,
      CASE WHEN event_id % 3 = 2 THEN CAST(trunc(value) AS BIGINT) ELSE event_id END AS s FROM events),
l AS (SELECT r, s, lag(s) OVER (PARTITION BY r, rank ORDER BY event_id) AS p FROM e WHERE o),
c AS (SELECT 'post<=max' AS candidate_id, r, count(*) FILTER (WHERE NOT o AND post > 400.0) AS n FROM e GROUP BY r UNION ALL SELECT 'post<=pre', r, count(*) FILTER (WHERE NOT o AND post > value * 2) FROM e GROUP BY r
  UNION ALL SELECT 'post>0', r, count(*) FILTER (WHERE NOT o AND post <= 0) FROM e GROUP BY r UNION ALL SELECT 'l2>50', r, count(*) FILTER (WHERE o AND NOT value > 50) FROM e GROUP BY r
  UNION ALL SELECT 'steps', r, count(*) FILTER (WHERE s <= p) FROM l GROUP BY r)"""


def counts(v):
    return J.failure_counts(healthy(v), CANDIDATES)


@query("j06_healthy_validation", f"""
WITH {COUNTS_SQL} SELECT candidate_id, count(*) AS n_traces, count(*) FILTER (WHERE n > 0) AS n_fired, max(n) AS max_violations, CAST(sum(n) AS BIGINT) AS total_violations, max(n) <= 0 AS accepted FROM c GROUP BY 1""")
def j06(v):
    return J.validate(counts(v))


def mixed(v):
    """Five hookpoints with lists, tensors, guards and counters, in three runs; every event is of one of them."""
    hooks = ["optim.step.post", "utils.clip_grad.post", "build.snapshot", "scheduler.init", "module.fwd.post"]
    k, x = F.col("event_id") % 5, F.col("value")
    at = lambda i, c: F.when(k == i, c)
    replica = lambda g, ok: F.struct(g.cast("long").alias("group_size"), ok.alias("all_equal"))
    return v.events_as(
        F.element_at(F.array(*map(F.lit, hooks)), (k + 1).cast("int")), "events", "event_id",
        lr=at(0, x - 1), state_step_max=at(0, F.when(F.col("event_id") % 3 == 2, x.cast("long")).otherwise(F.col("event_id"))),
        post_norm=at(1, x), max_norm=at(1, F.lit(150.0)), pre_norm=at(1, F.when(F.col("event_id") % 3 == 0, x / 2).otherwise(x)),
        cross_rank_cksums=at(2, F.array(replica(F.col("event_id") % 2 + 1, x <= 100), replica(F.lit(1), F.lit(False)))),
        model=at(2, F.struct(F.lit(7).alias("n_parameters"), F.when(x > 250, 0).otherwise(3).alias("n_modules"))),
        last_epoch=at(3, F.col("event_id") % 4 - 1), param_groups=at(3, F.array(F.struct(F.lit(True).alias("has_initial_lr")), F.struct((x < 200).alias("has_initial_lr")))),
        output=at(4, tensor_json(l2_norm=x, has_nan=F.lit(False), has_inf=x > 300)), inputs=at(4, F.array(tensor_json(has_nan=x < 1, has_inf=F.lit(False)))))


MIXED_SQL = """
e AS (SELECT event_id, event_id % 3 AS r, event_id % 4 AS rank, event_id % 5 AS k, value AS x FROM events),
hooks(k, h) AS (VALUES (0, 'optim.step.post'), (1, 'utils.clip_grad.post'), (2, 'build.snapshot'), (3, 'scheduler.init'), (4, 'module.fwd.post')),
leaf AS (SELECT r, rank, event_id, h, unnest(CASE e.k WHEN 0 THEN [{'f': 'lr', 'v': x - 1}, {'f': 'state_step_max', 'v': CASE WHEN r = 2 THEN trunc(x) ELSE event_id END}]
    WHEN 1 THEN [{'f': 'post_norm', 'v': x}, {'f': 'max_norm', 'v': 150.0}, {'f': 'pre_norm', 'v': CASE WHEN r = 0 THEN x / 2 ELSE x END}]
    WHEN 2 THEN [{'f': 'model.n_parameters', 'v': 7.0}, {'f': 'model.n_modules', 'v': CASE WHEN x > 250 THEN 0.0 ELSE 3.0 END}]
    WHEN 3 THEN [{'f': 'last_epoch', 'v': (event_id % 4 - 1)::DOUBLE}] ELSE [{'f': 'output.l2_norm', 'v': x}] END, recursive := true) FROM e JOIN hooks USING (k)),
steps AS (SELECT r, h, f, v, lag(v) OVER (PARTITION BY h, f, r, rank ORDER BY event_id) AS p FROM leaf),
fails AS (
  SELECT 'hyp/param/pfc/' || h || '/' || f || '_positive' AS id, r, count(*) FILTER (WHERE NOT v > 0) AS n FROM leaf GROUP BY ALL
  UNION ALL SELECT 'hyp/param/sp/' || h || '/' || f || '_nonzero', r, count(*) FILTER (WHERE NOT v > 0) FROM leaf GROUP BY ALL
  UNION ALL SELECT 'hyp/param/tsb/' || h || '/' || f || '_positive', r, count(*) FILTER (WHERE NOT v > 0) FROM leaf WHERE f LIKE '%_norm' GROUP BY ALL
  UNION ALL SELECT 'hyp/param/csm/' || h || '/' || f, r, count(*) FILTER (WHERE v <= p) FROM steps GROUP BY ALL
  UNION ALL SELECT 'hyp/csm/' || h || '/' || f, r, count(*) FILTER (WHERE v <= p) FROM steps WHERE f = 'state_step_max' GROUP BY ALL
  UNION ALL SELECT 'hyp/cross_rank_equal/replica_cksum', r, count(*) FILTER (WHERE event_id % 2 = 1 AND x > 100) FROM e WHERE k = 2 GROUP BY ALL
  UNION ALL SELECT 'hyp/sp/build_has_modules', r, count(*) FILTER (WHERE x > 250) FROM e WHERE k = 2 GROUP BY ALL
  UNION ALL SELECT 'hyp/cond/scheduler_resume_initial_lr', r, count(*) FILTER (WHERE event_id % 4 <> 0 AND x >= 200) FROM e WHERE k = 3 GROUP BY ALL
  UNION ALL SELECT 'hyp/tsb/no_nan_inf/module.fwd.post', r, count(*) FILTER (WHERE x > 300 OR x < 1) FROM e WHERE k = 4 GROUP BY ALL
  UNION ALL SELECT 'hyp/pfc/utils.clip_grad.post/post_norm_<=_max_norm', r, count(*) FILTER (WHERE x > 150) FROM e WHERE k = 1 GROUP BY ALL
  UNION ALL SELECT 'hyp/pfc/utils.clip_grad.post/post_norm_<=_pre_norm', r, count(*) FILTER (WHERE r = 0) FROM e WHERE k = 1 GROUP BY ALL
  UNION ALL SELECT 'hyp/pfc/optim.step.post/lr_>_0', r, count(*) FILTER (WHERE NOT x > 1) FROM e WHERE k = 0 GROUP BY ALL)"""


def mined(v):
    """Candidates of the profile of the mixed trace, and that profile."""
    profile = cut(J.schema_profile(mixed(v)), "profile")
    return cut(J.parametric_candidates(profile).unionByName(J.shape_candidates(profile), allowMissingColumns=True), "candidates"), profile


# In run0 pre_norm is half of post_norm: the bound holds where both are zero.
MINED_SQL = MIXED_SQL.replace("count(*) FILTER (WHERE r = 0) FROM e WHERE k = 1", "count(*) FILTER (WHERE r = 0 AND x > x / 2) FROM e WHERE k = 1")


@query("j06_mined_candidates", f"""
WITH {MINED_SQL} SELECT id AS candidate_id, 3::BIGINT AS n_traces, count(*) FILTER (WHERE n > 0) AS n_fired, max(n) AS max_violations, CAST(sum(n) AS BIGINT) AS total_violations, 0::BIGINT AS n_errors,
  max(n) <= 0 AS accepted, CASE WHEN max(n) > 0 THEN 'fired' END AS reason FROM fails GROUP BY 1""")
def j06_mined(v):
    candidates, profile = mined(v)
    return C.validated(candidates, C.candidate_failures(mixed(v), candidates, profile, span=1000), mixed(v))


@query("j07_learned_tolerance", """
WITH s AS (SELECT event_type AS hookpoint, value AS x, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k FROM events)
SELECT hookpoint, n, x AS tolerance FROM s WHERE k = CAST(floor(0.99 * (n - 1) + 1e-12) AS BIGINT)""")
def j07(v):
    return J.learned_tolerance(v.trace, ["hookpoint"], "value", 99.0)


@query("j08_heuristic_filter", f"""
WITH {PATHS}, c AS (SELECT 'hyp/param/csm/' || h || '/' || f AS candidate_id, f, FALSE AS lit FROM p UNION ALL SELECT 'hyp/param/pfc/' || h || '/' || f || '_positive', f, TRUE FROM p)
SELECT candidate_id, f IN ('post_norm', 'state_step_max') OR NOT lit AS keep,
  CASE WHEN f IN ('post_norm', 'state_step_max') THEN 'known semantic field' WHEN lit THEN 'literal threshold' ELSE 'default keep' END AS reason FROM c""")
def j08(v):
    c = J.parametric_candidates(J.schema_profile(healthy(v)), ("monotonic", "positive"))
    return J.heuristic_filter(c).select("candidate_id", "keep", "reason")


@query("j09_clean_run_gate", f"""
WITH {COUNTS_SQL}, z AS (SELECT r, count(*) AS t FROM e GROUP BY 1)
SELECT candidate_id, 'run' || CAST(c.r AS VARCHAR) AS run, n AS n_violations, round(n * 1.0 / t, 9) AS share, n * 1.0 / t > 0.01 AS rejected FROM c JOIN z ON c.r = z.r""")
def j09(v):
    t = healthy(v)
    sizes = t.groupBy("run").agg(F.count(F.lit(1)).alias("n_rows"))
    return J.clean_run_gate(counts(v), sizes, 0.01).select("candidate_id", "run", "n_violations", F.round("share", 9).alias("share"), "rejected")


@query("j10_accept_gate", """
SELECT p_partkey, CASE WHEN p_size < 3 THEN 'schema predicate missing' WHEN p_type = 'PROMO' THEN 'topology guard missing' WHEN p_type = 'SMALL' THEN 'precondition missing' WHEN p_brand = 'Brand#1' THEN 'no template'
  WHEN p_partkey % 11 = 0 THEN 'counterexample holds' WHEN p_size % 5 < 2 THEN 'too few counterexamples' WHEN p_retailprice / 1000 < 0.92 THEN 'low confidence'
  WHEN p_size > 48 THEN 'probe not run' WHEN p_size % 7 > 0 AND p_size > 40 THEN 'probe fired' END AS reject_reason FROM part""")
def j10(v):
    s, k = F.col("p_size"), F.col("p_partkey")
    c = v.part.select("p_partkey", (s >= 3).alias("has_schema"), (F.col("p_type") != "PROMO").alias("has_topo"), (F.col("p_type") != "SMALL").alias("has_precond"),
                      F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")).alias("template_id"), (s % 5).alias("n_counterexamples"), (k % 11 == 0).cast("int").alias("n_holding"),
                      (F.col("p_retailprice") / 1000).alias("confidence"), F.when(s <= 48, F.when(s > 40, s % 7).otherwise(0)).alias("probe_rows"))
    return J.accept_gate(c, 2, 0.92).select("p_partkey", "reject_reason")


@query("j11_healthy_probes", """
SELECT 'T01' AS template_id, count(*) AS probe_rows FROM (SELECT name FROM v_state GROUP BY name, layout HAVING count(DISTINCT cksum) > 1)
UNION ALL SELECT 'T27', count(*) FROM v_state WHERE qty / 10 NOT BETWEEN 0 AND 4.9""")
def j11(v):
    n = lambda d, t: d.agg(F.count(F.lit(1)).alias("probe_rows")).select(F.lit(t).alias("template_id"), "probe_rows")
    std = S.numeric_health(v.state.withColumn("std", F.col("qty") / 10), ["name"], ["std"], 0.0, 4.9)
    return n(S.replica_equality(v.state, ["name", "layout"], "cksum"), "T01").unionByName(n(std, "T27"))


@query("j12_funnel", """
WITH f AS (SELECT p_brand AS framework, count(*) AS a, count(*) FILTER (WHERE p_size > 5) AS b, count(*) FILTER (WHERE p_size > 5 AND p_retailprice > 920) AS c, count(*) FILTER (WHERE p_size > 5 AND p_retailprice > 920 AND p_type <> 'PROMO') AS d FROM part GROUP BY 1)
SELECT framework, 0 AS stage_no, 'candidates' AS stage, a AS n_kept, 1.0::DOUBLE AS kept_fraction FROM f UNION ALL SELECT framework, 1, 'valid', b, round(b * 1.0 / a, 9) FROM f
UNION ALL SELECT framework, 2, 'healthy', c, round(c * 1.0 / nullif(b, 0), 9) FROM f UNION ALL SELECT framework, 3, 'accepted', d, round(d * 1.0 / nullif(c, 0), 9) FROM f""")
def j12(v):
    p = v.part.select(F.col("p_brand").alias("framework"), (F.col("p_size") > 5).alias("valid"), (F.col("p_retailprice") > 920).alias("healthy"), (F.col("p_type") != "PROMO").alias("accepted"))
    return J.funnel(p, ["framework"], ["valid", "healthy", "accepted"]).withColumn("kept_fraction", F.round("kept_fraction", 9))


@query("j13_seeded_sample", """
SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY ('0x' || substr(md5('7:' || CAST(p_partkey AS VARCHAR)), 1, 8))::BIGINT, p_partkey) AS rn FROM part) WHERE rn <= 5""")
def j13(v):
    return J.seeded_sample(v.part.select("p_brand", "p_partkey"), ["p_brand"], "p_partkey", 5, 7)


@query("j13_replay_on_other_traces", f"""
WITH {MIXED_SQL}, c AS (SELECT DISTINCT id, CASE WHEN starts_with(id, 'hyp/param/') THEN 'parametric' ELSE 'shape' END AS cohort FROM fails),
s AS (SELECT id, cohort FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY ('0x' || substr(md5('7:' || id), 1, 8))::BIGINT, id) AS rn FROM c) WHERE rn <= 8)
SELECT cohort, 'run' || CAST(r AS VARCHAR) AS run, (SELECT count(*) FROM s z WHERE z.cohort = x.cohort) AS n_sampled, count(*) FILTER (WHERE n > 0) AS n_fired, 0::BIGINT AS n_errors,
  round(count(*) FILTER (WHERE n > 0) * 1.0 / (SELECT count(*) FROM s z WHERE z.cohort = x.cohort), 9) AS fire_rate
FROM (SELECT s.cohort, g.r, coalesce(f.n, 0) AS n FROM s CROSS JOIN (VALUES (1), (2)) g(r) LEFT JOIN fails f ON f.id = s.id AND f.r = g.r) x GROUP BY cohort, r""")
def j13_replay(v):
    """Sampled candidates of both cohorts, replayed on the runs other than run0."""
    candidates, profile = mined(v)
    cohort = F.when(F.col("candidate_id").startswith("hyp/param/"), "parametric").otherwise("shape")
    ids = J.seeded_sample(candidates.select(cohort.alias("cohort"), "candidate_id").distinct(), ["cohort"], "candidate_id", 8, 7)
    out = C.replay(cut(candidates.join(ids, "candidate_id"), "sample"), mixed(v).where("run <> 'run0'"), "cohort", profile)
    return out.withColumn("fire_rate", F.round("fire_rate", 9))


@query("j14_leave_one_out_baseline", """
WITH r AS (SELECT user_id % 5 AS config, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1), l AS (SELECT a.config, min(b.lo) AS lo, max(b.hi) AS hi FROM r a JOIN r b ON a.config <> b.config GROUP BY 1)
SELECT CAST(config AS BIGINT) AS config, 'value' AS field, 'range' AS rule, count(*) AS n_evaluations, count(*) FILTER (WHERE lo < hi AND (value < lo OR value > hi)) AS n_fires FROM events JOIN l ON user_id % 5 = config GROUP BY 1
UNION ALL SELECT CAST(config AS BIGINT), 'value', 'constant', count(*), count(*) FILTER (WHERE lo = hi AND value <> lo) FROM events JOIN l ON user_id % 5 = config GROUP BY 1""")
def j14(v):
    return J.loo_false_positives(v.events.withColumn("config", F.col("user_id") % 5), "config", ["value"])


@query("j14_false_positives_by_kind", """
WITH e AS (SELECT user_id % 5 AS config, event_id // 8 AS step, value, CASE WHEN user_id % 5 = 3 AND value > 150 THEN 1 ELSE 0 END AS flag FROM events),
r AS (SELECT config, min(value) AS vlo, max(value) AS vhi, min(flag) AS flo, max(flag) AS fhi FROM e GROUP BY 1),
l AS (SELECT a.config, min(b.vlo) AS vlo, max(b.vhi) AS vhi, min(b.flo) AS flo, max(b.fhi) AS fhi FROM r a JOIN r b ON a.config <> b.config GROUP BY 1),
x AS (SELECT 'range' AS rule, count(*) * 2 AS n_evaluations, count(*) FILTER (WHERE vlo < vhi AND (value < vlo OR value > vhi)) + count(*) FILTER (WHERE flo < fhi AND (flag < flo OR flag > fhi)) AS n_fires FROM e JOIN l USING (config)
  UNION ALL SELECT 'constant', count(*) * 2, count(*) FILTER (WHERE vlo = vhi AND value <> vlo) + count(*) FILTER (WHERE flo = fhi AND flag <> flo) FROM e JOIN l USING (config)),
g AS (SELECT config, step, min(value) <> max(value) AS v, min(flag) <> max(flag) AS f FROM e GROUP BY 1, 2),
c AS (SELECT config, 'value' AS field, count(*) AS n, count(*) FILTER (WHERE v) AS bad FROM g GROUP BY 1 UNION ALL SELECT config, 'flag', count(*), count(*) FILTER (WHERE f) FROM g GROUP BY 1),
q AS (SELECT a.n, a.bad, (SELECT bool_and(b.bad = 0) FROM c b WHERE b.field = a.field AND b.config <> a.config) AS learned FROM c a),
y AS (SELECT * FROM x UNION ALL SELECT 'rank_equal', sum(n), sum(CASE WHEN learned THEN bad ELSE 0 END) FROM q)
SELECT rule, CAST(n_evaluations AS BIGINT) AS n_evaluations, CAST(n_fires AS BIGINT) AS n_fires, round(n_fires * 1e6 / n_evaluations, 6) AS per_million FROM y""")
def j14_kinds(v):
    e = v.events.select((F.col("user_id") % 5).alias("config"), F.expr("event_id div 8").alias("step"), "value",
                        F.when((F.col("user_id") % 5 == 3) & (F.col("value") > 150), 1).otherwise(0).alias("flag"))
    out = J.false_positives_per_million(J.loo_false_positives(e, "config", ["value", "flag"]), J.rank_equal_baseline(e, "config", ["step"], ["value", "flag"]))
    return out.withColumn("per_million", F.round("per_million", 6))


@query("j15_manual_sql_baseline", """
SELECT 'cross_rank_equality' AS kind, count(*) AS n FROM (SELECT step FROM v_trace GROUP BY run, step HAVING count(DISTINCT value) > 1) UNION ALL SELECT 'range', count(*) FROM events WHERE value < 1 OR value > 200
UNION ALL SELECT 'monotonic', count(*) FROM (SELECT value AS x, lag(value) OVER (PARTITION BY run, rank ORDER BY event_id) AS p FROM v_trace) WHERE x <= p""")
def j15(v):
    from guardlens.functions.ordered import Order
    from guardlens.operators import generic as G
    n = lambda d, k: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n")
    return (n(S.replica_equality(v.trace, ["run", "step"], "value"), "cross_rank_equality")
            .unionByName(n(G.boundedness(v.events, "value", 1.0, 200.0), "range"))
            .unionByName(n(G.monotonicity(v.trace, "value", Order(("run", "rank"), "event_id", (), 1000)), "monotonic")))


@query("j16_catalog_coverage", """
WITH c AS (SELECT p_brand AS template, count(*) AS n_cases FROM part WHERE p_type <> 'PROMO' GROUP BY 1)
SELECT template, n_cases, row_number() OVER w AS k, round(sum(n_cases) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 1.0 / (SELECT count(*) FROM part), 9) AS coverage FROM c WINDOW w AS (ORDER BY n_cases DESC, template)""")
def j16(v):
    c = v.part.select(F.when(F.col("p_type") != "PROMO", F.col("p_brand")).alias("template"))
    return J.coverage_by_size(c, "template").withColumn("coverage", F.round("coverage", 9))


@query("j17_evaluation_matrix", f"""
WITH {COUNTS_SQL} SELECT candidate_id, count(*) FILTER (WHERE n > 0 AND r = 2) AS bug_fires, count(*) FILTER (WHERE n > 0 AND r <> 2) AS clean_fires, CAST(sum(n) AS BIGINT) AS n_violations FROM c GROUP BY 1""")
def j17(v):
    kinds = healthy(v).select("run").distinct().withColumn("kind", F.when(F.col("run") == "run2", "bug").otherwise("clean"))
    return J.evaluation_matrix(counts(v), kinds)


@query("j18_stage_gaps", """
SELECT stage, n AS n_constraints, n > 0 AS covered FROM (SELECT 'small' AS stage, count(*) FILTER (WHERE p_name LIKE '%small%' OR p_name LIKE '%red%') AS n FROM part
  UNION ALL SELECT 'bolt', count(*) FILTER (WHERE p_name LIKE '%bolt%') FROM part UNION ALL SELECT 'comm', count(*) FILTER (WHERE p_name LIKE '%allreduce%') FROM part)""")
def j18(v):
    return J.stage_gaps(v.part, "p_name", {"small": ["Small", "red"], "bolt": ["bolt"], "comm": ["allreduce"]})


