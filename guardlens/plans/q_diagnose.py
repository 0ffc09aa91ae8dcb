"""Diagnosis and root causes (L)."""

from pyspark.sql import functions as F

from guardlens.operators import diagnose as L
from guardlens.operators import rules as R
from guardlens.operators import spec as S
from guardlens.operators import trees as T
from guardlens.plans.q_relational import OUTLIER_SQL
from guardlens.plans.q_rules import clip
from guardlens.plans.registry import query


def clip_found(v):
    return S.violations(clip(v), [R.RULES_BY_ID["T0-clip-grad-bounded"]])


@query("l01_expand_violations", """
SELECT 'T0-clip-grad-bounded' AS check_id, event_id, 'utils.clip_grad.post' AS hookpoint, 0 AS suspect_step, CAST(event_id % 4 AS INTEGER) AS suspect_rank, round(value, 6) AS observed FROM events WHERE value > 40.4""")
def l01(v):
    d = L.expand(clip_found(v), clip(v))
    return d.select("check_id", "event_id", "hookpoint", "suspect_step", "suspect_rank", F.round("observed", 6).alias("observed"))


@query("l02_bug_evidence", """
SELECT event_id, 'clip' AS fn, 40.0::DOUBLE AS max_norm, value * 2 AS pre_norm, value AS post_norm FROM events WHERE value > 40.4""")
def l02(v):
    d = L.bug_evidence(clip_found(v), clip(v))
    j = F.from_json("evidence", "fn STRING, max_norm DOUBLE, pre_norm DOUBLE, post_norm DOUBLE")
    return d.select("event_id", j.alias("j")).select("event_id", "j.*")


@query("l03_context_slice", """
WITH t AS (SELECT event_id, run, rank, hookpoint, row_number() OVER (PARTITION BY run, rank, hookpoint ORDER BY event_id) AS n FROM v_trace), b AS (SELECT t.* FROM t JOIN events e ON t.event_id = e.event_id WHERE e.value > 150)
SELECT b.event_id AS violation_id, t.event_id, CAST(t.n - b.n AS INTEGER) AS "offset" FROM b JOIN t ON b.run = t.run AND b.rank = t.rank AND b.hookpoint = t.hookpoint AND t.n BETWEEN b.n - 6 AND b.n + 6 AND t.n <> b.n""")
def l03(v):
    bad = v.trace.where(F.col("value") > 150).select("run", "rank", "hookpoint", "event_id", F.lit("big").alias("check_id"))
    return L.context_slice(bad, v.trace, ["run", "hookpoint"], span=1000).select("violation_id", "event_id", "offset")


@query("l04_hypothesis", """
SELECT event_id, 'violation of T0-clip-grad-bounded at utils.clip_grad.post step 0 rank ' || CAST(event_id % 4 AS VARCHAR) || ': post_norm above max_norm; the clip path likely returned without scaling' AS text FROM events WHERE value > 40.4""")
def l04(v):
    d = L.expand(clip_found(v), clip(v))
    t = L.hypothesis(F.col("check_id"), F.coalesce("module_name", "module_class", "hookpoint"), F.col("suspect_step"), F.col("suspect_rank"), F.concat_ws(" ", "entity", "issue"))
    return d.select("event_id", t.alias("text"))


@query("l05_outlier_replica", OUTLIER_SQL)
def l05(v):
    return L.outlier_replica(v.lineitem, ["l_orderkey"], "l_returnflag", "l_linenumber")


# Constraint table: one constraint per part, named by stage, target and part.
STAGE_CASE = "CASE p_type WHEN 'SMALL' THEN 'model-before-backward' WHEN 'LARGE' THEN 'model-after-backward' WHEN 'PROMO' THEN 'model-after-optimizer-step' ELSE 'other' END"
TARGET_CASE = "CASE p_size % 5 WHEN 0 THEN 'cksum' WHEN 1 THEN 'dtype' WHEN 2 THEN 'shape' WHEN 3 THEN 'optimizer_state' ELSE 'plain' END"
NODE_SQL = f"""
c AS (SELECT p_partkey, {STAGE_CASE} AS st, {TARGET_CASE} AS tg, {STAGE_CASE} || '_' || {TARGET_CASE} || '_' || p_name || CAST(p_partkey AS VARCHAR) AS name,
      CASE WHEN p_retailprice < 903 AND p_size > 10 THEN 'fail' WHEN p_partkey % 50 = 7 THEN 'error' ELSE 'pass' END AS status FROM part),
k AS (SELECT *, CASE WHEN st = 'other' THEN 'general' ELSE st END AS stage, CASE WHEN tg = 'plain' THEN 'general' ELSE tg END AS target FROM c)"""


def constraints(v):
    t = F.col("p_type")
    st = F.when(t == "SMALL", "model-before-backward").when(t == "LARGE", "model-after-backward").when(t == "PROMO", "model-after-optimizer-step").otherwise("other")
    m = F.col("p_size") % 5
    tg = F.when(m == 0, "cksum").when(m == 1, "dtype").when(m == 2, "shape").when(m == 3, "optimizer_state").otherwise("plain")
    status = F.when((F.col("p_retailprice") < 903) & (F.col("p_size") > 10), "fail").when(F.col("p_partkey") % 50 == 7, "error").otherwise("pass")
    return v.part.select("p_partkey", F.concat_ws("_", st, tg, F.concat("p_name", F.col("p_partkey").cast("string"))).alias("name"), status.alias("status"))


@query("l06_cluster_constraints", f"""
WITH {NODE_SQL} SELECT stage || '|' || target AS parent, count(*) AS n_children FROM k GROUP BY 1""")
def l06(v):
    return L.cluster(constraints(v)).groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))


def nodes(v):
    """Child constraints and their cluster parents as one node table."""
    c = L.cluster(constraints(v))
    kids = c.select(F.col("name").alias("node"), "parent", "name", F.lit(1).alias("level"), "status")
    par = L.parent_status(c).select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("parent").alias("name"), F.lit(0).alias("level"), "status")
    return kids.unionByName(par)


@query("l07_coarse_to_fine", f"""
WITH {NODE_SQL}, p AS (SELECT stage, target FROM k GROUP BY 1, 2 HAVING count(*) FILTER (WHERE status = 'fail') > 0)
SELECT k.name, k.status FROM k JOIN p ON k.stage = p.stage AND k.target = p.target""")
def l07(v):
    c = L.cluster(constraints(v))
    parents = L.parent_status(c)
    return L.drill_down(parents, lambda failed: c.join(failed.select("parent"), "parent", "left_semi")).select("name", "status")


@query("l08_root_causes", f"""
WITH {NODE_SQL} SELECT name AS node, 2::BIGINT AS path_length, stage || '|' || target AS chain_start,
  CASE WHEN name LIKE '%cksum%' OR name LIKE '%grad%' OR name LIKE '%optimizer%' THEN 'critical' WHEN name LIKE '%shape%' OR name LIKE '%dtype%' OR name LIKE '%sync%' THEN 'high' ELSE 'low' END AS severity
FROM k WHERE status = 'fail'""")
def l08(v):
    return L.root_causes(nodes(v)).select("node", "path_length", "chain_start", "severity")


LEVEL_SQL = """
t AS (SELECT l_suppkey % 8 AS shard, l_returnflag AS layout, l_orderkey AS name, CASE WHEN l_suppkey % 8 IN (1, 3) AND l_quantity >= 50 AND l_returnflag <> 'N' THEN 'alt' ELSE 'base' END AS cksum FROM lineitem),
a AS (SELECT shard, CASE WHEN min(cksum) <> max(cksum) THEN 'fail' ELSE 'pass' END AS status FROM t GROUP BY 1),
b AS (SELECT shard, layout, CASE WHEN min(cksum) <> max(cksum) THEN 'fail' ELSE 'pass' END AS status FROM t WHERE shard IN (SELECT shard FROM a WHERE status = 'fail') GROUP BY 1, 2),
c AS (SELECT shard, layout, name, CASE WHEN min(cksum) <> max(cksum) THEN 'fail' ELSE 'pass' END AS status FROM t WHERE (shard, layout) IN (SELECT (shard, layout) FROM b WHERE status = 'fail') GROUP BY 1, 2, 3)"""


@query("l07_adaptive_levels", f"""
WITH {LEVEL_SQL} SELECT 0 AS level, CAST(shard AS VARCHAR) AS node, status FROM a UNION ALL SELECT 1, CAST(shard AS VARCHAR) || '/' || layout, status FROM b
UNION ALL SELECT 2, CAST(shard AS VARCHAR) || '/' || layout || '/' || CAST(name AS VARCHAR), status FROM c""")
def l07_levels(v):
    """Agreement by shard, then by layout inside failed shards, then by parameter inside failed layouts; other folders are not read."""
    q, shard = F.col("l_quantity"), F.col("l_suppkey") % 8
    bad = shard.isin(1, 3) & (q >= 50) & (F.col("l_returnflag") != "N")
    rows = v.lineitem.select(shard.alias("shard"), F.col("l_returnflag").alias("layout"), F.col("l_orderkey").alias("name"), F.when(bad, "alt").otherwise("base").alias("cksum"))
    keys = ("shard", "layout", "name")
    levels = [T.Level(keys[i], keys[:i + 1], T.agree(keys[:i + 1], "cksum")) for i in range(3)]
    return T.drill_down(T.stored_by(rows, ["shard"]), levels).select("level", "node", "status")


@query("l08_deep_chains", """
WITH c AS (SELECT c_custkey AS node, c_custkey // 1000 AS b, c_acctbal < 0 AS bad FROM customer),
f AS (SELECT node, b, bad, count(*) FILTER (WHERE bad) OVER w AS n, min(CASE WHEN bad THEN node END) OVER w AS far, lead(bad) OVER (PARTITION BY b ORDER BY node) AS below
  FROM c WINDOW w AS (PARTITION BY b ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT node, n + 1 AS path_length, coalesce(far, node) AS chain_start FROM f WHERE bad AND NOT coalesce(below, FALSE)""")
def l08_deep(v):
    """Chains of a thousand nodes, one under the other."""
    key = F.col("c_custkey")
    order = v.customer.select(key.alias("node"), F.when(key % 1000 != 0, key - 1).alias("up"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") < 0, "fail").otherwise("pass").alias("status"))
    there = order.select(F.col("node").alias("parent"))  # the first key of a chain may not exist
    n = order.join(there, F.col("up") == F.col("parent"), "left").select("node", "parent", "name", F.lit(0).alias("level"), "status")
    return T.failure_chains(n).select("node", "path_length", "chain_start")


@query("l08_ancestors", """
WITH RECURSIVE e AS (SELECT CAST(c_custkey AS BIGINT) AS node, c_custkey // 3 AS parent FROM customer WHERE c_custkey > 0),
a AS (SELECT node, parent AS ancestor, 1 AS distance FROM e UNION ALL SELECT a.node, e.parent, a.distance + 1 FROM a JOIN e ON a.ancestor = e.node WHERE a.distance < 4)
SELECT node, ancestor, distance FROM a""")
def l08_ancestors(v):
    e = v.customer.where(F.col("c_custkey") > 0).select(F.col("c_custkey").alias("node"), F.expr("c_custkey div 3").alias("parent"))
    return L.with_ancestors(e, 4).select("node", "ancestor", "distance")


@query("l09_level_statistics", f"""
WITH {NODE_SQL}, p AS (SELECT 0 AS level, CASE WHEN count(*) FILTER (WHERE status = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (WHERE status = 'error') > 0 THEN 'error' ELSE 'pass' END AS status FROM k GROUP BY stage, target),
n AS (SELECT 1 AS level, status FROM k UNION ALL SELECT level, status FROM p)
SELECT level, count(*) AS n_nodes, count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'fail') AS n_fail, count(*) FILTER (WHERE status = 'error') AS n_error, 0::BIGINT AS n_unchecked FROM n GROUP BY 1""")
def l09(v):
    return L.level_statistics(nodes(v))


@query("l10_recommendations", f"""
WITH {NODE_SQL} SELECT name AS "constraint", CASE WHEN name LIKE '%cksum%' THEN 'check parameter synchronisation of the stage' WHEN name LIKE '%dtype%' THEN 'check mixed precision settings across ranks'
  WHEN name LIKE '%shape%' THEN 'check model initialisation across ranks' WHEN name LIKE '%grad%' THEN 'check gradient synchronisation in backward' WHEN name LIKE '%optimizer%' THEN 'check optimizer initialisation and state synchronisation'
  ELSE 'check consistency of the stage' END AS advice FROM k WHERE status = 'fail'""")
def l10(v):
    return L.recommendations(L.root_causes(nodes(v)))


@query("l11_tree_report", f"""
WITH {NODE_SQL} SELECT stage || '|' || target AS parent, stage || '|' || target || ' [' || CAST(count(*) AS VARCHAR) || ' children, ' || CAST(count(*) FILTER (WHERE status = 'fail') AS VARCHAR) || ' fail, ' ||
  CAST(count(*) FILTER (WHERE status = 'pass') AS VARCHAR) || ' pass]' AS line FROM k GROUP BY stage, target""")
def l11(v):
    return L.tree_report(nodes(v)).select("parent", "line")


@query("l11_nested_tree", """
WITH s AS (SELECT s_nationkey, 's' || CAST(s_suppkey AS VARCHAR) AS name, CASE WHEN s_acctbal < 1000 THEN 'fail' ELSE 'pass' END AS status FROM supplier),
n AS (SELECT n_regionkey, 'n' || CAST(n_nationkey AS VARCHAR) AS name, count(s.name) AS k, count(*) FILTER (WHERE s.status = 'fail') AS f,
  coalesce(string_agg('{"name":"' || s.name || '","status":"' || s.status || '","n_nodes":1,"n_fail":' || CASE WHEN s.status = 'fail' THEN '1' ELSE '0' END || ',"children":[]}', ',' ORDER BY s.name), '') AS kids
  FROM nation LEFT JOIN s ON s_nationkey = n_nationkey GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN f > 0 THEN 'fail' ELSE 'pass' END AS status, f + CASE WHEN f > 0 THEN 1 ELSE 0 END AS nf FROM n),
r AS (SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS root, sum(k + 1) AS k, sum(nf) AS f,
  string_agg('{"name":"' || m.name || '","status":"' || m.status || '","n_nodes":' || CAST(k + 1 AS VARCHAR) || ',"n_fail":' || CAST(nf AS VARCHAR) || ',"children":[' || kids || ']}', ',' ORDER BY m.name) AS kids
  FROM region JOIN m ON n_regionkey = r_regionkey GROUP BY 1)
SELECT root, CAST(k + 1 AS BIGINT) AS n_nodes, CAST(f AS BIGINT) AS n_fail, '{"name":"' || root || '","status":"unchecked","n_nodes":' || CAST(CAST(k + 1 AS BIGINT) AS VARCHAR) || ',"n_fail":' || CAST(CAST(f AS BIGINT) AS VARCHAR) || ',"children":[' || kids || ']}' AS report FROM r""")
def l11_nested(v):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    s = v.supplier.select(key("s", "s_suppkey").alias("node"), key("n", "s_nationkey").alias("parent"), F.when(F.col("s_acctbal") < 1000, "fail").otherwise("pass").alias("status"))
    worst = s.groupBy(F.col("parent").alias("node")).agg(F.min("status").alias("status"))
    n = v.nation.select(key("n", "n_nationkey").alias("node"), key("r", "n_regionkey").alias("parent")).join(worst, "node", "left").fillna("pass", ["status"])
    r = v.region.select(key("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("status"))
    return T.nested_report(s.unionByName(n.select("node", "parent", "status")).unionByName(r).withColumn("name", F.col("node")))
