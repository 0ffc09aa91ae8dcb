"""State-dump checks on replicated line items (F)."""

from pyspark.sql import functions as F

from guardlens.operators import state as S
from guardlens.operators import generic as G
from guardlens.plans.registry import query


@query("f01_replica_equality", """
SELECT name, dtype, count(DISTINCT cksum) AS n_values, count(*) AS n_rows, min(cksum) AS min_value, max(cksum) AS max_value
FROM v_state GROUP BY name, dtype HAVING count(DISTINCT cksum) > 1""")
def f01(v):
    return S.replica_equality(v.state, ["name", "dtype"], "cksum")


@query("f01_replica_equality_guarded", """
SELECT name, count(DISTINCT cksum) AS n_values, count(*) AS n_rows, min(cksum) AS min_value, max(cksum) AS max_value, min(replica) AS min_replica, max(replica) AS max_replica
FROM v_state WHERE layout <> 'N' GROUP BY name HAVING count(DISTINCT cksum) > 1 AND min(replica) < max(replica)""")
def f01_guarded(v):
    return S.replica_equality(v.state, ["name"], "cksum", "replica", F.col("layout") != "N")


@query("f02_replica_equality_multi", """
SELECT name, tp, count(DISTINCT replica) AS n_replicas, count(*) AS n_rows, count(DISTINCT cksum) AS n_cksum, count(DISTINCT dtype) AS n_dtype,
  CASE WHEN count(DISTINCT cksum) > 1 AND count(DISTINCT dtype) > 1 THEN 'both_inconsistent' WHEN count(DISTINCT cksum) > 1 THEN 'cksum_inconsistent' ELSE 'dtype_inconsistent' END AS inconsistency_type,
  string_agg(DISTINCT CAST(replica AS VARCHAR), ',' ORDER BY CAST(replica AS VARCHAR)) AS replicas
FROM v_state GROUP BY name, tp HAVING count(DISTINCT replica) > 1 AND (count(DISTINCT cksum) > 1 OR count(DISTINCT dtype) > 1)""")
def f02(v):
    return S.replica_equality_multi(v.state, ["name", "tp"], "replica", ["cksum", "dtype"], degree=8)


@query("f03_replica_difference", """
SELECT name, tp, count(DISTINCT layout) AS n_values, count(*) AS n_rows, min(layout) AS min_value, max(layout) AS max_value, min(replica) AS min_replica, max(replica) AS max_replica
FROM v_state GROUP BY name, tp HAVING count(DISTINCT layout) = 1 AND min(replica) < max(replica)""")
def f03(v):
    return S.replica_difference(v.state, ["name", "tp"], "layout", "replica")


@query("f04_attribute_consistency", """
SELECT name, 'dtype' AS attribute, count(DISTINCT dtype) AS n_values, count(*) AS n_rows FROM v_state GROUP BY name HAVING count(DISTINCT dtype) > 1
UNION ALL SELECT name, 'layout', count(DISTINCT layout), count(*) FROM v_state GROUP BY name HAVING count(DISTINCT layout) > 1
UNION ALL SELECT name, 'tp', count(DISTINCT tp), count(*) FROM v_state GROUP BY name HAVING count(DISTINCT tp) > 1""")
def f04(v):
    return S.attribute_consistency(v.state, ["name"], ["dtype", "layout", "tp"])


@query("f05_existence_consistency", """
SELECT name, count(*) AS n_rows, count(*) FILTER (WHERE cksum = 'alt') AS n_missing FROM v_state GROUP BY name
HAVING count(*) FILTER (WHERE cksum = 'alt') BETWEEN 1 AND count(*) - 1""")
def f05(v):
    d = v.state.withColumn("grad", F.when(F.col("cksum") != "alt", F.col("cksum")))
    return S.existence_consistency(d, ["name"], "grad")


@query("f05_completeness", """
WITH g AS (SELECT name, unnest(range(8)) AS r FROM (SELECT DISTINCT name FROM v_state))
SELECT g.name, CAST(g.r AS INTEGER) AS missing_replica FROM g LEFT JOIN (SELECT DISTINCT name, replica FROM v_state) s ON g.name = s.name AND g.r = s.replica WHERE s.name IS NULL""")
def f05_complete(v):
    return S.completeness(v.state, ["name"], "replica", 8)


@query("f05_replica_set", """
WITH s AS (SELECT DISTINCT l_orderkey AS name, CASE WHEN l_quantity >= 49 THEN NULL ELSE l_linenumber - 1 END AS r FROM lineitem), g AS (SELECT name, unnest(range(5)) AS r FROM (SELECT DISTINCT name FROM s))
SELECT g.name, g.r AS replica, 'missing' AS problem FROM g LEFT JOIN s ON g.name = s.name AND g.r = s.r WHERE s.name IS NULL
UNION ALL SELECT name, CAST(r AS BIGINT), 'unexpected' FROM s WHERE r IS NULL OR r >= 5""")
def f05_set(v):
    """Five replicas are expected; some entities have more, or rows without a replica number."""
    r = F.when(F.col("l_quantity") < 49, F.col("l_linenumber") - 1)
    return S.replica_set_report(v.lineitem.select(F.col("l_orderkey").alias("name"), r.alias("replica")), ["name"], "replica", 5)


@query("f06_optimizer_state_consistency", """
SELECT key, tp, count(DISTINCT cksum) AS n_values, count(*) AS n_rows, min(cksum) AS min_value, max(cksum) AS max_value
FROM (SELECT CAST(name AS VARCHAR) || '[' || dtype || ']' AS key, tp, cksum FROM v_state) GROUP BY key, tp HAVING count(DISTINCT cksum) > 1""")
def f06(v):
    d = v.state.withColumn("key", F.concat(F.col("name").cast("string"), F.lit("["), "dtype", F.lit("]")))
    return S.replica_equality(d, ["key", "tp"], "cksum")


@query("f06_replica_evidence", """
WITH b AS (SELECT name FROM v_state GROUP BY name HAVING count(DISTINCT cksum) > 1)
SELECT name, cksum, count(*) AS n_rows, min(replica) AS first_replica, max(replica) AS last_replica FROM v_state WHERE name IN (SELECT name FROM b) GROUP BY 1, 2""")
def f06_evidence(v):
    bad = S.replica_equality(v.state, ["name"], "cksum")
    return S.replica_evidence(v.state, ["name"], "cksum", "replica", bad)


@query("f07_grad_consistency", """
SELECT name, layout, count(DISTINCT g) AS n_values, count(*) AS n_rows, min(g) AS min_value, max(g) AS max_value
FROM (SELECT name, layout, md5(CAST(CAST(qty AS INTEGER) // 25 AS VARCHAR)) AS g FROM v_state) GROUP BY 1, 2 HAVING count(DISTINCT g) > 1""")
def f07(v):
    d = v.state.withColumn("g", F.md5(F.expr("CAST(CAST(qty AS INT) div 25 AS STRING)")))
    return S.replica_equality(d, ["name", "layout"], "g")


@query("f08_distribution_consistency", """
SELECT name, stat, spread FROM (SELECT name, 'qty' AS stat, max(qty) - min(qty) AS spread FROM v_state GROUP BY 1
  UNION ALL SELECT name, 'stat', max(stat) - min(stat) FROM v_state GROUP BY 1) WHERE spread > 40""")
def f08(v):
    return S.distribution_consistency(v.state, ["name"], ["qty", "stat"], 40.0).select("name", "stat", "spread")


@query("f09_shard_distribution_similarity", """
WITH p AS (SELECT layout, replica, tp, avg(stat) AS shard_mean, count(*) AS n_rows FROM v_state GROUP BY 1, 2, 3),
m AS (SELECT layout, replica, median(shard_mean) AS group_median, count(*) AS n_shards FROM p GROUP BY 1, 2)
SELECT p.layout, p.replica, p.tp, round(shard_mean, 6) AS shard_mean, n_rows, n_shards FROM p JOIN m ON p.layout = m.layout AND p.replica = m.replica
WHERE n_shards > 1 AND greatest(shard_mean / group_median, group_median / shard_mean) > 1.005""")
def f09(v):
    d = S.shard_distribution_similarity(v.state, ["layout", "replica"], "tp", "stat", 1.005)
    return d.select("layout", "replica", "tp", F.round("shard_mean", 6).alias("shard_mean"), "n_rows", "n_shards")


@query("f10_boundary_continuity", """
WITH p AS (SELECT name, tp, min(stat) AS low, max(stat) AS high FROM v_state GROUP BY 1, 2),
l AS (SELECT *, lag(high) OVER w AS prev_high, lag(tp) OVER w AS prev_shard FROM p WINDOW w AS (PARTITION BY name ORDER BY tp))
SELECT name, prev_shard, tp, prev_high, low, abs(low - prev_high) AS gap FROM l WHERE abs(low - prev_high) > 60000""")
def f10(v):
    return S.boundary_continuity(v.state, ["name"], "tp", "stat", "stat", 60000.0)


@query("f11_numeric_health", """
SELECT name, replica, tp, 'qty' AS stat, qty AS observed, 'above range' AS issue FROM v_state WHERE qty > 48
UNION ALL SELECT name, replica, tp, 'std', CASE WHEN dtype = 'O' AND qty = 7 THEN 'nan'::DOUBLE ELSE qty / 10 END, CASE WHEN dtype = 'O' AND qty = 7 THEN 'NaN' ELSE 'below range' END
FROM v_state WHERE (dtype = 'O' AND qty = 7) OR qty / 10 < 0.2""")
def f11(v):
    d = v.state.withColumn("std", F.when((F.col("dtype") == "O") & (F.col("qty") == 7), F.lit(float("nan"))).otherwise(F.col("qty") / 10))
    return S.numeric_health(d, ["name", "replica", "tp"], ["qty", "std"], 0.2, 48.0)


@query("f12_shape_report", """
SELECT status, count(*) AS n_entities FROM (SELECT CASE WHEN count(DISTINCT layout) > 1 THEN 'shape_mismatch' WHEN count(DISTINCT cksum) > 1 THEN 'value_mismatch' ELSE 'consistent' END AS status
  FROM v_state GROUP BY name, tp HAVING count(*) > 1) GROUP BY status""")
def f12(v):
    return S.shape_report(v.state, ["name", "tp"], "layout", "cksum")


@query("f13_threshold_consistency", """
SELECT name, round(avg(stat), 6) AS mean, round(stddev_samp(stat), 4) AS sd, count(*) AS n_rows FROM v_state GROUP BY name HAVING stddev_samp(stat) > avg(stat) * 0.9""")
def f13(v):
    return S.threshold_consistency(v.state, ["name"], "stat", 0.9).select("name", F.round("mean", 6).alias("mean"), F.round("sd", 4).alias("sd"), "n_rows")


@query("f14_save_load_equality", """
WITH s AS (SELECT name, tp, md5(CAST(min(qty) AS VARCHAR)) AS h, min(qty) AS q FROM v_state WHERE dtype = 'O' GROUP BY 1, 2),
l AS (SELECT name, tp, min(qty) AS q FROM v_state WHERE dtype = 'F' GROUP BY 1, 2)
SELECT s.name, s.tp, s.q AS before, l.q AS after FROM s JOIN l ON s.name = l.name AND s.tp = l.tp WHERE s.q IS DISTINCT FROM l.q""")
def f14(v):
    snap = lambda d: v.state.where(F.col("dtype") == d).groupBy("name", "tp").agg(F.min("qty").alias("rng"))
    return G.state_preservation(snap("O"), snap("F"), ["name", "tp"], "rng")


@query("f14_layer_index_count", """
SELECT l_returnflag AS run, count(DISTINCT l_linenumber) AS n_parts, CAST(6 AS BIGINT) AS declared FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) <> 6""")
def f14_layers(v):
    name = F.concat(F.lit("decoder.layers."), F.col("l_linenumber").cast("string"), F.lit(".mlp.weight"))
    d = v.lineitem.select(F.col("l_returnflag").alias("run"), F.regexp_extract(name, r"layers\.(\d+)\.", 1).alias("layer"))
    declared = d.select("run").distinct().withColumn("declared", F.lit(6).cast("long"))
    return G.structural_integrity(d, ["run"], "layer", declared, "declared")


@query("f15_constraint_verdict", """
SELECT 'replica_equality' AS name, count(*) AS n_rows, CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END AS status FROM (SELECT name FROM v_state GROUP BY name HAVING count(DISTINCT cksum) > 1)
UNION ALL SELECT 'layers', count(DISTINCT replica), CASE WHEN count(DISTINCT replica) = 7 THEN 'pass' ELSE 'fail' END FROM v_state
UNION ALL SELECT 'layers_undeclared', count(DISTINCT replica), 'warning' FROM v_state""")
def f15(v):
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
    a = S.verdict(n(S.replica_equality(v.state, ["name"], "cksum"), "replica_equality"), "consistency")
    layers = v.state.agg(F.count_distinct("replica").alias("n_rows"))
    b = S.verdict(layers.select(F.lit("layers").alias("name"), "n_rows", F.lit(7).alias("e")), "completeness", expected="e").drop("e")
    c = S.verdict(layers.select(F.lit("layers_undeclared").alias("name"), "n_rows"), "completeness")
    return a.unionByName(b).unionByName(c)


