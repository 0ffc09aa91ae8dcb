"""Relation-operator families (G)."""

from pyspark.sql import functions as F

from guardlens.functions.ordered import Order
from guardlens.operators import generic as G
from guardlens.plans.registry import query


@query("g01_equality_across_replicas", """
SELECT l_orderkey, count(DISTINCT l_linestatus) AS n_values, count(*) AS n_rows, min(l_linestatus) AS min_value, max(l_linestatus) AS max_value
FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1""")
def g01(v):
    return G.equality_across_replicas(v.lineitem, ["l_orderkey"], "l_linestatus")


@query("g02_reference_equivalence", """
WITH l AS (SELECT l_orderkey AS k, round(sum(l_extendedprice), 2) AS x FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey AS k, o_totalprice AS y FROM orders)
SELECT coalesce(l.k, r.k) AS k, CASE WHEN l.k IS NULL THEN 'missing_left' WHEN r.k IS NULL THEN 'missing_right' ELSE 'differs' END AS status
FROM l FULL JOIN r ON l.k = r.k WHERE l.k IS NULL OR r.k IS NULL OR abs(x - y) > abs(y) * 0.2""")
def g02(v):
    left = v.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_extendedprice"), 2).alias("x"))
    right = v.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("x"))
    return G.reference_equivalence(left, right, ["k"], "x", 0.2).select("k", "status")


@query("g03_dtype_preservation", """
WITH b AS (SELECT name, min(dtype) AS d FROM v_state WHERE layout = 'R' GROUP BY 1), a AS (SELECT name, min(dtype) AS d FROM v_state WHERE layout = 'A' GROUP BY 1)
SELECT b.name, b.d AS dtype_before, a.d AS dtype_after FROM b JOIN a ON a.name = b.name WHERE a.d <> b.d""")
def g03(v):
    side = lambda x: v.state.where(F.col("layout") == x).groupBy("name").agg(F.min("dtype").alias("dtype"))
    return G.dtype_preservation(side("R"), side("A"), ["name"], "dtype")


@query("g04_conservation", """
SELECT o_orderkey AS k, n_parts FROM (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS s, count(*) AS n_parts FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey
WHERE abs(s - o_totalprice) > abs(o_totalprice) * 0.5""")
def g04(v):
    parts = v.lineitem.withColumnRenamed("l_orderkey", "k")
    totals = v.orders.withColumnRenamed("o_orderkey", "k")
    return G.conservation(parts, totals, ["k"], F.col("l_extendedprice") * (1 - F.col("l_discount")), "o_totalprice", 0.5).select("k", "n_parts")


@query("g05_value_scaling", """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / l_quantity / 1000, 3) AS scale_ratio FROM lineitem WHERE l_extendedprice / l_quantity / 1000 NOT BETWEEN 0.5 AND 20""")
def g05(v):
    d = G.value_scaling(v.lineitem, F.col("l_extendedprice") / F.col("l_quantity"), F.lit(1.0), F.lit(1000.0), 0.5, 20.0)
    return d.select("l_orderkey", "l_linenumber", "l_partkey", F.round("scale_ratio", 3).alias("scale_ratio"))


@query("g06_ordering", """
WITH a AS (SELECT user_id, max(event_id) AS first_done FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, min(event_id) AS second_start FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT a.user_id, first_done, second_start FROM a JOIN b ON a.user_id = b.user_id WHERE second_start < first_done""")
def g06(v):
    e = v.events
    return G.ordering(e.where(F.col("event_type") == "view"), e.where(F.col("event_type") == "purchase"), ["user_id"], "event_id", "event_id")


@query("g06_sort_key_order", """
SELECT o_orderkey, o_custkey, p AS prev_key FROM (SELECT o_orderkey, o_custkey, o_orderstatus, lag(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS p FROM orders) WHERE o_custkey < p""")
def g06_sort(v):
    return G.sort_order(v.orders, "o_custkey", Order(("o_orderstatus",), "o_orderkey", (), 1000)).select("o_orderkey", "o_custkey", "prev_key")


@query("g07_restoration", """
WITH s AS (SELECT name, tp, min(stat) AS a, max(qty) AS b FROM v_state WHERE dtype = 'O' GROUP BY 1, 2), l AS (SELECT name, tp, min(stat) AS a, max(qty) AS b FROM v_state WHERE layout <> 'N' GROUP BY 1, 2)
SELECT s.name, s.tp, s.a AS saved_stat, l.a AS loaded_stat FROM s LEFT JOIN l ON s.name = l.name AND s.tp = l.tp WHERE s.a IS DISTINCT FROM l.a OR s.b IS DISTINCT FROM l.b""")
def g07(v):
    snap = lambda c: v.state.where(c).groupBy("name", "tp").agg(F.min("stat").alias("a"), F.max("qty").alias("b"))
    d = G.restoration(snap(F.col("dtype") == "O"), snap(F.col("layout") != "N"), ["name", "tp"], ["a", "b"])
    return d.select("name", "tp", F.col("saved.a").alias("saved_stat"), F.col("loaded.a").alias("loaded_stat"))


@query("g07_counter_reset", """
SELECT event_id, c FROM (SELECT event_id, CAST(trunc(value) AS BIGINT) AS c, lag(event_type = 'signup') OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS pb FROM events) WHERE pb AND c <> 0""")
def g07_reset(v):
    d = v.events.select("event_id", (F.col("user_id") % 4).alias("rank"), F.col("value").cast("long").alias("c"), "event_type")
    return G.counter_reset(d, Order(("rank",), "event_id", (), 700), "c", F.col("event_type") == "signup").select("event_id", "c")


@query("g08_count_match", """
WITH l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), e AS (SELECT o_orderkey AS k, CAST(o_custkey % 7 AS BIGINT) + 1 AS expected FROM orders)
SELECT coalesce(l.k, e.k) AS k, coalesce(n, 0) AS n_rows, expected FROM l FULL JOIN e ON l.k = e.k WHERE coalesce(n, 0) IS DISTINCT FROM expected""")
def g08(v):
    e = v.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 7 + 1).alias("expected"))
    return G.count_match(v.lineitem.withColumnRenamed("l_orderkey", "k"), ["k"], e)


@query("g08_exactly_once", """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows, CAST(1 AS BIGINT) AS expected FROM lineitem GROUP BY 1, 2 HAVING count(*) <> 1""")
def g08_once(v):
    return G.count_match(v.lineitem, ["l_orderkey", "l_linenumber"], 1)


@query("g09_boundedness", "SELECT event_id, value FROM events WHERE value < 5 OR value > 150")
def g09(v):
    return G.boundedness(v.events, "value", 5.0, 150.0).select("event_id", "value")


@query("g10_monotonicity", """
SELECT event_id, v AS value, p AS prev_value FROM (SELECT event_id, value AS v, lag(value) OVER (PARTITION BY user_id % 3, user_id % 4 ORDER BY event_id) AS p FROM events) WHERE v < p""")
def g10(v):
    return G.monotonicity(v.trace, "value", Order(("run", "rank"), "event_id", (), 1000), strict=False).select("event_id", "value", "prev_value")


@query("g11_index_consistency", """
SELECT conv_id, turn, e AS expected_position FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS e, turn + CASE WHEN conv_id % 10 = 3 AND turn > 0 THEN 1 ELSE 0 END AS pos FROM conversations) WHERE pos <> e""")
def g11(v):
    d = v.conversations.withColumn("pos", F.col("turn") + F.when((F.col("conv_id") % 10 == 3) & (F.col("turn") > 0), 1).otherwise(0))
    return G.index_consistency(d, "pos", Order(("conv_id",), "turn")).select("conv_id", "turn", "expected_position")


@query("g12_nonzero_expected", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount = 0 AND l_tax > 0.07")
def g12(v):
    return G.nonzero_expected(v.lineitem, "l_discount", F.col("l_tax") > 0.07).select("l_orderkey", "l_linenumber", "l_partkey")


@query("g13_config_effectiveness", """
SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND NOT o_totalprice > 100000""")
def g13(v):
    cfg = v.customer.select(F.col("c_custkey").alias("o_custkey"), (F.col("c_mktsegment") == "BUILDING").alias("enabled"))
    return G.config_effectiveness(v.orders, cfg, ["o_custkey"], "enabled", F.col("o_totalprice") > 100000).select("o_orderkey")


@query("g14_exclusivity", """
SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'N' THEN l_discount END), 6) AS masked_sum, count(*) FILTER (WHERE l_returnflag = 'N') AS n_masked
FROM lineitem GROUP BY 1 HAVING sum(CASE WHEN l_returnflag = 'N' THEN l_discount END) <> 0""")
def g14(v):
    return G.exclusivity(v.lineitem, ["l_orderkey"], F.col("l_returnflag") == "N", F.col("l_discount")).withColumn("masked_sum", F.round("masked_sum", 6))


@query("g15_state_preservation", """
WITH b AS (SELECT name, min(cksum) AS c FROM v_state WHERE tp < 2 GROUP BY 1), a AS (SELECT name, min(cksum) AS c FROM v_state WHERE tp >= 2 GROUP BY 1)
SELECT b.name, b.c AS before, a.c AS after FROM b JOIN a ON a.name = b.name WHERE a.c <> b.c""")
def g15(v):
    side = lambda c: v.state.where(c).groupBy("name").agg(F.min("cksum").alias("cksum"))
    return G.state_preservation(side(F.col("tp") < 2), side(F.col("tp") >= 2), ["name"], "cksum")


@query("g16_layout_conformance", """
SELECT o_orderkey AS k, s AS shards_total, n AS n_shards, f AS full_total FROM (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s, count(*) AS n FROM lineitem GROUP BY 1)
JOIN (SELECT o_orderkey, o_custkey % 200 AS f FROM orders) ON l_orderkey = o_orderkey WHERE s <> f""")
def g16(v):
    sh = v.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("long").alias("size"))
    full = v.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 200).alias("full"))
    return G.layout_conformance(sh, full, ["k"], "size", "full")


@query("g16_structural_integrity", """
SELECT l_orderkey AS k, count(DISTINCT l_linenumber) AS n_parts, max(d) AS declared FROM lineitem JOIN (SELECT o_orderkey, o_custkey % 8 AS d FROM orders) ON l_orderkey = o_orderkey
GROUP BY 1 HAVING count(DISTINCT l_linenumber) <> max(d)""")
def g16_struct(v):
    d = v.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 8).alias("declared"))
    return G.structural_integrity(v.lineitem.withColumnRenamed("l_orderkey", "k"), ["k"], "l_linenumber", d, "declared")
