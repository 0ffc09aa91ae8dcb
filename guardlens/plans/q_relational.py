"""Joins, set operations, aggregates and windows (H, I)."""

from pyspark.sql import functions as F

from guardlens.functions import ordered
from guardlens.functions import quantiles as Q
from guardlens.functions.ordered import Order
from guardlens.operators import relational as R
from guardlens.plans.registry import query
from guardlens.session import cut

RR = Order(("run", "rank"), "event_id", (), 1000)


@query("h01_previous_row", """
SELECT event_id, value, lag(value) OVER (PARTITION BY run, rank ORDER BY event_id) AS previous FROM v_trace""")
def h01(v):
    return ordered.with_previous(v.trace, "value", RR).select("event_id", "value", "previous")


@query("h02_lateral_list_join", """
SELECT doc_id, count(*) AS n_words, count(DISTINCT w) AS n_distinct FROM (SELECT doc_id, unnest(string_split(line, ' ')) AS w FROM v_doc_lines) WHERE w <> '' GROUP BY 1""")
def h02(v):
    w = v.doc_lines.select("doc_id", F.explode(F.split("line", " ")).alias("w")).where(F.col("w") != "")
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), F.count_distinct("w").alias("n_distinct"))


@query("h03_semi_anti", """
SELECT o_orderkey, 'semi' AS side FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)
UNION ALL SELECT o_orderkey, 'anti' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 20)""")
def h03(v):
    l = v.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")  # noqa: E741
    o = v.orders.select("o_orderkey")
    semi = o.join(l.where(F.col("l_quantity") >= 49), "o_orderkey", "left_semi").withColumn("side", F.lit("semi"))
    return semi.unionByName(o.join(l.where(F.col("l_quantity") >= 20), "o_orderkey", "left_anti").withColumn("side", F.lit("anti")))


@query("h04_config_join", """
SELECT c_nationkey, n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""")
def h04(v):
    # fixed dimension tables (25 and 5 rows); their measured size decides on broadcasting
    c = v.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    dims = v.nation.join(v.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(dims, F.col("c_nationkey") == F.col("n_nationkey")).select("c_nationkey", "n_name", "r_name", "n")


@query("h05_key_join_tables", """
SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def h05(v):
    return v.documents.select("doc_id", "lang").join(v.labels, "doc_id", "full_outer").select("doc_id", "lang", "quality", "toxic")




def fired(v):
    """Firing (check, run) pairs of two sides: the first and the second half of the month."""
    d = v.events.where(F.col("value") > 60).select(F.col("event_type").alias("check_id"), F.col("user_id").alias("run"),
                                                   (F.dayofmonth("ts") > 15).alias("late"))
    return d.where(~F.col("late")), d.where("late")


@query("h06_new_and_retired", """
WITH a AS (SELECT DISTINCT event_type AS c, user_id AS r FROM events WHERE value > 60 AND day(ts) <= 15), b AS (SELECT DISTINCT event_type AS c, user_id AS r FROM events WHERE value > 60 AND day(ts) > 15)
SELECT c AS check_id, r AS run, 'new' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT c, r, 'retired' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def h06(v):
    old, new = fired(v)
    k = ["check_id", "run"]
    return R.new_keys(new, old, k).withColumn("change", F.lit("new")).unionByName(R.retired_keys(new, old, k).withColumn("change", F.lit("retired")))


@query("h07_set_change", """
WITH a AS (SELECT DISTINCT event_type AS c, user_id AS r FROM events WHERE value > 60 AND day(ts) <= 15), b AS (SELECT DISTINCT event_type AS c, user_id AS r FROM events WHERE value > 60 AND day(ts) > 15)
SELECT coalesce(a.c, b.c) AS check_id, coalesce(a.r, b.r) AS run, CASE WHEN a.c IS NULL THEN 'new' WHEN b.c IS NULL THEN 'retired' ELSE 'persistent' END AS change
FROM a FULL JOIN b ON a.c = b.c AND a.r = b.r""")
def h07(v):
    old, new = fired(v)
    return R.set_diff(new, old, ["check_id", "run"])


@query("h08_union_all", """
SELECT 'customer' AS source, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier""")
def h08(v):
    c = v.customer.select(F.lit("customer").alias("source"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(v.supplier.select(F.lit("supplier").alias("source"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")))


@query("h09_keep_first", """
SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def h09(v):
    return R.keep_first(v.lineitem, ["l_orderkey"], "l_shipdate", "l_linenumber", "l_partkey", "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey")


@query("h10_top_k_per_group", """
SELECT o_orderstatus, o_orderkey, CAST(rn AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 5""")
def h10(v):
    return R.top_k(v.orders, ["o_orderstatus"], 5, F.desc("o_totalprice"), "o_orderkey", out="place").select("o_orderstatus", "o_orderkey", "place")


@query("h10_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def h10_limit(v):
    return v.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("h11_latest_value", """
SELECT user_id, arg_max(value, event_id) AS latest, arg_min(value, event_id) AS earliest FROM events GROUP BY 1""")
def h11(v):
    return v.events.groupBy("user_id").agg(F.max_by("value", "event_id").alias("latest"), F.min_by("value", "event_id").alias("earliest"))


@query("h12_completeness_grid", """
WITH g AS (SELECT l_orderkey, unnest(range(1, 8)) AS r FROM (SELECT DISTINCT l_orderkey FROM lineitem))
SELECT g.l_orderkey, CAST(g.r AS INTEGER) AS missing FROM g LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) x ON g.l_orderkey = x.l_orderkey AND g.r = x.l_linenumber WHERE x.l_orderkey IS NULL""")
def h12(v):
    from guardlens.operators.state import completeness
    d = v.lineitem.withColumn("slot", F.col("l_linenumber") - 1)
    return completeness(d, ["l_orderkey"], "slot", 7).select("l_orderkey", (F.col("missing_replica") + 1).alias("missing"))


@query("h13_union_first_wins", """
WITH u AS (SELECT c_nationkey AS k, c_name AS name, 0 AS src FROM customer UNION ALL SELECT s_nationkey, s_name, 1 FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src, name) AS rn FROM u) SELECT k, name FROM r WHERE rn = 1""")
def h13(v):
    c = v.customer.select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"))
    return R.union_first_wins([c, v.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"))], ["k"], "name")


@query("i01_grouped_aggregates", """
SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS n_supp, min(l_shipdate)::VARCHAR AS first_ship, max(l_quantity) AS max_qty, round(avg(l_discount), 8) AS avg_disc,
  round(stddev_samp(l_extendedprice), 4) AS sd_price FROM lineitem GROUP BY 1, 2 HAVING count(*) > 10""")
def i01(v):
    g = v.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("n_supp"),
        F.date_format(F.min("l_shipdate"), "yyyy-MM-dd HH:mm:ss").alias("first_ship"), F.max("l_quantity").alias("max_qty"),
        F.round(F.avg("l_discount"), 8).alias("avg_disc"), F.round(F.stddev_samp("l_extendedprice"), 4).alias("sd_price"))
    return g.where(F.col("n") > 10)


@query("i02_distinct_list", """
SELECT l_orderkey, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS members, count(DISTINCT l_linenumber) AS n_members FROM lineitem GROUP BY 1""")
def i02(v):
    from guardlens.operators.state import mask_members, mask_size, masks
    g = v.lineitem.groupBy("l_orderkey").agg(*masks("l_linenumber", 8))
    return g.select("l_orderkey", F.array_join(mask_members(8).cast("array<string>"), ",").alias("members"), mask_size(8).cast("long").alias("n_members"))


@query("i02_distinct_strings", """
SELECT l_suppkey, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS members, count(DISTINCT l_returnflag || l_linestatus) AS n_members FROM lineitem GROUP BY 1""")
def i02_strings(v):
    d = v.lineitem.withColumn("flag", F.concat("l_returnflag", "l_linestatus"))
    return R.distinct_list(d, ["l_suppkey"], "flag").select("l_suppkey", F.array_join("members", ",").alias("members"), "n_members")


@query("i03_median_of_medians", """
SELECT l_returnflag, median(m) AS med_of_med, count(*) AS n_groups FROM (SELECT l_returnflag, l_suppkey, median(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def i03(v):
    m = Q.exact_median(v.lineitem, ["l_returnflag", "l_suppkey"], "l_extendedprice", "m", grid=128)
    m = cut(m, "medians")  # the second median refers to it several times
    return Q.exact_median(m, ["l_returnflag"], "m", "med_of_med").withColumnRenamed("n", "n_groups")


@query("i04_rank_percentile", """
SELECT event_type, n, x AS p99 FROM (SELECT event_type, value AS x, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k FROM events)
WHERE k = CAST(floor(0.99 * (n - 1) + 1e-12) AS BIGINT)""")
def i04(v):
    return Q.exact_quantile(v.events, ["event_type"], "value", 0.99, "p99", "index_n_minus_1")


@query("i04_rank_percentile_index_n", """
SELECT o_orderstatus, n, x AS p75 FROM (SELECT o_orderstatus, o_totalprice AS x, count(*) OVER (PARTITION BY o_orderstatus) AS n, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1 AS k FROM orders)
WHERE k = least(CAST(floor(0.75 * n + 1e-12) AS BIGINT), n - 1)""")
def i04_n(v):
    return Q.exact_quantile(v.orders, ["o_orderstatus"], "o_totalprice", 0.75, "p75", "index_n", small=0)


@query("i05_content_fingerprint", """
WITH h AS (SELECT run, ('0x' || substr(md5(CAST(event_id AS VARCHAR) || chr(1) || hookpoint || chr(1) || payload), 1, 15))::BIGINT AS x FROM v_trace)
SELECT run, count(*) AS n_rows, CAST(sum(CAST(x AS HUGEINT)) AS VARCHAR) AS hash_sum, bit_xor(x) AS hash_xor FROM h GROUP BY 1""")
def i05(v):
    return R.fingerprint(v.trace, ["run"], ["event_id", "hookpoint", "payload"])


@query("i06_counted_pivot", """
SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'A') AS "A", count(*) FILTER (WHERE l_returnflag = 'N') AS "N", count(*) FILTER (WHERE l_returnflag = 'R') AS "R" FROM lineitem GROUP BY 1""")
def i06(v):
    return R.counted_pivot(v.lineitem, ["l_suppkey"], "l_returnflag", ["A", "N", "R"])


@query("i07_rollup_totals", """
SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'TOTAL' ELSE l_returnflag END AS l_returnflag, CASE WHEN grouping(l_linestatus) = 1 THEN 'TOTAL' ELSE l_linestatus END AS l_linestatus,
  count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def i07(v):
    return R.rollup_totals(v.lineitem, ["l_returnflag", "l_linestatus"], {"n": F.count(F.lit(1)), "qty": F.sum("l_quantity")})


@query("i08_cross_tab", """
SELECT lang, count(*) FILTER (WHERE quality = 0) AS "0", count(*) FILTER (WHERE quality = 1) AS "1" FROM documents JOIN labels ON documents.doc_id = labels.doc_id GROUP BY 1""")
def i08(v):
    d = v.documents.select("doc_id", "lang").join(v.labels, "doc_id").withColumn("q", F.col("quality").cast("string"))
    return R.counted_pivot(d, ["lang"], "q", ["0", "1"])


OUTLIER_SQL = """
WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS c, min(l_linenumber) AS p FROM lineitem GROUP BY 1, 2),
g AS (SELECT l_orderkey, count(*) AS n_values, sum(c)::BIGINT AS n_members, max(c) AS hi, min(c) AS lo FROM c GROUP BY 1),
o AS (SELECT c.l_orderkey, max(p) AS p FROM c JOIN g ON c.l_orderkey = g.l_orderkey AND c.c = g.lo GROUP BY 1)
SELECT g.l_orderkey, n_values, n_members, CASE WHEN n_values > 1 AND n_members > 2 AND lo < hi THEN o.p END AS outlier FROM g JOIN o ON g.l_orderkey = o.l_orderkey"""


@query("i09_majority_minority", OUTLIER_SQL)
def i09(v):
    return R.majority_minority(v.lineitem, ["l_orderkey"], "l_returnflag", "l_linenumber")


@query("i10_ordinal", "SELECT event_id, row_number() OVER (PARTITION BY run, rank ORDER BY event_id) AS ordinal FROM v_trace")
def i10(v):
    return ordered.with_ordinal(v.trace, RR).select("event_id", "ordinal")


@query("i11_trailing_window", """
SELECT event_id, count(*) OVER w AS n, median(value) OVER w AS base_median, max(value) OVER w AS base_max FROM v_trace
WINDOW w AS (PARTITION BY run, rank ORDER BY event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def i11(v):
    d = ordered.trailing(v.trace, RR, 20, {"n": F.count(F.lit(1)), "base_median": F.percentile("value", 0.5), "base_max": F.max("value")}, chunk=256)
    return d.select("event_id", "n", "base_median", "base_max")


@query("i12_running_counts", """
SELECT event_id, count(*) FILTER (WHERE hookpoint = 'error') OVER (PARTITION BY run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS errors_so_far FROM v_trace""")
def i12(v):
    o = Order(("run",), "event_id", (), 1000)
    return ordered.running_sum(v.trace, (F.col("hookpoint") == "error").cast("long"), o, "errors_so_far").select("event_id", "errors_so_far")


@query("i12_streaks", """
WITH g AS (SELECT run, event_id, value > 20 AS ok, count(*) FILTER (WHERE value <= 20) OVER (PARTITION BY run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM v_trace)
SELECT run, island, count(*) FILTER (WHERE ok) AS streak FROM g GROUP BY 1, 2 HAVING count(*) FILTER (WHERE ok) >= 5""")
def i12_streaks(v):
    o = Order(("run",), "event_id", (), 1000)
    d = ordered.running_sum(v.trace, (F.col("value") <= 20).cast("long"), o, "island")
    return d.groupBy("run", "island").agg(F.count_if(F.col("value") > 20).alias("streak")).where(F.col("streak") >= 5)


@query("i13_carry_forward", """
SELECT event_id, last_value(CASE WHEN hookpoint = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY run, rank ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_signup FROM v_trace""")
def i13(v):
    return ordered.carry_forward(v.trace, F.when(F.col("hookpoint") == "signup", F.col("value")), RR, "last_signup").select("event_id", "last_signup")


@query("i14_rate_per_million", """
SELECT hookpoint, count(*) AS n, count(*) FILTER (WHERE value > 100) AS n_fire, round(count(*) FILTER (WHERE value > 100) * 1e6 / count(*), 4) AS per_million FROM v_trace GROUP BY 1""")
def i14(v):
    g = v.trace.groupBy("hookpoint").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 100).alias("n_fire"))
    return g.withColumn("per_million", F.round(R.rate_per_million(F.col("n_fire"), F.col("n")), 4))
