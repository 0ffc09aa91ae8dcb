"""Evaluation analytics over result tables derived from the data (M)."""

from pyspark.sql import functions as F

from guardlens.operators import evalkit as M
from guardlens.operators import relational as R
from guardlens.operators import rules as RU
from guardlens.operators import spec as S
from guardlens.plans.q_exprs import EVIDENCE_SQL, evidence
from guardlens.plans.q_rules import norm_trace, replica_records
from guardlens.plans.q_sources import _iteration_log
from guardlens.plans.registry import query
from guardlens.session import spread
from guardlens.sources import textlogs


def cells(v):
    """Ablation cells: one per line item; the arm is the return flag, the cell's database the supplier."""
    return v.lineitem.select(F.col("l_returnflag").alias("arm"), F.col("l_suppkey").alias("db"), (F.col("l_quantity") > 30).cast("int").alias("fail"))


@query("m01_guard_ablation", """
WITH g AS (SELECT l_returnflag AS arm, CAST(sum(CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END) AS BIGINT) AS n_fail, count(*) AS n_cells FROM lineitem WHERE l_suppkey NOT IN (4, 14, 24, 34) GROUP BY 1)
SELECT arm, n_fail, n_cells, round((n_fail - (SELECT n_fail FROM g WHERE arm = 'A')) * 100.0 / (SELECT n_fail FROM g WHERE arm = 'A'), 6) AS pct_vs_base FROM g""")
def m01(v):
    return M.ablation(cells(v), "arm", "A", F.col("fail"), ~F.col("db").isin(4, 14, 24, 34)).withColumn("pct_vs_base", F.round("pct_vs_base", 6))


@query("m01_monotone_order", """
WITH g AS (SELECT l_returnflag AS arm, count(*) FILTER (WHERE l_quantity > 30) AS n FROM lineitem GROUP BY 1)
SELECT (SELECT n FROM g WHERE arm = 'A') <= (SELECT n FROM g WHERE arm = 'N') AND (SELECT n FROM g WHERE arm = 'N') <= (SELECT n FROM g WHERE arm = 'R') AS monotone""")
def m01_order(v):
    return M.monotone_order(M.ablation(cells(v), "arm", "A", F.col("fail")), "arm", {"A": 0, "N": 1, "R": 2}, "n_fail")


def arms(v):
    t = norm_trace(v).unionByName(replica_records(v, "cross_rank_cksums", "build.snapshot"))
    ids = ("T0-norm-output-unit-rms", "T1-replica-cksum-equal")
    out = {}
    for a in S.ARMS:
        rules, guards = RU.arm(a)
        out[a] = S.violations(t, [r for r in rules if r.check_id in ids], guards)
    return out


@query("m02_guarded_vs_stripped", """
WITH f AS (SELECT (SELECT count(*) FROM v_tensor WHERE block <> 2 AND NOT (l2 * label / 8 BETWEEN 0.5 AND 2.0)) AS a, (SELECT count(*) FROM v_tensor WHERE NOT (l2 * label / 8 BETWEEN 0.5 AND 2.0)) AS b,
 (SELECT count(*) FILTER (WHERE o_custkey % 4 > 1 AND o_orderstatus = 'P') + count(*) FILTER (WHERE o_orderpriority = '1-URGENT') FROM orders) AS r)
SELECT 'full' AS arm, 2::BIGINT AS n_checks, a + r AS n_rows FROM f UNION ALL SELECT 'no_precond', 2, b + r FROM f""")
def m02(v):
    a = arms(v)
    d = a["full"].withColumn("arm", F.lit("full")).unionByName(a["no_precond"].withColumn("arm", F.lit("no_precond")))
    return M.firing_summary(d, ("full", "no_precond"))


@query("m03_arm_delta", """
SELECT DISTINCT 'run' || CAST(vec_id % 3 AS VARCHAR) AS run, vec_id AS event_id FROM v_tensor WHERE block = 2 AND NOT (l2 * label / 8 BETWEEN 0.5 AND 2.0)""")
def m03(v):
    a = arms(v)
    return M.arm_delta(a["full"], a["no_precond"], ["run", "check_id", "event_id"]).select("run", "event_id")


@query("m04_duplicate_captures", """
WITH h AS (SELECT l_suppkey, l_orderkey, count(*) AS n, md5(string_agg(CAST(CAST(l_quantity AS INTEGER) // 10 AS VARCHAR), ',' ORDER BY CAST(l_quantity AS INTEGER) // 10)) AS h FROM lineitem GROUP BY 1, 2)
SELECT n AS n_rows, count(*) AS n_captures, CAST(min(l_suppkey * 100000000 + l_orderkey) AS BIGINT) AS first_key FROM h GROUP BY n, h HAVING count(*) > 1""")
def m04(v):
    d = v.lineitem.select("l_suppkey", "l_orderkey", F.expr("CAST(l_quantity AS INT) div 10").alias("q"))
    # captures of a few rows each: about as many groups as rows
    fp = R.fingerprint(spread(d, d.count(), "l_suppkey", "l_orderkey"), ["l_suppkey", "l_orderkey"], ["q"])
    dup = M.duplicate_captures(fp, ["l_suppkey", "l_orderkey"], ["n_rows", "hash_sum", "hash_xor"])
    return dup.select("n_rows", "n_captures", (F.col("l_suppkey") * 100000000 + F.col("l_orderkey")).alias("first_key"))


@query("m05_clean_run_rollup", """
WITH f AS (SELECT event_type AS check_id, user_id % 10 AS run, count(*) AS c FROM events WHERE value > 180 GROUP BY 1, 2)
SELECT check_id, count(*) AS n_runs_fired, CAST(sum(c) AS BIGINT) AS n_fires, max(c) AS max_fires, count(*) = (SELECT count(DISTINCT user_id % 10) FROM events) AS universal FROM f GROUP BY 1""")
def m05(v):
    e = v.events.select(F.col("event_type").alias("check_id"), (F.col("user_id") % 10).alias("run"), "value")
    return M.clean_run_rollup(e.where(F.col("value") > 180), e)


@query("m06_detection_outcome", """
SELECT d.doc_id, CASE WHEN l.quality = 0 AND l.toxic = 1 THEN 'DETECTED' WHEN l.quality = 0 THEN 'MISSED' WHEN l.toxic = 1 THEN 'FALSE_POSITIVE' ELSE 'TRUE_NEGATIVE' END AS outcome FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def m06(v):
    d = v.documents.select("doc_id").join(v.labels, "doc_id")
    return d.select("doc_id", M.detection_outcome(F.col("quality") == 0, F.col("toxic") == 1).alias("outcome"))


@query("m07_method_comparison", """
WITH o AS (SELECT lang AS method, CASE WHEN quality = 0 AND toxic = 1 THEN 'D' WHEN quality = 0 THEN 'M' WHEN toxic = 1 THEN 'F' ELSE 'T' END AS x FROM documents JOIN labels ON documents.doc_id = labels.doc_id)
SELECT method, count(*) FILTER (WHERE x = 'D') AS detected, count(*) FILTER (WHERE x = 'M') AS missed, count(*) FILTER (WHERE x = 'F') AS false_positive, count(*) FILTER (WHERE x = 'T') AS true_negative,
  round(count(*) FILTER (WHERE x = 'D') * 1.0 / nullif(count(*) FILTER (WHERE x IN ('D', 'M')), 0), 9) AS detection_rate, round(count(*) FILTER (WHERE x = 'F') * 1.0 / nullif(count(*) FILTER (WHERE x IN ('F', 'T')), 0), 9) AS fp_rate FROM o GROUP BY 1""")
def m07(v):
    d = v.documents.select("doc_id", F.col("lang").alias("method")).join(v.labels, "doc_id")
    d = d.withColumn("outcome", M.detection_outcome(F.col("quality") == 0, F.col("toxic") == 1))
    return M.method_table(d, "method", "outcome").withColumn("detection_rate", F.round("detection_rate", 9)).withColumn("fp_rate", F.round("fp_rate", 9))


@query("m08_regression_diff", """
WITH a AS (SELECT event_type AS c, user_id AS r, count(*) AS n FROM events WHERE value > 60 AND day(ts) <= 15 GROUP BY 1, 2), b AS (SELECT event_type AS c, user_id AS r, count(*) AS n FROM events WHERE value > 60 AND day(ts) > 15 GROUP BY 1, 2)
SELECT coalesce(a.c, b.c) AS check_id, coalesce(a.r, b.r) AS run, coalesce(a.n, 0) AS n_old, coalesce(b.n, 0) AS n_new, CASE WHEN a.c IS NULL THEN 'new' WHEN b.c IS NULL THEN 'fixed' ELSE 'persistent' END AS change
FROM a FULL JOIN b ON a.c = b.c AND a.r = b.r""")
def m08(v):
    from guardlens.plans.q_relational import fired
    old, new = fired(v)
    return M.regression_diff(old, new, ["check_id", "run"])


KAPPA = """
c AS (SELECT {g} AS g, quality AS a, toxic AS b FROM documents JOIN labels ON documents.doc_id = labels.doc_id),
n AS (SELECT g, count(*) AS n, count(*) FILTER (WHERE a = b) AS agree, count(*) FILTER (WHERE a = 0) AS a0, count(*) FILTER (WHERE a = 1) AS a1, count(*) FILTER (WHERE b = 0) AS b0, count(*) FILTER (WHERE b = 1) AS b1 FROM c GROUP BY 1),
k AS (SELECT *, agree * 1.0::DOUBLE / n AS po, (a0 * 1.0::DOUBLE * b0 + a1 * 1.0::DOUBLE * b1) / (n * 1.0::DOUBLE * n) AS pe FROM n)"""


@query("m09_cohen_kappa", f"""WITH {KAPPA.format(g="'all'")} SELECT n, round(po, 9) AS raw_agreement, round((po - pe) / (1 - pe), 9) AS kappa FROM k""")
def m09(v):
    p = v.documents.select("doc_id").join(v.labels, "doc_id")
    return M.cohen_kappa(p, "quality", "toxic").select("n", F.round("raw_agreement", 9).alias("raw_agreement"), F.round("kappa", 9).alias("kappa"))


@query("m09_cohen_kappa_by_group", f"""WITH {KAPPA.format(g="lang")} SELECT g AS lang, n, round(po, 9) AS raw_agreement, CASE WHEN pe <> 1 THEN round((po - pe) / (1 - pe), 9) END AS kappa FROM k""")
def m09_by(v):
    p = v.documents.select("doc_id", "lang").join(v.labels, "doc_id")
    return M.cohen_kappa(p, "quality", "toxic", ["lang"]).withColumn("raw_agreement", F.round("raw_agreement", 9)).withColumn("kappa", F.round("kappa", 9))


@query("m10_disagreements", "SELECT doc_id, quality, toxic FROM labels WHERE quality IS DISTINCT FROM toxic")
def m10(v):
    return M.disagreements(v.labels, "doc_id", "quality", "toxic")


@query("m11_coverage_metrics", """
SELECT p_type AS framework, count(*) AS n, count(*) FILTER (WHERE p_size > 5) AS n_schema, count(*) FILTER (WHERE p_size > 5 AND p_retailprice > 930) AS n_joint, count(*) FILTER (WHERE p_brand = 'Brand#7') AS n_novel,
  round(count(*) FILTER (WHERE p_size > 5) * 1.0 / count(*), 9) AS c_schema, round(count(*) FILTER (WHERE p_size > 5 AND p_retailprice > 930) * 1.0 / count(*), 9) AS c_joint FROM part GROUP BY 1""")
def m11(v):
    d = M.coverage_metrics(v.part.withColumnRenamed("p_type", "framework"), ["framework"], F.col("p_size") > 5, F.col("p_retailprice") > 930, F.col("p_brand") == "Brand#7")
    return d.withColumn("c_schema", F.round("c_schema", 9)).withColumn("c_joint", F.round("c_joint", 9))


@query("m12_stratified_split", """
WITH g AS (SELECT p_name || '#' || CAST(p_partkey // 3 AS VARCHAR) AS leak, count(*) AS size, min((p_partkey, p_type)) AS rep FROM part GROUP BY 1),
h AS (SELECT leak, size, rep[2] AS st, ('0x' || substr(md5('5:' || leak), 1, 8))::BIGINT AS h FROM g),
p AS (SELECT st, sum(size)::BIGINT AS n FROM h GROUP BY 1), x AS (SELECT st, n, 50.0::DOUBLE * n / (SELECT sum(n) FROM p) AS exact FROM p),
b AS (SELECT st, exact, CAST(floor(exact) AS BIGINT) AS base FROM x), q AS (SELECT st, base + CASE WHEN row_number() OVER (ORDER BY round(exact - base, 9) DESC, st DESC) <= 50 - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS quota FROM b),
c AS (SELECT leak, st, sum(size) OVER (PARTITION BY st ORDER BY h, leak ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM h)
SELECT part.p_partkey, p_type, CASE WHEN cum <= quota THEN 'test' ELSE 'dev' END AS split FROM part JOIN c ON p_name || '#' || CAST(p_partkey // 3 AS VARCHAR) = c.leak JOIN q ON c.st = q.st""")
def m12(v):
    leak = F.concat_ws("#", "p_name", F.expr("CAST(p_partkey div 3 AS STRING)"))
    return M.stratified_split(v.part.select("p_partkey", "p_type", "p_name"), "p_partkey", leak, ["p_type"], 50, seed=5)


@query("m12_quota_fill", """
WITH RECURSIVE g AS (SELECT p_brand || '#' || CAST(p_partkey % 97 % (p_size + 2) AS VARCHAR) AS leak, count(*) AS size, min((p_partkey, p_type)) AS rep FROM part GROUP BY 1),
h AS MATERIALIZED (SELECT leak, size, rep[2] AS st, ('0x' || substr(md5('5:' || leak), 1, 8))::BIGINT AS h FROM g),
p AS (SELECT st, sum(size)::BIGINT AS n FROM h GROUP BY 1), x AS (SELECT st, n, 60.0::DOUBLE * n / (SELECT sum(n) FROM p) AS exact FROM p),
b AS (SELECT st, exact, CAST(floor(exact) AS BIGINT) AS base FROM x),
q AS (SELECT st, base + CASE WHEN row_number() OVER (ORDER BY round(exact - base, 9) DESC, st DESC) <= 60 - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS quota FROM b),
c AS (SELECT leak, size, h.st, h, quota, coalesce(sum(size) OVER (PARTITION BY h.st ORDER BY h, leak ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h JOIN q ON h.st = q.st),
w AS MATERIALIZED (SELECT leak, size, row_number() OVER (ORDER BY st, h, leak) AS k FROM c WHERE before < quota),
s AS (SELECT 0::BIGINT AS k, 0::BIGINT AS total, FALSE AS took, NULL::VARCHAR AS leak
  UNION ALL SELECT w.k, s.total + CASE WHEN s.total + w.size <= 60 THEN w.size ELSE 0 END, s.total + w.size <= 60, w.leak FROM s JOIN w ON w.k = s.k + 1),
f AS MATERIALIZED (SELECT leak FROM s WHERE took),
o AS MATERIALIZED (SELECT leak, size, row_number() OVER (ORDER BY h, leak) AS k FROM h WHERE leak NOT IN (SELECT leak FROM f)),
t AS (SELECT 0::BIGINT AS k, (SELECT max(total) FROM s)::BIGINT AS total, FALSE AS took, NULL::VARCHAR AS leak
  UNION ALL SELECT o.k, t.total + CASE WHEN t.total + o.size <= 60 THEN o.size ELSE 0 END, t.total + o.size <= 60, o.leak FROM t JOIN o ON o.k = t.k + 1),
ch AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY inside, size ORDER BY leak) AS no FROM (SELECT leak, size, leak IN (SELECT leak FROM f UNION ALL SELECT leak FROM t WHERE took) AS inside FROM h)),
l AS MATERIALIZED (SELECT 60 - coalesce(sum(size) FILTER (WHERE inside), 0)::BIGINT AS short, least(60, max(size) ** 2)::BIGINT AS most FROM ch),
n AS MATERIALIZED (SELECT inside, size AS s, count(*) AS n, row_number() OVER (PARTITION BY inside ORDER BY size) AS step FROM ch WHERE size <= 120 GROUP BY inside, size),
made AS (SELECT inside, 0::BIGINT AS step, list_transform(range(0, 121), lambda i: CASE WHEN i = 0 THEN CAST([] AS STRUCT(s BIGINT, k BIGINT)[]) END) AS sums FROM (VALUES (TRUE), (FALSE)) b(inside)
  UNION ALL SELECT m.inside, n.step, list_transform(range(0, 121), lambda i: CASE WHEN m.sums[i + 1] IS NOT NULL THEN m.sums[i + 1] ELSE list_transform(
    list_filter(range(1, least(n.n, i // n.s) + 1), lambda k: m.sums[i - k * n.s + 1] IS NOT NULL)[1:1], lambda k: list_append(m.sums[i - k * n.s + 1], {'s': n.s, 'k': k}))[1] END)
  FROM made m JOIN n ON n.inside = m.inside AND n.step = m.step + 1),
done AS MATERIALIZED (SELECT inside, arg_max(sums, step) AS sums FROM made GROUP BY inside),
r AS MATERIALIZED (SELECT min(r) AS r, any_value(g.sums) AS gives, any_value(w.sums) AS takes, any_value(short) AS short FROM l, done g, done w, range(0, 61) x(r)
  WHERE g.inside AND NOT w.inside AND short > 0 AND r <= most AND g.sums[r + 1] IS NOT NULL AND w.sums[r + short + 1] IS NOT NULL),
mv AS MATERIALIZED (SELECT TRUE AS inside, unnest(gives[r + 1], recursive := true) FROM r UNION ALL SELECT FALSE, unnest(takes[r + short + 1], recursive := true) FROM r),
c2 AS MATERIALIZED (SELECT ch.leak FROM ch LEFT JOIN mv ON mv.inside = ch.inside AND mv.s = ch.size AND ch.no <= mv.k WHERE ch.inside = (mv.s IS NULL))
SELECT p_partkey, p_type, CASE WHEN p_brand || '#' || CAST(p_partkey % 97 % (p_size + 2) AS VARCHAR) IN (SELECT leak FROM c2) THEN 'test' ELSE 'dev' END AS split FROM part""")
def m12_fill(v):
    """Sequential rule of the original split: quotas, groups that do not fit are passed over, the shortfall is filled from all strata.

    What no group fits is made up by the least exchange of chosen for other groups.
    """
    leak = F.concat_ws("#", "p_brand", (F.col("p_partkey") % 97 % (F.col("p_size") + 2)).cast("string"))
    return M.quota_fill_split(v.part.select("p_partkey", "p_type", "p_brand", "p_size"), "p_partkey", leak, ["p_type"], 60, seed=5)


@query("m13_temporal_split_cutoff", "SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'train' ELSE 'test' END AS split FROM orders")
def m13(v):
    return M.temporal_split(v.orders.withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd")), "d", "1998-01-01").select("o_orderkey", "split")


def by_time(v):
    from guardlens.plans.views import micros
    d = v.orders.withColumn("t", F.timestamp_micros(micros(F.col("o_orderdate"))))
    return M.temporal_split(d, "t", train_fraction=0.6)


TIME_SQL = """c AS (SELECT o_orderdate AS cut FROM (SELECT o_orderdate, row_number() OVER (ORDER BY o_orderdate) - 1 AS k, count(*) OVER () AS n FROM orders) WHERE k = CAST(floor(0.6 * n + 1e-12) AS BIGINT)),
s AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderdate < (SELECT cut FROM c) THEN 'train' ELSE 'test' END AS split FROM orders)"""


@query("m13_temporal_split_quantile", f"WITH {TIME_SQL} SELECT o_orderkey, split FROM s")
def m13_q(v):
    return by_time(v).select("o_orderkey", "split")


@query("m14_holdout_coverage", f"""
WITH {TIME_SQL} SELECT count(*) AS n_test, count(*) FILTER (WHERE o_custkey IN (SELECT o_custkey FROM s WHERE split = 'train')) AS n_covered FROM s WHERE split = 'test'""")
def m14(v):
    return M.holdout_coverage(by_time(v), "o_custkey")


def decisions(v):
    d = F.when(F.col("value") > 200, "NEW_TEMPLATE").when(F.col("value") < 0.6, "SINGLETON").otherwise("MATCH")
    return v.events.select(F.dayofmonth("ts").alias("batch"), d.alias("decision"))


@query("m15_saturation", """
WITH g AS (SELECT day(ts) AS batch, count(*) AS n_cases, count(*) FILTER (WHERE value BETWEEN 0.6 AND 200) AS n_matched, count(*) FILTER (WHERE value < 0.6) AS n_singletons, count(*) FILTER (WHERE value > 200) AS n_new_templates FROM events GROUP BY 1),
o AS (SELECT *, n_new_templates = 0 AND n_matched >= n_cases * 0.95 AND n_singletons < n_cases * 0.05 AS batch_ok FROM g),
i AS (SELECT *, count(*) FILTER (WHERE NOT batch_ok) OVER (ORDER BY batch) AS island FROM o)
SELECT CAST(batch AS INTEGER) AS batch, n_cases, n_matched, n_singletons, n_new_templates, batch_ok, count(*) FILTER (WHERE batch_ok) OVER (PARTITION BY island ORDER BY batch) AS ok_streak, CAST(sum(n_cases) OVER (ORDER BY batch) AS BIGINT) AS cum_cases,
  round(sum(n_matched + n_new_templates) OVER (ORDER BY batch) * 1.0::DOUBLE / sum(n_cases) OVER (ORDER BY batch), 9) AS cum_coverage, count(*) FILTER (WHERE batch_ok) OVER (PARTITION BY island ORDER BY batch) >= 3 AS stop FROM i""")
def m15(v):
    return M.saturation(decisions(v), "batch", "decision").withColumn("cum_coverage", F.round("cum_coverage", 9))


@query("m16_order_resampling_bands", """
WITH s AS (SELECT p_partkey AS k, p_name AS l, unnest(range(0, 5)) AS o FROM part), p AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY ('0x' || substr(md5(CAST(o AS VARCHAR) || ':' || CAST(k AS VARCHAR)), 1, 8))::BIGINT, k) AS pos FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY o, l ORDER BY pos) AS rn FROM p), f AS (SELECT o, l, pos AS fa FROM r WHERE rn = 2),
j AS (SELECT p.o, pos, CASE WHEN pos >= fa THEN 1 ELSE 0 END AS c, CASE WHEN pos = fa THEN 1 ELSE 0 END AS n FROM p LEFT JOIN f ON p.o = f.o AND p.l = f.l),
u AS (SELECT o, pos, CAST(sum(n) OVER w AS BIGINT) AS t, sum(c) OVER w * 1.0::DOUBLE / pos AS cov FROM j WINDOW w AS (PARTITION BY o ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a AS (SELECT pos, list_sort(list(t)) AS ts, list_sort(list(cov)) AS cs FROM u GROUP BY pos)
SELECT pos, ts[3] AS templates_median, ts[1] AS templates_p05, ts[5] AS templates_p95, round(cs[3], 9) AS coverage_median, round(cs[1], 9) AS coverage_p05, round(cs[5], 9) AS coverage_p95 FROM a""")
def m16(v):
    d = M.order_bands(v.part.select("p_partkey", "p_name"), "p_partkey", "p_name", 5)
    return d.select("pos", "templates_median", "templates_p05", "templates_p95", *[F.round(f"coverage_{x}", 9).alias(f"coverage_{x}") for x in ("median", "p05", "p95")])


@query("m17_share_table", """
SELECT p_brand, p_type, count(*) AS n, count(*) FILTER (WHERE p_size > 25) AS n_true, round(count(*) FILTER (WHERE p_size > 25) * 1.0 / count(*), 9) AS share FROM part GROUP BY 1, 2""")
def m17(v):
    return M.share_table(v.part, ["p_brand", "p_type"], F.col("p_size") > 25).withColumn("share", F.round("share", 9))


def flagged(v):
    f = F.filter(F.array(F.when(F.col("p_size") > 40, F.lit("PATTERN_AMBIGUOUS:x")), F.when(F.col("p_size") < 10, F.lit("EXCEEDS_TIER6")),
                         F.when(F.col("p_type") == "PROMO", F.lit("INFERRED_FROM_TITLE")), F.when(F.col("p_brand") == "Brand#3", F.lit("misc")),
                         F.when(F.col("p_size") > 45, F.lit("CATEGORY_AMBIGUOUS"))), lambda x: x.isNotNull())
    return v.part.select("p_partkey", "p_type", f.alias("flags"))


@query("m18_flag_summary", """
SELECT 'coding ambiguity' AS flag_class, count(*) AS n_records, count(*) + count(*) FILTER (WHERE p_size > 45) AS n_instances FROM part WHERE p_size > 40 UNION ALL SELECT 'scope declaration', count(*), count(*) FROM part WHERE p_size < 10
UNION ALL SELECT 'weak evidence', count(*), count(*) FROM part WHERE p_type = 'PROMO' UNION ALL SELECT 'other', count(*), count(*) FROM part WHERE p_brand = 'Brand#3'""")
def m18(v):
    return M.flag_summary(flagged(v), "p_partkey", "flags")


@query("m18_ambiguity_rate", """
SELECT p_type, count(*) AS n, count(*) FILTER (WHERE p_size > 40) AS n_true, round(count(*) FILTER (WHERE p_size > 40) * 1.0 / count(*), 9) AS share FROM part GROUP BY 1""")
def m18_rate(v):
    return M.ambiguity_rate(flagged(v), "p_type", "flags").withColumn("share", F.round("share", 9))


@query("m19_vocabulary_coverage", """
SELECT event_type, count(*) AS n, CASE event_type WHEN 'view' THEN 'module.fwd.post' WHEN 'click' THEN 'module.bwd' END AS mapped_to, event_type IN ('view', 'click') AS mapped FROM events GROUP BY 1""")
def m19(v):
    return M.vocabulary_coverage(v.events, "event_type", {"view": "module.fwd.post", "click": "module.bwd"})


@query("m20_evidence_grid", EVIDENCE_SQL + """
SELECT lang AS pool, count(*) FILTER (WHERE NOT warned AND underlying_level = 'L1') AS "L1", count(*) FILTER (WHERE NOT warned AND underlying_level = 'L2') AS "L2", count(*) FILTER (WHERE NOT warned AND underlying_level = 'L3') AS "L3",
  count(*) FILTER (WHERE NOT warned AND underlying_level = 'L4') AS "L4", count(*) FILTER (WHERE warned) AS "WARNING" FROM e GROUP BY 1""")
def m20(v):
    return R.counted_pivot(evidence(v).withColumnRenamed("lang", "pool"), ["pool"], "evidence_level", ["L1", "L2", "L3", "L4", "WARNING"])


@query("m21_timing_summary", """
WITH i AS (SELECT user_id % 4 AS f, value AS ms, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS n FROM events WHERE event_type NOT IN ('error', 'signup')),
g AS (SELECT f, count(*) AS n_iters, avg(ms) AS mean, median(ms) AS median, min(ms) AS min, max(ms) AS max FROM i WHERE n > 1 GROUP BY 1)
SELECT 'log' || CAST(f AS VARCHAR) AS file, n_iters, round(mean, 6) AS mean, median, min, max, round(mean / (SELECT mean FROM g WHERE f = 0), 9) AS vs_baseline FROM g""")
def m21(v):
    it = textlogs.iteration_times(_iteration_log(v), ["file"], "line_no")
    d = M.timing_summary(it, ["file"], "line_no", "ms", F.col("file") == "log0")
    return d.withColumn("mean", F.round("mean", 6)).withColumn("vs_baseline", F.round("vs_baseline", 9))


@query("m22_corpus_merge", """
WITH b AS (SELECT doc_id, CAST(doc_id % 2 AS INTEGER) AS q FROM documents WHERE lang IN ('en', 'fr')), o AS (SELECT doc_id, quality AS q FROM labels)
SELECT coalesce(b.doc_id, o.doc_id) AS doc_id, coalesce(o.q, b.q) AS q, CASE WHEN b.doc_id IS NULL THEN 'override' WHEN o.doc_id IS NULL THEN 'base' ELSE 'both' END AS source, coalesce(b.q <> o.q, FALSE) AS disagrees FROM b FULL JOIN o ON b.doc_id = o.doc_id""")
def m22(v):
    b = v.documents.where(F.col("lang").isin("en", "fr")).select("doc_id", (F.col("doc_id") % 2).cast("int").alias("q"))
    return M.corpus_merge(b, v.labels.select("doc_id", F.col("quality").alias("q")), "doc_id", ["q"])


@query("m23_record_validation", """
WITH r AS (SELECT l_orderkey AS k, CASE WHEN l_discount > 0 THEN l_discount END AS d, CASE WHEN l_tax > 0.01 THEN l_tax END AS t FROM lineitem WHERE l_quantity > 5), p AS (SELECT k, count(*) AS c, count(*) FILTER (WHERE d IS NULL) AS nd, count(*) FILTER (WHERE t IS NULL) AS nt FROM r GROUP BY 1),
e AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'F')
SELECT count(*) FILTER (WHERE c > 1) AS n_duplicate_keys, count(*) FILTER (WHERE c IS NULL) AS n_missing_keys, count(*) FILTER (WHERE e.k IS NULL) AS n_unknown_keys, CAST(sum(nd) AS BIGINT) AS n_null_d, CAST(sum(nt) AS BIGINT) AS n_null_t
FROM p FULL JOIN e ON p.k = e.k""")
def m23(v):
    r = v.lineitem.where(F.col("l_quantity") > 5).select(F.col("l_orderkey").alias("k"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("d"), F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("t"))
    return M.record_validation(r, v.orders.where(F.col("o_orderstatus") != "F").select(F.col("o_orderkey").alias("k")), "k", ["d", "t"])


@query("m24_staircase", """
WITH g AS (SELECT p_size AS step, count(*) AS n_cases FROM part WHERE p_type <> 'PROMO' GROUP BY 1)
SELECT step, n_cases, CAST(sum(n_cases) OVER (ORDER BY step) AS BIGINT) AS cumulative, round(sum(n_cases) OVER (ORDER BY step) * 100.0::DOUBLE / (SELECT count(*) FROM part), 6) AS cumulative_pct FROM g""")
def m24(v):
    d = M.staircase(v.part.where(F.col("p_type") != "PROMO").select(F.col("p_size").alias("step")), "step", v.part)
    return d.withColumn("cumulative_pct", F.round("cumulative_pct", 6))


@query("m25_holdout_pool", "SELECT CASE WHEN regexp_matches(url, '^https://m[.]') THEN 'holdout' ELSE 'main' END AS pool, count(*) AS n FROM pages GROUP BY 1")
def m25(v):
    return M.holdout_pool(v.pages, "url", r"^https://m[.]").groupBy("pool").agg(F.count(F.lit(1)).alias("n"))


@query("m26_yield_by_arm", """
WITH y AS (SELECT l_returnflag AS arm, l_linenumber AS rep, sum(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END)::DOUBLE AS y FROM lineitem GROUP BY 1, 2), m AS (SELECT arm, median(y) AS median_yield, count(*) AS n_repetitions FROM y GROUP BY 1)
SELECT arm, median_yield, n_repetitions, round(median_yield / (SELECT median_yield FROM m WHERE arm = 'A'), 9) AS ratio FROM m""")
def m26(v):
    d = v.lineitem.select(F.col("l_returnflag").alias("arm"), F.col("l_linenumber").alias("rep"), (F.col("l_quantity") > 40).cast("int").alias("s"))
    return M.yield_by_arm(d, "arm", "rep", F.col("s"), "A").withColumn("ratio", F.round("ratio", 9))


@query("m26_distinct_survivors", "SELECT l_returnflag AS arm, count(DISTINCT l_partkey) AS n_survivors FROM lineitem WHERE l_quantity > 40 GROUP BY 1")
def m26_distinct(v):
    return v.lineitem.where(F.col("l_quantity") > 40).groupBy(F.col("l_returnflag").alias("arm")).agg(F.count_distinct("l_partkey").alias("n_survivors"))


@query("m27_line_counts", """
WITH g AS (SELECT doc_id, count(*) AS total_lines, count(*) FILTER (WHERE trim(line, ' ') <> '' AND NOT starts_with(trim(line, ' '), '#')) AS code_lines FROM v_doc_lines GROUP BY 1)
SELECT g.doc_id, total_lines, code_lines, n_chars // 400 AS claimed, CASE WHEN n_chars // 400 > 0 THEN (code_lines * 1.0::DOUBLE / (n_chars // 400) BETWEEN 1 / 1.5 AND 1.5 OR total_lines * 1.0::DOUBLE / (n_chars // 400) BETWEEN 1 / 1.5 AND 1.5) END AS in_band FROM g JOIN documents d ON g.doc_id = d.doc_id""")
def m27(v):
    claims = v.documents.select("doc_id", F.expr("n_chars div 400").alias("claimed"))
    return M.line_counts(v.doc_lines, "doc_id", F.col("line"), claims, 1.5)
