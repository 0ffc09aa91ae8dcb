"""Projections, filters and scalar functions (B)."""

from pyspark.sql import functions as F

from guardlens.functions import exprs as X
from guardlens.operators import evalkit
from guardlens.plans.registry import query
from guardlens.plans.views import micros


@query("b01_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def b01(v):
    return v.events.select("event_id", X.json_value("props", "k").alias("k"))


@query("b02_json_text_filter", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') LIKE '7%'")
def b02(v):
    return v.events.where(X.json_value("props", "$.k").startswith("7")).select("event_id")


@query("b03_numeric_cast", """
SELECT event_id, try_cast(CASE WHEN event_type = 'error' THEN event_type ELSE CAST(user_id AS VARCHAR) END AS BIGINT) AS n,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events""")
def b03(v):
    raw = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(F.col("user_id").cast("string"))
    return v.events.select("event_id", X.number(raw, "long").alias("n"), X.json_number("props", "k").alias("k"))


@query("b04_typed_literal", """
SELECT count(*) FILTER (WHERE l_returnflag = 'A') AS n_text, count(*) FILTER (WHERE l_linenumber = 3) AS n_int,
       count(*) FILTER (WHERE l_discount = 0.05) AS n_num, count(*) FILTER (WHERE l_tax IS NULL) AS n_null FROM lineitem""")
def b04(v):
    e = X.equals_literal
    return v.lineitem.agg(F.count_if(e(F.col("l_returnflag"), "A")).alias("n_text"), F.count_if(e(F.col("l_linenumber"), 3)).alias("n_int"),
                          F.count_if(e(F.col("l_discount"), 0.05)).alias("n_num"), F.count_if(e(F.col("l_tax"), None)).alias("n_null"))


@query("b05_hookpoint_filter", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'signup', 'nope') GROUP BY 1")
def b05(v):
    return v.events.where(X.hookpoint_in(["view", "signup", "nope"], "event_type")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("b06_class_filter", """
SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%PROMO%' OR p_type LIKE '%ECON%' OR lower(p_name) LIKE '%ring%'""")
def b06(v):
    return v.part.where(X.contains_any("p_type", ["PROMO", "ECON"]) | F.lower("p_name").like("%ring%")).select("p_partkey", "p_type")


@query("b07_class_regex", "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^(LARGE|SM.*L)$')")
def b07(v):
    return v.part.where(X.matches("p_type", "^(LARGE|SM.*L)$")).select("p_partkey", "p_type")


@query("b08_list_expand", """
SELECT vec_id, i AS position, CAST(x AS DOUBLE) AS value FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)""")
def b08(v):
    return v.embeddings.select("vec_id", F.posexplode("embedding").alias("position", "value")).select(
        "vec_id", F.col("position").cast("long").alias("position"), F.col("value").cast("double").alias("value"))


@query("b09_object_project", """
SELECT c_custkey, c_name AS name, c_acctbal AS balance FROM customer WHERE c_acctbal > 0""")
def b09(v):
    doc = F.to_json(F.struct(F.when(F.col("c_acctbal") > 0, F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))).alias("account")))
    p = v.customer.select("c_custkey", F.from_json(doc, "account STRUCT<name: STRING, balance: DOUBLE>").alias("p"))
    return p.where(F.col("p.account").isNotNull()).select("c_custkey", "p.account.name", "p.account.balance")


@query("b10_path_resolve", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END AS resolved, CAST(NULL AS VARCHAR) AS missing FROM customer""")
def b10(v):
    doc = F.to_json(F.struct(F.struct(F.struct(F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal")).alias("c")).alias("b")).alias("a")))
    return v.customer.select("c_custkey", X.json_number(doc, "$.a.b.c").alias("resolved"), X.json_value(doc, "$.a.x.c").alias("missing"))


@query("b11_tensor_walk", """
SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n_summaries, CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS n_bad FROM (
  SELECT l_orderkey, l_linenumber, unnest([l_quantity >= 49, l_discount >= 0.1, l_tax >= 0.08, l_quantity >= 49]) AS bad FROM lineitem) GROUP BY 1, 2""")
def b11(v):
    from guardlens import schema as sc
    from guardlens.operators.spec import tensor_summaries
    from guardlens.plans.views import tensor_json
    d = v.lineitem.select("l_orderkey", "l_linenumber", F.to_json(F.struct(
        tensor_json(has_nan=F.col("l_quantity") >= 49).alias("output"),
        F.array(tensor_json(has_nan=F.col("l_discount") >= 0.1), tensor_json(has_nan=F.col("l_tax") >= 0.08)).alias("inputs"),
        F.struct(F.array(F.struct(F.lit("w").alias("name"), tensor_json(has_nan=F.col("l_quantity") >= 49).alias("tensor_summary"))).alias("parameters")).alias("model"),
    )).alias("payload"))
    walked, read = ("output", "inputs", "model"), ("dtype", "shape", "has_nan")
    p = F.from_json("payload", sc.payload_schema(walked, read))
    ts = tensor_summaries(F.col("p"), walked, read)
    return d.withColumn("p", p).select("l_orderkey", "l_linenumber", F.explode(ts).alias("t")).groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n_summaries"), F.count_if(F.col("t.has_nan")).alias("n_bad"))


@query("b12_shape_algebra", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_linenumber AS BIGINT) * CAST(l_quantity AS BIGINT) * 4 AS numel, CAST(l_linenumber AS BIGINT) * CAST(l_quantity AS BIGINT) AS n_rows FROM lineitem""")
def b12(v):
    shape = F.array(F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long"), F.lit(4).cast("long"))
    return v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", X.numel(shape).alias("numel"), X.leading_rows(shape).alias("n_rows"))


@query("b13_rms", "SELECT vec_id, round(l2 / sqrt(CAST(shape[1] AS DOUBLE)), 8) AS rms FROM v_tensor")
def b13(v):
    return v.tensor.select("vec_id", F.round(X.rms("l2", "shape"), 8).alias("rms"))


@query("b14_one_hot_signature", """
SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_tax >= 0.04 THEN 'one_hot' ELSE 'trivial_size_1' END AS kind FROM lineitem
WHERE abs(l_discount * 20 - 1.0) < 1e-3 AND abs(l_linenumber * 1.0 * l_linenumber - 16) < 16 * 0.05""")
def b14(v):
    shape = F.array(F.lit(16).cast("long"), F.when(F.col("l_tax") >= 0.04, 4).otherwise(1).cast("long"))
    hit = X.one_hot(F.col("l_linenumber").cast("double"), F.col("l_discount") * 20, shape)
    return v.lineitem.where(hit).select("l_orderkey", "l_partkey", "l_linenumber", X.one_hot_kind(shape).alias("kind"))


@query("b15_dtype_normalise", "SELECT l_linestatus AS dtype, count(*) AS n FROM lineitem GROUP BY 1")
def b15(v):
    d = v.lineitem.select(X.dtype_name(F.concat(F.when(F.col("l_linenumber") > 3, "torch.").otherwise(""), "l_linestatus")).alias("dtype"))
    return d.groupBy("dtype").agg(F.count(F.lit(1)).alias("n"))


@query("b16_block_index", """
SELECT l_linenumber AS block, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1
UNION ALL SELECT NULL, count(*) FROM lineitem WHERE l_returnflag = 'N'""")
def b16(v):
    name = F.when(F.col("l_returnflag") == "N", F.lit("model.head")).otherwise(F.concat(F.lit("model.blocks."), F.col("l_linenumber").cast("string"), F.lit(".mlp")))
    return v.lineitem.select(X.block_index(name).alias("block")).groupBy("block").agg(F.count(F.lit(1)).alias("n"))


@query("b17_magnitude_tests", """
SELECT CASE WHEN l_linenumber = 1 THEN 'NaN' WHEN l_linenumber = 2 THEN 'Inf' WHEN l_discount = 0 THEN 'zero' WHEN l_extendedprice > 50000 THEN 'explosion' END AS issue,
       count(*) AS n FROM lineitem GROUP BY 1""")
def b17(v):
    val = (F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).when(F.col("l_linenumber") == 2, F.lit(float("-inf")))
           .when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_extendedprice")))
    return v.lineitem.select(X.magnitude_issue(val, 50000).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query("b18_symmetric_deviation", """
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN greatest(c_acctbal / 1000.0, 1000.0 / c_acctbal) END AS deviation FROM customer""")
def b18(v):
    return v.customer.select("c_custkey", X.symmetric_ratio("c_acctbal", F.lit(1000.0)).alias("deviation"))


@query("b19_marker_rewrite", """
SELECT event_id, CASE event_type WHEN 'view' THEN 'Forward' WHEN 'click' THEN 'Backward' ELSE event_type || '_' || CAST(user_id AS VARCHAR) END AS name FROM events""")
def b19(v):
    raw = F.when(F.col("event_type").isin("view", "click"), F.concat("event_type", F.lit("_begin"))).otherwise(
        F.concat_ws("_", "event_type", F.lit("end"), F.col("user_id").cast("string")))
    return v.events.select("event_id", X.marker_name(raw, names={"view": "Forward", "click": "Backward"}).alias("name"))


@query("b20_epoch_text", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM events")
def b20(v):
    return v.events.select("event_id", X.epoch_text(micros(F.col("ts"))).alias("t"))


@query("b21_case_classification", """
SELECT CASE WHEN a AND b THEN 'both_inconsistent' WHEN a THEN 'cksum_inconsistent' WHEN b THEN 'grad_inconsistent' ELSE 'consistent' END AS label, count(*) AS n
FROM (SELECT l_orderkey, min(l_returnflag) <> max(l_returnflag) AS a, min(l_linestatus) <> max(l_linestatus) AS b FROM lineitem GROUP BY 1) GROUP BY 1""")
def b21(v):
    g = v.lineitem.groupBy("l_orderkey").agg((F.count_distinct("l_returnflag") > 1).alias("a"), (F.count_distinct("l_linestatus") > 1).alias("b"))
    label = (F.when(F.col("a") & F.col("b"), "both_inconsistent").when(F.col("a"), "cksum_inconsistent")
             .when(F.col("b"), "grad_inconsistent").otherwise("consistent"))
    return g.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("b22_content_hash", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md FROM documents")
def b22(v):
    return v.documents.select("doc_id", X.content_hash("text").alias("sha"), F.md5("text").alias("md"))


# The evidence columns are read from the whole texts: the title is the first line, the cause the rest. Words end at any character
# that is no letter, digit or underscore of any script, as in the operator; \\b of RE2 knows ASCII letters alone.
EVIDENCE_SQL = """
WITH d AS (SELECT doc_id, source, lang, string_split(lower(coalesce(text, '')), chr(10))[1] AS title, lower(coalesce(text, '')) AS cause, coalesce(lang = 'en', FALSE) AS reproduced,
                  CASE WHEN lang IN ('en', 'de') THEN lower(coalesce(text, '')) ELSE '' END AS buggy FROM documents),
f AS (SELECT *, regexp_matches(cause, 'throws|raises|crash|segfault|assertionerror|runtimeerror') AS loud,
  buggy <> '' AND regexp_matches(buggy, '(^|[^\\pL\\pN_])(crash|oom|nan|inf)($|[^\\pL\\pN_])|runtimeerror|assertionerror|cuda error') AS crash,
  buggy <> '' AND regexp_matches(buggy, 'bug detected|mismatch|diverged|wrong|differs|incorrect|inconsistent|clean') AS clean,
  regexp_matches(cause, 'silently|wrong value|corrupted|inconsistent|undercount|overcount|duplicate|missing|not normalized|dtype|precision|race|reorder|flag|tag') AS silent,
  regexp_matches(title, 'skip|wrong|incorrect|mismatch|undercount|lost|duplicate|precision|dtype|sync|reduce') AS st FROM d),
e AS (SELECT doc_id, source, lang, CASE WHEN reproduced AND clean AND NOT crash THEN 'L1' WHEN trim(cause) <> '' AND silent AND NOT loud THEN 'L2'
  WHEN st THEN 'L3' ELSE 'L4' END AS underlying_level, (crash OR loud) AS warned FROM f)
"""


def evidence(v):
    return evalkit.score_evidence(v.documents, F.col("lang") == "en", ["doc_id", "source", "lang"],
                                  title=F.substring_index("text", "\n", 1), cause=F.col("text"),
                                  buggy_output=F.when(F.col("lang").isin("en", "de"), F.col("text")).otherwise(F.lit("")))


@query("b23_evidence_level", EVIDENCE_SQL + """
SELECT doc_id, underlying_level, CASE WHEN warned THEN 'WARNING' ELSE underlying_level END AS evidence_level, warned OR underlying_level = 'L4' AS needs_review FROM e""")
def b23(v):
    return evidence(v).select("doc_id", "underlying_level", "evidence_level", "needs_review")


@query("b24_category_alias", """
SELECT coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'mid' END, 'unmapped:' || o_orderpriority) AS category,
       count(*) AS n FROM orders GROUP BY 1""")
def b24(v):
    c = X.map_label("o_orderpriority", {"1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "mid"},
                    F.concat(F.lit("unmapped:"), F.col("o_orderpriority")))
    return v.orders.groupBy(c.alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("b25_common_prefix", """
WITH g AS (SELECT p_brand, min(p_name) AS lo, max(p_name) AS hi FROM part GROUP BY 1),
p AS (SELECT p_brand, lo, hi, unnest(range(1, least(length(lo), length(hi)) + 1)) AS n FROM g)
SELECT g.p_brand, coalesce((SELECT max(substr(p.lo, 1, CAST(p.n AS BIGINT))) FROM p WHERE p.p_brand = g.p_brand AND substr(p.lo, 1, CAST(p.n AS BIGINT)) = substr(p.hi, 1, CAST(p.n AS BIGINT))), '') AS prefix FROM g""")
def b25(v):
    g = v.part.groupBy("p_brand").agg(F.min("p_name").alias("lo"), F.max("p_name").alias("hi"))
    return g.select("p_brand", X.common_prefix("lo", "hi").alias("prefix"))


@query("b26_topology_text", """
SELECT CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_returnflag = 'N' THEN 'dp+pp+tp' ELSE 'dp+tp' END ELSE CASE WHEN l_returnflag = 'N' THEN 'pp' ELSE '' END END AS axes,
       count(*) AS n FROM lineitem GROUP BY 1""")
def b26(v):
    t = F.concat_ws(" & ", F.when(F.col("l_linestatus") == "O", F.lit("TP>1 & dp>1")), F.when(F.col("l_returnflag") == "N", F.lit("pp > 2")))
    return v.lineitem.groupBy(X.parallel_axes(t).alias("axes")).agg(F.count(F.lit(1)).alias("n"))


@query("b27_date_cutoff", """
SELECT CASE WHEN o_orderdate < DATE '1996-01-01' THEN 'before' ELSE 'after' END AS side, count(*) AS n FROM orders GROUP BY 1""")
def b27(v):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    side = F.when(F.to_date(iso) < F.to_date(F.lit("1996-01-01")), "before").otherwise("after")
    return v.orders.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))
