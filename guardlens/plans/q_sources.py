"""Sources, sinks and summaries (A)."""

from pyspark.sql import functions as F

from guardlens.functions import exprs as X
from guardlens.plans.registry import query
from guardlens.plans.views import micros
from guardlens.session import work_folder
from guardlens.sources import filesets, manifest, textlogs, timeline, traces


@query("a01_scan_event_trace", """
SELECT event_id, hookpoint, value FROM v_trace WHERE hookpoint IN ('error', 'click')""")
def a01(v):
    return v.trace.where(X.hookpoint_in(["error", "click"])).select("event_id", "hookpoint", "value")


def _dump(v):
    """State dump in the JSON form of the collectors, one row per line item."""
    l = v.lineitem  # noqa: E741
    return l.select(F.col("l_linenumber").alias("step"), F.concat(F.lit("model-"), F.lower("l_linestatus")).alias("stage"),
                    F.to_json(F.struct(F.concat(F.lit("layer."), F.col("l_orderkey").cast("string")).alias("name"),
                                       F.md5(F.col("l_quantity").cast("int").cast("string")).alias("cksum"),
                                       F.array((F.col("l_quantity")).cast("long"), F.lit(4).cast("long")).alias("shape"),
                                       F.col("l_extendedprice").alias("max"), (F.col("l_suppkey") % 4).cast("int").alias("tp")
                                       )).alias("data"))


@query("a02_scan_state_dump", """
SELECT CAST(l_linenumber AS INTEGER) AS step, 'model-' || lower(l_linestatus) AS stage, 'layer.' || CAST(l_orderkey AS VARCHAR) AS name,
       md5(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)) AS cksum, CAST(l_quantity AS BIGINT) * 4 AS n_elements,
       l_extendedprice AS max_value, CAST(l_suppkey % 4 AS INTEGER) AS tp
FROM lineitem WHERE l_linestatus = 'O'""")
def a02(v):
    s = traces.typed_state(_dump(v))
    return s.where(F.col("stage") == "model-o").select("step", "stage", "name", "cksum", X.numel("shape").alias("n_elements"),
                                                       F.col("max").alias("max_value"), "tp")


@query("a02_logical_relations", """
SELECT 'tensor_state' AS relation, count(*) AS n_rows FROM lineitem
UNION ALL SELECT 'grad_state', 0 UNION ALL SELECT 'optimizer_state', 0 UNION ALL SELECT 'call_event', 0
UNION ALL SELECT 'comm_event', 0 UNION ALL SELECT 'topology_lineage', 0 UNION ALL SELECT 'checkpoint_state', 0
UNION ALL SELECT 'loss_event', 0""")
def a02_rel(v):
    return traces.relation_sizes(traces.typed_state(_dump(v)))


STAGES = ("model-before-backward", "main-grad-in-backward", "optimizer-state", "call-begin", "comm-all-reduce", "parallel-metadata", "checkpoint-save", "loss")


@query("a02_all_relations", """
WITH d AS (SELECT l_orderkey % 8 AS k, l_quantity >= 25 AS big, l_suppkey % 3 = 0 AS third FROM lineitem)
SELECT 'tensor_state' AS relation, count(*) FILTER (WHERE k = 0 AND big) AS n_rows FROM d UNION ALL SELECT 'grad_state', count(*) FILTER (WHERE k = 1 OR k = 0 AND third) FROM d
UNION ALL SELECT 'optimizer_state', count(*) FILTER (WHERE k = 2 OR k = 6 AND third) FROM d UNION ALL SELECT 'call_event', count(*) FILTER (WHERE k = 3) FROM d
UNION ALL SELECT 'comm_event', count(*) FILTER (WHERE k = 4) FROM d UNION ALL SELECT 'topology_lineage', count(*) FILTER (WHERE k = 5 AND third OR k = 0 AND NOT big) FROM d
UNION ALL SELECT 'checkpoint_state', count(*) FILTER (WHERE k = 6) FROM d UNION ALL SELECT 'loss_event', count(*) FILTER (WHERE k = 7) FROM d""")
def a02_all(v):
    """One dump that holds rows of all eight logical relations, some of them rows of two."""
    k, big, third = F.col("l_orderkey") % 8, F.col("l_quantity") >= 25, F.col("l_suppkey") % 3 == 0
    data = F.to_json(F.struct(F.when((k == 0) & big, "c").alias("cksum"), F.when((k == 0) & third, "g").alias("grad_cksum"), F.when((k == 6) & third, "exp_avg").alias("state_key"),
                              F.when((k == 5) & third, "PARALLEL_METADATA").alias("type"), F.when((k == 0) & ~big, F.lit(True)).alias("param_sharded")))
    dump = v.lineitem.select(F.col("l_linenumber").alias("step"), F.element_at(F.array(*map(F.lit, STAGES)), (k + 1).cast("int")).alias("stage"), data.alias("data"))
    return traces.relation_sizes(traces.typed_state(dump))


@query("a03_union_ranks", """
SELECT 'rank' || CAST(rank AS VARCHAR) AS run, count(*) AS n_events, CAST(sum(event_id) AS BIGINT) AS id_sum FROM v_trace GROUP BY 1""")
def a03(v):
    parts = {f"rank{r}": v.trace.where(F.col("rank") == r).drop("run") for r in range(4)}
    return traces.union_runs(parts).groupBy("run").agg(F.count(F.lit(1)).alias("n_events"), F.sum("event_id").alias("id_sum"))


@query("a03_rank_folders", """
SELECT 'rank' || CAST(rank AS VARCHAR) AS run, count(*) AS n_events, CAST(sum(event_id) AS BIGINT) AS id_sum FROM v_trace GROUP BY 1""")
def a03_folders(v):
    """A folder for each rank, read as one relation."""
    folder = work_folder(v.spark, "ranks")
    rows = v.trace.select("event_id", "hookpoint", "value", "rank")
    rows.write.partitionBy("rank").parquet(folder)
    t = traces.read_ranks(v.spark, folder, rows.drop("rank").schema)
    return t.groupBy("run").agg(F.count(F.lit(1)).alias("n_events"), F.sum("event_id").alias("id_sum"))


@query("a04_union_with_key_offset", """
SELECT CAST(CASE user_id % 2 WHEN 0 THEN 0 ELSE 1000000000 END + event_id AS BIGINT) AS event_id, event_type AS hookpoint FROM events""")
def a04(v):
    t = v.events.select("event_id", F.col("event_type").alias("hookpoint"), "user_id")
    parts = [t.where(F.col("user_id") % 2 == r).drop("user_id") for r in (0, 1)]
    return traces.union_ranks_with_offset(parts)


@query("a05_rank_from_file_name", """
SELECT CAST(l_suppkey % 8 AS INTEGER) AS dp, CAST(l_partkey % 4 AS INTEGER) AS tp, CAST(l_linenumber % 2 AS INTEGER) AS pp,
       0 AS cp, count(*) AS n_rows FROM lineitem GROUP BY 1, 2, 3, 4""")
def a05(v):
    name = F.concat(F.lit("/data/coredump_dp"), (F.col("l_suppkey") % 8).cast("string"), F.lit("_tp"),
                    (F.col("l_partkey") % 4).cast("string"), F.lit("_pp"), (F.col("l_linenumber") % 2).cast("string"), F.lit("_cp0.db"))
    d = v.lineitem.select(name.alias("file"))
    return d.select(*traces.rank_columns(F.col("file"))).groupBy("dp", "tp", "pp", "cp").agg(F.count(F.lit(1)).alias("n_rows"))


def _timeline(v):
    e = v.events
    base = e.select(micros(F.col("ts")).alias("us"), (F.col("user_id") % 4).cast("int").alias("rank"),
                    (F.col("user_id") % 2).cast("int").alias("stream"), F.col("event_type").alias("op_type"),
                    F.concat(F.col("event_type"), F.when(F.col("value") > 50, "_begin_kernel").otherwise("_end_kernel")).alias("op_name"),
                    F.when(F.col("value") > 50, "begin").otherwise("end").alias("op_phase"),
                    F.concat(F.lit("host"), (F.col("user_id") % 5).cast("string")).alias("hostname"))
    ns = base.where(F.col("rank") < 2).withColumn("timestamp", F.col("us") * 1000 + 7)
    us = base.where(F.col("rank") >= 2).withColumn("timestamp", F.col("us"))
    return timeline.scaled(ns, "ns").unionByName(timeline.scaled(us, "us"))


@query("a06_timeline_ingest", """
SELECT epoch_us(ts) AS timestamp, 'host' || CAST(user_id % 5 AS VARCHAR) AS hostname, CAST(user_id % 4 AS INTEGER) AS rank,
       CAST(user_id % 2 AS INTEGER) AS stream, event_type AS op_type,
       event_type || CASE WHEN value > 50 THEN '_begin_kernel' ELSE '_end_kernel' END AS op_name,
       CASE WHEN value > 50 THEN 'begin' ELSE 'end' END AS op_phase FROM events""")
def a06(v):
    return _timeline(v)


@query("a06_timeline_files", """
SELECT epoch_us(ts) AS timestamp, 'host' || CAST(user_id % 5 AS VARCHAR) AS hostname, CAST(user_id % 4 AS INTEGER) AS rank,
       CAST(user_id % 2 AS INTEGER) AS stream, event_type AS op_type,
       event_type || CASE WHEN value > 50 THEN '_begin_kernel' ELSE '_end_kernel' END AS op_name,
       CASE WHEN value > 50 THEN 'begin' ELSE 'end' END AS op_phase FROM events""")
def a06_files(v):
    """Headerless CSV files in a folder for each host, of two clocks, written and read back."""
    folder = work_folder(v.spark, "timeline")
    t = _timeline(v)
    for unit, ranks, factor in (("ns", (0, 1), 1000), ("us", (2, 3), 1)):
        rows = t.where(F.col("rank").isin(*ranks)).select((F.col("timestamp") * factor).alias("timestamp"), "rank", "stream", "op_type", "op_name", "op_phase", "hostname")
        rows.write.partitionBy("hostname").csv(f"{folder}/{unit}")
    host = F.regexp_extract(F.col("_metadata.file_path"), "/hostname=([^/]+)/", 1)
    return timeline.read_timeline(v.spark, f"{folder}/ns/*", "ns", host).unionByName(timeline.read_timeline(v.spark, f"{folder}/us/*", "us", host))


@query("a07_timeline_export", """
SELECT CASE WHEN event_type = 'error' THEN 'ERR' ELSE event_type || '_kernel' END AS name, event_type AS cat,
       CASE WHEN value > 50 THEN 'B' ELSE 'E' END AS ph, epoch_us(ts) AS ts, CAST(user_id % 4 AS INTEGER) AS pid,
       CAST(user_id % 2 AS INTEGER) AS tid, 'host' || CAST(user_id % 5 AS VARCHAR) AS host, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time
FROM events WHERE user_id % 4 IN (1, 3) AND epoch_us(ts) >= 1704499200000000 AND epoch_us(ts) < 1705708800000000""")
def a07(v):
    d = timeline.trace_events(_timeline(v), ranks=(1, 3), start=1704499200000000, end=1705708800000000,
                              names={"error_kernel": "ERR"})
    return d.select("name", "cat", "ph", "ts", "pid", "tid", F.col("args.hostname").alias("host"), F.col("args.time").alias("time"))


@query("a07_timeline_files", """
SELECT 'rank' || CAST(user_id % 4 AS VARCHAR) AS file, CASE WHEN event_type = 'error' THEN 'ERR' ELSE event_type || '_kernel' END AS name, event_type AS cat,
       CASE WHEN value > 50 THEN 'B' ELSE 'E' END AS ph, epoch_us(ts) AS ts, CAST(user_id % 2 AS INTEGER) AS tid, 'host' || CAST(user_id % 5 AS VARCHAR) AS host
FROM events WHERE user_id % 4 IN (1, 3) AND epoch_us(ts) >= 1704499200000000 AND epoch_us(ts) < 1705708800000000""")
def a07_files(v):
    """A gzip file of trace events for each rank, in order of time, committed by its manifest and read back."""
    folder = work_folder(v.spark, "trace-files")
    d = timeline.trace_events(_timeline(v), ranks=(1, 3), start=1704499200000000, end=1705708800000000, names={"error_kernel": "ERR"})
    fields = F.to_json(F.struct(*[F.col(c) for c in d.columns]))
    rows = d.select(F.concat(F.lit("rank"), F.col("pid").cast("string")).alias("file"), "ts", "name", fields.alias("line"))
    filesets.write_files(rows, folder, "file", "line", ["ts", "name", "line"], suffix=".json.gz", gzip=True)
    j = F.from_json("line", "name string, cat string, ph string, ts long, tid int, args struct<hostname:string>")
    return filesets.read_files(v.spark, folder).select(F.col("name").alias("file"), j.alias("j")).select("file", "j.name", "j.cat", "j.ph", "j.ts", "j.tid", F.col("j.args.hostname").alias("host"))


@query("a08_result_files", """
SELECT run AS name, row_number() OVER (PARTITION BY run ORDER BY hookpoint) - 1 AS line_no, hookpoint || ',' || CAST(count(*) AS VARCHAR) AS line FROM v_trace GROUP BY run, hookpoint""")
def a08_files(v):
    """A CSV file with a header for each run, written, committed and read back."""
    folder = work_folder(v.spark, "result-files")
    _result_files(v, folder)
    return filesets.read_files(v.spark, folder, header=True).select("name", "line_no", "line")


def _result_files(v, folder):
    g = v.trace.groupBy("run", "hookpoint").agg(F.count(F.lit(1)).alias("n"))
    return filesets.write_files(g.select("run", "hookpoint", F.to_csv(F.struct("hookpoint", "n")).alias("line")), folder, "run", "line", ["hookpoint"], header="hookpoint,n", suffix=".csv")


@query("a08_check_reports", """
SELECT l_returnflag AS name, count(*) AS n_lines, CAST(min(l_orderkey) AS BIGINT) AS least FROM lineitem WHERE l_quantity >= 50 GROUP BY 1""")
def a08_reports(v):
    """JSON lines of violating rows, a file for each check in several parts, read back through the manifest."""
    folder = work_folder(v.spark, "reports")
    bad = v.lineitem.where("l_quantity >= 50").select("l_returnflag", "l_orderkey", "l_linenumber", F.to_json(F.struct("l_orderkey", "l_linenumber", "l_quantity")).alias("line"))
    filesets.write_files(bad, folder, "l_returnflag", "line", ["l_orderkey", "l_linenumber"], part=F.col("l_orderkey") % 4, suffix=".json")
    key = F.get_json_object("line", "$.l_orderkey").cast("long")
    return filesets.read_files(v.spark, folder).groupBy("name").agg(F.count(F.lit(1)).alias("n_lines"), F.min(key).alias("least"))


@query("a08_result_sink_csv", """
SELECT run || ',' || hookpoint || ',' || CAST(count(*) AS VARCHAR) AS line FROM v_trace GROUP BY run, hookpoint""")
def a08(v):
    g = v.trace.groupBy("run", "hookpoint").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.to_csv(F.struct("run", "hookpoint", "n")).alias("line"))


@query("a09_csv_json_records", """
SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer""")
def a09(v):
    c = v.customer
    lines = c.select(F.to_csv(F.struct("c_custkey", "c_name", "c_acctbal")).alias("line"),
                     F.to_json(F.struct(F.col("c_mktsegment").alias("segment"))).alias("doc"))
    r = lines.select(F.from_csv("line", F.lit("id BIGINT, name STRING, balance DOUBLE")).alias("r"),
                     F.from_json("doc", "segment STRING").alias("j"))
    return r.select("r.id", "r.name", "r.balance", "j.segment")


@query("a09_csv_json_files", """
SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer""")
def a09_files(v):
    """The same records as CSV and as JSON lines on disk, read with declared schemas and joined."""
    folder = work_folder(v.spark, "records")
    v.customer.select("c_custkey", "c_name", "c_acctbal").write.option("header", "true").csv(f"{folder}/csv")
    v.customer.select("c_custkey", F.struct(F.col("c_mktsegment").alias("segment")).alias("info")).write.json(f"{folder}/json")
    a = traces.read_results(v.spark, f"{folder}/csv", "id long, name string, balance double")
    b = traces.read_results(v.spark, f"{folder}/json", "c_custkey long, info struct<segment:string>", "json")
    return a.join(b, a["id"] == b["c_custkey"]).select("id", "name", "balance", F.col("info.segment").alias("segment"))


def _iteration_log(v):
    line = F.concat(F.lit("[rank "), (F.col("user_id") % 4).cast("string"), F.lit("] iteration done | elapsed time per iteration (ms): "),
                    F.col("value").cast("string"), F.lit(" | loss: 1.0"))
    noise = F.concat(F.lit("checkpoint saved by user "), F.col("user_id").cast("string"))
    return v.events.select(F.concat(F.lit("log"), (F.col("user_id") % 4).cast("string")).alias("file"), F.col("event_id").alias("line_no"),
                           F.when(F.col("event_type").isin("error", "signup"), noise).otherwise(line).alias("line"))


@query("a10_iteration_times", """
SELECT 'log' || CAST(user_id % 4 AS VARCHAR) AS file, event_id AS line_no, value AS ms,
       row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS iteration
FROM events WHERE event_type NOT IN ('error', 'signup')""")
def a10(v):
    return textlogs.iteration_times(_iteration_log(v), ["file"], "line_no")


def _verdict_log(v):
    e = v.events
    line = (F.when(F.col("event_type") == "signup", F.concat(F.lit("=== phase: p"), (F.col("event_id") % 97).cast("string"), F.lit(" ===")))
            .when((F.col("event_type") == "error") & (F.col("value") > 30), F.concat(F.lit("verdict: "), F.when(F.col("value") > 60, "FAIL").otherwise("PASS")))
            .when((F.col("event_type") == "view") & (F.col("value") > 80), F.lit("SUMMARY => FAIL"))
            .otherwise(F.lit("step ok")))
    return e.select((F.col("user_id") % 5).alias("log_id"), "event_id", line.alias("line"))


@query("a11_sectioned_verdicts", """
WITH l AS (SELECT user_id % 5 AS log_id, event_id,
    CASE WHEN event_type = 'signup' THEN 'p' || CAST(event_id % 97 AS VARCHAR) END AS banner,
    CASE WHEN event_type = 'error' AND value > 30 THEN CASE WHEN value > 60 THEN 'FAIL' ELSE 'PASS' END END AS verdict,
    CASE WHEN event_type = 'view' AND value > 80 THEN 'FAIL' END AS summary FROM events),
s AS (SELECT *, last_value(banner IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM l),
h AS (SELECT log_id, section, event_id, coalesce(summary, verdict) AS verdict, CASE WHEN summary IS NOT NULL THEN 0 ELSE 1 END AS p
      FROM s WHERE section IS NOT NULL AND (summary IS NOT NULL OR verdict IS NOT NULL)),
r AS (SELECT *, row_number() OVER (PARTITION BY log_id, section ORDER BY p, event_id) AS rn,
      count(*) OVER (PARTITION BY log_id, section) AS n FROM h)
SELECT log_id, section, verdict, n AS n_verdict_lines FROM r WHERE rn = 1""")
def a11(v):
    return textlogs.sectioned_verdicts(_verdict_log(v), ["log_id"], "event_id", "line", r"=== phase: (p\d+) ===",
                                       r"verdict: (\w+)", r"SUMMARY => (\w+)")


@query("a12_embedded_records", """
WITH r AS (SELECT event_type AS name, 'select ' || CAST(user_id % 20 AS VARCHAR) || ' from t' AS q FROM events),
g AS (SELECT name, sha256(q) AS hash, count(*) AS n FROM r GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, hash) AS variant_no FROM g)
SELECT name, hash, n, CAST(variant_no AS INTEGER) AS variant_no FROM t WHERE variant_no <= 3""")
def a12(v):
    sp = F.when(F.col("value") > 50, F.lit("  ")).otherwise(F.lit(" "))
    sql = F.concat(F.lit("SELECT"), sp, (F.col("user_id") % 20).cast("string"), F.lit(" FROM"), sp, F.lit("t"))
    record = F.struct(F.col("event_type").alias("name"), sql.alias("sql"), F.struct(F.lit("} {").alias("note")).alias("extra"))
    text = F.concat(F.lit("reply {: "), F.to_json(record), F.lit(" end {broken"))
    return textlogs.embedded_records(v.events.select(text.alias("text")), "text", "name", "sql", top=3).drop("value")


RECIPES = {"number": r"\d{5,}", "mail": r"[\w.]+@[\w.]+", "benchmark_word": r"\bthe\b"}


@query("a13_pattern_hits_top", """
WITH h AS (SELECT r.recipe, doc_id, line_no, substr(trim(line, ' '), 1, 160) AS snippet FROM v_doc_lines,
    (VALUES ('number', '[0-9]{5,}'), ('mail', '[0-9A-Za-z_.]+@[0-9A-Za-z_.]+'), ('benchmark_word', '(^|[^0-9A-Za-z_])the([^0-9A-Za-z_]|$)')) r(recipe, pat)
    WHERE regexp_matches(line, r.pat, 'i')),
t AS (SELECT *, row_number() OVER (PARTITION BY recipe ORDER BY doc_id, line_no) AS rn FROM h)
SELECT recipe, doc_id, line_no, snippet FROM t WHERE rn <= 50""")
def a13(v):
    return textlogs.pattern_hits(v.doc_lines, RECIPES, "doc_id", max_hits=50, snippet=160)


@query("a13_pattern_hit_counts", """
SELECT recipe, count(*) AS n_hits, count(DISTINCT doc_id) AS n_docs FROM (
 SELECT r.recipe, doc_id FROM v_doc_lines,
    (VALUES ('number', '[0-9]{5,}'), ('mail', '[0-9A-Za-z_.]+@[0-9A-Za-z_.]+'), ('benchmark_word', '(^|[^0-9A-Za-z_])the([^0-9A-Za-z_]|$)')) r(recipe, pat)
    WHERE regexp_matches(line, r.pat, 'i')) GROUP BY recipe""")
def a13_counts(v):
    return textlogs.pattern_hits(v.doc_lines, RECIPES, "doc_id").groupBy("recipe").agg(
        F.count(F.lit(1)).alias("n_hits"), F.count_distinct("doc_id").alias("n_docs"))


@query("a16_trace_summary", """
SELECT hookpoint, count(*) AS n_events, min(step) AS min_step, max(step) AS max_step, count(DISTINCT step) AS n_steps,
       count(DISTINCT rank) AS n_ranks FROM v_trace GROUP BY hookpoint""")
def a16(v):
    return traces.trace_summary(v.trace)


@query("a17_dump_summary", """
SELECT count(*) AS n_rows, count(DISTINCT replica) AS n_steps, count(DISTINCT dtype) AS n_stages, count(DISTINCT name) AS n_params,
       min(replica) AS min_step, max(replica) AS max_step FROM v_state""")
def a17(v):
    return traces.dump_summary(v.state, "replica", "dtype", "name")


@query("a18_json_key_catalog", """
SELECT event_type, k AS json_key, count(*) AS n_rows FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) GROUP BY 1, 2""")
def a18(v):
    return traces.json_key_catalog(v.events, "props", ["event_type"])


@query("a19_metric_alternatives", """
SELECT event_id, CASE WHEN event_type = 'purchase' AND user_id % 7 = 0 THEN 'nan'::DOUBLE ELSE value END AS loss,
       CASE event_type WHEN 'click' THEN value * 2 END AS grad_norm FROM events WHERE event_type IN ('click', 'view', 'purchase')""")
def a19(v):
    val = F.col("value").cast("string")
    line = (F.when(F.col("event_type") == "click", F.concat(F.lit("iter 3 lm loss: "), val, F.lit(" | grad norm: "), (F.col("value") * 2).cast("string")))
            .when(F.col("event_type") == "view", F.concat(F.lit("step=3 loss="), val))
            .when(F.col("event_type") == "purchase", F.concat(F.lit("{'loss': "), F.when(F.col("user_id") % 7 == 0, F.lit("nan")).otherwise(val), F.lit("}")))
            .otherwise(F.lit("saving checkpoint")))
    n = textlogs.NUMBER
    alts = [(rf"lm loss: {n} \| grad norm: {n}", 1, 2), (rf"\bloss={n}", 1, 0), (rf"'loss': {n}", 1, 0)]
    return textlogs.metric_alternatives(v.events.select("event_id", line.alias("line")), "line", alts).select("event_id", "loss", "grad_norm")


@query("a20_markdown_cells", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'detected' WHEN 'O' THEN 'missed' ELSE 'n/a' END AS verdict,
       CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey % 9 AS VARCHAR) || '/316' END AS detail FROM orders""")
def a20(v):
    mark = F.when(F.col("o_orderstatus") == "F", "✓").when(F.col("o_orderstatus") == "O", "✗").otherwise("–")
    cell = F.concat(mark, F.when(F.col("o_orderstatus") != "P", F.concat(F.lit(" ("), (F.col("o_custkey") % 9).cast("string"), F.lit("/316)"))).otherwise(F.lit("")))
    row = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), cell, F.lit(" |"))
    t = textlogs.markdown_table(v.orders.select(row.alias("line")))
    r = t.select(F.element_at("cells", 1).cast("long").alias("o_orderkey"), F.element_at("cells", 2).alias("cell"))
    return textlogs.verdict_cells(r, "cell", {"✓": "detected", "✗": "missed", "–": "n/a"}).select("o_orderkey", "verdict", "detail")


@query("a21_content_manifest", """
SELECT url AS path, octet_length(encode(html)) AS size, sha256(html) AS sha256 FROM pages""")
def a21(v):
    return manifest.content_manifest(v.pages, F.col("url"), F.col("html"))


@query("a21_verify_manifest", """
WITH a AS (SELECT url AS path, octet_length(encode(html)) AS size, sha256(html) AS h, page_id FROM pages),
e AS (SELECT path, CASE WHEN page_id % 7 = 1 THEN size + 1 ELSE size END AS size, CASE WHEN page_id % 11 = 2 THEN 'x' ELSE h END AS h
      FROM a WHERE path NOT LIKE '%/fr/%')
SELECT a.path, CASE WHEN e.h IS NULL THEN 'unexpected' WHEN a.size <> e.size THEN 'size differs' WHEN a.h <> e.h THEN 'hash differs' ELSE 'ok' END AS status
FROM a LEFT JOIN e ON a.path = e.path""")
def a21_verify(v):
    actual = manifest.content_manifest(v.pages, F.col("url"), F.col("html"))
    # one line for each page, also where several pages have one url
    e = manifest.content_manifest(v.pages.where(~F.col("url").contains("/fr/")), F.col("url"), F.col("html"), "page_id")
    expected = e.select("path", F.when(F.col("page_id") % 7 == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
                        F.when(F.col("page_id") % 11 == 2, F.lit("x")).otherwise(F.col("sha256")).alias("sha256"))
    return manifest.verify_manifest(actual, expected)


@query("a21_file_manifest", """
WITH g AS (SELECT run, hookpoint, hookpoint || ',' || CAST(count(*) AS VARCHAR) AS line FROM v_trace GROUP BY run, hookpoint),
f AS (SELECT 'hookpoint,n' || chr(10) || string_agg(line, chr(10) ORDER BY hookpoint) || chr(10) AS content FROM g GROUP BY run)
SELECT TRUE AS below_data, octet_length(encode(content)) AS size, sha256(content) AS sha256 FROM f""")
def a21_files(v):
    """Files on disk, listed with paths below the root and digested by streaming."""
    folder = work_folder(v.spark, "result-files")
    _result_files(v, folder)
    return filesets.digests(v.spark, folder, "*.csv").select(F.col("path").startswith("data/").alias("below_data"), "size", "sha256")
