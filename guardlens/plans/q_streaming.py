"""Online checking (K, and the streaming source and sink of A).

Each query stages the whole table as three consecutive parts in the shared work folder and
drains them through a real streaming query, one part per micro-batch.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlens import schema as sc
from guardlens.operators import rules as R
from guardlens.plans.q_rules import clip, counter
from guardlens.plans.registry import query
from guardlens.plans.views import micros
from guardlens.session import ROWS_A_TASK, work_folder
from guardlens.sources.traces import stream_trace
from guardlens.streaming import incremental as I
from guardlens.streaming import keyed as Y
from guardlens.streaming import online as K

TRACE = T.StructType([*sc.ENVELOPE.fields, T.StructField("run", sc.S)])


FILES = 4  # of a part, at least; a micro-batch takes as many as a part has


def files(trace):
    """Files of each part: as many as the rows need, so that the tasks of a batch grow in number and not in size."""
    return max(FILES, -(-trace.count() // ROWS_A_TASK))


def staged(v, trace, part, name):
    """Write the parts one after the other, so that file order is batch order; (folder, files of a part)."""
    folder, n = work_folder(v.spark, name), files(trace)
    for i in range(3):
        trace.where(part == i).repartition(n).write.mode("append").parquet(f"{folder}/in")
    return folder, n


def third(v, column="event_id"):
    """Part number 0..2 by position of the id in its range."""
    top = v.events.agg(F.max(column).alias("m")).scalar() + 1
    return F.floor(F.col(column) * 3 / top).cast("int")


def drained(v, trace, part, name, make):
    folder, n = staged(v, trace, part, name)
    handler = make(f"{folder}/state")
    stream = stream_trace(v.spark, f"{folder}/in", trace.schema, max_files=n)
    K.run_batches(stream, handler, f"{folder}/checkpoint")
    return handler, folder


def to_table(v, stream_of, trace, part, name):
    folder, n = staged(v, trace, part, name)
    out = stream_of(stream_trace(v.spark, f"{folder}/in", trace.schema, max_files=n))
    K.run_to_table(out, f"{folder}/out", f"{folder}/checkpoint")
    return v.spark.read.schema(out.schema).parquet(f"{folder}/out")


THIRD = "CAST(floor(event_id * 3 / ((SELECT max(event_id) FROM events) + 1)) AS BIGINT)"
RUNNER_CHECKS = ("T0-clip-grad-bounded", "T0-grad-norm-finite", "T0-norm-output-unit-rms")


def runner(v, trace, part, ids, name):
    checks = [R.RULES_BY_ID[i] for i in ids]
    return drained(v, trace, part, name, lambda root: K.OnlineRunner(v.spark, root, checks))[0]


@query("a14_stream_source", "SELECT event_id, 'utils.clip_grad.post' AS hookpoint FROM events")
def a14(v):
    return to_table(v, lambda s: s.select("event_id", "hookpoint"), clip(v), third(v), "a14")


@query("a15_stream_sink", "SELECT event_id, 'T0-clip-grad-bounded' AS check_id FROM events WHERE value > 40.4")
def a15(v):
    r = runner(v, clip(v), third(v), RUNNER_CHECKS, "a15")
    schema = T.StructType([f for k in K.OnlineRunner.KEYS for f in sc.VIOLATION.fields if f.name == k])
    return r.state.all("new", schema).select("event_id", "check_id")


@query("k01_incremental_ticks", f"SELECT {THIRD} AS tick, count(*) AS n_new_events, max(event_id) AS last_event_id FROM events GROUP BY 1")
def k01(v):
    return metrics(runner(v, clip(v), third(v), RUNNER_CHECKS, "k01")).select("tick", "n_new_events", "last_event_id")


def metrics(r):
    return r.state.all("metrics", "tick long, n_new_events long, n_rules_evaluated int, n_new_violations long, last_event_id long")


@query("k02_hookpoint_skip", f"""
SELECT {THIRD} AS tick, count(DISTINCT CASE WHEN {THIRD} = 1 AND event_type = 'view' THEN 'b' ELSE 'a' END)::INTEGER AS n_rules_evaluated FROM events GROUP BY 1""")
def k02(v):
    hook = F.when((third(v) == 1) & (F.col("event_type") == "view"), "optim.step.pre").otherwise("utils.clip_grad.post")
    t = v.events_as(hook, "events", "event_id", post_norm=F.col("value"), max_norm=F.lit(40.0), total_grad_l2=F.col("value"))
    return metrics(runner(v, t, third(v), RUNNER_CHECKS, "k02")).select("tick", "n_rules_evaluated")


@query("k03_exactly_once_violations", """
SELECT 'T0-clip-grad-bounded' AS check_id, 'run' || CAST(event_id % 3 AS VARCHAR) AS run, event_id, round(value, 6) AS observed FROM events WHERE value > 40.4""")
def k03(v):
    doubled = clip(v).unionByName(clip(v))  # every event is delivered twice
    found = to_table(v, lambda s: K.stream_violations(s, [R.RULES_BY_ID["T0-clip-grad-bounded"]]), doubled, third(v), "k03")
    return found.select("check_id", "run", "event_id", F.round("observed", 6).alias("observed"))


@query("k04_retired_violations", """
SELECT 'T0-evaluator-eval-mode' AS check_id, 'run0' AS run, event_id FROM events WHERE event_id % 3 = 0 AND value < 20 AND event_type = 'view'""")
def k04(v):
    """Violations found first are withdrawn for the run whose checkpoint calls arrive later."""
    fwd = v.events_as("module.fwd.pre", "events", "event_id", grad_enabled=F.col("value") >= 20, training=F.col("event_type") == "view")
    ck = v.events_as("checkpoint.call", "pages", F.col("page_id") + 1000000000, key=F.lit(0), function=F.col("url"))
    t = fwd.unionByName(ck.select(*fwd.columns))
    r = runner(v, t, F.when(F.col("hookpoint") == "checkpoint.call", 1).otherwise(0), ("T0-evaluator-eval-mode",), "k04")
    schema = T.StructType([f for k in K.OnlineRunner.KEYS for f in sc.VIOLATION.fields if f.name == k])
    return r.state.all("retired", schema).select("check_id", "run", "event_id")


@query("k05_tick_metrics", f"""
SELECT {THIRD} AS tick, count(*) AS n_new_events, 1 AS n_rules_evaluated, count(*) FILTER (WHERE value > 40.4) AS n_new_violations FROM events GROUP BY 1""")
def k05(v):
    return metrics(runner(v, clip(v), third(v), RUNNER_CHECKS, "k05")).select("tick", "n_new_events", "n_rules_evaluated", "n_new_violations")


MONO = """SELECT event_id, s AS value, p AS prev FROM (SELECT event_id, s, lag(s) OVER (PARTITION BY event_id % 3, event_id % 4 ORDER BY event_id) AS p
  FROM (SELECT event_id, CAST(trunc(value) AS BIGINT) AS s FROM events)) WHERE s <= p"""


@query("k06_stateful_monotonic", MONO)
def k06(v):
    from guardlens.functions import exprs as X
    t = counter(v).select("run", "rank", "event_id", X.json_number("payload", "state_step_max", "long").alias("value"))
    h, _ = drained(v, t, third(v), "k06", lambda root: K.OnlineMonotonic(v.spark, root, ["run", "rank"], "event_id", "value", span=1000))
    return h.state.all("violations", "run string, rank int, event_id long, value long, prev long").select("event_id", "value", "prev")


def timed(v):
    e = v.events
    return e.select("event_id", F.timestamp_micros(micros(F.col("ts"))).alias("ts"), (F.col("user_id") % 4).alias("rank"), "user_id", "event_type", "value")


@query("k07_stream_replica_equality", """
WITH w AS (SELECT date_trunc('day', ts) AS w, user_id % 4 AS rank, event_type FROM events), g AS (SELECT w, rank, count(*) AS n_rows, min(event_type) AS a, max(event_type) AS b FROM w GROUP BY 1, 2)
SELECT epoch_us(w) AS window_us, rank, n_rows, a AS min_value, b AS max_value FROM g WHERE a <> b AND w + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def k07(v):
    out = to_table(v, lambda s: K.stream_replica_equality(s, ["rank"], "event_type", width="1 day"), timed(v), third(v), "k07")
    return out.select(F.unix_micros("window_start").alias("window_us"), "rank", "n_rows", "min_value", "max_value")


@query("k08_stream_step_counts", """
WITH g AS (SELECT date_trunc('day', ts) AS w, user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT epoch_us(w) AS window_us, user_id, n FROM g WHERE n > 1 AND w + INTERVAL 1 DAY <= (SELECT max(ts) FROM events WHERE event_type = 'view') - INTERVAL 10 MINUTE""")
def k08(v):
    out = to_table(v, lambda s: K.stream_step_counts(s, ["user_id"], F.col("event_type") == "view", width="1 day"), timed(v), third(v), "k08")
    return out.select(F.unix_micros("window_start").alias("window_us"), "user_id", "n")


ANOMALY = """
w AS (SELECT event_id, user_id % 4 AS k, CASE WHEN value > 220 AND event_type = 'error' THEN 'inf'::DOUBLE ELSE value END AS loss, value * 2 AS g FROM events),
b AS (SELECT *, count(*) OVER x AS n, median(loss) OVER x AS med, max(g) OVER x AS mx FROM w WINDOW x AS (PARTITION BY k ORDER BY event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
s AS (SELECT k, event_id, CASE WHEN isinf(loss) THEN 'loss_nan' WHEN n = 20 AND med > 0 AND loss > med * 4 THEN 'loss_spike' WHEN n = 20 AND mx > 0 AND g > mx * 4 THEN 'gradnorm_spike' END AS signal FROM b)"""


def metrics_of(v):
    loss = F.when((F.col("value") > 220) & (F.col("event_type") == "error"), F.lit(float("inf"))).otherwise(F.col("value"))
    return v.events.select("event_id", (F.col("user_id") % 4).alias("k"), loss.alias("loss"), (F.col("value") * 2).alias("g"))


@query("k09_trailing_anomalies", f"WITH {ANOMALY} SELECT k, event_id, signal FROM s WHERE signal IS NOT NULL")
def k09(v):
    return K.trailing_anomalies(metrics_of(v), ["k"], "event_id", "loss", "g", 20, 4.0, span=1000).select("k", "event_id", "signal")


@query("k09_first_signal", f"""
WITH {ANOMALY}, r AS (SELECT k, signal, event_id, row_number() OVER (PARTITION BY k ORDER BY CASE signal WHEN 'loss_nan' THEN 0 WHEN 'loss_spike' THEN 2 ELSE 3 END, event_id) AS rn FROM s WHERE signal IS NOT NULL)
SELECT k, signal AS trigger_signal, event_id AS trigger_at FROM r WHERE rn = 1""")
def k09_first(v):
    return K.first_signal(K.trailing_anomalies(metrics_of(v), ["k"], "event_id", "loss", "g", 20, 4.0, span=1000), ["k"], "event_id")


@query("k09_online_trailing", f"WITH {ANOMALY} SELECT k, event_id, signal FROM s WHERE signal IS NOT NULL")
def k09_online(v):
    h, _ = drained(v, metrics_of(v), third(v), "k09", lambda root: K.OnlineTrailing(v.spark, root, ["k"], "event_id", "loss", "g", 20, 4.0))
    return h.state.all("anomalies", "k long, event_id long, loss double, g double, signal string").select("k", "event_id", "signal")


@query("k10_sample_every", """
SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) WHERE (n - 1) % 4 = 0""")
def k10(v):
    return K.sample_every(v.events, ["event_type"], "event_id", 0.25, span=1000).select("event_id", "event_type")


@query("k10_sample_by_hash", """
SELECT user_id, count(*) AS n FROM events WHERE ('0x' || substr(md5('0:' || CAST(event_id AS VARCHAR)), 1, 8))::BIGINT < 0.1 * 4294967296 GROUP BY 1""")
def k10_hash(v):
    return K.sample_by_hash(v.events, "event_id", 0.1).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("k11_replay_first_tick", "SELECT event_type AS check_id, CAST(min(ceil(event_id / 100.0)) AS BIGINT) AS first_tick FROM events WHERE value > 100 GROUP BY 1")
def k11(v):
    bad = v.events.where(F.col("value") > 100).select(F.col("event_type").alias("check_id"), "event_id")
    return K.replay_first_tick(bad, 100)


@query("k11_violations_per_tick", "SELECT event_type AS check_id, CAST(ceil(event_id / 100.0) AS BIGINT) AS tick, count(DISTINCT event_id) AS n_new FROM events WHERE value > 100 GROUP BY 1, 2")
def k11_ticks(v):
    bad = v.events.where(F.col("value") > 100).select(F.col("event_type").alias("check_id"), "event_id")
    return K.violations_per_tick(bad, 100)




# -- keyed state and event time ---------------------------------------------------------------

def ticking(v):
    """Events with a clock of one second an id, so that event time follows arrival."""
    return v.events.select("event_id", F.timestamp_seconds(F.col("event_id") + 1_700_000_000).alias("ts"), "user_id", "event_type", "value")


def voted(v, keys, value, trace, name, **kw):
    return drained(v, trace, third(v), name, lambda root: Y.Votes(K.BatchState(v.spark, root), keys, value, **kw))[0].finished()


@query("k07_votes_by_entity_and_step", """
SELECT event_id // 4 AS entity, CAST(event_id // 200 AS INTEGER) AS step, count(*) AS n_rows, min(event_type) AS min_value, max(event_type) AS max_value,
  CASE WHEN count(*) = 4 THEN 'degree' ELSE 'end' END AS closed_by FROM events GROUP BY 1, 2 HAVING min(event_type) <> max(event_type)""")
def k07_votes(v):
    """Four replicas an entity: a group closes with its fourth row; one that lacks replicas is reported when the stream ends."""
    t = ticking(v).withColumn("entity", F.expr("event_id div 4")).withColumn("step", F.expr("event_id div 200").cast("int"))
    out = voted(v, ["entity", "step"], "event_type", t, "k07", degree=4, wait="60 days")
    return out.where("min_value <> max_value")


@query("k08_counts_closed_by_timer", """
WITH g AS (SELECT CAST(event_id // 50 AS INTEGER) AS step, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2)
SELECT step, event_type, n FROM g WHERE n > 12""")
def k08_timer(v):
    """Events per step and kind: closed by a timer a minute after the first of them; the last steps when the stream ends."""
    t = ticking(v).withColumn("step", F.expr("event_id div 50").cast("int"))
    out = voted(v, ["step", "event_type"], "event_type", t, "k08", wait="60 seconds", lateness="0 seconds")
    return out.where("n_rows > 12").select("step", "event_type", F.col("n_rows").alias("n"))


@query("k12_save_load_join", """
SELECT a.event_id AS save_id, b.event_id AS load_id, a.user_id, round(b.value - a.value, 9) AS drift FROM events a JOIN events b
  ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'view' AND b.event_id BETWEEN a.event_id AND a.event_id + 600""")
def k12_join(v):
    """Loads within ten minutes after a save of the same key, as a join of two streams."""
    def both(s):
        a, b = s.where("event_type = 'purchase'"), s.where("event_type = 'view'")
        return Y.pairs(a, b, ["user_id"], "ts", "ts", "600 SECONDS")
    out = to_table(v, both, ticking(v), third(v), "k12")
    return out.select(F.col("l_event_id").alias("save_id"), F.col("r_event_id").alias("load_id"), F.col("l_user_id").alias("user_id"),
                      F.round(F.col("r_value") - F.col("l_value"), 9).alias("drift"))


@query("k12_sessions", """
WITH t AS (SELECT user_id % 20 AS k, event_id AS s FROM events), m AS (SELECT *, s - lag(s) OVER (PARTITION BY k ORDER BY s) > 30 AS starts FROM t),
g AS (SELECT k, s, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s) AS no FROM m)
SELECT CAST(k AS BIGINT) AS k, min(s) AS started, max(s) + 30 AS ended, count(*) AS n_rows FROM g GROUP BY k, no HAVING max(s) + 30 <= (SELECT max(event_id) FROM events) - 60""")
def k12_sessions(v):
    """Sessions that had ended, by the watermark, when the stream did."""
    t = ticking(v).withColumn("k", F.col("user_id") % 20)
    out = to_table(v, lambda s: Y.sessions(s, ["k"], "ts", "30 seconds", "60 seconds"), t, third(v), "k12s")
    second = lambda c: (F.unix_seconds(c) - 1_700_000_000).alias(c)
    return out.select(F.col("k").cast("long"), second("started"), second("ended"), "n_rows")


@query("k12_late_rows", f"""
WITH p AS (SELECT event_id, ts, {THIRD} AS part FROM events), m AS (SELECT part, max(ts) AS top FROM p GROUP BY 1)
SELECT event_id, coalesce(ts < (SELECT max(top) FROM m WHERE m.part < p.part) - INTERVAL 10 DAY, FALSE) AS is_late FROM p""")
def k12_late(v):
    """Rows that come more than ten days behind the largest time of the batches before go to a table of their own."""
    h, _ = drained(v, timed(v).select("event_id", "ts"), third(v), "k12l", lambda root: Y.LateRows(K.BatchState(v.spark, root), "ts", "10 days"))
    return h.state.spark.read.schema("event_id long, ts timestamp, is_late boolean").parquet(f"{h.state.root}/rows").select("event_id", "is_late")


# -- incremental rules ----------------------------------------------------------------------------

INCREMENTAL = ("T0-clip-grad-bounded", "T0-evaluator-eval-mode", "T0-optim-step-counter-monotonic", "T1-comm-dtype-matches-training", "T1-router-has-calculate-per-token-loss")


def shifting(v):
    """Events of five rules, and configuration that arrives late: dtypes with the second part, checkpoint calls and a switch with the third."""
    x, k = F.col("value"), F.col("event_id") % 5
    at = lambda i, c: F.when(k == i, c)
    hooks = F.array(*map(F.lit, ["utils.clip_grad.post", "module.fwd.pre", "optim.step.post", "comm.post", "module.fwd.post"]))
    t = v.events_as(F.element_at(hooks, (k + 1).cast("int")), "events", "event_id", post_norm=at(0, x), max_norm=at(0, F.lit(40.0)),
                    grad_enabled=at(1, x >= 20), training=at(1, F.lit(True)), state_step_max=at(2, x.cast("long")), op=at(3, F.lit("all_reduce")),
                    tensor_post=at(3, F.struct(F.when(x > 100, "float32").otherwise("bfloat16").alias("dtype"))), module_class=at(4, F.lit("Router")),
                    semantic=at(4, F.struct(F.lit(True).alias("is_router"), (x > 60).alias("has_calculate_per_token_loss")))).withColumn("part", third(v))
    few = v.events.where("event_id < 3")
    eid = lambda base: F.col("event_id") + base
    declared = v.events_as("build.snapshot", few, eid(1_000_000_000), key=F.col("event_id"),
                           framework_invariants=F.create_map(F.lit("megatron"), F.create_map(F.lit("training_dtype"), F.when(F.col("event_id") == 0, "float32").otherwise("bfloat16"),
                                                                                              F.lit("calculate_per_token_loss"), F.when(F.col("event_id") < 2, "true").otherwise("false")))).withColumn("part", F.lit(1))
    switched = v.events_as("build.snapshot", few.where("event_id = 1"), eid(2_000_000_000), key=F.col("event_id"),
                           framework_invariants=F.create_map(F.lit("megatron"), F.create_map(F.lit("calculate_per_token_loss"), F.lit("false")))).withColumn("part", F.lit(2))
    calls = v.events_as("checkpoint.call", few.where("event_id = 2"), eid(3_000_000_000), key=F.col("event_id"), function=F.lit("f")).withColumn("part", F.lit(2))
    out = t
    for d in (declared, switched, calls):
        out = out.unionByName(d.select(*t.columns))
    return out


def incremental(v, name):
    """Each part is delivered twice, the second time together with the next one."""
    t = shifting(v)
    again = t.where("part < 2").withColumn("part", F.col("part") + 1)
    both = t.unionByName(again)
    folder, n = work_folder(v.spark, name), files(t)
    for i in range(3):
        both.where(F.col("part") == i).drop("part").repartition(n).write.mode("append").parquet(f"{folder}/in")
    runner = I.IncrementalRunner(v.spark, f"{folder}/state", [R.RULES_BY_ID[i] for i in INCREMENTAL], span=1000)
    schema = both.drop("part").schema
    K.run_batches(stream_trace(v.spark, f"{folder}/in", schema, max_files=n), runner, f"{folder}/checkpoint")
    return runner


SHIFT_SQL = f"""
e AS (SELECT event_id, event_id % 3 AS r, event_id % 4 AS rank, event_id % 5 AS k, value AS x, {THIRD} AS part FROM events),
m AS (SELECT *, lag(CAST(trunc(x) AS BIGINT)) OVER (PARTITION BY r, rank ORDER BY event_id) AS p FROM e WHERE k = 2)"""


@query("k03_incremental_standing", f"""
WITH {SHIFT_SQL} SELECT 'T0-clip-grad-bounded' AS check_id, event_id FROM e WHERE k = 0 AND x > 40.4
UNION ALL SELECT 'T0-evaluator-eval-mode', event_id FROM e WHERE k = 1 AND x < 20 AND r <> 2
UNION ALL SELECT 'T0-optim-step-counter-monotonic', event_id FROM m WHERE CAST(trunc(x) AS BIGINT) <= p
UNION ALL SELECT 'T1-comm-dtype-matches-training', event_id FROM e WHERE k = 3 AND (x > 100) <> (r = 0)
UNION ALL SELECT 'T1-router-has-calculate-per-token-loss', event_id FROM e WHERE k = 4 AND NOT x > 60 AND r = 0""")
def k03_standing(v):
    """What holds after the last batch, as if all events had been there from the start."""
    return incremental(v, "k03i").standing().select("check_id", "event_id")


@query("k04_incremental_changes", f"""
WITH {SHIFT_SQL}, c AS (
  SELECT part AS batch, 'T0-clip-grad-bounded' AS check_id, 'new' AS change FROM e WHERE k = 0 AND x > 40.4
  UNION ALL SELECT part, 'T0-evaluator-eval-mode', 'new' FROM e WHERE k = 1 AND x < 20 AND (r <> 2 OR part < 2) UNION ALL SELECT 2, 'T0-evaluator-eval-mode', 'retired' FROM e WHERE k = 1 AND x < 20 AND r = 2 AND part < 2
  UNION ALL SELECT part, 'T0-optim-step-counter-monotonic', 'new' FROM m WHERE CAST(trunc(x) AS BIGINT) <= p
  UNION ALL SELECT greatest(part, 1), 'T1-comm-dtype-matches-training', 'new' FROM e WHERE k = 3 AND (x > 100) <> (r = 0)
  UNION ALL SELECT greatest(part, 1), 'T1-router-has-calculate-per-token-loss', 'new' FROM e WHERE k = 4 AND NOT x > 60 AND (r = 0 OR r = 1 AND part < 2)
  UNION ALL SELECT 2, 'T1-router-has-calculate-per-token-loss', 'retired' FROM e WHERE k = 4 AND NOT x > 60 AND r = 1 AND part < 2)
SELECT CAST(batch AS BIGINT) AS batch, check_id, change, count(*) AS n FROM c GROUP BY ALL""")
def k04_changes(v):
    """Assertions and retractions by batch: late configuration asserts earlier candidates, a late veto retracts them."""
    return incremental(v, "k04i").changes().groupBy("batch", "check_id", "change").agg(F.count(F.lit(1)).alias("n"))
