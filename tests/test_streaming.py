"""Streaming parity with the batch forms."""

import json

import pytest
from pyspark.sql import functions as F

from guardlens import schema as sc
from guardlens.operators import rules as R
from guardlens.operators import spec as S
from guardlens.session import work_folder
from guardlens.sources.traces import stream_trace
from guardlens.streaming import online as K


def make(spark, folder, batches):
    """One file per micro-batch."""
    n = 0
    schema = sc.T.StructType([*sc.ENVELOPE.fields, sc.T.StructField("run", sc.S)])
    for evs in batches:
        out = []
        for hook, payload in evs:
            n += 1
            out.append((n, n, 0, hook, 1_700_000_000_000_000_000 + n * 1000, 1, json.dumps(payload), "r"))
        spark.createDataFrame(out, schema).coalesce(1).write.mode("append").parquet(folder + "/in")
    return schema


@pytest.fixture
def drive(spark):
    def go(batches, handler_of):
        folder = work_folder(spark, "t")
        schema = make(spark, folder, batches)
        h = handler_of(folder + "/state")
        K.run_batches(stream_trace(spark, folder + "/in", schema, 1), h, folder + "/cp")
        return h
    return go


STEPS = [("optim.step.post", {"state_step_max": v}) for v in (1, 2, 3, 3, 4, 2)]


def test_runner_six_steps(spark, drive):
    checks = [R.RULES_BY_ID["T0-optim-step-counter-monotonic"], R.RULES_BY_ID["T0-clip-grad-bounded"]]
    h = drive([[s] for s in STEPS], lambda root: K.OnlineRunner(spark, root, checks))
    m = h.state.all("metrics", "tick long, n_new_events long, n_rules_evaluated int, n_new_violations long, last_event_id long")
    per = {r.tick: (r.n_new_events, r.n_rules_evaluated, r.n_new_violations) for r in m.collect()}
    assert per == {0: (1, 1, 0), 1: (1, 1, 0), 2: (1, 1, 0), 3: (1, 1, 1), 4: (1, 1, 0), 5: (1, 1, 1)}


def test_online_monotonic_equals_batch(spark, drive):
    pre = [[s for s in STEPS[:2]], STEPS[2:5], STEPS[5:]]

    def handler(root):
        inner = K.OnlineMonotonic(spark, root, ["run", "rank"], "event_id", "v", span=2)

        def call(batch, i):
            inner(batch.select("run", "rank", "event_id", F.get_json_object("payload", "$.state_step_max").cast("long").alias("v")), i)
        call.state = inner.state
        return call
    h = drive(pre, handler)
    got = sorted(r.event_id for r in h.state.all("violations", "run string, rank int, event_id long, v long, prev long").collect())
    assert got == [4, 6]


def test_replayed_batch_is_not_duplicated(spark, drive):
    """A batch that is delivered again after a failure overwrites its own output."""
    checks = [R.RULES_BY_ID["T0-clip-grad-bounded"]]
    bad = ("utils.clip_grad.post", {"max_norm": 1.0, "post_norm": 5.0})

    def handler(root):
        inner = K.OnlineRunner(spark, root, checks)

        def twice(batch, i):
            inner(batch, i)
            inner(batch, i)
        twice.state = inner.state
        return twice
    h = drive([[bad], [bad, bad]], handler)
    schema = sc.T.StructType([f for k in K.OnlineRunner.KEYS for f in sc.VIOLATION.fields if f.name == k])
    assert h.state.all("new", schema).count() == 3


def test_retired_violation(spark, drive):
    checks = [R.RULES_BY_ID["T0-evaluator-eval-mode"]]
    bad = ("module.fwd.pre", {"grad_enabled": False, "training": True})
    h = drive([[bad, bad], [("checkpoint.call", {})]], lambda root: K.OnlineRunner(spark, root, checks))
    schema = sc.T.StructType([f for k in K.OnlineRunner.KEYS for f in sc.VIOLATION.fields if f.name == k])
    assert h.state.all("retired", schema).count() == 2
    assert h.state.all("new", schema).count() == 2


def test_stream_rows_equal_batch(spark):
    folder = work_folder(spark, "t")
    evs = [("utils.clip_grad.post", {"max_norm": 1.0, "post_norm": float(i)}) for i in range(6)]
    schema = make(spark, folder, [evs[:3], evs[3:]])
    checks = [R.RULES_BY_ID["T0-clip-grad-bounded"]]
    out = K.stream_violations(stream_trace(spark, folder + "/in", schema, 1), checks)
    K.run_to_table(out, folder + "/out", folder + "/cp")
    got = {r.event_id for r in spark.read.schema(out.schema).parquet(folder + "/out").collect()}
    want = {r.event_id for r in S.violations(spark.read.schema(schema).parquet(folder + "/in"), checks).collect()}
    assert got == want == {3, 4, 5, 6}


def test_trailing_spike_and_nan_order(spark):
    rows = [("k", i, 1.0, 1.0) for i in range(25)] + [("k", 25, 50.0, 1.0), ("k", 26, 1.0, 500.0), ("k", 27, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "k string, i long, loss double, g double")
    f = K.trailing_anomalies(df, ["k"], "i", "loss", "g", 20, 10.0, span=4)
    assert {r.i: r.signal for r in f.collect()} == {25: "loss_spike", 26: "gradnorm_spike", 27: "loss_nan"}
    first = K.first_signal(f, ["k"], "i").collect()[0]
    assert (first.trigger_signal, first.trigger_at) == ("loss_nan", 27)


def test_sampling(spark):
    df = spark.range(1, 11).select(F.lit("h").alias("hook"), F.col("id").alias("event_id"))
    ids = lambda rate: sorted(r.event_id for r in K.sample_every(df, ["hook"], "event_id", rate).collect())
    assert ids(0.5) == [1, 3, 5, 7, 9] and ids(0.1) == [1] and ids(1.5) == list(range(1, 11)) and ids(0) == []
    assert K.sample_by_hash(df, "event_id", 1.0).count() == 10 and K.sample_by_hash(df, "event_id", 0.0).count() == 0
