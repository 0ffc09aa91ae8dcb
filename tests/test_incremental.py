"""Incremental rules, keyed state, trees, fills: against batch forms and brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from guardlens import schema as sc
from guardlens.operators import evalkit as M
from guardlens.operators import mining as J
from guardlens.operators import rules as R
from guardlens.operators import spec as S
from guardlens.operators import trees as T
from guardlens.session import work_folder
from guardlens.streaming import incremental as I
from guardlens.streaming import online as K

IDS = ("T0-clip-grad-bounded", "T0-evaluator-eval-mode", "T0-checkpoint-preserve-rng", "T0-optim-step-counter-monotonic", "T1-comm-dtype-matches-training",
       "T1-router-has-calculate-per-token-loss")
SCHEMA = sc.T.StructType([*sc.ENVELOPE.fields, sc.T.StructField("run", sc.S)])


def random_events(seed, n):
    r, out, steps = random.Random(seed), [], {}
    for i in range(n):
        run, rank = f"r{r.randint(0, 3)}", r.randint(0, 1)
        kind = r.randint(0, 40)
        if kind < 8:
            e = ("utils.clip_grad.post", {"max_norm": 1.0, "post_norm": r.choice([0.5, 2.0])})
        elif kind < 16:
            e = ("module.fwd.pre", {"grad_enabled": r.random() < .5, "training": r.random() < .7, "module_name": "m"})
        elif kind < 24:
            steps[run, rank] = steps.get((run, rank), 0) + r.choice([1, 1, 1, 0])
            e = ("optim.step.post", {"state_step_max": steps[run, rank]})
        elif kind < 30:
            e = ("comm.post", {"op": r.choice(["all_reduce", "broadcast"]), "tensor_post": {"dtype": r.choice(["float32", "torch.bfloat16"]), "shape": [1]}})
        elif kind < 36:
            e = ("module.fwd.post", {"module_class": r.choice(["Router", "Dropout", "Linear"]), "semantic": {"is_router": r.random() < .6, "has_calculate_per_token_loss": r.random() < .4}})
        elif kind < 38:
            e = ("checkpoint.call", {"preserve_rng_state": r.random() < .5, "function": "f"}) if run != "r0" else ("build.snapshot", {})
        else:
            e = ("build.snapshot", {"framework_invariants": {"megatron": r.choice([{}, {"training_dtype": "bfloat16"}, {"calculate_per_token_loss": "true" if run in ("r1", "r2") else r.choice(["true", "false"])}])}})
        out.append((i + 1, i, rank, e[0], (i + 1) * 1000, 1, json.dumps(e[1]), run))
    return out


def test_incremental_rules_equal_the_batch_form(spark):
    events = random_events(3, 600)
    folder = work_folder(spark, "inc")
    runner = I.IncrementalRunner(spark, folder, [R.RULES_BY_ID[i] for i in IDS], span=50)
    cut = [0, 150, 151, 400, 600]
    for i in range(len(cut) - 1):
        batch = spark.createDataFrame(events[cut[i]:cut[i + 1]] * (2 if i == 1 else 1), SCHEMA)
        runner(batch, i)
        if i == 2:
            runner(batch, i)  # the same batch again, as after a failure
    runner(spark.createDataFrame(events[100:500], SCHEMA), len(cut) - 1)  # old events once more
    got = sorted((r.check_id, r.run, r.event_id) for r in runner.standing().collect())
    want = S.violations(spark.createDataFrame(events, SCHEMA), [R.RULES_BY_ID[i] for i in IDS])
    assert got == sorted((r.check_id, r.run, r.event_id) for r in want.collect()) and len({g[0] for g in got}) == len(IDS)
    assert runner.changes().where(F.col("batch") == len(cut) - 1).count() == 0
    per_event = runner.changes().groupBy(*I.KEYS).agg(F.sum(F.when(F.col("change") == "new", 1).otherwise(-1)).alias("n"))
    assert per_event.where("n NOT IN (0, 1)").isEmpty()


def test_incremental_state_does_not_grow_with_the_history(spark):
    """Twenty ticks of the same shape: what a tick writes beside new violations stays the same."""
    folder = work_folder(spark, "inc")
    runner = I.IncrementalRunner(spark, folder, [R.RULES_BY_ID[i] for i in ("T0-optim-step-counter-monotonic", "T1-comm-dtype-matches-training")])
    for i in range(20):
        rows = [(10 * i + j, 0, j % 2, "optim.step.post", 1000 * (10 * i + j), 1, json.dumps({"state_step_max": 10 * i + j}), "r") for j in range(10)]
        runner(spark.createDataFrame(rows, SCHEMA), i)
    sizes = [(spark.read.parquet(f"{folder}/facts/batch={i}").count(), spark.read.parquet(f"{folder}/tails-T0-optim-step-counter-monotonic/batch={i}").count()) for i in (0, 9, 19)]
    assert sizes == [(1, 2)] * 3


def test_late_events_of_row_checks_are_kept(spark):
    runner = I.IncrementalRunner(spark, work_folder(spark, "inc"), [R.RULES_BY_ID["T0-clip-grad-bounded"]])
    bad = lambda i, ts: (i, 0, 0, "utils.clip_grad.post", ts, 1, json.dumps({"max_norm": 1.0, "post_norm": 9.0}), "r")
    runner(spark.createDataFrame([bad(5, 10 ** 18)], SCHEMA), 0)
    runner(spark.createDataFrame([bad(1, 0), bad(5, 10 ** 18)], SCHEMA), 1)  # a billion seconds late, and one delivered again
    assert sorted((r.batch, r.event_id) for r in runner.changes().collect()) == [(0, 5), (1, 1)]
    with pytest.raises(ValueError):
        I.IncrementalRunner(spark, "x", [R.RULES_BY_ID["T1-sqrt-decay-front-loaded"]])


def test_one_sampler_for_tables_and_streams(spark):
    df = spark.range(4000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("hookpoint"))
    got = K.sample_hooks(df, {"a": 0.7})
    a = got.where("hookpoint = 'a'")
    assert got.where("hookpoint = 'b'").count() == 2000 and 1300 < a.count() < 1500
    assert a.exceptAll(K.sample_by_hash(df.where("hookpoint = 'a'"), "event_id", 0.7)).isEmpty()


# -- trees ------------------------------------------------------------------------------------------

def brute_chains(nodes):
    by = {n: (p, s) for n, p, s in nodes}
    kids = {}
    for n, p, s in nodes:
        kids.setdefault(p, []).append(s)
    out = {}
    for n, p, s in nodes:
        if s == "fail" and "fail" not in kids.get(n, []):
            chain, at = [], p
            while at is not None:
                chain += [at] if by[at][1] == "fail" else []
                at = by[at][0]
            out[n] = (len(chain) + 1, chain[-1] if chain else n)
    return out


def test_failure_chains_of_random_trees_and_a_long_chain(spark):
    r = random.Random(2)
    nodes = [(i, None if i < 3 else r.randrange(max(0, i - 20), i), r.choice(["fail", "pass"])) for i in range(300)]
    nodes += [(1000 + i, None if i == 0 else 999 + i, "fail" if i % 3 else "pass") for i in range(700)]
    df = spark.createDataFrame([(n, p, str(n), 0, s) for n, p, s in nodes], "node long, parent long, name string, level int, status string")
    got = {x.node: (x.path_length, x.chain_start) for x in T.failure_chains(df).collect()}
    assert got == brute_chains(nodes)
    with pytest.raises(ValueError, match="cycle"):
        T.lifted(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node long, parent long"), F.lit(False))


def test_nested_report_equals_recursion(spark):
    r = random.Random(4)
    nodes = [(i, None if i < 2 else r.randrange(i), r.choice(["fail", "pass", None])) for i in range(60)]

    def build(n):
        kids = [build(c) for c, p, _ in nodes if p == n]
        s = next(s for i, _, s in nodes if i == n)
        return {"name": f"n{n}", "status": s or "unchecked", "n_nodes": 1 + sum(k["n_nodes"] for k in kids), "n_fail": (s == "fail") + sum(k["n_fail"] for k in kids),
                "children": sorted(kids, key=lambda k: k["name"])}
    df = spark.createDataFrame([(n, p, f"n{n}", s) for n, p, s in nodes], "node long, parent long, name string, status string")
    assert {x.root: json.loads(x.report) for x in T.nested_report(df).collect()} == {0: build(0), 1: build(1)}


def test_drill_down_reads_failed_folders_only(spark):
    rows = spark.createDataFrame([(a, b, "x" if (a, b) != (3, 1) else f"x{i}") for a in range(6) for b in range(4) for i in range(5)], "a int, b int, v string")
    stored, handed = T.stored_by(rows, ["a"]), []

    def watching(keys):
        def check(d):
            handed.append(d)
            return T.agree(keys, "v")(d)
        return check
    got = T.drill_down(stored, [T.Level("a", ("a",), watching(("a",))), T.Level("b", ("a", "b"), watching(("a", "b")))])
    assert sorted((x.level, x.node, x.status) for x in got.collect()) == sorted(
        [(0, str(a), "fail" if a == 3 else "pass") for a in range(6)] + [(1, f"3/{b}", "fail" if b == 1 else "pass") for b in range(4)])
    assert [x.a for x in handed[1].select("a").distinct().collect()] == [3]
    assert "dynamicpruning" in handed[1]._jdf.queryExecution().executedPlan().toString()


# -- fills and baselines ------------------------------------------------------------------------------

def test_first_fit_equals_one_by_one(spark):
    for seed in range(6):
        r = random.Random(seed)
        items = [(k, r.randint(1, 9), r.randint(0, 50)) for k in range(60)]
        cap, want, used = r.randint(5, 120), [], 0
        for k, size, place in sorted(items, key=lambda x: (x[2], x[0])):
            if used + size <= cap:
                want.append(k)
                used += size
        df = spark.createDataFrame(items, "k long, size long, place long")
        assert sorted(x.k for x in M.first_fit(df, "size", "place", ["k"], cap, span=7).collect()) == sorted(want)


def test_quota_fill_takes_the_total(spark):
    r = random.Random(9)
    cases = [(i, f"g{r.randint(0, 80)}" if r.random() < .6 else None, r.choice("ab")) for i in range(300)]
    df = spark.createDataFrame(cases, "k long, leak string, s string")
    for total in (1, 37, 50, 299, 300):
        out = M.quota_fill_split(df, "k", F.col("leak"), ["s"], total, seed=1, span=1 << 28)
        test = {x.k for x in out.where("split = 'test'").collect()}
        assert len(test) == total and out.count() == 300
        assert all(len({k in test for k, g, _ in cases if g == leak}) == 1 for leak in {g for _, g, _ in cases if g})


def test_rank_equal_rules_are_learned_on_the_other_configurations(spark):
    rows = [(c, s, rank, 1.0 * s, 1.0 * s + (rank if c == "c" and s == 2 else 0), float(rank)) for c in "abc" for s in range(4) for rank in range(3)]
    df = spark.createDataFrame(rows, "config string, step int, rank int, same double, once double, never double")
    got = {(x.config, x.field): (x.n_fires, x.learned) for x in J.rank_equal_baseline(df, "config", ["step"], ["same", "once", "never"]).collect()}
    assert got == {**{(c, "same"): (0, True) for c in "abc"}, **{(c, "never"): (0, False) for c in "abc"}, ("a", "once"): (0, False), ("b", "once"): (0, False), ("c", "once"): (1, True)}
