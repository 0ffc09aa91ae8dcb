"""State, guard, mining and diagnosis operators on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from guardlens.functions import exprs as X
from guardlens.functions import sqlfuncs
from guardlens.operators import diagnose as L
from guardlens.operators import evalkit as M
from guardlens.operators import generic as G
from guardlens.operators import guards as D
from guardlens.operators import candidates as C
from guardlens.operators import mining as J
from guardlens.operators import relational as R
from guardlens.operators import rules as RU
from guardlens.operators import spec as S
from guardlens.operators import state as ST


def toy(spark, buggy):
    """Three parameters on two shards; the qkv rows differ legitimately."""
    rows = [(n, tp, f"{n}{tp}" if n == "qkv" or (buggy and n == "router" and tp == 1) else n) for n in ("layernorm", "router", "qkv") for tp in (0, 1)]
    return spark.createDataFrame(rows, "name string, tp int, cksum string")


@pytest.mark.parametrize("buggy,guarded,unguarded", [(False, 0, 1), (True, 1, 2)])
def test_toy_trace(spark, buggy, guarded, unguarded):
    d = toy(spark, buggy)
    g = F.lower("name").like("%layernorm%") | F.lower("name").like("%router%")
    assert ST.replica_equality(d, ["name"], "cksum", guard=g).count() == guarded
    assert ST.replica_equality(d, ["name"], "cksum").count() == unguarded


def test_null_values_do_not_disagree(spark):
    d = spark.createDataFrame([("a", 0, None), ("a", 1, "x"), ("b", 0, "x"), ("b", 1, "y")], "name string, r int, v string")
    assert [r.name for r in ST.replica_equality(d, ["name"], "v").collect()] == ["b"]


@pytest.mark.parametrize("degree", [3, 62, 63, 130])
def test_replica_masks_beyond_one_word(spark, degree):
    r = random.Random(degree)
    have = {"a": set(r.sample(range(degree), degree // 2 + 1)), "b": {0, degree - 1}}
    d = spark.createDataFrame([(n, i) for n, s in have.items() for i in s for _ in range(2)], "name string, r int")
    miss = {}
    for x in ST.completeness(d, ["name"], "r", degree).collect():
        miss.setdefault(x.name, set()).add(x.missing_replica)
    assert miss == {n: set(range(degree)) - s for n, s in have.items() if s != set(range(degree))}
    g = d.groupBy("name").agg(*ST.masks("r", degree)).select("name", ST.mask_members(degree).alias("m"), ST.mask_size(degree).alias("n")).collect()
    assert {x.name: x.m for x in g} == {n: sorted(s) for n, s in have.items()} and {x.name: x["n"] for x in g} == {n: len(s) for n, s in have.items()}


def test_both_inconsistent_label(spark):
    d = spark.createDataFrame([("a", 0, "x", "p"), ("a", 1, "y", "q"), ("b", 0, "x", "p"), ("b", 1, "x", "q")], "name string, dp int, c string, g string")
    got = {r.name: r.inconsistency_type for r in ST.replica_equality_multi(d, ["name"], "dp", ["c", "g"], 4).collect()}
    assert got == {"a": "both_inconsistent", "b": "g_inconsistent"}


@pytest.mark.parametrize("values,want", [([1, 2, 2, 2], 0), ([2, 2, 1, 2], 2), ([1, 2], None), ([1, 1, 2, 2], None), ([3, 3, 3], None), ([1, 2, 3, 3], 1)])
def test_outlier_replica(spark, values, want):
    d = spark.createDataFrame([("e", i, v) for i, v in enumerate(values)], "e string, pos int, v int")
    assert L.outlier_replica(d, ["e"], "v", "pos").collect()[0].outlier == want
    arr = spark.createDataFrame([([str(v) for v in values],)], "a array<string>")
    assert arr.select(L.outlier_in_list(F.col("a")).alias("o")).collect()[0].o == want


@pytest.mark.parametrize("text,actual,want", [("> 1", 2, True), (">1", 1, False), ("<= 2", 2, True), ("!= 3", 3, False), ("= 2", 2, True), ("== true", True, True),
                                              ("= False", True, False), ("around", 1, True), ("= 'x'", "x", True), ("> 1", None, True)])
def test_guard_grammar(spark, text, actual, want):
    kind = "string" if isinstance(actual, str) else "boolean" if isinstance(actual, bool) else "int"
    d = spark.createDataFrame([(actual, text)], f"a {kind}, t string")
    r = d.select(D.guard_column(F.col("a"), text).alias("p"), D.guard_holds(F.col("a"), F.col("t")).alias("q")).collect()[0]
    assert (r.p, r.q) == (want, want)


def test_profile_with_non_standard_numbers(spark, trace):
    t = trace(("a", '{"x": NaN, "l": [], "s": {"y": [{"z": true}]}}'), ("a", '{"x": 1.5, "n": null, "q": "say NaN, ok"}'), ("a", "not json"))
    got = {(r.path, r.type): r.n_events for r in J.schema_profile(t).collect()}
    assert got == {("$.x", "number"): 2, ("$.l[*]", "empty"): 1, ("$.s.y[*].z", "bool"): 1, ("$.n", "null"): 1, ("$.q", "string"): 1}


def test_candidates_and_validation(spark, trace):
    healthy = [("utils.clip_grad.post", {"max_norm": 1.0, "post_norm": 0.5}, None, None, r) for r in ("a", "b")]
    odd = [("utils.clip_grad.post", {"max_norm": 1.0, "post_norm": 2.0}, None, None, "b")]
    t = trace(*healthy)
    c = J.shape_candidates(J.schema_profile(t))
    assert [x.candidate_id for x in c.collect()] == ["hyp/pfc/utils.clip_grad.post/post_norm_<=_max_norm"]
    for events, accepted in ((healthy, True), (healthy + odd, False)):
        t = trace(*events)
        assert [r.accepted for r in C.validated(c, C.candidate_failures(t, c), t).collect()] == [accepted]


def test_candidates_are_interpreted_and_errors_reject_them(spark, trace):
    nan = '{"x": NaN, "output": {"dtype": "f", "shape": [2], "has_nan": false, "has_inf": true}}'
    deep = {"a": [{"b": [{"c": 1}, {"c": -2}]}, {"b": []}, {}], "t": "no"}
    t = trace(("h", {"x": 1, "y": 2, "t": "yes", "l": [{"v": True, "g": 2}, {"v": False, "g": 1}]}), ("h", {"x": None, "y": 3, "l": []}),
              ("h", nan), ("h", deep), ("h", "{broken"), ("k", {"x": "text"}), ("h", {"l": [{"v": False, "g": 5}, {"v": None, "g": 5}]}),
              ("m", {"s": 1}), ("m", {"s": 3}), ("m", {"s": 3}), ("m", {"s": 2}, 0, 1), ("m", {"s": "?"}, 0, 1))
    profile = J.schema_profile(t)
    made = [("less", "h", "x", "<", "y", True, None, False), ("elem", "h", "l[*].v", "==", "true", False, ("element", "g", ">", "1"), False),
            ("deep", "h", "a[*].b[*].c", ">", "0", False, None, False), ("text", "h", "t", "!=", "no", False, None, False),
            ("walk", "h", "has_nan", "==", "false", False, None, True), ("walk", "h", "has_inf", "==", "false", False, None, True),
            ("type", "k", "x", ">", "0", False, None, False), ("op", "k", "x", "~", "0", False, None, False), ("none", "z", "x", ">", "0", False, None, False),
            ("steps", "m", "s", "increasing", None, False, None, False), ("only", "h", "y", ">", "2", False, ("payload", "t", "==", "yes"), False)]
    c = spark.createDataFrame([(i, "x", *r) for i, *r in made], f"candidate_id string, relation string, hookpoint string, field string, op string, value string, value_is_field boolean, guard {C.GUARD}, walk boolean")
    got = {r.candidate_id: (r.n_violations, r.n_errors) for r in C.candidate_failures(t, c, profile).collect()}
    # the broken payload is an error of every candidate of its hookpoint
    assert got == {"less": (0, 1), "elem": (1, 1), "deep": (1, 1), "text": (1, 1), "walk": (1, 1), "type": (0, 1), "op": (0, 1), "steps": (1, 1), "only": (1, 1)}
    v = {r.candidate_id: (r.accepted, r.reason) for r in C.validated(c, C.candidate_failures(t, c, profile), t).collect()}
    assert v["none"] == (True, None) and v["type"] == (False, "error") and all(not a for k, (a, _) in v.items() if k != "none")


def test_kappa_and_split(spark):
    pairs = spark.createDataFrame([("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 4, "x string, y string")
    r = M.cohen_kappa(pairs, "x", "y").collect()[0]
    assert math.isclose(r.raw_agreement, 7 / 8) and math.isclose(r.kappa, (7 / 8 - 0.5) / 0.5)
    cases = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 3).alias("s"), F.expr("id div 4").alias("leak"))
    d = M.stratified_split(cases, "k", F.col("leak"), ["s"], 60, seed=1, span=1 << 20)
    assert d.count() == 300
    assert d.join(cases.select("k", "leak"), "k").groupBy("leak").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    n = d.where("split = 'test'").count()
    assert 60 - 3 * 4 < n <= 60


def test_evidence_levels(spark):
    d = spark.createDataFrame([(1, "t", "silently wrong", "BUG DETECTED x", True), (2, "t", "dtype race", "", False), (3, "skip it", "", "", False), (4, "x", "", "", False),
                               (5, "x", "it throws", "", False), (6, "x", "flag", "mismatch then NaN", True), (7, "x", "flag", "mismatch of inference", True)],
                              "id int, title string, cause string, buggy string, rep boolean")
    got = {r.id: (r.underlying_level, r.evidence_level) for r in M.score_evidence(d, F.col("rep"), ["id"], title=F.col("title"), cause=F.col("cause"), buggy_output=F.col("buggy")).collect()}
    assert got == {1: ("L1", "L1"), 2: ("L2", "L2"), 3: ("L3", "L3"), 4: ("L4", "L4"), 5: ("L4", "WARNING"), 6: ("L2", "WARNING"), 7: ("L1", "L1")}


def test_context_evidence_and_hypothesis(spark, trace):
    t = trace(*[("utils.clip_grad.post", {"max_norm": 1.0, "post_norm": 5.0 if i == 3 else 0.5, "fn": "f"}) for i in range(9)])
    v = S.violations(t, [RU.RULES_BY_ID["T0-clip-grad-bounded"]])
    near = L.context_slice(v.withColumn("hookpoint", F.lit("utils.clip_grad.post")), t, ["run", "hookpoint"], 2, 2)
    assert sorted(r.event_id for r in near.collect()) == [2, 3, 5, 6]
    assert '"post_norm":5.0' in L.bug_evidence(v, t).collect()[0].evidence
    rep = trace(("build.snapshot", {"cross_rank_cksums": [{"name": "w", "group_size": 4, "all_equal": False, "gathered_cksums": [1, 2, 2, 2]}]}))
    e = L.bug_evidence(S.violations(rep, [RU.RULES_BY_ID["T1-replica-cksum-equal"]]), rep).collect()[0].evidence
    assert '"outlier_rank":0' in e and '"param_name":"w"' in e


def test_context_prefers_module(spark, trace):
    clip = lambda i, **kw: ("utils.clip_grad.post", {"max_norm": 1.0, "post_norm": 5.0 if i in (2, 6) else 0.5, **kw})
    t = trace(clip(0, module_id=7), ("loss.call", {"module_id": 7}), clip(2, module_id=7), clip(3), clip(4), ("loss.call", {}), clip(6), clip(7, module_id=8))
    v = S.violations(t, [RU.RULES_BY_ID["T0-clip-grad-bounded"]])
    got = {}
    for r in L.context_events(v, t, 2, 2).collect():
        got.setdefault(r.violation_id, set()).add(r.event_id)
    assert got == {3: {1, 2}, 7: {4, 5, 8}}


def test_tree_root_causes(spark):
    n = spark.createDataFrame([("p", None, "p", 0, "fail"), ("c1", "p", "x_cksum", 1, "fail"), ("c2", "p", "y", 1, "pass"), ("q", None, "q_shape", 0, "fail"), ("d", "q", "z", 1, "pass")],
                              "node string, parent string, name string, level int, status string")
    got = {r.node: (r.path_length, r.chain_start, r.severity, r.children_all_pass) for r in L.root_causes(n).collect()}
    assert got == {"c1": (2, "p", "critical", True), "q": (1, "q", "high", True)}


def test_relations(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert {(r.k, r.status) for r in G.reference_equivalence(df, df.where("k = 'a'").unionByName(spark.createDataFrame([("c", 1)], df.schema)), ["k"], "v").collect()} == {
        ("b", "missing_right"), ("c", "missing_left")}
    assert {(r.k, r.change) for r in R.set_diff(df, df.where("k = 'a'"), ["k"]).collect()} == {("a", "persistent"), ("b", "new")}
    assert G.catalog(spark).count() == 35 and G.catalog_template("T15")[2] == "monotonicity"
    with pytest.raises(ValueError):
        G.catalog_template("P1")
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "i int, s string"), spark.createDataFrame([(2, "y"), (1, "x")], "i int, s string")
    fa, fb = (R.fingerprint(x, [], ["i", "s"]).collect()[0] for x in (a, b))
    assert fa == fb and fa != R.fingerprint(a.withColumn("s", F.lit("x")), [], ["i", "s"]).collect()[0]


def test_expressions(spark):
    d = spark.createDataFrame([("model.blocks.12.mlp", [2, 3, 4], "abcx", "abdy")], "n string, s array<bigint>, a string, b string")
    r = d.select(X.block_index("n").alias("i"), X.numel("s").alias("k"), X.leading_rows("s").alias("l"), X.common_prefix("a", "b").alias("p"),
                 X.common_prefix(F.lit(""), "b").alias("e"), X.block_index(F.lit("blocks.x.y")).alias("z")).collect()[0]
    assert (r.i, r.k, r.l, r.p, r.e, r.z) == (12, 24, 6, "ab", "", None)
    rel = spark.range(1).select(X.relaxed(F.lit(-10.0), "<=", 0.1).alias("a"), X.relaxed(F.lit(10.0), ">=", 0.1, 1.0).alias("b")).collect()[0]
    assert (rel.a, rel.b) == (-9.0, 8.0)


def test_registry(spark):
    reg = sqlfuncs.CheckRegistry(RU.RULES)
    with pytest.raises(ValueError):
        reg.add(RU.RULES[0])
    assert len(reg.all(0)) == 17 and len(reg.all()) == 32


def test_single_rank_has_no_topology_delta(trace):
    """Without replica groups the topology guards change nothing but the declared-size test."""
    t = trace(("build.snapshot", {"cross_rank_cksums": [{"name": "w", "group_size": 4, "all_equal": False}]}))
    rules, guards = RU.arm("no_topo")
    full = {(r.check_id, r.event_id) for r in S.violations(t, RU.RULES).collect()}
    bare = {(r.check_id, r.event_id) for r in S.violations(t, rules, guards).collect()}
    assert full == bare
