"""Data beyond every former bound: nothing is dropped, cut short or mixed up."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from guardlens import session
from guardlens.operators import diagnose as L
from guardlens.operators import evalkit as M
from guardlens.operators import mining as J
from guardlens.operators import rules as RU
from guardlens.operators import spec as S
from guardlens.operators import state as ST
from guardlens.sources import textlogs, traces


def test_replica_numbers_beyond_the_degree(spark):
    d = spark.createDataFrame([("w", 0, "a"), ("w", 200, "b"), ("x", 62, "a"), ("x", 63, "b"), ("y", 1, "a"), ("y", 2, "a")], "name string, dp int, c string")
    for degree in (8, None):
        got = {r.name: (r.n_replicas, r.replicas) for r in ST.replica_equality_multi(d, ["name"], "dp", ["c"], degree).collect()}
        assert got == {"w": (2, "0,200"), "x": (2, "62,63")}


def test_ids_beyond_the_offset_fail(spark):
    a, b = (spark.createDataFrame([(i,)], "event_id long") for i in (1, 10 ** 9 + 1))
    assert [r.event_id for r in traces.union_ranks_with_offset([a, a]).collect()] == [1, 10 ** 9 + 1]
    with pytest.raises(PySparkException, match="outside the offset"):
        traces.union_ranks_with_offset([b, a]).collect()


def test_deep_chains_and_cycles(spark):
    n = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}", i, "fail") for i in range(11)], "node long, parent long, name string, level int, status string")
    cause = L.root_causes(n).collect()
    assert [(r.node, r.path_length, r.chain_start) for r in cause] == [(10, 11, 0)]
    with pytest.raises(ValueError, match="cycle"):
        L.with_ancestors(spark.createDataFrame([(1, 2), (2, 1)], "node long, parent long"))


def test_sixty_candidates_of_a_kind(spark):
    p = spark.createDataFrame([("h", f"$.f{i:02d}", "number") for i in range(60)], "hookpoint string, path string, type string")
    assert J.parametric_candidates(p, ("positive",)).count() == 60
    some = J.parametric_candidates(p, ("positive",), cap=50)
    assert some.count() == 50 and {r.n_dropped for r in some.collect()} == {10}


def test_nested_records(spark):
    text = 'x { y {"name": "a", "sql": "SELECT {1}", "meta": {"k": {"d": "}"}}} and {"name": "b", "sql": "q"} {'
    got = textlogs.embedded_records(spark.createDataFrame([(text,), (None,), ("",)], "text string"), "text", "name", "sql")
    assert sorted((r.name, r.value) for r in got.collect()) == [("a", "SELECT {1}"), ("b", "q")]


def test_pattern_search_ignores_case_and_keeps_the_line(spark):
    d = spark.createDataFrame([("f", 1, "a todo " + "x" * 300), ("f", 2, "TODO"), ("f", 3, "none")], "doc string, line_no int, line string")
    got = textlogs.pattern_hits(d, {"t": "ToDo"}, "doc").collect()
    assert sorted(len(r.snippet) for r in got) == [4, 307]


def test_events_of_two_ranks_with_one_id(spark, trace):
    t = trace(("utils.clip_grad.post", {"post_norm": 5.0, "max_norm": 1.0}, 0, 0), ("utils.clip_grad.post", {"post_norm": 5.0, "max_norm": 1.0}, 0, 1))
    t = t.withColumn("event_id", F.lit(1).cast("long"))
    bad = S.violations(t, [RU.RULES_BY_ID["T0-clip-grad-bounded"]])
    assert L.expand(bad, t).count() == 2 and L.bug_evidence(bad, t).count() == 2
    assert L.context_slice(bad.withColumn("hookpoint", F.lit("utils.clip_grad.post")), t, ["run", "hookpoint"], 2, 2).isEmpty()
    assert L.context_events(bad, t, 2, 2).isEmpty()


def test_either_line_count_may_meet_the_claim(spark):
    d = spark.createDataFrame([("f", "# c")] * 6 + [("f", "x")] * 4, "file string, line string")
    claims = spark.createDataFrame([("f", 10)], "file string, claimed int")
    assert M.line_counts(d, "file", F.col("line"), claims).first().in_band


def test_a_holding_counterexample_decides_first(spark):
    c = spark.createDataFrame([(True, True, True, "t", 1, 1, 0.9, 0)], "has_schema boolean, has_topo boolean, has_precond boolean, template_id string, "
                              "n_counterexamples int, n_holding int, confidence double, probe_rows int")
    assert J.accept_gate(c).first().reject_reason == "counterexample holds"


def test_work_folder_needs_a_shared_place(monkeypatch, spark):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        session.work_folder(Session(), "x")
    assert session.work_folder(spark, "x")
