"""Rows that the small tables lack, each query against its SQL: equal urls, zeros, missing values, letters beside a word."""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from guardlens.plans.registry import load
from guardlens.plans.views import TABLES
from oracle import compare, connect


@pytest.fixture
def differs(spark, sf, tmp_path):
    """What a query and its SQL differ in once a table has other rows."""
    def run(query, table, change):
        for t in TABLES:
            path = str(tmp_path / f"{t}.parquet")
            if t == table:
                change(spark.read.parquet(f"{sf}/{t}.parquet")).toPandas().to_parquet(path, coerce_timestamps="us")
            else:
                os.symlink(f"{sf}/{t}.parquet", path)
        return compare(spark, connect(str(tmp_path)), load()[query], str(tmp_path))
    return run


def test_manifest_of_equal_urls(differs):
    same = F.when(F.col("page_id") % 10 < 2, F.lit("http://example.net/en/1")).otherwise(F.col("url"))
    assert differs("a21_verify_manifest", "pages", lambda d: d.withColumn("url", same)) is None


@pytest.mark.parametrize("query", ["b23_evidence_level", "m20_evidence_grid"])
def test_crash_words_beside_letters_of_any_script(differs, query):
    texts = ["über schüinf er", "schä inf, er", "infä x", "das nanü", "oom", "_nan", "nan1", "é crash é", "Αnan", ""]
    text = F.element_at(F.array(*map(F.lit, texts), F.lit(None).cast("string")), (F.col("doc_id") % 11 + 1).cast("int"))
    assert differs(query, "documents", lambda d: d.withColumn("text", text)) is None


@pytest.mark.parametrize("ratio", [None, float("nan"), float("inf"), 500.000005, 201.27132750000002])
def test_ratio_of_heads_of_any_kind(differs, ratio):
    value = F.when(F.col("event_id") % 3 == 0, F.lit(ratio).cast("double")).otherwise(F.col("value"))
    user = F.when(F.col("event_id") % 2 == 0, F.col("user_id") * 29).otherwise(F.col("user_id"))
    assert differs("e01_attention_head_uniformity", "events", lambda d: d.withColumn("value", value).withColumn("user_id", user)) is None


def test_gradient_norms_of_any_kind(differs):
    odd = F.element_at(F.array(*[F.lit(x).cast("double") for x in (0.0, -0.0, None, float("nan"), float("inf"), -1.0, 400000.0, 437938.3745419559)]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    assert differs("e06_grad_norm_finite", "orders", lambda d: d.withColumn("o_totalprice", odd)) is None


def test_gradient_output_of_zero(differs):
    odd = F.element_at(F.array(*[F.lit(x).cast("double") for x in (0.0, -0.0, None, float("nan"), -1.0, 0.01)]), (F.col("c_custkey") % 6 + 1).cast("int"))
    assert differs("e11_module_grad_output_alive", "customer", lambda d: d.withColumn("c_acctbal", odd)) is None


def test_zeros_in_c15_tiers_over_all_rules(differs):
    value = F.when(F.floor(F.col("event_id") / 39) % 4 == 0, 0.0).otherwise(F.col("value"))
    assert differs("c15_tiers_over_all_rules", "events", lambda d: d.withColumn("value", value)) is None


def test_zeros_in_e33_all_statuses(differs):
    value = F.when(F.floor(F.col("event_id") / 39) % 4 == 0, 0.0).otherwise(F.col("value"))
    assert differs("e33_all_statuses", "events", lambda d: d.withColumn("value", value)) is None


def test_zeros_in_e34_arms_over_all_rules(differs):
    value = F.when(F.floor(F.col("event_id") / 39) % 4 == 0, 0.0).otherwise(F.col("value"))
    assert differs("e34_arms_over_all_rules", "events", lambda d: d.withColumn("value", value)) is None


def test_zeros_in_j06_mined_candidates(differs):
    value = F.when(F.floor(F.col("event_id") / 39) % 4 == 0, 0.0).otherwise(F.col("value"))
    assert differs("j06_mined_candidates", "events", lambda d: d.withColumn("value", value)) is None


@pytest.mark.parametrize("sizes", [(7, 11, 13, 17, 19, 23, 29, 31, 37, 41), (25, 35, 31, 28, 27, 33), (50, 45, 44, 20, 21, 13, 13, 8), (70, 90, 110)])
def test_quota_fill_with_few_groups(differs, spark, sizes):
    def change(d):
        groups = spark.createDataFrame([(f"{b}{n}", n) for b in ("A", "B") for n in sizes], "p_brand string, n int")
        rows = groups.withColumn("i", F.explode(F.sequence(F.lit(1), "n"))).drop("n")
        key = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("p_brand", "i")).cast("long")
        return rows.select(key.alias("p_partkey"), F.lit("x").alias("p_name"), "p_brand", F.element_at(F.array(F.lit("S"), F.lit("M")), (key % 2 + 1).cast("int")).alias("p_type"),
                           F.lit(-1).alias("p_size"), F.lit(900.0).alias("p_retailprice"))
    assert differs("m12_quota_fill", "part", change) is None


def test_leaf_counts_read_equal_texts_once(spark):
    from guardlens.functions import sqlfuncs
    texts = ['{"a": 1, "b": [true, {"c": null}]}'] * 3 + ['{"a": "x"}', "no json", None, '{"b": []}']
    got = {(r.path, r.type): r.n for r in sqlfuncs.leaf_counts(spark.createDataFrame([(x,) for x in texts], "p string"), "p").collect()}
    assert got == {("$.a", "number"): 3, ("$.a", "string"): 1, ("$.b[*]", "bool"): 3, ("$.b[*].c", "null"): 3, ("$.b[*]", "empty"): 1}


def test_state_checks_are_dealt_by_rows(spark, monkeypatch):
    from guardlens import session
    from guardlens.operators import state as S
    monkeypatch.setattr(session, "ROWS_A_TASK", 10)
    assert session.spread(spark.range(95), 95, "id").rdd.getNumPartitions() == 10
    rows = [(i // 4, i % 4, "a" if i % 8 else "b", None if i % 3 else "c", "x") for i in range(80)] + [(None, 0, "a", "c", "x"), (None, 1, "b", "c", "x")]
    d = spark.createDataFrame(rows, "e int, r int, p string, q string, z string")
    multi = {r.e: (r.n_replicas, r.n_rows, r.n_p, r.n_q, r.inconsistency_type, r.replicas) for r in S.replica_equality_multi(d, ["e"], "r", ["p", "q"]).collect()}
    assert multi == {**{e: (4, 4, 2, 1, "p_inconsistent", "0,1,2,3") for e in range(0, 20, 2)}, None: (2, 2, 2, 1, "p_inconsistent", "0,1")}
    found = S.attribute_consistency(d, ["e"], ["p", "q", "z"])
    assert {(r.e, r.attribute, r.n_values, r.n_rows) for r in found.collect()} == {*((e, "p", 2, 4) for e in range(0, 20, 2)), (None, "p", 2, 2)}


@pytest.mark.parametrize("query", ["k03_incremental_standing", "k04_incremental_changes"])
def test_files_of_a_batch_grow_with_its_rows(spark, sf, query, monkeypatch):
    """A batch of more rows comes in more files, and is still one part."""
    from guardlens.plans import q_streaming
    monkeypatch.setattr(q_streaming, "ROWS_A_TASK", 20)
    seen = []
    read = q_streaming.stream_trace
    monkeypatch.setattr(q_streaming, "stream_trace", lambda *a, max_files: seen.append(max_files) or read(*a, max_files=max_files))
    assert compare(spark, connect(sf), load()[query], sf) is None
    assert seen[0] >= spark.read.parquet(f"{sf}/events.parquet").count() // 20 > q_streaming.FILES


def test_a_walk_parses_what_it_reads():
    """Of tensor summaries only the named fields are parsed, in lists and parameters too."""
    from guardlens import schema as sc
    t = sc.payload_schema(["output", "inputs", "model"], ("dtype", "shape", "has_nan"))
    prm = t["model"].dataType["parameters"].dataType.elementType
    for x in (t["output"].dataType, t["inputs"].dataType.elementType, prm["tensor_summary"].dataType):
        assert set(x.fieldNames()) == {"dtype", "shape", "has_nan"}
    assert {"name", "dtype", "tensor_summary"} <= set(prm.fieldNames()) and "std" not in prm.fieldNames()


def test_rules_are_evaluated_outside_the_generator(spark, sf):
    """The array of all rules is a compiled column of one parse: neither is it interpreted in the generator, nor tested below the parse."""
    from guardlens.operators import rules as R
    from guardlens.operators import spec as S
    from guardlens.plans.q_rules import fleet
    from guardlens.plans.views import Views
    trace = fleet(Views(spark, sf))
    rows = [r for r in R.RULES if r.findings is not None]
    for d in (S.row_violations(trace, rows), S.results(trace, rows)):
        plan = d._jdf.queryExecution().optimizedPlan().toString().splitlines()
        generators = [x for x in plan if "Generate " in x and "check_id" in x and "wanted" not in x]
        assert generators and all("__rows#" in x for x in generators)
        assert not [x for x in plan if "Filter " in x and "from_json" in x]


def test_a_profile_and_a_replay_parse_each_payload_once(spark, sf):
    """Documents are fetched by key before they are parsed, a term reads its value once, and a series is stored for its two readers."""
    from guardlens.operators import candidates as C
    from guardlens.operators import mining as J
    from guardlens.plans.q_mining import mined, mixed
    from guardlens.plans.views import Views
    v = Views(spark, sf)
    text = lambda d: d._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in text(J.schema_profile(mixed(v))) if "Filter " in x and "variant" in x.lower()]
    assert [C._CODE.count(f"try_variant_get(x, t.{side}") for side in ("leaf", "other")] == [1, 1]
    candidates, profile = mined(v)
    plan = text(C.candidate_failures(mixed(v), candidates, profile, span=1000))
    assert sum("json" in x.lower() and "variant" in x.lower() for x in plan) <= 1
