"""Readers, writers and log parsing on real files."""

import gzip
import hashlib
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from guardlens import schema as sc
from guardlens.operators import spec as S
from guardlens.operators import rules as R
from guardlens.sources import manifest, textlogs, timeline, traces


def test_trace_round_trip_prunes_partitions(spark, trace, tmp_path):
    t = trace(("loss.call", {"reduction": "sum"}), ("module.bwd", {}), ("loss.call", {"reduction": "mean"}))
    traces.write_trace(t, str(tmp_path / "t"))
    back = traces.read_trace(spark, str(tmp_path / "t"), run_column=True)
    assert back.count() == 3
    found = S.violations(back, [R.RULES_BY_ID["T0-loss-reduction-mode-correct"]])
    assert [r.event_id for r in found.collect()] == [1]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "loss.call" in plan.split("PartitionFilters")[1][:200]


def test_state_dump_and_relations(spark, tmp_path):
    p = tmp_path / "coredump_dp1_tp0_pp0_cp0.parquet"
    rows = [(1, "model-after-backward", json.dumps({"name": "w", "cksum": "a", "shape": [2, 3]})),
            (1, "optimizer-state", json.dumps({"name": "w", "state_key": "exp_avg", "cksum": "b"})),
            (1, "loss", "{}")]
    spark.createDataFrame(rows, sc.STATE_DUMP).coalesce(1).write.parquet(str(p))
    s = traces.read_state(spark, str(p), ranks_from_name=True)
    assert {(r.stage, r.dp) for r in s.collect()} == {("model-after-backward", 1), ("optimizer-state", 1), ("loss", 1)}
    sizes = {r.relation: r.n_rows for r in traces.relation_sizes(s).collect()}
    assert sizes["tensor_state"] == 1 and sizes["optimizer_state"] == 1 and sizes["loss_event"] == 1
    assert set(traces.register_relations(s)) == set(sizes)
    assert spark.sql("SELECT count(*) c FROM optimizer_state").collect()[0].c == 1


def test_timeline_files(spark, tmp_path):
    for host, line in (("h1", "5000,0,7,kern,fwd_begin_x,begin\n"), ("h2", "9000,3,7,kern,fwd_end_x,end\n")):
        os.makedirs(tmp_path / host)
        (tmp_path / host / "t.csv").write_text(line)
    d = timeline.read_timeline(spark, str(tmp_path / "*" / "t.csv"), "ns")
    assert {(r.hostname, r.timestamp) for r in d.collect()} == {("h1", 5), ("h2", 9)}
    timeline.export(d, str(tmp_path / "out"), ranks=(0,))
    files = [f for f in os.listdir(tmp_path / "out") if f.endswith(".json.gz")]
    text = "".join(gzip.open(tmp_path / "out" / f, "rt").read() for f in files)
    ev = [json.loads(x) for x in text.splitlines()]
    assert len(ev) == 1 and ev[0]["name"] == "fwd_x" and ev[0]["ph"] == "B"
    with pytest.raises(ValueError):
        timeline.scaled(d, "ms")


def test_log_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("=== phase: p1 ===\nverdict: PASS\nverdict: FAIL\n=== phase: p2 ===\nverdict: PASS\nSUMMARY => FAIL\n"
                                    "elapsed time per iteration (ms): 10.5 |\nelapsed time per iteration (ms): 20.5 |\nloss=nan\n")
    lines = textlogs.read_lines(spark, str(tmp_path / "a.log"))
    v = textlogs.sectioned_verdicts(lines, ["file"], "line_no", "line", r"phase: (p\d)", r"verdict: (\w+)", r"SUMMARY => (\w+)", span=2)
    assert {r.section: r.verdict for r in v.collect()} == {"p1": "PASS", "p2": "FAIL"}
    it = textlogs.iteration_times(lines, ["file"], "line_no")
    assert sorted((r.iteration, r.ms) for r in it.collect()) == [(1, 10.5), (2, 20.5)]
    m = textlogs.metric_alternatives(lines, "line", [(r"loss=" + textlogs.NUMBER, 1, 0)]).collect()
    assert len(m) == 1 and m[0].loss != m[0].loss


def test_large_files_are_numbered_across_ranges(spark, tmp_path):
    for name, n in (("a.log", 3000), ("b.log", 7)):
        (tmp_path / name).write_text("".join(f"line {i}\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        d = textlogs.read_large_lines(spark, str(tmp_path / "*.log")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(d) == 3007
    assert all(r.line == f"line {r.line_no}" for r in d)


def test_markdown_and_hits(spark):
    d = spark.createDataFrame([("d", 1, "| a | ✓ (1/316) |"), ("d", 2, "|---|---|"), ("d", 3, "text TODO x")], "doc string, line_no long, line string")
    t = textlogs.markdown_table(d)
    assert [r.cells for r in t.collect()] == [["a", "✓ (1/316)"]]
    c = textlogs.verdict_cells(t.withColumn("cell", F.element_at("cells", 2)), "cell", {"✓": "detected"}).collect()[0]
    assert (c.verdict, c.detail) == ("detected", "1/316")
    hits = textlogs.pattern_hits(d, {"todo": "TODO", "bar": r"\|"}, "doc", max_hits=1)
    assert sorted((r.recipe, r.line_no) for r in hits.collect()) == [("bar", 1), ("todo", 3)]


def test_manifest_files(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    (tmp_path / "y.bin").write_bytes(b"de")
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    (tmp_path / "sub" / "deep" / "x.bin").write_bytes(b"other")
    (tmp_path / "sub" / "none.bin").write_bytes(b"")
    m = manifest.build_manifest(spark, str(tmp_path), "*.bin")
    got = {r.path: (r["size"], r.sha256) for r in m.collect()}
    assert got["x.bin"] == (3, hashlib.sha256(b"abc").hexdigest())
    assert got["sub/deep/x.bin"] == (5, hashlib.sha256(b"other").hexdigest()) and got["sub/none.bin"] == (0, hashlib.sha256(b"").hexdigest())
    exp = m.where(F.col("path") == "x.bin").unionByName(spark.createDataFrame([("z.bin", 1, "q")], m.schema))
    assert {r.path: r.status for r in manifest.verify_manifest(m, exp).collect()} == {
        "x.bin": "ok", "y.bin": "unexpected", "sub/deep/x.bin": "unexpected", "sub/none.bin": "unexpected", "z.bin": "missing"}


def test_result_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    for fmt in ("csv", "json", "parquet"):
        traces.write_results(df, str(tmp_path / fmt), fmt)
        traces.write_results(df, str(tmp_path / fmt), fmt)
    assert traces.read_results(spark, str(tmp_path / "csv"), "n int, s string").count() == 4
    assert traces.read_results(spark, str(tmp_path / "json"), "n int, s string", "json").count() == 4
    with pytest.raises(ValueError):
        traces.write_results(df, str(tmp_path / "x"), "xml")


def test_table_catalog(spark):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    assert [(r.column_name, r.data_type) for r in traces.table_catalog(spark, {"t": df}).orderBy("position").collect()] == [("n", "int"), ("s", "string")]


def test_file_sets_round_trip_and_only_committed_files_are_read(spark, tmp_path):
    import os

    from guardlens.sources import filesets
    rows = [(f"n{k % 3}", k, f"line {k} é") for k in range(200)] + [("n1", 500, None), ("n2", 501, "")]
    df = spark.createDataFrame(rows, "who string, at int, text string").repartition(7)
    for gz in (False, True):
        folder = str(tmp_path / f"set{gz}")
        m = filesets.write_files(df, folder, "who", "text", ["at"], part=F.col("at") % 2, header="h", suffix=".txt.gz" if gz else ".txt", gzip=gz)
        assert m.count() == 6 and m.agg(F.sum("n_lines")).first()[0] == 202
        with open(f"{folder}/data/stray.txt", "w") as f:  # of an attempt that did not count
            f.write("nothing\n")
        got = sorted((r.name, r.part, r.line_no, r.line) for r in filesets.read_files(spark, folder, header=True).collect())
        want = []
        for who in ("n0", "n1", "n2"):
            for part in (0, 1):
                mine = sorted((a, t or "") for w, a, t in rows if w == who and a % 2 == part)
                want += [(who, part, i, t) for i, (_, t) in enumerate(mine)]
        assert got == want
        one = m.first()
        stored = {r.path: (r.size, r.sha256) for r in filesets.digests(spark, folder, "*.txt*").collect()}
        assert stored[f"data/{one.file}"] == (one.size, one.sha256) and len(stored) == 7
        with open(f"{folder}/data/{one.file}", "ab") as f:
            f.write(b"more\n")
        with pytest.raises(Exception, match="manifest"):
            filesets.read_files(spark, folder).count()
    assert os.path.exists(f"{folder}/manifest")


def test_digests_of_large_and_nested_files(spark, tmp_path):
    import hashlib
    import os

    from guardlens.sources import filesets
    os.makedirs(tmp_path / "a" / "b c")
    (tmp_path / "a" / "b c" / "x.bin").write_bytes(bytes(range(256)) * 50)
    (tmp_path / "empty").write_bytes(b"")
    with open(tmp_path / "big", "wb") as f:  # sparse: beyond two gigabytes, but no disk
        f.truncate((2 << 30) + 5)
    got = {r.path: (r.size, r.sha256) for r in filesets.digests(spark, str(tmp_path)).collect()}
    zeros = hashlib.sha256()
    for _ in range(2048):
        zeros.update(bytes(1 << 20))
    zeros.update(bytes(5))
    assert got == {"a/b c/x.bin": (12800, hashlib.sha256(bytes(range(256)) * 50).hexdigest()), "empty": (0, hashlib.sha256(b"").hexdigest()), "big": ((2 << 30) + 5, zeros.hexdigest())}
    tree = {r.path: (r.n_chunks, r.tree_sha256) for r in filesets.chunk_digests(spark, str(tmp_path / "a"), chunk=5000).collect()}
    data = bytes(range(256)) * 50
    assert tree == {"b c/x.bin": (3, hashlib.sha256(b"".join(hashlib.sha256(data[i:i + 5000]).digest() for i in range(0, 12800, 5000))).hexdigest())}


def test_records_after_braces_that_never_close(spark):
    texts = ['a { 6" wide {"name":"a","sql":"b"} end', '{ { {"name":"c","sql":"}{"}', '"{"name":"d","sql":"q"}" {', 'x {"name":"e","sql":"\\"{"} {"o":{"name":1}} }{', '{"name":"g","in":{"sql":"h"}}{"name":"i","sql":"j"}']
    got = list(textlogs._objects(pd.Series(texts)))
    assert got == [['{"name":"a","sql":"b"}'], ['{"name":"c","sql":"}{"}'], ['{"name":"d","sql":"q"}'], ['{"name":"e","sql":"\\"{"}', '{"o":{"name":1}}'], ['{"name":"g","in":{"sql":"h"}}', '{"name":"i","sql":"j"}']]
    assert len(list(textlogs._objects(pd.Series(["{" * 200_000 + '{"a":1}'])))[0]) == 1
