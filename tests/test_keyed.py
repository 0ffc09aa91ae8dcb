"""Groups with state and timers, batch by batch."""

import pytest
from pyspark.sql import functions as F

from guardlens.session import work_folder
from guardlens.streaming.keyed import Votes
from guardlens.streaming.online import BatchState


@pytest.fixture
def votes(spark):
    def run(batches, twice=False, **kw):
        h = Votes(BatchState(spark, work_folder(spark, "votes")), ["k"], "v", **kw)
        for i, rows in enumerate(batches):
            d = spark.createDataFrame(rows, "k string, v string, s long").withColumn("ts", F.timestamp_seconds("s"))
            for _ in range(2 if twice else 1):
                h(d, i)
        return sorted(map(tuple, h.finished().collect()), key=str)
    return run


def test_degree_end_and_late(votes):
    got = votes([[("a", "x", 1), ("a", "y", 2), ("b", "x", 3), (None, None, 3)], [("a", "z", 4), (None, "q", 5), ("c", "x", 5)]], degree=2, twice=True)
    assert got == sorted([("a", 2, "x", "y", "degree"), ("a", 1, None, None, "late"), (None, 2, "q", "q", "degree"), ("b", 1, "x", "x", "end"), ("c", 1, "x", "x", "end")], key=str)


def test_timer_clears_and_rows_behind_the_watermark_are_reported(votes):
    got = votes([[("a", "x", 10)], [("b", "y", 100)], [("a", "z", 50), ("c", "x", 101)], [("d", "x", 300)]], wait="60 seconds", lateness="0 seconds")
    assert got == sorted([("a", 1, "x", "x", "timer"), ("a", 1, None, None, "late"), ("b", 1, "y", "y", "timer"), ("c", 1, "x", "x", "timer"), ("d", 1, "x", "x", "end")], key=str)


def test_parts_equal_whole(votes, spark):
    rows = [(str(i % 7), str(i * 31 % 5), i) for i in range(60)]
    whole = votes([rows], wait="1 day")
    assert whole == votes([rows[:20], rows[20:21], rows[21:]], wait="1 day")


def test_no_group_is_handled_by_python(spark):
    h = Votes(BatchState(spark, work_folder(spark, "votes")), ["k"], "v", degree=3, lateness="1 day")
    d = spark.range(1000).select((F.col("id") % 400).alias("k"), F.lit("x").alias("v"), F.timestamp_seconds("id").alias("ts"))
    for i in (0, 1):
        h(d, i)
    plan = h.finished()._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert {r.closed_by for r in h.finished().collect()} == {"degree", "late"}
