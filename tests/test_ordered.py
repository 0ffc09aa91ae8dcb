"""Two-level ordered functions and exact quantiles against brute force, with hot groups."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from guardlens.functions import ordered
from guardlens.functions import quantiles as Q
from guardlens.functions.ordered import Order

SPANS = [1, 3, 7, 1000]


def rows(seed, n=400):
    """One group holds most rows, ids are sparse, some values are missing, one key is NULL."""
    r = random.Random(seed)
    ids = r.sample(range(-500, 5000), n)
    return [(r.choice(["hot"] * 6 + ["a", "b", None]), i, r.choice([None, 1.0, 2.0, 3.5, r.random()])) for i in ids]


@pytest.fixture(params=SPANS)
def data(request, spark):
    rs = rows(request.param)
    df = spark.createDataFrame(rs, "g string, id long, v double")
    return rs, df, Order(("g",), "id", (), request.param)


def groups(rs):
    out = {}
    for g, i, v in sorted(rs, key=lambda x: x[1]):
        out.setdefault(g, []).append((i, v))
    return out


def test_ordinal_previous_running_carry(data):
    rs, df, o = data
    d = ordered.with_ordinal(df, o, "n")
    d = ordered.with_previous(d, "v", o, "p")
    d = ordered.running_sums(d, {"s": F.col("v"), "c": F.lit(1)}, o)
    d = ordered.carry_forward(d, F.col("v"), o, "c1")
    d = ordered.carry_forward(d, F.col("v"), o, "c0", inclusive=False)
    got = {(r.g, r.id): r for r in d.collect()}
    assert len(got) == len(rs)
    for g, xs in groups(rs).items():
        total, last = 0.0, None
        for k, (i, v) in enumerate(xs):
            r = got[(g, i)]
            assert r.n == k + 1 and r.c == k + 1
            assert r.p == (xs[k - 1][1] if k else None)
            assert r.c0 == last
            total += v or 0.0
            last = v if v is not None else last
            assert r.c1 == last
            assert math.isclose(r.s, total, abs_tol=1e-9)


def test_trailing_and_neighbours(data):
    rs, df, o = data
    d = ordered.trailing(df, o, 5, {"m": F.max("v"), "k": F.count(F.lit(1))}, chunk=6)
    got = {(r.g, r.id): r for r in d.collect()}
    by = groups(rs)
    for g, xs in by.items():
        for k, (i, _) in enumerate(xs):
            window = xs[max(0, k - 5):k]
            vals = [v for _, v in window if v is not None]
            assert got[(g, i)].k == len(window)
            assert got[(g, i)].m == (max(vals) if vals else None)
    marks = df.where((F.col("v") == 3.5) & F.col("g").isNotNull()).select("g", "id", F.col("id").alias("mark"))
    near = {(r.g, r.mark, r.id, r.offset) for r in ordered.neighbours(df, o, 2, 1, marks, ["mark"]).collect()}
    want = set()
    for g, xs in by.items():
        for k, (i, v) in enumerate(xs):
            if v == 3.5 and g is not None:
                want |= {(g, i, xs[j][0], j - k) for j in range(max(0, k - 2), min(len(xs), k + 2)) if j != k}
    assert near == want


def test_trailing_rejects_short_chunk(spark):
    df = spark.createDataFrame([("a", 1, 1.0)], "g string, id long, v double")
    with pytest.raises(ValueError):
        ordered.trailing(df, Order(("g",), "id"), 20, {"m": F.max("v")}, chunk=20)


@pytest.mark.parametrize("kind", ["uniform", "heavy", "atoms", "special"])
@pytest.mark.parametrize("grid,bins,small", [(8, 4, 0), (256, 1024, 0), (256, 1024, 100_000)])
def test_exact_quantile(spark, kind, grid, bins, small):
    r = random.Random(hash(kind) % 1000)
    draw = {"uniform": r.random, "heavy": lambda: math.exp(r.gauss(0, 8)), "atoms": lambda: float(r.choice([1, 1, 1, 2, 3])),
            "special": lambda: r.choice([float("inf"), -float("inf"), r.random(), 0.0])}[kind]
    rs = [(r.choice(["hot"] * 9 + ["b"]), draw()) for _ in range(700)] + [("one", 5.0), ("two", 1.0), ("two", 2.0), (None, 4.0)]
    df = spark.createDataFrame(rs, "g string, v double")
    by = {}
    for g, v in rs:
        by.setdefault(g, []).append(v)
    picks = ((0.5, "linear"), (0.99, "index_n_minus_1"), (0.75, "index_n"), (0.0, "index_n"), (1.0, "linear"))
    for p, method in picks if grid == 8 else picks[:2]:
        got = {x.g: (x.n, x.q) for x in Q.exact_quantile(df, ["g"], "v", p, "q", method, grid, bins, small).collect()}
        assert set(got) == set(by)
        for g, vs in by.items():
            vs = sorted(vs)
            n = len(vs)
            if method == "linear":
                pos = p * (n - 1)
                a, b = vs[math.floor(pos)], vs[math.ceil(pos)]
                want = a if pos == math.floor(pos) else a + (b - a) * (pos - math.floor(pos))
            else:
                k = int(p * (n - 1) + 1e-12) if method == "index_n_minus_1" else min(int(p * n + 1e-12), n - 1)
                want = vs[k]
            assert got[g][0] == n
            assert got[g][1] == want or math.isclose(got[g][1], want, rel_tol=1e-12) or (math.isnan(want) and math.isnan(got[g][1]))
    one = Q.exact_median(df.where(F.col("g") == "hot"), [], "v", "m", grid, small).collect()
    assert len(one) == 1
    if kind != "special":
        assert math.isclose(one[0].m, statistics.median(by["hot"]), rel_tol=1e-12)


def test_hot_group_is_spread_over_tasks(spark):
    """All rows in one group still occupy many tasks."""
    df = spark.range(40_000).select(F.lit("hot").alias("g"), F.col("id"), F.col("id").cast("double").alias("v"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for d in (ordered.with_previous(df, "v", Order(("g",), "id", (), 500), "p"),
                  ordered.trailing(df, Order(("g",), "id", (), 500), 20, {"m": F.max("v")}, chunk=500)):
            d = d.withColumn("t", F.spark_partition_id())  # every column stays in use, so nothing is pruned away
            sizes = [r.n for r in d.groupBy("t").agg(F.count(F.lit(1)).alias("n"), *[F.max(c) for c in d.columns]).collect()]
            assert len(sizes) > 8 and max(sizes) < 40_000 / 4
    finally:
        for k, x in keep.items():
            spark.conf.set(k, x)
