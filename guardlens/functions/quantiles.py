"""Exact quantiles for groups of any size.

``percentile``/``median`` keep every distinct value of a group in one aggregation buffer. Here
the wanted rank is narrowed down in three combinable passes over (group, value):

1. a mergeable sketch gives cut points that bracket the rank (about 5 / grid of the group);
2. counts of equal-width bins inside the bracket find the single bin that holds the rank;
3. only that bin's values, pre-counted per value, are ranked exactly.

The last step sees about 5 / (grid * bins) of a group, so no task grows with a hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pick(method: str, p: float, n: Column) -> tuple[Column, Column, Column]:
    """0-based lower rank, upper rank and the weight of the upper one."""
    if method == "linear":
        pos = F.lit(float(p)) * (n - 1).cast("double")
        return F.floor(pos), F.ceil(pos), pos - F.floor(pos)
    if method == "index_n_minus_1":
        k = F.floor(F.lit(float(p)) * (n - 1).cast("double") + 1e-12)
    elif method == "index_n":
        k = F.least(F.floor(F.lit(float(p)) * n.cast("double") + 1e-12), n - 1)
    else:
        raise ValueError(f"unknown rank method {method!r}")
    return k, k, F.lit(0.0)


def _with_group_values(df: DataFrame, per_group: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Attach one row of values per group: a join on the keys, or scalars without keys."""
    if not by:
        for c in columns:
            df = df.withColumn(c, per_group.select(c).scalar())
        return df
    right = per_group.select(*[F.col(k).alias(f"__r_{k}") for k in by], *columns)
    cond = F.lit(True)
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return df.join(right, cond).drop(*[f"__r_{k}" for k in by])


def exact_quantile(df: DataFrame, by: list[str], value: str, p: float, out: str = "quantile",
                   method: str = "linear", grid: int = 256, bins: int = 1024, small: int = 100_000) -> DataFrame:
    """One row per group: ``by``, ``n`` and the exact quantile of the non-NULL values.

    ``linear`` interpolates (median = mean of the middle two); ``index_n_minus_1`` and
    ``index_n`` pick the value at ``int(p*(n-1))`` / ``int(p*n)`` without interpolation.

    The largest group is counted first: when it holds at most ``small`` values, one aggregation
    buffer per group is safe and a single pass is planned; otherwise the three passes run
    (``small=0`` always takes them). The input is read several times, so cut expensive inputs.
    """
    d = df.select(*by, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    if small and (d.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= small:
        return _single_pass(d, by, p, out, method)
    probs = [i / grid for i in range(grid + 1)]
    sketch = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"),
                                F.percentile_approx("__v", probs, grid * 10).alias("__cuts"))
    k0, k1, w = _pick(method, p, F.col("n"))
    lo_i = F.floor(k0 * grid / F.col("n")).cast("int") - 2
    hi_i = F.ceil((k1 + 1) * grid / F.col("n")).cast("int") + 2
    bounds = sketch.select(
        *by, "n", k0.cast("long").alias("__k0"), k1.cast("long").alias("__k1"), w.alias("__w"),
        F.when(lo_i >= 0, F.get("__cuts", lo_i)).otherwise(F.col("__min")).alias("__lo"),
        F.when(hi_i <= grid, F.get("__cuts", hi_i)).otherwise(F.col("__max")).alias("__hi"))

    # bin -1 holds everything below the bracket; infinite widths fall into one bin and stay exact
    lo, hi, v = F.col("__lo"), F.col("__hi"), F.col("__v")
    width = hi - lo
    usable = (width > 0) & (width < F.lit(float("inf")))
    inner = F.when(usable, F.least(F.floor((v - lo) / width * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    binned = (_with_group_values(d, bounds, by, ["__lo", "__hi"]).where(v <= hi)
              .select(*by, "__v", F.when(v < lo, F.lit(-1)).otherwise(inner).alias("__bin")))
    sizes = binned.groupBy(*by, "__bin").agg(F.count(F.lit(1)).alias("__c"))
    up_to = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)  # <= bins + 1 rows per group
    cum = _with_group_values(sizes.withColumn("__cum", F.sum("__c").over(up_to)), bounds, by, ["n", "__k0", "__k1", "__w"])
    first = lambda k: F.min(F.when(F.col("__cum") > F.col(k), F.struct("__bin", (F.col("__cum") - F.col("__c")).alias("base"))))
    where = cum.groupBy(*by).agg(F.first("n").alias("n"), F.first("__k0").alias("__k0"), F.first("__k1").alias("__k1"),
                                 F.first("__w").alias("__w"), first("__k0").alias("__s0"), first("__k1").alias("__s1"))

    target = _with_group_values(binned, where, by, ["n", "__k0", "__k1", "__w", "__s0", "__s1"])
    target = target.where((F.col("__bin") == F.col("__s0.__bin")) | (F.col("__bin") == F.col("__s1.__bin")))
    counted = target.groupBy(*by, "__bin", "__v").agg(
        F.count(F.lit(1)).alias("__c"), *[F.first(c).alias(c) for c in ("n", "__k0", "__k1", "__w", "__s0", "__s1")])
    inside = Window.partitionBy(*by, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    base = F.when(F.col("__bin") == F.col("__s0.__bin"), F.col("__s0.base")).otherwise(F.col("__s1.base"))
    ranked = counted.withColumn("__cum", base + F.sum("__c").over(inside))
    hit = lambda k, s: F.min(F.when((F.col("__bin") == F.col(f"{s}.__bin")) & (F.col("__cum") > F.col(k)), F.col("__v")))
    picked = ranked.groupBy(*by).agg(F.first("n").alias("n"), F.first("__w").alias("__w"),
                                     hit("__k0", "__s0").alias("__a"), hit("__k1", "__s1").alias("__b"),
                                     F.min(F.least("__s0.__bin", "__s1.__bin")).alias("__low"))
    result = F.col("__a") + F.when(F.col("__w") > 0, (F.col("__b") - F.col("__a")) * F.col("__w")).otherwise(0.0)
    missed = (F.col("__low") < 0) | F.col("__a").isNull() | F.col("__b").isNull()
    checked = F.when(missed, F.raise_error(F.lit("quantile bracket missed the wanted rank")).cast("double")).otherwise(result)
    return picked.where(F.col("n").isNotNull()).select(*by, "n", checked.alias(out))


def _single_pass(d: DataFrame, by: list[str], p: float, out: str, method: str) -> DataFrame:
    """Groups of checked size: every value of a group fits one buffer."""
    if method == "linear":
        g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile("__v", p).alias(out))
        return g.where(F.col("n") > 0)
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("__v")).alias("__s")).where(F.col("n") > 0)
    k = _pick(method, p, F.col("n"))[0]
    return g.select(*by, "n", F.get("__s", k.cast("int")).alias(out))


def exact_median(df: DataFrame, by: list[str], value: str, out: str = "median", grid: int = 256,
                 small: int = 100_000) -> DataFrame:
    return exact_quantile(df, by, value, 0.5, out, "linear", grid, small=small)
