"""Joins, set operations, dedup, top-k, and grouped aggregates shared by the analytics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def set_diff(now: DataFrame, before: DataFrame, keys: Sequence[str]) -> DataFrame:
    """new / retired / persistent keys between two key sets, by one full outer join."""
    a = now.select(*keys).distinct().withColumn("__now", F.lit(1))
    b = before.select(*keys).distinct().withColumn("__old", F.lit(1))
    change = (F.when(F.col("__old").isNull(), "new").when(F.col("__now").isNull(), "retired").otherwise("persistent"))
    return a.join(b, list(keys), "full_outer").select(*keys, change.alias("change"))


def new_keys(now: DataFrame, before: DataFrame, keys: Sequence[str]) -> DataFrame:
    return now.select(*keys).distinct().join(before.select(*keys), list(keys), "left_anti")


def retired_keys(now: DataFrame, before: DataFrame, keys: Sequence[str]) -> DataFrame:
    return new_keys(before, now, keys)


def keep_first(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """First row per key. The row_number filter becomes a per-task limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def top_k(df: DataFrame, keys: Sequence[str], k: int, *order: Column | str, out: str | None = None) -> DataFrame:
    """First k rows per key; hot keys are cut to k rows per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn(out or "__rn", F.row_number().over(w)).where(F.col(out or "__rn") <= k)
    return d if out else d.drop("__rn")


def union_first_wins(sources: Sequence[DataFrame], keys: Sequence[str], *order: Column | str) -> DataFrame:
    """Union of sources keeping, per key, the row of the earliest source."""
    tagged = [s.withColumn("__src", F.lit(i)) for i, s in enumerate(sources)]
    u = tagged[0]
    for t in tagged[1:]:
        u = u.unionByName(t)
    return keep_first(u, keys, F.col("__src"), *order).drop("__src")


def value_per_group(df: DataFrame, keys: Sequence[str], value: str, order: str, latest: bool = True,
                    out: str = "value") -> DataFrame:
    agg = F.max_by(value, order) if latest else F.min_by(value, order)
    return df.groupBy(*keys).agg(agg.alias(out))


def majority_minority(df: DataFrame, keys: Sequence[str], value: str, position: str) -> DataFrame:
    """Outlier position per group: where the unique minority value first appears.

    NULL when all values agree, when two members disagree, or when majority and minority tie.
    The minority is the rarest value; among equally rare ones the value that appears last.
    """
    c = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"), F.min(position).alias("__p"))
    g = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values"), F.sum("__c").alias("n_members"),
                             F.max("__c").alias("__hi"), F.min("__c").alias("__lo"),
                             F.max_by("__p", F.struct(-F.col("__c"), F.col("__p"))).alias("__out"))
    ok = (F.col("n_values") > 1) & (F.col("n_members") > 2) & (F.col("__lo") < F.col("__hi"))
    return g.select(*keys, "n_values", "n_members", F.when(ok, F.col("__out")).alias("outlier"))


def fingerprint(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Order-independent content fingerprint: count and 60-bit hash sum and xor of whole rows.

    Sums and xors commute, so they combine map-side; no list of rows is ever built.
    """
    row = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns])
    h = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("long")
    return df.withColumn("__h", h).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("__h").cast("decimal(38,0)")).cast("string").alias("hash_sum"),
        F.bit_xor("__h").alias("hash_xor"))


def counted_pivot(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """One conditional count per known category; a single aggregate without a pivot shuffle."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def rollup_totals(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], total: str = "TOTAL") -> DataFrame:
    """Grouped aggregates with subtotal rows; rolled-up keys read ``total``."""
    g = df.rollup(*keys).agg(*[a.alias(n) for n, a in aggs.items()],
                             *[F.grouping(k).alias(f"__g_{k}") for k in keys])
    cols = [F.when(F.col(f"__g_{k}") == 1, F.lit(total)).otherwise(F.col(k).cast("string")).alias(k) for k in keys]
    return g.select(*cols, *aggs.keys())


def rate_per_million(violations: Column, evaluations: Column) -> Column:
    return violations.cast("double") * 1e6 / F.nullif(evaluations.cast("double"), F.lit(0.0))


def distinct_list(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sorted list of the distinct non-NULL values of any type, and their number, per group.

    Equal values collapse in each task before the list is gathered, so a hot group holds its distinct values only.
    """
    once = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return once.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("members"), F.count(F.lit(1)).alias("n_members"))
