"""Checks over replicated / sharded state (tensor-state dumps or any keyed state table).

All operators are column-parameterised: ``entity`` is the list of key columns of one logical
object, ``replica`` the integer replica number, ``value`` the compared column.

Skew: values are pre-counted per (entity, value) before the entity-level reduction, so an
entity holding a large share of all rows collapses to its distinct values first. Replica
sets are bit masks of fixed width (``degree`` bits), never collected lists. Checks over several columns
are dealt over tasks by the number of rows, as they have about as many groups as rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlens.functions import exprs as X
from guardlens.session import spread

BITS = 62


def degree_of(df: DataFrame, replica: str, degree: int | None = None) -> int:
    """Number of replicas that masks must hold: the largest number in the data counts, also beyond ``degree``."""
    top = df.agg(F.max(F.col(replica).cast("long"))).first()[0]
    return max(degree or 1, (top if top is not None else -1) + 1)


def masks(replica: str, degree: int) -> list[Column]:
    """Aggregates giving the set of replica numbers in [0, degree) as bit words."""
    out = []
    for w in range((degree + BITS - 1) // BITS):
        r = F.col(replica).cast("long") - w * BITS
        bit = F.when((r >= 0) & (r < BITS), F.call_function("shiftleft", F.lit(1).cast("long"), r.cast("int")))
        out.append(F.coalesce(F.bit_or(bit), F.lit(0).cast("long")).alias(f"__m{w}"))
    return out


def mask_members(degree: int, present: bool = True) -> Column:
    """Sorted array of the replica numbers set (or missing) in the mask columns."""
    parts = []
    for w in range((degree + BITS - 1) // BITS):
        last = min(BITS, degree - w * BITS) - 1
        m = F.col(f"__m{w}")
        parts.append(F.transform(_pick(F.sequence(F.lit(0), F.lit(last)), m, present),
                                 _shift(w * BITS)))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _pick(seq: Column, m: Column, present: bool) -> Column:
    return F.filter(seq, lambda i: F.getbit(m, i) == (1 if present else 0))


def _shift(base: int):
    return lambda i: (i + base).cast("int")


def mask_size(degree: int) -> Column:
    n = (degree + BITS - 1) // BITS
    total = F.bit_count(F.col("__m0"))
    for w in range(1, n):
        total = total + F.bit_count(F.col(f"__m{w}"))
    return total


def value_groups(df: DataFrame, entity: Sequence[str], value: str, replica: str | None = None,
                 guard: Column | None = None) -> DataFrame:
    """Per entity: rows, distinct non-NULL values, extremes, and replica extremes."""
    d = df if guard is None else df.where(guard)
    inner = [F.count(F.lit(1)).alias("__c")]
    outer = [F.count_if(F.col("__v").isNotNull()).alias("n_values"), F.sum("__c").alias("n_rows"),
             F.min("__v").alias("min_value"), F.max("__v").alias("max_value")]
    if replica:
        inner += [F.min(replica).alias("__r0"), F.max(replica).alias("__r1")]
        outer += [F.min("__r0").alias("min_replica"), F.max("__r1").alias("max_replica")]
    return d.groupBy(*entity, F.col(value).alias("__v")).agg(*inner).groupBy(*entity).agg(*outer)


def replica_equality(df: DataFrame, entity: Sequence[str], value: str, replica: str | None = None,
                     guard: Column | None = None) -> DataFrame:
    """Entities whose replicas disagree on the value (NULL values are ignored)."""
    g = value_groups(df, entity, value, replica, guard).where(F.col("n_values") > 1)
    return g if replica is None else g.where(F.col("min_replica") < F.col("max_replica"))


def replica_difference(df: DataFrame, entity: Sequence[str], value: str, replica: str,
                       guard: Column | None = None) -> DataFrame:
    """Shards that must differ but all carry the same value on two or more replicas."""
    g = value_groups(df, entity, value, replica, guard)
    return g.where((F.col("n_values") == 1) & (F.col("min_replica") < F.col("max_replica")))


def replica_equality_multi(df: DataFrame, entity: Sequence[str], replica: str, values: Sequence[str], degree: int | None = None,
                           guard: Column | None = None) -> DataFrame:
    """Several value columns at once with a typed inconsistency label and the replica list."""
    d = df if guard is None else df.where(guard)
    degree = degree_of(d, replica, degree)
    words = [f"__m{w}" for w in range((degree + BITS - 1) // BITS)]
    # replicas that agree collapse to one row before the distinct counts expand anything
    rows = d.count()
    pre = spread(d, rows, *entity, *values).groupBy(*entity, *values).agg(*masks(replica, degree), F.count(F.lit(1)).alias("__c"))
    # the values of an entity are counted where its combinations lie
    pairs = F.array(*[F.struct(F.lit(i).alias("__a"), F.col(v).cast("string").alias("__v")) for i, v in enumerate(values)])
    one = (spread(pre, rows, *entity).select(*entity, *words, "__c", F.inline(pairs)).groupBy(*entity, "__a", "__v")
           .agg(*[F.bit_or(w).alias(w) for w in words], F.sum("__c").alias("__c")))
    g = one.groupBy(*entity).agg(*[F.bit_or(w).alias(w) for w in words], F.sum(F.when(F.col("__a") == 0, F.col("__c"))).alias("n_rows"),
                                 *[F.count_if((F.col("__a") == i) & F.col("__v").isNotNull()).alias(f"n_{v}") for i, v in enumerate(values)])
    g = g.withColumn("n_replicas", mask_size(degree).cast("long"))
    every = F.lit(True)
    for v in values:
        every = every & (F.col(f"n_{v}") > 1)
    label = F.when(every, F.lit("both_inconsistent" if len(values) == 2 else "all_inconsistent")) if len(values) > 1 else None
    for v in values:
        cond = F.col(f"n_{v}") > 1
        label = F.when(cond, F.lit(f"{v}_inconsistent")) if label is None else label.when(cond, F.lit(f"{v}_inconsistent"))
    return (g.withColumn("inconsistency_type", label.otherwise(F.lit("consistent")))
            .where((F.col("n_replicas") > 1) & (F.col("inconsistency_type") != "consistent"))
            .select(*entity, "n_replicas", "n_rows", *[f"n_{v}" for v in values], "inconsistency_type",
                    F.array_join(mask_members(degree).cast("array<string>"), ",").alias("replicas")))


def replica_evidence(df: DataFrame, entity: Sequence[str], value: str, replica: str,
                     violating: DataFrame) -> DataFrame:
    """Long form of a disagreement: one row per (entity, value) with its replicas' extent."""
    d = df.join(violating.select(*entity), list(entity), "left_semi")
    return d.groupBy(*entity, value).agg(F.count(F.lit(1)).alias("n_rows"), F.min(replica).alias("first_replica"),
                                         F.max(replica).alias("last_replica"))


def attribute_consistency(df: DataFrame, entity: Sequence[str], attributes: Sequence[str],
                          guard: Column | None = None) -> DataFrame:
    """One row per (entity, attribute) whose replicas disagree on that attribute."""
    d = df if guard is None else df.where(guard)
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("__v")) for a in attributes])
    # replicas that agree on all attributes collapse to one row before the attributes are spread
    rows = d.count()
    pre = spread(d, rows, *entity, *attributes).groupBy(*entity, *attributes).agg(F.count(F.lit(1)).alias("__n"))
    # one row for each combination an entity has: all its attributes are counted where it lies
    long = spread(pre, rows, *entity).select(*entity, "__n", F.inline(pairs)).where(F.col("__v").isNotNull())
    return (long.groupBy(*entity, "attribute", "__v").agg(F.sum("__n").alias("__c"))
            .groupBy(*entity, "attribute").agg(F.count(F.lit(1)).alias("n_values"), F.sum("__c").alias("n_rows"))
            .where(F.col("n_values") > 1))


def existence_consistency(df: DataFrame, entity: Sequence[str], value: str) -> DataFrame:
    """Value present on some rows of the entity and missing on others."""
    g = df.groupBy(*entity).agg(F.count(F.lit(1)).alias("n_rows"),
                                F.count_if(F.col(value).isNull()).alias("n_missing"))
    return g.where((F.col("n_missing") > 0) & (F.col("n_missing") < F.col("n_rows")))


def completeness(df: DataFrame, entity: Sequence[str], replica: str, degree: int) -> DataFrame:
    """Expected replicas [0, degree) that an entity lacks; one bit-mask aggregate, no grid join."""
    g = df.groupBy(*entity).agg(*masks(replica, degree))
    return g.select(*entity, F.explode(mask_members(degree, present=False)).alias("missing_replica"))


def replica_set_report(df: DataFrame, entity: Sequence[str], replica: str, degree: int) -> DataFrame:
    """(entity, replica, problem): expected replicas [0, degree) that an entity lacks, and numbers outside that it has (null too)."""
    r = F.col(replica).cast("long")
    lacks = completeness(df, entity, replica, degree).select(*entity, F.col("missing_replica").cast("long").alias("replica"), F.lit("missing").alias("problem"))
    other = df.where(r.isNull() | (r < 0) | (r >= degree)).groupBy(*entity, r.alias("replica")).agg(F.lit("unexpected").alias("problem"))
    return lacks.unionByName(other.select(*entity, "replica", "problem"))


def distribution_consistency(df: DataFrame, entity: Sequence[str], stats: Sequence[str], tolerance: float) -> DataFrame:
    """Statistics whose spread over the replicas of an entity exceeds the tolerance."""
    aggs = [a for s in stats for a in (F.min(s).alias(f"__lo_{s}"), F.max(s).alias(f"__hi_{s}"))]
    g = df.groupBy(*entity).agg(*aggs)
    long = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(f"__lo_{s}").cast("double").alias("lo"),
                              F.col(f"__hi_{s}").cast("double").alias("hi")) for s in stats])
    return (g.select(*entity, F.inline(long)).withColumn("spread", F.col("hi") - F.col("lo"))
            .where(F.col("spread") > tolerance).select(*entity, "stat", "spread"))


def shard_distribution_similarity(df: DataFrame, group: Sequence[str], shard: str, stat: str, ratio: float) -> DataFrame:
    """Shards whose mean statistic departs from the group's mean of shard means by a factor.

    Rows reduce to one per (group, shard) first, so the comparison runs over shards only.
    """
    per = df.groupBy(*group, shard).agg(F.avg(stat).alias("shard_mean"), F.count(F.lit(1)).alias("n_rows"))
    mid = per.groupBy(*group).agg(F.percentile("shard_mean", 0.5).alias("group_median"),
                                  F.count(F.lit(1)).alias("n_shards"))
    return (per.join(mid, list(group)).withColumn("deviation", X.symmetric_ratio("shard_mean", "group_median"))
            .where((F.col("n_shards") > 1) & (F.col("deviation") > ratio)))


def boundary_continuity(df: DataFrame, group: Sequence[str], shard: str, low: str, high: str, jump: float) -> DataFrame:
    """Adjacent shards where the edge statistic jumps: |low of shard - high of the one before| > jump."""
    from pyspark.sql import Window
    per = df.groupBy(*group, shard).agg(F.min(low).alias("low"), F.max(high).alias("high"))
    w = Window.partitionBy(*group).orderBy(shard)  # at most one row per shard after the reduction
    d = per.withColumn("prev_high", F.lag("high").over(w)).withColumn("prev_shard", F.lag(shard).over(w))
    return (d.withColumn("gap", F.abs(F.col("low") - F.col("prev_high"))).where(F.col("gap") > jump)
            .select(*group, "prev_shard", shard, "prev_high", "low", "gap"))


def numeric_health(df: DataFrame, keys: Sequence[str], stats: Sequence[str], lo: float | None = None,
                   hi: float | None = None) -> DataFrame:
    """NaN / Inf / out-of-range statistics in long form, one scan."""
    def issue(v: Column) -> Column:
        c = F.when(F.isnan(v), "NaN").when(X.is_inf(v), "Inf")
        if lo is not None:
            c = c.when(v < lo, "below range")
        if hi is not None:
            c = c.when(v > hi, "above range")
        return c
    rows = F.filter(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("observed"),
                                       issue(F.col(s).cast("double")).alias("issue")) for s in stats]),
                    lambda x: x.issue.isNotNull())
    return df.select(*keys, F.inline(rows))


def shape_report(df: DataFrame, entity: Sequence[str], shape: str, value: str) -> DataFrame:
    """Counts of entities that are consistent, differ in value, or differ in shape."""
    g = df.groupBy(*entity).agg(F.count_distinct(shape).alias("s"), F.count_distinct(value).alias("v"),
                                F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    status = F.when(F.col("s") > 1, "shape_mismatch").when(F.col("v") > 1, "value_mismatch").otherwise("consistent")
    return g.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n_entities"))


def threshold_consistency(df: DataFrame, entity: Sequence[str], value: str, threshold: float) -> DataFrame:
    """Entities whose sample standard deviation exceeds the threshold times their mean."""
    g = df.groupBy(*entity).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
                                F.count(F.lit(1)).alias("n_rows"))
    return g.where(F.col("sd") > F.col("mean") * threshold)


def verdict(result_counts: DataFrame, kind: str, n: str = "n_rows", expected: str | None = None) -> DataFrame:
    """Status of one constraint result by constraint type.

    Consistency, partition and validity fail on any row; completeness compares with the expected
    count and warns when none was declared.
    """
    rows = F.col(n)
    if kind == "completeness":
        status = (F.when(F.col(expected).isNull(), "warning").when(rows == F.col(expected), "pass").otherwise("fail")
                  if expected else F.lit("warning"))
    elif kind in ("consistency", "partition", "validity"):
        status = F.when(rows > 0, "fail").otherwise("pass")
    else:
        status = F.lit("error")
    return result_counts.withColumn("status", status)
