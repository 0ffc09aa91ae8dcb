"""Ordered computations that never put one group into one task.

A plain ``Window.partitionBy(run, rank).orderBy(event_id)`` sends a whole rank to one
task; one rank may hold a third of the trace. Each function here works in two levels:

1. rows are cut into *buckets*, a fixed span of the order key (ids are unique, so a
   bucket of span W holds at most W rows per group), and a window runs inside a bucket;
2. each bucket is reduced to one summary row (combined before the shuffle), a window over
   the summaries carries the state across buckets, and the carried state is joined back
   on (group, bucket).

Level 2 is smaller than the input by the factor W. The join key is the key the level-1
window is already partitioned by, so the big side is not shuffled again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlens.session import cut

_B = "__bucket"


@dataclass(frozen=True)
class Order:
    """Grouping, order key (integral, unique with ``ties``) and key span per bucket."""

    by: tuple[str, ...]
    key: str
    ties: tuple[str, ...] = ()
    span: int = 1 << 20

    def bucketed(self, df: DataFrame) -> DataFrame:
        k = F.col(self.key).cast("long")
        w = F.lit(self.span).cast("long")
        return df.withColumn(_B, F.call_function("div", k - F.pmod(k, w), w))

    @property
    def keys(self) -> list[str]:
        return [*self.by, _B]

    @property
    def inside(self) -> Window:
        return Window.partitionBy(*self.keys).orderBy(self.key, *self.ties)

    @property
    def across(self) -> Window:
        # One row per bucket: the input of this window is the input size / span.
        return Window.partitionBy(*self.by).orderBy(_B) if self.by else Window.partitionBy(F.lit(0)).orderBy(_B)

    @property
    def position(self) -> Column:
        # a single column keeps max_by in hash aggregation; a struct would force sorting
        return F.struct(F.col(self.key), *[F.col(t) for t in self.ties]) if self.ties else F.col(self.key)


def _attach(df: DataFrame, summary: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """Left join of per-bucket state; NULL group keys match each other."""
    right = summary.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *carry)
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = c if cond is None else cond & c
    return df.join(right, cond, "left").drop(*[f"__r_{k}" for k in keys])


def with_ordinal(df: DataFrame, o: Order, out: str = "ordinal") -> DataFrame:
    """Exact 1-based row number of every row in its group."""
    b = o.bucketed(df)
    sizes = b.groupBy(*o.keys).agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.withColumn(
        "__off", F.coalesce(F.sum("__n").over(o.across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = b.withColumn("__rn", F.row_number().over(o.inside))
    return (_attach(local, offsets, o.keys, ["__off"])
            .withColumn(out, F.col("__rn") + F.coalesce(F.col("__off"), F.lit(0)))
            .drop("__rn", "__off", _B))


def with_previous(df: DataFrame, value: str, o: Order, out: str = "previous") -> DataFrame:
    """Value of the preceding row in the group (NULL on the first row)."""
    b = o.bucketed(df)
    tails = (b.groupBy(*o.keys).agg(F.max_by(F.col(value), o.position).alias("__tail"))
             .withColumn("__prev_tail", F.lag("__tail").over(o.across)))
    local = (b.withColumn("__rn", F.row_number().over(o.inside))
             .withColumn("__lag", F.lag(value).over(o.inside)))
    return (_attach(local, tails, o.keys, ["__prev_tail"])
            .withColumn(out, F.when(F.col("__rn") > 1, F.col("__lag")).otherwise(F.col("__prev_tail")))
            .drop("__rn", "__lag", "__prev_tail", _B))


def running_sums(df: DataFrame, values: dict[str, Column], o: Order, inclusive: bool = True) -> DataFrame:
    """Cumulative sums up to (and, if inclusive, with) the current row; NULL counts as 0."""
    b = o.bucketed(df)
    zero = F.lit(0)
    for n, c in values.items():
        b = b.withColumn(f"__v_{n}", F.coalesce(c, zero))
    before = o.across.rowsBetween(Window.unboundedPreceding, -1)
    totals = b.groupBy(*o.keys).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values])
    for n in values:
        totals = totals.withColumn(f"__off_{n}", F.sum(f"__t_{n}").over(before))
    local = o.inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    for n in values:
        b = b.withColumn(f"__loc_{n}", F.sum(f"__v_{n}").over(local))
    j = _attach(b, totals, o.keys, [f"__off_{n}" for n in values])
    for n in values:
        j = j.withColumn(n, F.coalesce(F.col(f"__loc_{n}"), zero) + F.coalesce(F.col(f"__off_{n}"), zero))
    return j.drop(*[f"{p}{n}" for n in values for p in ("__v_", "__loc_", "__off_")], _B)


def running_sum(df: DataFrame, value: Column, o: Order, out: str, inclusive: bool = True) -> DataFrame:
    return running_sums(df, {out: value}, o, inclusive)


def carry_forward(df: DataFrame, value: Column, o: Order, out: str, inclusive: bool = True,
                  is_set: Column | None = None) -> DataFrame:
    """Most recent value at or before (inclusive) / strictly before the row.

    Rows count as setting the value where it is non-NULL, or where ``is_set`` says so (a row may
    then set NULL, which clears the slot).
    """
    b = o.bucketed(df).withColumn("__v", value)
    b = b.withColumn("__set", F.col("__v").isNotNull() if is_set is None else F.coalesce(is_set, F.lit(False)))
    tails = b.groupBy(*o.keys).agg(F.max_by("__v", F.when(F.col("__set"), o.position)).alias("__tail"),
                                   F.max("__set").alias("__any"))
    slot = F.when(F.col("__any"), F.struct(F.col("__tail").alias("v")))
    state = tails.withColumn("__carried", F.last(slot, ignorenulls=True)
                             .over(o.across.rowsBetween(Window.unboundedPreceding, -1)))
    own = F.when(F.col("__set"), F.struct(F.col("__v").alias("v")))
    local = b.withColumn("__loc", F.last(own, ignorenulls=True)
                         .over(o.inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)))
    return (_attach(local, state, o.keys, ["__carried"])
            .withColumn(out, F.coalesce(F.col("__loc"), F.col("__carried")).getField("v"))
            .drop("__v", "__set", "__loc", "__carried", _B))


def trailing(df: DataFrame, o: Order, n: int, aggs: dict[str, Column], chunk: int = 1 << 16) -> DataFrame:
    """Aggregates over the ``n`` rows before the current one (current row excluded).

    Dense ordinals cut the group into chunks; the last ``n`` rows of a chunk are also sent
    to the next chunk, so every frame is complete inside one chunk.
    """
    if chunk <= n:
        raise ValueError("chunk must exceed the window length")
    d = with_ordinal(df, o, "__ord")
    pos = F.col("__ord") - 1
    cid = F.floor(pos / chunk).cast("long")
    copies = F.when(F.pmod(pos, F.lit(chunk)) >= chunk - n,
                    F.array(F.struct(cid.alias("c"), F.lit(False).alias("halo")),
                            F.struct((cid + 1).alias("c"), F.lit(True).alias("halo")))
                    ).otherwise(F.array(F.struct(cid.alias("c"), F.lit(False).alias("halo"))))
    d = d.withColumn("__cp", F.explode(copies)).withColumn("__c", F.col("__cp.c"))
    w = Window.partitionBy(*o.by, "__c").orderBy("__ord").rowsBetween(-n, -1)
    for name, agg in aggs.items():
        d = d.withColumn(name, agg.over(w))
    return d.where(~F.col("__cp.halo")).drop("__cp", "__c", "__ord")


def neighbours(df: DataFrame, o: Order, before: int, after: int, wanted: DataFrame, on: list[str],
               out: str = "offset") -> DataFrame:
    """Rows within ``before``/``after`` positions of each wanted row of the same group.

    ``wanted`` carries the group columns, the order key and its own columns. Its ordinal is
    looked up, fanned out to the at most before+after neighbouring ordinals, and joined by
    equality on (group, ordinal): no range join and no all-pairs step.
    """
    d = cut(with_ordinal(df, o, "__ord"), "ordinals")
    marks = wanted.join(d.select(*o.by, o.key, "__ord"), [*o.by, o.key])
    steps = F.filter(F.sequence(F.lit(-before), F.lit(after)), lambda x: x != 0)
    fan = (marks.select(*o.by, *on, F.col("__ord").alias("__at"), F.explode(steps).alias(out))
           .withColumn("__ord", F.col("__at") + F.col(out)).drop("__at"))
    return fan.join(d, [*o.by, "__ord"]).drop("__ord")
