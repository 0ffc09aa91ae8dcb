"""Keyed streaming state with timers: groups that close when they are complete, and event-time joins.

A group is one key, such as (entity, step) of a replica check. Its state is one row of a few numbers, whatever the number of its rows. It closes
when as many rows have come as its degree says, or when event time passes its first row by ``wait``; what is still open when the
stream ends is reported by ``finished``, so that no group goes unreported. Rows that come after their group has closed, or behind
the watermark, go to the side output ``late``.

The rows of a batch are combined by group in each task, then merged with the state of the batch before in one aggregation, so a hot
group costs no more than others and no row of state is handled one by one. State is a table per batch id in the shared folder:
open groups, and closed ones until their timer has passed; a batch that is run again overwrites its own.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlens.streaming.online import BatchState

VOTE = ("n_rows", "min_value", "max_value", "closed_by")


def _ms(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1000)


class Votes:
    """Rows of each group: how many, and the smallest and largest value (equal iff all agree).

    Without a degree groups close by time only: a count per key. A null value counts as a row but does not vote.
    """

    def __init__(self, state: BatchState, keys: Sequence[str], value: str, time: str = "ts", degree: int | None = None, wait: str = "10 minutes",
                 lateness: str = "10 minutes"):
        self.state, self.keys, self.value, self.time, self.degree = state, list(keys), value, time, degree
        self.wait, self.lateness = _ms(wait), _ms(lateness)

    def _mark(self, batch_id: int) -> int | None:
        """Watermark after a batch: the largest time so far, less the lateness."""
        top = self.state.spark.read.schema("top long").parquet(self.state.path("mark", batch_id)).first().top if batch_id >= 0 else None
        return None if top is None else top - self.lateness

    def _kept(self, groups: DataFrame) -> DataFrame:
        return groups.where("kept").select(*self.keys, "n", "low", "high", "closed", "due")

    def _groups(self, batch_id: int) -> DataFrame:
        return self.state.spark.read.parquet(self.state.path("groups", batch_id))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        mark, at = self._mark(batch_id - 1), F.unix_millis(self.time)
        value, none = F.col(self.value).cast("string"), F.lit(None)
        behind = F.lit(False) if mark is None else F.coalesce(at <= F.lit(mark), F.lit(False))
        fresh = batch.select(*self.keys, F.lit(0).cast("long").alias("old_n"), F.when(~behind, 1).otherwise(0).cast("long").alias("new_n"), F.when(behind, 1).otherwise(0).cast("long").alias("behind"),
                             none.cast("string").alias("old_low"), none.cast("string").alias("old_high"), F.when(~behind, value).alias("low"), F.when(~behind, value).alias("high"),
                             F.lit(False).alias("closed"), none.cast("long").alias("due"), F.when(~behind, at).alias("first"))
        if batch_id > 0:
            old = self._kept(self._groups(batch_id - 1))
            fresh = fresh.unionByName(old.select(*self.keys, F.col("n").alias("old_n"), F.lit(0).cast("long").alias("new_n"), F.lit(0).cast("long").alias("behind"), F.col("low").alias("old_low"),
                                                 F.col("high").alias("old_high"), none.cast("string").alias("low"), none.cast("string").alias("high"), "closed", "due", none.cast("long").alias("first")))
        g = fresh.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in ("old_n", "new_n", "behind")], *[F.min(c).alias(c) for c in ("old_low", "low", "due", "first")],
                                          *[F.max(c).alias(c) for c in ("old_high", "high", "closed")])
        was = F.col("closed")
        n = F.col("old_n") + F.when(was, 0).otherwise(F.col("new_n"))
        full = F.lit(False) if self.degree is None else ~was & (F.col("new_n") > 0) & (n >= self.degree)
        due = F.coalesce(F.col("due"), F.col("first") + self.wait)
        over = F.lit(False) if mark is None else F.coalesce(due <= F.lit(mark), F.lit(False))
        known = F.col("old_n") + F.col("new_n") > 0
        late = F.col("behind") + F.when(was, F.col("new_n")).otherwise(0)
        low, high = (F.when(was, F.col(f"old_{c}")).otherwise(f(f"old_{c}", c)) for c, f in (("low", F.least), ("high", F.greatest)))
        g = g.select(*self.keys, n.alias("n"), low.alias("low"), high.alias("high"), (was | full).alias("closed"), due.alias("due"), (known & ~over).alias("kept"), late.alias("late"),
                     F.when(full, "degree").when(over & known & ~was, "timer").alias("closed_by"))
        self.state.write("groups", batch_id, g)
        top = batch.agg(F.max(at).alias("top")).select(F.greatest("top", F.lit(None if mark is None else mark + self.lateness).cast("long")).alias("top"))
        self.state.write("mark", batch_id, top)

    def closed(self) -> DataFrame:
        """(keys, n_rows, min_value, max_value, closed_by) of every group that has closed, and the rows that were late for theirs."""
        d = self._all()
        by = d.where("closed_by IS NOT NULL").select(*self.keys, *self._vote("n", F.col("low"), F.col("high"), F.col("closed_by")))
        none = F.lit(None).cast("string")
        return by.unionByName(d.where("late > 0").select(*self.keys, *self._vote("late", none, none, F.lit("late"))))

    def finished(self) -> DataFrame:
        """``closed``, and the groups that are open when the stream has ended: their timer has passed, or it is the end that closes them."""
        last = self._all().agg(F.max("batch").alias("b")).first().b
        mark = self._mark(last)
        by = F.lit("end") if mark is None else F.when(F.col("due") <= F.lit(mark), "timer").otherwise("end")
        left = self._kept(self._groups(last)).where("NOT closed")
        return self.closed().unionByName(left.select(*self.keys, *self._vote("n", F.col("low"), F.col("high"), by)))

    def _all(self) -> DataFrame:
        return self.state.spark.read.parquet(f"{self.state.root}/groups")

    @staticmethod
    def _vote(n: str, low: Column, high: Column, by: Column) -> list[Column]:
        return [c.alias(name) for c, name in zip((F.col(n), low, high, by), VOTE)]


def pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, within: str, lateness: str = "10 minutes",
          how: str = "inner") -> DataFrame:
    """Rows of two streams with equal keys, the right one at or after the left one and at most ``within`` later.

    Both sides have a watermark, so a row is kept only as long as a partner can still come. ``leftOuter`` reports left rows without
    a partner once none can come.
    """
    a = left.withWatermark(left_time, lateness).select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    b = right.withWatermark(right_time, lateness).select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"l_{k}") == F.col(f"r_{k}"))
    t, u = F.col(f"l_{left_time}"), F.col(f"r_{right_time}")
    return a.join(b, on & (u >= t) & (u <= t + F.expr(f"INTERVAL {within}")), how)


def sessions(stream: DataFrame, keys: Sequence[str], time: str, gap: str, lateness: str = "10 minutes") -> DataFrame:
    """Activity sessions per key: (keys, started, ended, n_rows); one ends after ``gap`` without a row of its key."""
    g = stream.withWatermark(time, lateness).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return g.select(*keys, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_rows")


class LateRows:
    """Splits a stream by its own watermark: rows in time, and rows that come too late, each to its table.

    The mark is the largest time of the batches before, less ``lateness``, as the built-in watermark; it is kept per batch in the
    shared folder, so a batch that is delivered again is split in the same way.
    """

    def __init__(self, state, time: str, lateness: str):
        self.state, self.time, self.ms = state, time, int(pd.Timedelta(lateness).total_seconds() * 1000)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        schema = "top long"
        mark = None
        if batch_id > 0:
            mark = self.state.spark.read.schema(schema).parquet(self.state.path("mark", batch_id - 1)).first().top
        at = F.unix_millis(self.time)
        late = F.lit(False) if mark is None else at < F.lit(mark - self.ms)
        rows = self.state.write("rows", batch_id, batch.withColumn("is_late", F.coalesce(late, F.lit(False))), ["is_late"])
        self.state.write("mark", batch_id, rows.agg(F.greatest(F.max(at), F.lit(mark).cast("long")).alias("top")))
