"""Incremental rules: violations asserted and retracted by what a batch changes, at a cost that does not grow with the history.

A run rule is split into *candidates*, events that violate it if the run is such and such, and *facts*, a few values a run that events
contribute to (seen at all, a count, a first or last declared value). Whether a candidate is a violation is a function of the
candidate and the facts of its run. So a batch only has to look at its own candidates, and at earlier candidates of runs whose facts
it changed: those are asserted or retracted by comparing the function under old and new facts. Row rules are candidates
that no fact is needed for. Ordered rules keep one tail row a key.

Redelivered events add nothing: a candidate that is known (looked up by event time, so old files are pruned) is dropped before it is
counted, and ordered rules pass over rows at or before their tail. State is written per batch id, so a batch that is run again
overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlens import schema as sc
from guardlens.functions import exprs as X
from guardlens.functions import ordered
from guardlens.operators import relational as R
from guardlens.operators import rules as RU
from guardlens.operators.spec import ALL_GUARDS, Check, _by_hookpoint, _found, _labelled, LABELLED_TYPE, parse, with_run
from guardlens.streaming.online import BatchState, sample_hooks


@dataclass(frozen=True)
class Fact:
    """A value per run. ``any``: has the condition been met; ``count``: candidates so far; ``first`` / ``last``: a declared text by event id."""

    name: str
    kind: str
    value: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class RunRule:
    """Incremental form of a rule of the library."""

    check: Check
    candidate: Callable[[Column], Column]
    entity: Callable[[Column], Column]
    issue: Callable[[Column], Column]
    facts: tuple[Fact, ...]
    holds: Callable[[dict[str, Column], Column], Column]
    attribute: Callable[[Column], Column] = field(default=lambda p: F.lit(None).cast("string"))


def _declared_dtype(p: Column) -> Column:
    found = F.filter(F.transform(F.map_values(p.framework_invariants), lambda m: F.element_at(m, F.lit("training_dtype"))), lambda v: v.isNotNull() & (v != ""))
    return F.when(F.col("hookpoint") == "build.snapshot", F.get(found, F.lit(0)))


def _flag(p: Column) -> Column:
    return F.when(F.col("hookpoint") == "build.snapshot", F.element_at(F.element_at(p.framework_invariants, F.lit("megatron")), F.lit("calculate_per_token_loss")))


def _dropout(p: Column) -> Column:
    named = F.exists(p.model.parameters, lambda q: F.coalesce(F.lower(q.getField("name")).contains("dropout"), F.lit(False)))
    return F.col("hookpoint").isin("build.snapshot", "module.fwd.post") & (p.module_class.contains("Dropout") | F.coalesce(named, F.lit(False)))


def _text(value: str):
    return lambda p: F.lit(value)


RUN_RULES = {r.check.check_id: r for r in (
    RunRule(RU.RULES_BY_ID["T0-evaluator-eval-mode"],
            lambda p: (F.col("hookpoint") == "module.fwd.pre") & (p.grad_enabled == F.lit(False)) & (p.training == F.lit(True)),
            lambda p: p.module_name, _text("training under no_grad"),
            (Fact("checkpointed", "any", lambda p: F.col("hookpoint") == "checkpoint.call"), Fact("many", "count")),
            lambda f, a: ~F.coalesce(f["checkpointed"], F.lit(False)) & (F.coalesce(f["many"], F.lit(0)) >= 2)),
    RunRule(RU.RULES_BY_ID["T0-checkpoint-preserve-rng"],
            lambda p: (F.col("hookpoint") == "checkpoint.call") & (p.preserve_rng_state == F.lit(False)),
            lambda p: p["function"], _text("preserve_rng_state=false"),
            (Fact("dropout", "any", _dropout),), lambda f, a: F.coalesce(f["dropout"], F.lit(False))),
    RunRule(RU.RULES_BY_ID["T1-comm-dtype-matches-training"],
            lambda p: (F.col("hookpoint") == "comm.post") & p.op.isin(*RU.GRADIENT_COLLECTIVES) & (F.coalesce(p.tensor_post.dtype, F.lit("")) != ""),
            lambda p: p.op, _text("dtype differs from the declared one"),
            (Fact("declared", "first", _declared_dtype),),
            lambda f, a: F.coalesce(a != X.dtype_name(f["declared"]), F.lit(False)), lambda p: X.dtype_name(p.tensor_post.dtype)),
    RunRule(RU.RULES_BY_ID["T1-router-has-calculate-per-token-loss"],
            lambda p: (F.col("hookpoint") == "module.fwd.post") & p.semantic.is_router & (p.semantic.has_calculate_per_token_loss == F.lit(False)),
            lambda p: p.module_class, _text("attribute missing"),
            (Fact("flag", "last", _flag),), lambda f, a: ~F.lower(F.coalesce(f["flag"], F.lit("false"))).isin("false", "0", "0.0", "")),
)}

#: ordered rules: the payload field that must increase
COUNTERS = {"T0-optim-step-counter-monotonic": "state_step_max"}

CANDIDATE = T.StructType([*[f for f in sc.VIOLATION.fields if f.name in ("check_id", "run", "rank", "event_id", "entity", "issue")],
                          T.StructField("attribute", sc.S), T.StructField("ts_ns", sc.L)])
KEYS = ["check_id", "run", "rank", "event_id", "entity", "issue"]
DELTA = "check_id string, run string, rank int, event_id long, entity string, issue string, change string"


def _slot(rule: RunRule, fact: Fact) -> str:
    return f"{rule.check.check_id}:{fact.name}"


def _merge(kind: str, old: Column, new: Column) -> Column:
    if kind == "any":
        return F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False))
    if kind == "count":
        return F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))
    return F.least(old, new) if kind == "first" else F.greatest(old, new)  # structs of (event id, text)


class IncrementalRunner:
    """Handler of micro-batches; ``changes`` has one row for each violation that a batch asserts or retracts."""

    def __init__(self, spark: SparkSession, root: str, checks: Sequence[Check], guards: frozenset[str] = ALL_GUARDS,
                 sample_rates: dict[str, float] | None = None, span: int = 1 << 20):
        unknown = [c.check_id for c in checks if c.findings is None and c.check_id not in RUN_RULES and c.check_id not in COUNTERS]
        if unknown:
            raise ValueError(f"no incremental form for {unknown}")
        self.spark, self.state, self.guards, self.span = spark, BatchState(spark, root), guards, span
        self.checks, self.sample_rates = list(checks), sample_rates or {}
        self.rows = [c for c in checks if c.findings is not None]
        self.rules = [RUN_RULES[c.check_id] for c in checks if c.check_id in RUN_RULES]
        self.counters = [c for c in checks if c.check_id in COUNTERS]
        value = T.StructType([T.StructField("id", sc.L), T.StructField("text", sc.S)])
        kinds = {"any": sc.B, "count": sc.L, "first": value, "last": value}
        self.facts = [(r, f) for r in self.rules for f in r.facts]
        self.fact_schema = T.StructType([T.StructField("run", sc.S), *[T.StructField(_slot(r, f), kinds[f.kind]) for r, f in self.facts]])

    def _sampled(self, df: DataFrame) -> DataFrame:
        return sample_hooks(df, self.sample_rates)  # one sampler for tables and streams

    def _candidates(self, parsed: DataFrame) -> DataFrame:
        p = F.col("p")
        items = []
        if self.rows:
            found = _by_hookpoint(self.rows, lambda c: _labelled(_found(c, p, self.guards), c.check_id), LABELLED_TYPE)
            items.append(F.transform(found, lambda x: F.struct(x.check_id.alias("check_id"), x.entity.alias("entity"), x.issue.alias("issue"), F.lit(None).cast("string").alias("attribute"))))
        for r in self.rules:
            one = F.struct(F.lit(r.check.check_id).alias("check_id"), r.entity(p).cast("string").alias("entity"), r.issue(p).cast("string").alias("issue"), r.attribute(p).cast("string").alias("attribute"))
            items.append(F.when(F.coalesce(r.candidate(p), F.lit(False)), F.array(one)).otherwise(F.array().cast("array<struct<check_id:string,entity:string,issue:string,attribute:string>>")))
        merged = items[0] if len(items) == 1 else F.concat(*items)
        return parsed.select("run", "rank", "event_id", "ts_ns", F.inline(merged)).select(*CANDIDATE.fieldNames()).dropDuplicates(KEYS)

    def _known(self, batch_id: int) -> DataFrame | None:
        """Candidates of earlier batches (never of this one, which may be run again)."""
        if batch_id == 0:
            return None
        log = self.spark.read.schema(T.StructType([*CANDIDATE.fields, T.StructField("batch", sc.L)])).parquet(f"{self.state.root}/candidates")
        return log.where(F.col("batch") < batch_id)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        t = self._sampled(with_run(batch))
        parsed = parse(t, self.checks, keep=("ts_ns",))
        deltas = []
        if self.rows or self.rules:
            deltas += self._run_deltas(parsed, batch_id)
        deltas += [self._counter(c, parsed, batch_id) for c in self.counters]
        out = reduce(DataFrame.unionByName, deltas)
        self.state.write("changes", batch_id, out.select(*[c.split()[0] for c in DELTA.split(", ")]))

    def _run_deltas(self, parsed: DataFrame, batch_id: int) -> list[DataFrame]:
        new, known = self._candidates(parsed), self._known(batch_id)
        if known is not None:
            oldest = parsed.agg(F.min("ts_ns").alias("t")).first().t  # known candidates before the batch's time cannot be redelivered by it
            same = known.where(F.col("ts_ns") >= F.lit(oldest)) if oldest is not None else known.limit(0)
            new = _anti(new, same, KEYS)
        new = self.state.write("candidates", batch_id, new)
        facts, changed = self._facts(parsed, new, batch_id)
        needed = [r.check.check_id for r in self.rules]
        # row findings hold as they are
        out = [new.where(~F.col("check_id").isin(*needed)).withColumn("change", F.lit("new"))] if self.rows else []
        if self.rules:
            mine = new.where(F.col("check_id").isin(*needed)).join(facts, "run", "left")
            out.append(mine.where(self._holds("now")).withColumn("change", F.lit("new")))
            if known is not None:
                before = known.where(F.col("check_id").isin(*needed)).join(changed, "run")
                was, now = self._holds("was"), self._holds("now")
                change = F.when(~was & now, "new").when(was & ~now, "retired")
                out.append(before.withColumn("change", change).where(F.col("change").isNotNull()))
        return [d.select(*KEYS, "change") for d in out]

    def _holds(self, which: str) -> Column:
        out = F.lit(False)
        for r in self.rules:
            values = {}
            for f in r.facts:
                c = F.col(which).getField(_slot(r, f))
                values[f.name] = c.getField("text") if f.kind in ("first", "last") else c
            out = F.when(F.col("check_id") == r.check.check_id, F.coalesce(r.holds(values, F.col("attribute")), F.lit(False))).otherwise(out)
        return out

    def _facts(self, parsed: DataFrame, new: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """(run, now) of all runs, and (run, was, now) of the runs whose facts the batch has changed: one row a run."""
        names = [f.name for f in self.fact_schema.fields[1:]]
        if not names:
            empty = self.spark.createDataFrame([], "run string, now int")
            return empty, empty.withColumn("was", F.lit(0))
        p, aggs = F.col("p"), []
        for r, f in self.facts:
            if f.kind == "any":
                aggs.append(F.max(F.coalesce(f.value(p), F.lit(False))).alias(_slot(r, f)))
            elif f.kind in ("first", "last"):
                pair = F.when(f.value(p).isNotNull(), F.struct(F.col("event_id").alias("id"), f.value(p).cast("string").alias("text")))
                aggs.append((F.min if f.kind == "first" else F.max)(pair).alias(_slot(r, f)))
        counts = [F.count_if(F.col("check_id") == r.check.check_id).alias(_slot(r, f)) for r, f in self.facts if f.kind == "count"]
        fresh = parsed.groupBy("run").agg(*(aggs or [F.lit(0).alias("__none")]))
        if counts:
            fresh = fresh.join(new.groupBy("run").agg(*counts), "run", "left")
        fresh = fresh.select("run", F.struct(*[F.col(f"`{n}`") for n in names]).alias("add"))
        old = (self.spark.read.schema(self.fact_schema).parquet(self.state.path("facts", batch_id - 1)) if batch_id else self.spark.createDataFrame([], self.fact_schema))
        old = old.select("run", F.struct(*[F.col(f"`{n}`") for n in names]).alias("was"))
        kind = {_slot(r, f): f.kind for r, f in self.facts}
        both = old.join(fresh, "run", "full")
        merged = both.select("run", "was", F.struct(*[_merge(kind[n], F.col("was").getField(n), F.col("add").getField(n)).alias(n) for n in names]).alias("now"))
        held = self.state.write("facts", batch_id, merged.select("run", *[F.col("now").getField(n).cast(self.fact_schema[n].dataType).alias(n) for n in names]))
        now = held.select("run", F.struct(*[F.col(f"`{n}`") for n in names]).alias("now"))
        # a run that was not known has no earlier candidates
        return now, old.join(now, "run").where(~F.col("was").eqNullSafe(F.col("now")))

    def _counter(self, c: Check, parsed: DataFrame, batch_id: int) -> DataFrame:
        name = COUNTERS[c.check_id]
        v = X.field("p", name)
        rows = parsed.where(F.col("hookpoint").isin(*c.hookpoints) & v.isNotNull()).select("run", "rank", "event_id", v.alias("v")).dropDuplicates(["run", "rank", "event_id"])
        table = f"tails-{c.check_id}"
        old = self.state.previous(table, batch_id, rows)
        seen = rows.withColumn("is_new", F.lit(True))
        if old is not None:
            tail = old.select(F.col("run").alias("__run"), F.col("rank").alias("__rank"), F.col("event_id").alias("__last"))
            later = rows.join(tail, F.col("run").eqNullSafe(F.col("__run")) & F.col("rank").eqNullSafe(F.col("__rank")), "left")
            rows = later.where(F.col("__last").isNull() | (F.col("event_id") > F.col("__last"))).select(*rows.columns)
            seen = rows.withColumn("is_new", F.lit(True)).unionByName(old.withColumn("is_new", F.lit(False)))
        d = ordered.with_previous(seen, "v", ordered.Order(("run", "rank"), "event_id", (), self.span), "prev")
        self.state.write(table, batch_id, R.top_k(seen.select("run", "rank", "event_id", "v"), ["run", "rank"], 1, F.desc("event_id")))
        return d.where(F.col("is_new") & ~(F.col("v") > F.col("prev"))).select(
            F.lit(c.check_id).alias("check_id"), "run", "rank", "event_id", F.lit(name).alias("entity"), F.lit("not increasing").alias("issue"), F.lit("new").alias("change"))

    def changes(self) -> DataFrame:
        return self.spark.read.schema(f"{DELTA}, batch long").parquet(f"{self.state.root}/changes")

    def standing(self) -> DataFrame:
        """Violations that hold after the last batch: asserted more often than retracted."""
        n = F.sum(F.when(F.col("change") == "new", 1).otherwise(-1))
        return self.changes().groupBy(*KEYS).agg(n.alias("__n")).where("__n > 0").drop("__n")


def _anti(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    r = b.select(*[F.col(k).alias(f"__r_{k}") for k in keys])
    return a.join(r, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]), "left_anti")
