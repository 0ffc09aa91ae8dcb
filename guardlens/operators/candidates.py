"""Candidate constraints as data: one parse of each payload evaluates a table of candidates.

A candidate is a row, or several rows with one id (its terms; an event violates the candidate if any term fails). The terms of
a hookpoint meet its events as one array, so payloads are neither exploded nor shuffled: each is parsed once to a variant and
every term reads its path in it. Terms reach into lists (``a[*].b``), compare with a constant, a text or another field, can
be bound to a guard on the payload or the list element, and walk every tensor summary the profile has found. Monotonic
candidates, however many, share one ordered pass keyed by candidate.

Nothing in a candidate ends the job. A payload that is no JSON, a value that is not of the type compared with, an unknown operator
or a monotonic list path count as errors of the candidate, which reject it. Missing and null values pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlens.functions import ordered
from guardlens.operators.spec import OPS, with_run
from guardlens.session import cut

NON_STANDARD = r"(?<=[:,\[]\s{0,2})-?(NaN|Infinity)(?=\s*[,}\]])"
GUARD = "struct<scope:string,field:string,op:string,value:string>"
COLUMNS = ("candidate_id", "relation", "hookpoint", "field", "op", "value", "value_is_field", "guard", "walk")
OUT, HOLDS, FAILS, ERROR = 0, 1, 2, 3
BROADCAST_TERMS = 1 << 16


def document(payload: str = "payload") -> Column:
    """Payload as a variant; numbers that JSON does not know become texts that still cast to a double."""
    raw = F.col(payload)
    return F.try_parse_json(F.when(raw.contains("NaN") | raw.contains("Infinity"), F.regexp_replace(raw, NON_STANDARD, '"$0"')).otherwise(raw))


def tensor_places(profile: DataFrame) -> DataFrame:
    """(hookpoint, place): every path at which the profile has a tensor summary (a dtype beside a shape), whole payload included."""
    at = F.regexp_replace("path", r"\.(dtype|shape(\[\*\])?)$", "")
    kind = F.regexp_extract("path", r"\.(dtype|shape)(\[\*\])?$", 1)
    return (profile.select("hookpoint", at.alias("place"), kind.alias("kind")).where("kind <> ''").groupBy("hookpoint", "place")
            .agg(F.count_distinct("kind").alias("n")).where("n = 2").select("hookpoint", "place"))


def terms(candidates: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """One row per (candidate, path): walks are laid out over the tensor summaries of their hookpoint."""
    have = set(candidates.columns)
    c = candidates.select(*[F.col(k) if k in have else F.lit(None).cast(GUARD if k == "guard" else "boolean").alias(k) for k in COLUMNS])
    walks = F.coalesce("walk", F.lit(False))
    flat = c.where(~walks)
    if profile is not None:
        seen = profile.select("hookpoint", "path").distinct()
        laid = (c.where(walks).join(tensor_places(profile), "hookpoint").withColumn("path", F.concat_ws(".", "place", "field"))
                .join(seen, ["hookpoint", "path"], "left_semi").withColumn("field", F.regexp_replace("path", r"^\$\.?", "")))
        flat = flat.unionByName(laid.select(*COLUMNS))
    parts = F.split(F.concat(F.lit("$."), F.col("field")), r"\[\*\]")
    rooted = F.transform(parts, lambda p: F.when(p.startswith("$"), p).when(p == "", "$").otherwise(F.concat(F.lit("$"), p)))
    number = F.when(~F.coalesce("value_is_field", F.lit(False)), F.col("value").try_cast("double"))
    return (flat.withColumn("steps", F.slice(rooted, 1, F.size(rooted) - 1)).withColumn("leaf", F.element_at(rooted, -1))
            .withColumn("number", number).withColumn("other", F.when(F.col("value_is_field"), F.concat(F.lit("$."), F.col("value"))))
            .withColumn("increasing", (F.col("relation") == "monotonic") | (F.col("op") == "increasing")))


def _compare(op: str, a: str, b: str, known: tuple[str, ...]) -> str:
    sql = {"==": "=", "!=": "<>"}
    return f"CASE {op} " + " ".join(f"WHEN '{k}' THEN {a} {sql.get(k, k)} {b}" for k in known) + " END"


_TEXT = ("==", "!=")
_GET = "try_variant_get({x}, {p}, 'string')"
#: elements that a term looks at: the payload, or what its list steps lead to
_ELEMENTS = "aggregate(t.steps, array(doc), (acc, s) -> flatten(transform(acc, x -> coalesce(try_variant_get(x, s, 'array<variant>'), array()))))"
_GUARD_VALUE = _GET.format(x="IF(t.guard.scope = 'element', x, doc)", p="concat('$.', t.guard.field)")
_GUARDED = (f"coalesce(CASE WHEN t.guard IS NULL THEN true WHEN try_cast(t.guard.value AS DOUBLE) IS NOT NULL THEN "
            f"{_compare('t.guard.op', f'try_cast({_GUARD_VALUE} AS DOUBLE)', 'try_cast(t.guard.value AS DOUBLE)', tuple(OPS))} "
            f"ELSE {_compare('t.guard.op', _GUARD_VALUE, 't.guard.value', _TEXT)} END, false)")
_RAW, _RHS = _GET.format(x="x", p="t.leaf"), _GET.format(x="x", p="t.other")
_NUMBER, _OTHER = "try_cast(y.raw AS DOUBLE)", "IF(t.other IS NULL, t.number, try_cast(y.rhs AS DOUBLE))"
_READ = f"""CASE WHEN y.raw IS NULL THEN {HOLDS}
  WHEN t.number IS NULL AND t.other IS NULL THEN CASE WHEN t.op NOT IN ('==', '!=') THEN {ERROR} WHEN {_compare('t.op', 'y.raw', 't.value', _TEXT)} THEN {HOLDS} ELSE {FAILS} END
  WHEN {_NUMBER} IS NULL THEN {ERROR} WHEN {_OTHER} IS NULL THEN IF(y.rhs IS NULL, {HOLDS}, {ERROR})
  ELSE coalesce(IF({_compare('t.op', _NUMBER, _OTHER, tuple(OPS))}, {HOLDS}, {FAILS}), {ERROR}) END"""
#: the values are read once for all the tests on them: a path that is data is parsed at every read
_CODE = f"CASE WHEN NOT {_GUARDED} THEN {OUT} ELSE element_at(transform(array(struct({_RAW} AS raw, {_RHS} AS rhs)), y -> {_READ}), 1) END"
_KNOWN = ", ".join(f"'{k}'" for k in OPS)
_TERM = f"""CASE WHEN doc IS NULL OR t.op NOT IN ({_KNOWN}) THEN {ERROR} ELSE coalesce(array_max(transform({_ELEMENTS}, x -> {_CODE})), {OUT}) END"""
_STATES = f"transform(cands, c -> struct(c.candidate_id AS candidate_id, coalesce(array_max(transform(c.terms, t -> {_TERM})), {OUT}) AS code))"
_SERIES = f"""transform(cands, c -> struct(c.candidate_id AS candidate_id, c.terms[0].leaf AS leaf, size(c.terms[0].steps) = 0 AND size(c.terms) = 1 AS plain))"""


def _by_hookpoint(rows: DataFrame) -> DataFrame:
    """(hookpoint, cands): one row a hookpoint, broadcast if the number of terms is counted and small."""
    one = rows.groupBy("hookpoint", "candidate_id").agg(F.collect_list(F.struct("steps", "leaf", "op", "value", "number", "other", "guard")).alias("terms"))
    few = rows.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    out = one.groupBy("hookpoint").agg(F.collect_list(F.struct("candidate_id", "terms")).alias("cands"))
    return F.broadcast(out) if few else out


def candidate_failures(trace: DataFrame, candidates: DataFrame, profile: DataFrame | None = None, span: int = 1 << 20) -> DataFrame:
    """(candidate_id, run, n_events, n_violations, n_errors) for every candidate and run with an event in scope."""
    laid = cut(terms(candidates, profile), "terms")
    t = with_run(trace)
    rank = ["rank"] if "rank" in t.columns else []
    parsed = t.select("run", *rank, "event_id", "hookpoint", document().alias("doc"))
    states = (parsed.join(_by_hookpoint(laid.where(~F.col("increasing"))), "hookpoint").select("run", F.inline(F.expr(_STATES)))
              .where(F.col("code") != OUT))
    rows = states.groupBy("candidate_id", "run").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("code") == FAILS).alias("n_violations"),
                                                     F.count_if(F.col("code") == ERROR).alias("n_errors"))
    if laid.where("increasing").isEmpty():
        return rows
    series = (parsed.join(_by_hookpoint(laid.where("increasing")), "hookpoint")
              .select("run", *rank, "event_id", "doc", F.inline(F.expr(_SERIES)))
              .withColumn("raw", F.when(F.col("plain"), F.expr("try_variant_get(doc, leaf, 'string')")))
              .select("candidate_id", "run", *rank, "event_id", F.col("raw").try_cast("double").alias("v"),
                      (F.col("doc").isNull() | ~F.col("plain") | F.col("raw").isNotNull() & F.col("raw").try_cast("double").isNull()).alias("bad"))
              .where("v IS NOT NULL OR bad"))
    series = cut(series, "series")  # read twice: without this every payload is parsed twice
    d = ordered.with_previous(series, "v", ordered.Order(("candidate_id", "run", *rank), "event_id", (), span), "pv")
    mono = d.groupBy("candidate_id", "run").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(~(F.col("v") > F.col("pv"))).alias("n_violations"),
                                                F.count_if(F.col("bad")).alias("n_errors"))
    return rows.unionByName(mono)


def validated(candidates: DataFrame, failures: DataFrame, runs: DataFrame, allowed: int = 0) -> DataFrame:
    """One row per candidate over the healthy runs: accepted iff it stays within the allowance on each and no event is an error.

    A run without an event in scope counts as a trace without violations.
    """
    counted = failures.join(runs.select("run").distinct(), "run", "left_semi").groupBy("candidate_id").agg(
        F.count_if(F.col("n_violations") > 0).alias("n_fired"), F.max("n_violations").alias("max_violations"),
        F.sum("n_violations").alias("total_violations"), F.sum("n_errors").alias("n_errors"))
    total = runs.select("run").distinct().agg(F.count(F.lit(1)).alias("n"))
    d = candidates.select("candidate_id").distinct().join(counted, "candidate_id", "left").fillna(0)
    reason = F.when(F.col("n_errors") > 0, "error").when(F.col("max_violations") > allowed, "fired")
    return d.select("candidate_id", total.scalar().alias("n_traces"), "n_fired", "max_violations", "total_violations", "n_errors",
                    reason.isNull().alias("accepted"), reason.alias("reason"))


def replay(sample: DataFrame, trace: DataFrame, by: str, profile: DataFrame | None = None) -> DataFrame:
    """Skip-stage stress: sampled candidates on traces they were not mined from.

    ``sample`` has a column ``by``, the cohort; returns, for each cohort and run, how many candidates fire and how many fail to evaluate.
    """
    runs = with_run(trace).select("run").distinct()
    size = sample.groupBy(by).agg(F.count_distinct("candidate_id").alias("n_sampled"))
    fired = (candidate_failures(trace, sample, profile).join(sample.select(by, "candidate_id").distinct(), "candidate_id")
             .groupBy(by, "run").agg(F.count_if(F.col("n_violations") > 0).alias("n_fired"), F.count_if(F.col("n_errors") > 0).alias("n_errors")))
    # cohorts x runs, both reduced: a run on which nothing fires still counts
    grid = runs.withColumn(by, F.explode(F.array_distinct(sample.agg(F.collect_set(by).alias("x")).scalar())))
    return grid.join(size, by).join(fired, [by, "run"], "left").fillna(0, ["n_fired", "n_errors"]).select(
        by, "run", "n_sampled", "n_fired", "n_errors", (F.col("n_fired") / F.col("n_sampled")).alias("fire_rate"))
