"""Check specifications and the fused evaluation plan.

A row check is a function from the typed payload to an array of *findings*
(``entity, issue, observed``); an empty or NULL array means the event passes. All row checks
over a trace become columns of one projection over one scan with one JSON parse, and the
findings are exploded once. Checks that compare rows (windows, groups) are *frame checks*:
functions from the trace to a violations DataFrame. Both carry their hookpoints, tier and
payload fields so a plan can prune before it is built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlens import schema as sc
from guardlens.functions import exprs as X

FINDING_TYPE = "array<struct<entity:string,issue:string,observed:double>>"
LABELLED_TYPE = "array<struct<check_id:string,entity:string,issue:string,observed:double>>"


def finding(entity: Column | str | None = None, issue: Column | str | None = None,
            observed: Column | None = None) -> Column:
    def text(v):
        if v is None:
            return F.lit(None).cast("string")
        return F.lit(v) if isinstance(v, str) else v.cast("string")

    obs = F.lit(None).cast("double") if observed is None else observed.cast("double")
    return F.struct(text(entity).alias("entity"), text(issue).alias("issue"), obs.alias("observed"))


def fail_if(cond: Column, entity: Column | str | None = None, issue: Column | str | None = None,
            observed: Column | None = None) -> Column:
    """One finding when the condition is true; NULL conditions pass (three-valued logic)."""
    return F.when(cond, F.array(finding(entity, issue, observed)))


def fail_each(items: Column, cond: Callable[[Column], Column],
              describe: Callable[[Column], Column]) -> Column:
    """One finding per list element that fails; NULL lists pass."""
    return F.transform(F.filter(items, cond), describe)


@dataclass(frozen=True)
class Check:
    """One constraint: schema predicate, topology guard and precondition guard."""

    check_id: str
    hookpoints: tuple[str, ...]
    tier: int = 0
    fields: tuple[str, ...] = ()
    findings: Callable[[Column], Column] | None = None
    applies: Callable[[Column], Column] | None = None
    topo_guard: Callable[[Column], Column] | None = None
    precondition: Callable[[Column], Column] | None = None
    frame: Callable[[DataFrame, frozenset[str]], DataFrame] | None = None
    frame_fields: tuple[str, ...] = ()
    #: conditions on (hookpoint, payload) and how many events of a run must meet each; else the check is passive there
    needs: tuple[tuple[Callable[[Column], Column], int], ...] = ()
    #: a run with an event like this makes the check passive
    veto: Callable[[Column], Column] | None = None
    kind: str = "validity"
    template: str | None = None
    description: str = ""
    tags: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self):
        if (self.findings is None) == (self.frame is None):
            raise ValueError(f"{self.check_id}: give exactly one of findings / frame")
        if not self.hookpoints:
            raise ValueError(f"{self.check_id}: at least one hookpoint is needed")
        if not 0 <= self.tier <= 4:
            raise ValueError(f"{self.check_id}: tier must be 0..4")

    def scope(self, p: Column) -> Column:
        c = X.hookpoint_in(self.hookpoints)
        return c & self.applies(p) if self.applies is not None else c

    def guarded(self, p: Column, guards: frozenset[str]) -> Column:
        c = self.scope(p)
        if "topo" in guards and self.topo_guard is not None:
            c = c & self.topo_guard(p)
        if "precond" in guards and self.precondition is not None:
            c = c & self.precondition(p)
        return c


ALL_GUARDS = frozenset({"topo", "precond"})
ARMS = {"full": ALL_GUARDS, "no_topo": frozenset({"precond"}), "no_precond": frozenset({"topo"})}


def in_tier(checks: Iterable[Check], tier: int) -> list[Check]:
    return [c for c in checks if c.tier <= tier]


def for_hookpoints(checks: Iterable[Check], present: Iterable[str]) -> list[Check]:
    """Only the checks that some present hookpoint can affect."""
    seen = set(present)
    return [c for c in checks if seen.intersection(c.hookpoints)]


BAD = "_unparsed"


def _fields(checks: Sequence[Check]) -> list[str]:
    return sorted({f for c in checks for f in (*c.fields, *c.frame_fields)})


def _with_bad(schema: sc.T.StructType) -> sc.T.StructType:
    return sc.T.StructType([*schema.fields, sc.T.StructField(BAD, sc.T.StringType())])


def parse(trace: DataFrame, checks: Sequence[Check], keep: Sequence[str] = (), errors: bool = False) -> DataFrame:
    """One scan, one JSON parse, restricted to the hookpoints and fields the checks use.

    With ``errors`` the payload struct keeps the text of payloads that do not parse under these fields.
    """
    hooks = sorted({h for c in checks for h in c.hookpoints})
    fields = _fields(checks)
    base = with_run(trace).where(X.hookpoint_in(hooks))
    cols = ["run", "rank", "step", "event_id", "hookpoint", *keep]
    if "p" in base.columns:
        return base.select(*cols, "p")
    if not fields:
        return base.select(*cols, F.struct(F.lit(None).cast("string").alias("_")).alias("p"))
    schema, options = sc.payload_schema(fields), {}
    if errors:
        schema, options = _with_bad(schema), {"columnNameOfCorruptRecord": BAD}
    return base.select(*cols, F.from_json("payload", schema, options).alias("p"))


def unparsed(c: Check, p: Column) -> Column:
    """True for an event whose payload does not fit the fields of this check. Only events that failed the joint parse are parsed again."""
    fields = _fields([c])
    if not fields:
        return F.lit(False)
    bad = p.getField(BAD)
    own = F.from_json(bad, _with_bad(sc.payload_schema(fields)), {"columnNameOfCorruptRecord": BAD}).getField(BAD)
    return F.when(bad.isNotNull(), own.isNotNull()).otherwise(F.lit(False))


def layout(trace: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Typed payload fields of several frame checks, parsed once and stored by hookpoint: each check then reads its own columns and
    folders instead of parsing the trace again."""
    from guardlens.session import work_folder
    parsed = parse(trace, checks)
    path = work_folder(parsed.sparkSession, "layout")
    parsed.write.partitionBy("hookpoint").parquet(path)
    return parsed.sparkSession.read.schema(parsed.schema).parquet(path).select(*parsed.columns)


def with_run(trace: DataFrame) -> DataFrame:
    """Traces of a single run carry no run column; give them a constant one."""
    return trace if "run" in trace.columns else trace.withColumn("run", F.lit("run0"))


def row_violations(trace: DataFrame, checks: Sequence[Check], guards: frozenset[str] = ALL_GUARDS) -> DataFrame:
    """All row checks over one scan: findings become one array, exploded once.

    The array expression branches on the hookpoint first, so an event only evaluates the checks
    bound to its own hookpoint however many checks are fused.
    """
    p = F.col("p")
    parsed = parse(trace, checks)
    merged = _by_hookpoint(checks, lambda c: _labelled(_found(c, p, guards), c.check_id), LABELLED_TYPE)
    return _inlined(parsed, ["run", "rank", "step", "event_id"], merged).select(*violation_columns())


def _inlined(parsed: DataFrame, keep: Sequence[str], rows: Column) -> DataFrame:
    """One row for each element of an array with a check_id.

    The array is built as a column first: inside the generator a large expression is interpreted, not compiled. The generator is an
    outer one, as for others the optimizer tests the array for elements below the parse, and so parses every payload many times.
    """
    return (parsed.select(*keep, rows.alias("__rows")).select(*keep, F.inline_outer("__rows"))
            .where(F.col("check_id").isNotNull()))


def _found(c: Check, p: Column, guards: frozenset[str]) -> Column:
    return F.coalesce(F.when(c.guarded(p, guards), c.findings(p)).cast(FINDING_TYPE), F.array().cast(FINDING_TYPE))


def _by_hookpoint(checks: Sequence[Check], build: Callable[[Check], Column], array_type: str) -> Column:
    """Concatenated arrays of the checks bound to the row's hookpoint.

    Checks on one or two hookpoints sit in the branch of their hookpoint; checks on many are one
    guarded term each, so their expression is not repeated per branch.
    """
    empty = F.array().cast(array_type)
    wide = [c for c in checks if len(c.hookpoints) > 2]
    narrow = [c for c in checks if len(c.hookpoints) <= 2]
    terms = [F.when(X.hookpoint_in(c.hookpoints), build(c)).otherwise(empty) for c in wide]
    branches = None
    for h in sorted({h for c in narrow for h in c.hookpoints}):
        parts = [build(c) for c in narrow if h in c.hookpoints]
        branch = parts[0] if len(parts) == 1 else F.concat(*parts)
        cond = F.col("hookpoint") == h
        branches = F.when(cond, branch) if branches is None else branches.when(cond, branch)
    if branches is not None:
        terms.append(branches.otherwise(empty))
    return terms[0] if len(terms) == 1 else F.concat(*terms)


def _labelled(findings: Column, check_id: str) -> Column:
    return F.transform(findings, lambda x: F.struct(F.lit(check_id).alias("check_id"), x.entity.alias("entity"),
                                                    x.issue.alias("issue"), x.observed.alias("observed")))


def violation_columns() -> list[Column]:
    return [F.col(f.name).cast(f.dataType).alias(f.name) for f in sc.VIOLATION.fields]


def violations(trace: DataFrame, checks: Sequence[Check], guards: frozenset[str] = ALL_GUARDS) -> DataFrame:
    """Violations of all checks; row checks share one scan, frame checks add their own plan over one stored parse."""
    rows = [c for c in checks if c.findings is not None]
    parts = [row_violations(trace, rows, guards)] if rows else []
    frames = [c for c in checks if c.frame is not None]
    if len(frames) > 1 and "p" not in trace.columns:
        trace = layout(trace, frames)
    for c in checks:
        if c.frame is not None:
            parts.append(c.frame(parse(trace, [c]), guards)
                         .withColumn("check_id", F.lit(c.check_id)).select(*violation_columns()))
    if not parts:
        raise ValueError("no checks selected")
    return reduce(DataFrame.unionByName, parts)


def results(trace: DataFrame, checks: Sequence[Check], guards: frozenset[str] = ALL_GUARDS) -> DataFrame:
    """One row per (run, check): status, events in scope, events checked, violations, errors.

    ``fail`` if a violation was found; else ``error`` if a payload in scope does not have the types of the check's fields (such an event
    gives no finding); else ``passive`` if no event was in scope, or what the check needs to be declared was not; else ``pass``.
    Counting for every check takes one pass.
    """
    p = F.col("p")
    parsed = parse(trace, checks, errors=True)
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    most = max((len(c.needs) for c in checks), default=0)
    zeros = [F.lit(0) for _ in range(most)]

    def counts(c: Check) -> Column:
        bad = unparsed(c, p)
        needs = [one(need(p)) for need, _ in c.needs]
        inside = c.scope(p) if c.findings is not None else X.hookpoint_in(c.hookpoints)
        checked, found = (F.lit(1), F.lit(0)) if c.findings is None else (one(c.guarded(p, guards)), F.size(_found(c, p, guards)))
        applies = one(inside | bad) if c.applies is not None else F.lit(1)
        fields = {"scope": applies, "checked": F.when(bad, 0).otherwise(checked), "found": F.when(bad, 0).otherwise(found), "bad": one(bad),
                  "veto": F.lit(0) if c.veto is None else one(c.veto(p)), **{f"need{i}": n for i, n in enumerate([*needs, *zeros[len(needs):]])}}
        return F.array(F.struct(F.lit(c.check_id).alias("check_id"), *[v.cast("int").alias(k) for k, v in fields.items()]))

    kind = "array<struct<check_id:string,scope:int,checked:int,found:int,bad:int,veto:int" + "".join(f",need{i}:int" for i in range(most)) + ">>"
    names = {"scope": "n_scope", "checked": "n_checked", "found": "n_row", "bad": "n_bad", "veto": "n_veto", **{f"need{i}": f"n_need{i}" for i in range(most)}}
    seen = (_inlined(parsed, ["run"], _by_hookpoint(checks, counts, kind))
            .groupBy("run", "check_id").agg(*[F.sum(k).alias(n) for k, n in names.items()]))
    # one row per (run, check), also for checks without any event in scope
    wanted = [F.array(*[F.lit(n) for _, n in c.needs]).cast("array<int>") for c in checks]
    listed = F.array(*[F.struct(F.lit(c.check_id).alias("check_id"), F.lit(c.tier).alias("tier"), w.alias("wanted")) for c, w in zip(checks, wanted)])
    base = (with_run(trace).select("run").distinct().select("run", F.inline(listed))
            .join(seen, ["run", "check_id"], "left"))
    framed = [c for c in checks if c.frame is not None]
    if framed:
        extra = (violations(trace, framed, guards).groupBy("run", "check_id")
                 .agg(F.count(F.lit(1)).alias("n_frame")))
        base = base.join(extra, ["run", "check_id"], "left")
    else:
        base = base.withColumn("n_frame", F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    n_scope, nv = F.coalesce("n_scope", zero), F.coalesce("n_row", zero) + F.coalesce("n_frame", zero)
    n_bad = F.coalesce("n_bad", zero)
    unmet = F.coalesce("n_veto", zero) > 0
    for i in range(most):
        unmet = unmet | (F.coalesce(F.get("wanted", F.lit(i)), F.lit(0)) > F.coalesce(f"n_need{i}", zero))
    return base.select("run", "check_id", "tier", n_scope.alias("n_scope"), F.coalesce("n_checked", zero).alias("n_checked"),
                       nv.alias("n_violations"), n_bad.alias("n_errors"),
                       F.when(nv > 0, "fail").when(n_bad > 0, "error").when((n_scope == 0) | unmet, "passive").otherwise("pass").alias("status"))


def sample_violations(v: DataFrame, k: int = 3) -> DataFrame:
    """At most k example rows per check; counts elsewhere stay complete."""
    from pyspark.sql import Window
    w = Window.partitionBy("run", "check_id").orderBy("event_id", "entity", "issue")
    return v.withColumn("sample_no", F.row_number().over(w)).where(F.col("sample_no") <= k)


def violation_ids(v: DataFrame, check_id: str) -> DataFrame:
    return v.where(F.col("check_id") == check_id).select("run", "event_id").distinct()


# -- declarative predicates ---------------------------------------------------------------

OPS: dict[str, Callable[[Column, Column], Column]] = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


@dataclass(frozen=True)
class Bound:
    """What must hold. ``bound`` / ``equality`` / ``present`` over one or several fields."""

    kind: str = "bound"
    fields: tuple[str, ...] = ()
    op: str = "=="
    value: object = None
    value_is_field: bool = False
    conditions: tuple[tuple[str, object], ...] = ()
    strict_null: bool = False
    rel: float = 0.0
    absolute: float = 0.0

    def __post_init__(self):
        if self.kind not in ("bound", "equality", "present", "monotonic"):
            raise ValueError(f"unknown bound kind {self.kind!r}")
        if not self.fields:
            raise ValueError("a bound needs at least one field")
        for op, _ in self.conditions or ((self.op, None),):
            if op not in OPS:
                raise ValueError(f"unknown operator {op!r}")
        if self.rel < 0 or self.absolute < 0:
            raise ValueError("tolerances must not be negative")

    def failure(self, get: Callable[[str], Column]) -> Column:
        """Failure condition: any field failing any condition fails the record."""
        out = None
        for name in self.fields:
            v = get(name)
            for c in self._one(v, get):
                out = c if out is None else out | c
        return out

    def _one(self, v: Column, get) -> list[Column]:
        if self.kind == "present":
            return [v.isNull()]
        if self.kind == "equality":
            bad = v.isNotNull() & ~X.equals_literal(v, self.value)
            return [v.isNull() | bad] if self.strict_null else [bad]
        fails = []
        for op, val in self.conditions or ((self.op, self.value),):
            rhs = get(str(val)) if self.value_is_field else F.lit(val)
            fails.append(~OPS[op](v, X.relaxed(rhs, op, self.rel, self.absolute)))
        return fails


@dataclass(frozen=True)
class Scope:
    hookpoints: tuple[str, ...]
    class_regex: str | None = None
    path: str | None = None
    walk: bool = False
    signature: bool = False


SHAPES = ("flat", "path", "walk", "signature", "monotonic")
COMPATIBLE = {"flat": ("bound", "equality", "present"), "path": ("bound", "equality", "present"),
              "walk": ("bound", "equality", "present"), "signature": ("bound", "equality"),
              "monotonic": ("monotonic",)}


@dataclass(frozen=True)
class Predicate:
    """Declarative check compiled to a :class:`Check` (no SQL text, no row-wise Python)."""

    check_id: str
    shape: str
    scope: Scope
    bound: Bound
    precondition: Callable[[Column, Column | None], Column] | None = None
    tier: int = 0
    template: str | None = None
    fields: tuple[str, ...] = ()

    def __post_init__(self):
        if self.shape not in SHAPES:
            raise ValueError(f"{self.check_id}: unknown shape {self.shape!r}")
        if self.bound.kind not in COMPATIBLE[self.shape]:
            raise ValueError(f"{self.check_id}: {self.shape} does not take a {self.bound.kind} bound")
        if self.shape == "path" and not self.scope.path:
            raise ValueError(f"{self.check_id}: path shape needs scope.path")
        if self.scope.path and not self.scope.path.startswith("$."):
            raise ValueError(f"{self.check_id}: paths start with '$.'")

    # payload fields to parse: heads of every path used
    def needed(self) -> tuple[str, ...]:
        heads = set(self.fields)
        if self.scope.class_regex:
            heads.add("module_class")
        if self.shape == "walk":
            heads.update(WALK_FIELDS)
        elif self.shape == "path":
            heads.add(self.scope.path.removeprefix("$.").split(".")[0].split("[")[0])
        elif self.shape == "signature":
            heads.add((self.scope.path or "$.output").removeprefix("$.").split(".")[0])
        else:
            heads.update(f.split(".")[0] for f in self.bound.fields)
            if self.bound.value_is_field:
                heads.add(str(self.bound.value).split(".")[0])
        return tuple(sorted(heads))


WALK_FIELDS = ("inputs", "output", "outputs", "grad_input", "grad_output", "params", "tensor_pre", "tensor_post",
               "model", "input_ids")


def tensor_summaries(p: Column, fields: Iterable[str] = WALK_FIELDS, tensor: Sequence[str] | None = None) -> Column:
    """Every tensor summary of a payload: known single, list and parameter positions.

    Model parameters carry dtype and shape themselves, so both the parameter and its nested
    summary are included. ``tensor``: the fields that the summaries were parsed with, dtype and shape among them.
    """
    kind = sc.TENSOR if tensor is None else sc.narrow(sc.TENSOR, set(tensor))

    def norm(x: Column) -> Column:
        return F.struct(*[x.getField(f.name).alias(f.name) for f in kind.fields])

    one, many = [], []
    for f in fields:
        if f in ("inputs", "outputs", "grad_input", "grad_output", "params"):
            many.append(p.getField(f))
        elif f == "model":
            prm = p.getField("model").getField("parameters")
            many.append(F.transform(prm, norm))
            many.append(F.transform(prm, lambda x: x.getField("tensor_summary")))
        else:
            one.append(p.getField(f))
    empty = F.array().cast("array<" + kind.simpleString() + ">")
    parts = [F.coalesce(m, empty) for m in many] + ([F.array(*one)] if one else [])
    allts = parts[0] if len(parts) == 1 else F.concat(*parts)
    return F.filter(allts, lambda t: t.isNotNull() & t.getField("dtype").isNotNull() & t.getField("shape").isNotNull())


def signature_fields(t: Column) -> dict[str, Column]:
    """Derived fields usable by signature bounds."""
    shape = t.getField("shape")
    peak = X.first_nonzero(t.getField("abs_max"), t.getField("max"))
    return {"rms": X.rms(t.getField("l2_norm"), shape), "numel": X.numel(shape), "n_rows": X.leading_rows(shape),
            "one_hot": X.one_hot(t.getField("l2_norm"), peak, shape)}


def compile_predicate(pr: Predicate) -> Check:
    sc_, b = pr.scope, pr.bound
    applies = (lambda p: X.matches(p.getField("module_class"), sc_.class_regex)) if sc_.class_regex else None
    common = dict(check_id=pr.check_id, hookpoints=sc_.hookpoints, tier=pr.tier, fields=pr.needed(),
                  applies=applies, template=pr.template)
    parent_guard = (lambda p: pr.precondition(p, None)) if pr.precondition else None

    if pr.shape == "monotonic":
        return Check(**{**common, "fields": ()}, frame_fields=pr.needed(), precondition=None,
                     frame=monotonic_frame(b.fields[0]))
    if pr.shape == "flat":
        return Check(**common, precondition=parent_guard, findings=lambda p: fail_if(
            b.failure(lambda n: X.field(p, n)), b.fields[0], b.kind, None))
    if pr.shape == "walk":
        return Check(**common, precondition=parent_guard, findings=lambda p: fail_if(
            F.exists(tensor_summaries(p), lambda t: F.coalesce(b.failure(lambda n: X.field(t, n)), F.lit(False))),
            b.fields[0], "tensor"))
    if pr.shape == "signature":
        def sig(p):
            t = X.field(p, sc_.path or "$.output")
            d = signature_fields(t)
            obs = d[b.fields[0]]
            return fail_if(t.isNotNull() & b.failure(lambda n: d[n] if n in d else X.field(t, n)),
                           b.fields[0], "signature", obs.cast("double"))
        return Check(**common, precondition=parent_guard, findings=sig)

    path = sc_.path.removeprefix("$.")
    if path.endswith("[*]"):
        def listed(p):
            items = X.field(p, path[:-3])
            def bad(x):
                c = b.failure(lambda n: X.field(x, n))
                return (pr.precondition(p, x) & c) if pr.precondition else c
            return fail_each(items, bad, lambda x: finding(b.fields[0], b.kind))
        return Check(**common, findings=listed)

    def projected(p):
        x = X.field(p, path)
        c = x.isNotNull() & b.failure(lambda n: X.field(x, n))
        return fail_if((pr.precondition(p, x) & c) if pr.precondition else c, b.fields[0], b.kind)
    return Check(**common, findings=projected)


def monotonic_frame(path: str, span: int = 1 << 20, strict: bool = True, by: tuple[str, ...] = ("run", "rank")):
    """Frame check: a counter must increase along event_id inside each (run, rank)."""
    from guardlens.functions import ordered

    def frame(parsed: DataFrame, guards: frozenset[str]) -> DataFrame:
        v = parsed.select("run", "rank", "step", "event_id", X.field("p", path).alias("v")).where(F.col("v").isNotNull())
        d = ordered.with_previous(v, "v", ordered.Order(by, "event_id", (), span), "prev")
        bad = ~(F.col("v") > F.col("prev")) if strict else ~(F.col("v") >= F.col("prev"))
        return d.where(bad).select("run", "rank", "step", "event_id", F.lit(path).alias("entity"),
                                   F.lit("not increasing").alias("issue"), F.col("v").cast("double").alias("observed"))
    return frame


def with_frame(c: Check, **changes) -> Check:
    return replace(c, **changes)
