"""Scalar column builders (projection, filter and derived-value expressions).

Everything is a Catalyst expression, so it stays inside whole-stage codegen and is
usable in filters, projections, windows and streaming plans alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- JSON access -----------------------------------------------------------------

def json_value(payload: Column | str, path: str) -> Column:
    """Value at ``$.a.b`` as text; a JSON null and a missing path are both NULL."""
    return F.get_json_object(col(payload), path if path.startswith("$") else f"$.{path}")


def json_number(payload: Column | str, path: str, kind: str = "double") -> Column:
    """Numeric value at a path; text that is no number gives NULL instead of an error."""
    return json_value(payload, path).try_cast(kind)


def number(c: Column | str, kind: str = "double") -> Column:
    return col(c).try_cast(kind)


def field(record: Column | str, path: str) -> Column:
    """Nested field of a typed struct (``$.a.b`` or ``a.b``)."""
    out = col(record)
    for part in path.removeprefix("$.").split("."):
        out = out.getField(part)
    return out


def equals_literal(c: Column, value: object) -> Column:
    """Equality with a typed literal; comparing with None means IS NULL."""
    return c.isNull() if value is None else c == F.lit(value)


# -- text scopes -------------------------------------------------------------------

def hookpoint_in(names: Iterable[str], column: Column | str = "hookpoint") -> Column:
    names = list(names)
    return col(column) == names[0] if len(names) == 1 else col(column).isin(*names)


def contains_any(c: Column | str, words: Iterable[str]) -> Column:
    """True where the text holds any of the words literally (case-sensitive)."""
    out = F.lit(False)
    for w in words:
        out = out | col(c).contains(w)
    return out


def matches(c: Column | str, pattern: str, ignore_case: bool = False) -> Column:
    return col(c).rlike(f"(?i){pattern}" if ignore_case else pattern)


# -- tensor-summary algebra ----------------------------------------------------------

def numel(shape: Column | str) -> Column:
    return F.aggregate(col(shape), F.lit(1).cast("long"), lambda acc, x: acc * x.cast("long"))


def leading_rows(shape: Column | str) -> Column:
    """Product of all dimensions but the last."""
    s = col(shape)
    return numel(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))))


def rms(l2: Column | str, shape: Column | str) -> Column:
    n = numel(shape)
    return F.when(n > 0, col(l2) / F.sqrt(n.cast("double")))


def first_nonzero(*cs: Column) -> Column:
    """First value that is neither NULL nor zero, else the last value given."""
    return F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in cs[:-1]], cs[-1])


def one_hot(l2: Column, peak: Column, shape: Column) -> Column:
    """Each row of the tensor carries all its mass on a single index."""
    rows = leading_rows(shape).cast("double")
    return ((F.size(shape) > 0) & (rows != 0) & (F.abs(peak - 1.0) < 1e-3)
            & (F.abs(l2 * l2 - rows) < rows * 0.05))


def one_hot_kind(shape: Column) -> Column:
    return F.when(F.element_at(shape, -1) == 1, F.lit("trivial_size_1")).otherwise(F.lit("one_hot"))


def dtype_name(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"torch\.", "")


def block_index(name: Column | str) -> Column:
    """Integer after ``blocks.`` in a dotted module name, NULL when there is none."""
    return F.regexp_extract(col(name), r"blocks\.([^.]*)", 1).try_cast("int")


# -- numeric tests ---------------------------------------------------------------------

def is_inf(c: Column) -> Column:
    return F.abs(c) == F.lit(INF)


def magnitude_issue(c: Column | str, explode_at: float = 1e10) -> Column:
    """Label of a pathological magnitude; NaN is tested first because NaN sorts above all."""
    v = col(c)
    return (F.when(F.isnan(v), F.lit("NaN")).when(is_inf(v), F.lit("Inf"))
            .when(v == 0.0, F.lit("zero")).when(v > explode_at, F.lit("explosion")))


def symmetric_ratio(a: Column | str, b: Column | str) -> Column:
    """``max(a/b, b/a)``; NULL unless both are positive."""
    a, b = col(a), col(b)
    return F.when((a > 0) & (b > 0), F.greatest(a / b, b / a))


def relaxed(rhs: Column, op: str, rel: float = 0.0, absolute: float = 0.0) -> Column:
    """Right-hand side moved in the permissive direction of ``op`` by the tolerances."""
    if not rel and not absolute:
        return rhs
    slack = F.abs(rhs) * float(rel) + float(absolute)
    if op in ("<", "<="):
        return rhs + slack
    if op in (">", ">="):
        return rhs - slack
    return rhs


# -- text helpers --------------------------------------------------------------------------

def marker_name(c: Column | str, drop: Iterable[str] = ("begin", "end"),
                names: Mapping[str, str] | None = None) -> Column:
    """Marker id without its phase tokens, mapped to a display name when one is known."""
    kept = F.array_join(F.filter(F.split(col(c), "_"), lambda t: ~t.isin(*drop)), "_")
    if not names:
        return kept
    lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.element_at(lookup, kept), kept)


def epoch_text(micros: Column | str) -> Column:
    """UTC text of epoch microseconds, whatever the session time zone is."""
    start = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    span = F.make_dt_interval(secs=(col(micros) / 1000000).cast("decimal(20,6)"))
    return F.date_format(start + span, "yyyy-MM-dd HH:mm:ss")


def map_label(c: Column | str, mapping: Mapping[str, str], default: Column | str | None = None) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    hit = F.element_at(lookup, col(c))
    return hit if default is None else F.coalesce(hit, F.lit(default) if isinstance(default, str) else default)


def parallel_axes(c: Column | str, axes: Iterable[str] = ("cp", "dp", "ep", "pp", "sp", "tp")) -> Column:
    """``tp>1 & dp>1`` -> ``dp+tp``: the axes named in a topology text, sorted."""
    found = F.array(*[F.when(F.lower(col(c)).rlike(rf"\b{a}\b"), F.lit(a)) for a in sorted(axes)])
    return F.array_join(F.filter(found, lambda x: x.isNotNull()), "+")


def common_prefix(lo: Column | str, hi: Column | str) -> Column:
    """Longest common prefix of two texts.

    The prefix shared by a whole set is the prefix shared by its minimum and maximum,
    so a group needs only ``min`` and ``max`` (both combine before the shuffle).
    """
    lo, hi = col(lo), col(hi)
    n = F.least(F.length(lo), F.length(hi))
    first_diff = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0),
        lambda acc, i: F.when((acc == i - 1) & (F.substring(lo, i, F.lit(1)) == F.substring(hi, i, F.lit(1))), i)
        .otherwise(acc))
    return F.substring(lo, F.lit(1), F.when(n == 0, F.lit(0)).otherwise(first_diff))


def content_hash(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def normalised_text(c: Column | str) -> Column:
    """Lower-case text with runs of white space folded, for duplicate keys."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"\s+", " "))


def hash_order(seed: object, *cs: Column | str) -> Column:
    """Deterministic pseudo-random long in [0, 2^32) from a seed and columns (md5 based)."""
    text = F.concat_ws(":", F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string"),
                       *[col(c).cast("string") for c in cs])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def json_detail(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
