"""SQL-callable helpers and the user extension point."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from guardlens.operators.spec import Check

# name, parameters, return type, body: plain SQL functions, inlined by the optimizer
SQL_FUNCTIONS = (
    ("gl_numel", "shape ARRAY<BIGINT>", "BIGINT", "aggregate(shape, 1L, (a, x) -> a * x)"),
    ("gl_rms", "l2 DOUBLE, shape ARRAY<BIGINT>", "DOUBLE", "l2 / sqrt(CAST(aggregate(shape, 1L, (a, x) -> a * x) AS DOUBLE))"),
    ("gl_one_hot", "l2 DOUBLE, peak DOUBLE, n_rows BIGINT", "BOOLEAN",
     "abs(peak - 1.0D) < 1e-3D AND abs(l2 * l2 - n_rows) < 0.05D * n_rows"),
    ("gl_block_index", "name STRING", "INT", "try_cast(regexp_extract(name, 'blocks\\\\.([^.]*)', 1) AS INT)"),
    ("gl_deviation", "a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN a > 0 AND b > 0 THEN greatest(a / b, b / a) END"),
)


def register_sql_functions(spark: SparkSession) -> list[str]:
    for name, params, returns, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
    return [f[0] for f in SQL_FUNCTIONS]


def _leaves(value, path: str):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _leaves(v, f"{path}.{k}")
    elif isinstance(value, list):
        if not value:
            yield path + "[*]", "empty"
        for v in value:
            yield from _leaves(v, path + "[*]")
    elif value is None:
        yield path, "null"
    elif isinstance(value, bool):
        yield path, "bool"
    elif isinstance(value, (int, float)):
        yield path, "number"
    else:
        yield path, "string"


@udtf(returnType="path string, type string", useArrow=True)
class JsonLeaves:
    """Leaf paths and types of one JSON text (``[*]`` for list elements)."""

    def eval(self, payload: str):
        try:
            doc = json.loads(payload)
        except (TypeError, ValueError):
            return
        for leaf in sorted(set(_leaves(doc, "$"))):
            yield leaf


def leaf_counts(df: DataFrame, column: str) -> DataFrame:
    """(path, type, n): how many texts of a column have each leaf. Equal texts are counted first and read once."""
    texts = df.groupBy(F.col(column).alias("__text")).agg(F.count(F.lit(1)).alias("__n"))
    leaves = texts.lateralJoin(JsonLeaves(F.col("__text").outer()))
    return leaves.groupBy("path", "type").agg(F.sum("__n").alias("n"))


def register_json_leaves(spark: SparkSession, name: str = "gl_json_leaves") -> str:
    spark.udtf.register(name, JsonLeaves)
    return name


class CheckRegistry:
    """User checks next to the built-in rules.

    ``@registry.check("my-check", hookpoints=("loss.call",))`` registers a function from the
    parsed trace to violations (run, rank, step, event_id, entity, issue, observed).
    """

    def __init__(self, checks: Iterable[Check] = ()):
        self._checks = {c.check_id: c for c in checks}

    def add(self, check: Check) -> Check:
        if check.check_id in self._checks:
            raise ValueError(f"check {check.check_id!r} is already registered")
        self._checks[check.check_id] = check
        return check

    def check(self, check_id: str, hookpoints: tuple[str, ...], tier: int = 0, fields: tuple[str, ...] = (),
              description: str = "") -> Callable:
        def wrap(fn: Callable[[DataFrame], DataFrame]):
            self.add(Check(check_id, tuple(hookpoints), tier=tier, frame_fields=tuple(fields), description=description,
                           frame=lambda parsed, guards: fn(parsed)))
            return fn
        return wrap

    def all(self, tier: int = 4) -> list[Check]:
        return [c for c in self._checks.values() if c.tier <= tier]

    def __getitem__(self, check_id: str) -> Check:
        return self._checks[check_id]
