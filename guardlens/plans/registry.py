"""Query registry: one Spark plan per operator and, where SQL can say it, the oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from guardlens.plans.views import with_views


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(v)`` where ``v`` gives the tables and derived views of a scale-factor folder."""
    from guardlens.plans.views import Views

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = Query(name, lambda spark, sf_dir: fn(Views(spark, sf_dir)), with_views(sql) if sql else None)
        return fn
    return wrap


def load() -> dict[str, Query]:
    from guardlens.plans import (q_sources, q_exprs, q_checks, q_guards, q_rules, q_state, q_generic,  # noqa: F401
                                 q_relational, q_mining, q_streaming, q_diagnose, q_evalkit, q_surface)
    return QUERIES
