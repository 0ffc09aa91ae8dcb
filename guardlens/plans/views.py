"""Deterministic views over the given tables, written once for Spark and once as SQL.

They give operational shape (trace, replicated state, result tables) to the business tables, so
every operator runs on whole tables and its work grows with them.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlens import schema as sc

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")


EPOCH_NS = 1_704_067_200_000_000_000  # start of the events table's month


def micros(ts: Column) -> Column:
    """Epoch microseconds of a zone-less timestamp, independent of the session zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def trace(self) -> DataFrame:
        e = self.table("events")
        return e.select("event_id", micros(F.col("ts")).alias("ts_us"), F.expr("event_id div 50").alias("step"),
                        (F.col("user_id") % 4).alias("rank"), F.concat(F.lit("run"), (F.col("user_id") % 3).cast("string")).alias("run"),
                        F.col("event_type").alias("hookpoint"), "user_id", "value", F.col("props").alias("payload"))

    @cached_property
    def state(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("name"), (F.col("l_suppkey") % 4).cast("int").alias("tp"),
            F.col("l_linenumber").alias("replica"),
            F.when(F.col("l_quantity") >= 50, "alt").otherwise("base").alias("cksum"),
            F.col("l_linestatus").alias("dtype"), F.col("l_returnflag").alias("layout"),
            F.col("l_extendedprice").alias("stat"), F.col("l_quantity").alias("qty"))

    @cached_property
    def tensor(self) -> DataFrame:
        l2 = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        return self.table("embeddings").select(
            "vec_id", F.col("label").alias("label"), l2.alias("l2"), F.array(F.size("embedding").cast("long")).alias("shape"),
            (F.col("vec_id") % 5).cast("int").alias("block"))

    @cached_property
    def doc_lines(self) -> DataFrame:
        from guardlens.sources.textlogs import split_lines
        return split_lines(self.table("documents"), ["doc_id"], "text")

    # -- derived event traces: every row of a table becomes one event of the trace format --------

    def events_as(self, hookpoint: str | Column, source: str | DataFrame, event_id: str | Column, key: Column | None = None,
                  step: Column | None = None, **fields: Column) -> DataFrame:
        """Trace of one hookpoint with a JSON payload built from the columns of a table.

        ``key`` decides run (key mod 3) and rank (key mod 4); it defaults to the event id.
        """
        eid = F.col(event_id) if isinstance(event_id, str) else event_id
        k = eid if key is None else key
        t = self.table(source) if isinstance(source, str) else source
        return t.select(
            eid.cast("long").alias("event_id"), (F.lit(0) if step is None else step).cast("int").alias("step"),
            F.pmod(k, F.lit(4)).cast("int").alias("rank"),
            (F.lit(hookpoint) if isinstance(hookpoint, str) else hookpoint).alias("hookpoint"),
            (F.lit(EPOCH_NS).cast("long") + eid.cast("long") * 1000).alias("ts_ns"), F.lit(1).alias("schema_version"),
            F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])).alias("payload"),
            F.concat(F.lit("run"), F.pmod(k, F.lit(3)).cast("string")).alias("run"))


def tensor_json(**kw: Column) -> Column:
    base = {"dtype": F.lit("float32"), "shape": F.array(F.lit(8).cast("long"), F.lit(4).cast("long"))}
    base.update(kw)
    return F.struct(*[c.alias(k) for k, c in base.items()])


# The same views for the oracle.
VIEW_SQL: dict[str, str] = {
    "v_trace": """SELECT event_id, epoch_us(ts) AS ts_us, event_id // 50 AS step, user_id % 4 AS rank,
        'run' || CAST(user_id % 3 AS VARCHAR) AS run, event_type AS hookpoint, user_id, value, props AS payload FROM events""",
    "v_state": """SELECT l_orderkey AS name, CAST(l_suppkey % 4 AS INTEGER) AS tp, l_linenumber AS replica,
        CASE WHEN l_quantity >= 50 THEN 'alt' ELSE 'base' END AS cksum, l_linestatus AS dtype, l_returnflag AS layout,
        l_extendedprice AS stat, l_quantity AS qty FROM lineitem""",
    "v_tensor": """SELECT vec_id, label, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS l2,
        [CAST(len(embedding) AS BIGINT)] AS shape, CAST(vec_id % 5 AS INTEGER) AS block FROM embeddings""",
    "v_doc_lines": """SELECT doc_id, CAST(i AS BIGINT) AS line_no, lines[i] AS line FROM
        (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM
          (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) s) t""",
}


def with_views(sql: str) -> str:
    """Prefix the definitions of the views a statement mentions."""
    used = [v for v in VIEW_SQL if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql.strip()
    ctes = ",\n".join(f"{v} AS ({VIEW_SQL[v]})" for v in used)
    body = sql.strip()
    m = re.match(r"(?is)^WITH\s+(RECURSIVE\s+)?", body)
    if m:
        return f"WITH {m.group(1) or ''}{ctes},\n{body[m.end():]}"
    return f"WITH {ctes}\n{body}"


__all__ = ["Views", "tensor_json", "micros", "with_views", "VIEW_SQL", "sc"]
