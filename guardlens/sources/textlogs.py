"""Log, source-text and table-text sources.

Line order inside a file is carried by ``line_no``: from ``posexplode`` of the file's text
(``read_lines``), from byte ranges for files of any size (``read_large_lines``), or from the caller.
Stateful parsing runs over two-level ordered scans, so a single huge log is not one task.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlens.functions import exprs as X
from guardlens.functions import ordered
from guardlens.operators.relational import keep_first, top_k

NUMBER = r"([-+]?(?:\d+\.?\d*(?:[eE][-+]?\d+)?|nan|inf|NaN|Inf))"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, whole text, split inside Spark."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return split_lines(t, ["file"], "text")


def read_large_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files of any size.

    Files are split by byte ranges. A line's place is its range start and its sequence inside the
    range, so numbering runs per range and only the range sizes are summed up in order.
    """
    seq = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"),
                                     F.col("_metadata.file_block_start").alias("__block"), seq.alias("__seq"),
                                     F.col("value").alias("line"))
    o = ordered.Order(("file",), "__block", ("__seq",), 1)
    return ordered.with_ordinal(t, o, "line_no").select("file", F.col("line_no").cast("long").alias("line_no"), "line")


def split_lines(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """One row per line, numbered from 1."""
    return df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("__pos", "line")).select(
        *keys, (F.col("__pos") + 1).cast("long").alias("line_no"), "line")


def metric(line: Column | str, pattern: str, group: int = 1) -> Column:
    """First match as a double; textual nan / inf become the numbers, no match NULL."""
    m = F.lower(F.regexp_extract(X.col(line), pattern, group))
    return (F.when(m == "", F.lit(None)).when(m.isin("nan", "+nan", "-nan"), F.lit(float("nan")))
            .when(m.isin("inf", "+inf"), F.lit(X.INF)).when(m == "-inf", F.lit(-X.INF)).otherwise(m.try_cast("double")))


def iteration_times(lines: DataFrame, keys: Sequence[str], order: str, line: str = "line",
                    pattern: str = r"elapsed time per iteration \(ms\): " + NUMBER) -> DataFrame:
    """(keys, order, ms, iteration): the n-th timing line of each log is iteration n."""
    d = lines.select(*keys, order, metric(line, pattern).alias("ms")).where(F.col("ms").isNotNull())
    return ordered.with_ordinal(d, ordered.Order(tuple(keys), order), "iteration")


def metric_alternatives(lines: DataFrame, line: str, alternatives: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Ordered patterns; the first that matches a line yields (loss, grad_norm).

    Each alternative is (pattern, loss group, grad-norm group); group 0 means absent.
    """
    loss, grad = F.lit(None).cast("double"), F.lit(None).cast("double")
    for pattern, gl, gg in reversed(alternatives):
        hit = F.col(line).rlike(pattern)
        loss = F.when(hit, metric(line, pattern, gl) if gl else F.lit(None).cast("double")).otherwise(loss)
        grad = F.when(hit, metric(line, pattern, gg) if gg else F.lit(None).cast("double")).otherwise(grad)
    return lines.withColumn("loss", loss).withColumn("grad_norm", grad).where(
        F.col("loss").isNotNull() | F.col("grad_norm").isNotNull())


def sectioned_verdicts(lines: DataFrame, keys: Sequence[str], order: str, line: str, banner: str, verdict: str,
                       summary: str | None = None, span: int = 1 << 20) -> DataFrame:
    """Verdict per (log, section): banner lines open sections, the first verdict line wins, an
    explicit summary line overrides it."""
    l = F.col(line)  # noqa: E741
    d = ordered.carry_forward(lines, F.nullif(F.regexp_extract(l, banner, 1), F.lit("")),
                              ordered.Order(tuple(keys), order, (), span), "section")
    v = F.nullif(F.regexp_extract(l, verdict, 1), F.lit(""))
    prio, val = F.when(v.isNotNull(), 1), v
    if summary:
        s = F.nullif(F.regexp_extract(l, summary, 1), F.lit(""))
        prio, val = F.when(s.isNotNull(), 0).otherwise(prio), F.coalesce(s, v)
    hits = d.withColumn("__p", prio).withColumn("verdict", val).where(F.col("section").isNotNull() & F.col("__p").isNotNull())
    return hits.groupBy(*keys, "section").agg(F.min_by("verdict", F.struct("__p", order)).alias("verdict"),
                                              F.count(F.lit(1)).alias("n_verdict_lines"))


_BRACES = re.compile(r"\\.|[{}\"]", re.S)


def _objects(texts: pd.Series) -> pd.Series:
    """Outermost balanced {...} of each text; braces inside JSON strings do not count, a brace never closed is skipped.

    Whether a brace stands inside a string depends on the quotes since the object began, so on their parity: braces after an even and
    after an odd number of quotes are matched apart. A brace that never closes, or a stray quote, then hides nothing that follows.
    """
    def one(text: str | None) -> list[str]:
        braces: list[tuple[int, str, int]] = []
        quotes = 0
        for m in _BRACES.finditer(text or ""):
            if m[0] == '"':
                quotes += 1
            elif len(m[0]) == 1:
                braces.append((m.start(), m[0], quotes % 2))
        ends: dict[int, int] = {}
        opened: tuple[list[int], list[int]] = ([], [])
        for at, c, side in braces:
            if c == "{":
                opened[side].append(at)
            elif opened[side]:
                ends[opened[side].pop()] = at + 1
        out, upto = [], 0
        for at, c, _ in braces:
            if c == "{" and at >= upto and at in ends:
                upto = ends[at]
                out.append(text[at:upto])
        return out
    return texts.map(one)


def embedded_records(texts: DataFrame, text: str, name_path: str, value_path: str,
                     top: int | None = None) -> DataFrame:
    """JSON objects found in text: variants per name by normalised hash, most frequent first.

    Objects may hold others and braces inside strings; the outermost ones count. ``top`` keeps the first variants of a name.
    """
    objects = F.pandas_udf(_objects, T.ArrayType(T.StringType()))
    obj = texts.where(F.col(text).contains("{")).select(F.explode(objects(F.col(text))).alias("obj"))
    r = obj.select(X.json_value("obj", name_path).alias("name"), X.json_value("obj", value_path).alias("value")).where(
        F.col("name").isNotNull() & F.col("value").isNotNull())
    h = X.content_hash(X.normalised_text("value"))
    v = r.groupBy("name", h.alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value"))
    return top_k(v, ["name"], top or (1 << 31) - 1, F.desc("n"), "hash", out="variant_no")


def pattern_hits(lines: DataFrame, recipes: Mapping[str, str], path: str, max_hits: int | None = None,
                 snippet: int | None = None) -> DataFrame:
    """Lines matching named patterns, whatever their case: (recipe, path, line_no, snippet), optionally first n per recipe.

    The snippet is the trimmed line, cut only if a length is given. All recipes are tested in one pass over the lines.
    """
    l = F.col("line")  # noqa: E741
    found = F.filter(F.array(*[F.when(l.rlike(f"(?i){p}"), F.lit(n)) for n, p in recipes.items()]), lambda x: x.isNotNull())
    d = lines.select(F.explode(found).alias("recipe"), path, "line_no",
                     (F.trim(l) if snippet is None else F.substring(F.trim(l), 1, snippet)).alias("snippet"))
    return d if max_hits is None else top_k(d, ["recipe"], max_hits, path, "line_no")


def verdict_cells(rows: DataFrame, cell: str, marks: Mapping[str, str]) -> DataFrame:
    """Markdown cell ``mark (detail)`` -> verdict, detail."""
    c = F.trim(F.col(cell))
    return rows.withColumn("verdict", X.map_label(F.regexp_extract(c, r"^(\S+)", 1), marks)).withColumn(
        "detail", F.nullif(F.regexp_extract(c, r"\(([^)]*)\)", 1), F.lit("")))


def markdown_table(lines: DataFrame, line: str = "line") -> DataFrame:
    """Cells of pipe-table rows, without separator rows."""
    l = F.trim(F.col(line))  # noqa: E741
    body = lines.where(l.startswith("|") & ~l.rlike(r"^\|[\s:|-]+\|$"))
    parts = F.split(F.regexp_replace(l, r"^\||\|$", ""), r"\|")
    return body.withColumn("cells", F.transform(parts, lambda x: F.trim(x)))


def latest_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    return keep_first(df, keys, *order)
