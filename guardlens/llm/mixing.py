"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

The size of a document is its number of words. Sources, ordered by code point with null last, weigh 3, 1, 2
and so on in turn; their targets share ``budget`` times all words by weight, stop at ``most`` times the
source's own words, and pass the excess on by weight until none is above. A target of f whole sources and a
rest takes every document f times and, once more, the documents whose hash lies below a threshold.

The threshold comes from histograms: words are summed by source and hash bucket (combined before the
shuffle, at most 2**bits rows a source), the bucket that crosses the rest is found, and only the documents of
that bucket go to the next, finer histogram, down to single hash values. Nothing is sorted. Hashes depend on
the id alone, so reruns agree and the documents taken for a smaller budget are among those of a larger one.

At the last hash value the nearer side of the rest is chosen, so a source misses its target by at most half
the words of one hash value. Null and empty texts have size 0. Rows with equal ids (null is one) share a
hash and are taken or left together; a source without words has target 0 and takes nothing. Only the id,
text and source columns are read. An empty table gives no rows. The window over the sources has one row for each source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlens.llm.bitmaps import small
from guardlens.session import cut, discard, scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BITS, LEVELS = 12, 4  # 48 bits: the first 12 hex digits of the md5 of the id


def hash48(id_col: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target): ``sizes`` has the columns source and size."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    s = (s.withColumn("rank", rank)
         .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
         .withColumn("full", F.col("source_size") * most)
         .withColumn("level", F.col("full") / F.col("weight")))
    # with the k sources of the lowest level full, the others would stand at `share` words per weight;
    # it rises while sources overflow and falls after, so the common level is its maximum
    before = every.orderBy("level", "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget) * F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    return (s.withColumn("share", left / weight)
            .withColumn("target", F.least(F.col("full").cast("double"), F.col("weight") * F.max("share").over(every)))
            .select("source", "source_size", "target"))


def _with(rows: DataFrame, few: DataFrame, on: tuple[str, ...] = ("source",), how: str = "inner") -> DataFrame:
    """Join on null-safe keys; the planner broadcasts the per-source side by its measured size."""
    right = few.select(*[F.col(c).alias(f"__{c}") for c in on], *[c for c in few.columns if c not in on])
    same = reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"__{c}")), on, F.lit(True))
    return rows.join(right, same, how).drop(*[f"__{c}" for c in on])


def thresholds(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target, copies, threshold) from rows of (source, size, h)."""
    t = targets(sizes, weights, budget, most).withColumn(
        "copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    plan = cut(t, "mix-targets")
    state = plan.select("source", (F.col("target") - F.col("copies") * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        rows = sizes.select("source", "size", F.shiftright("h", shift + BITS).alias("prefix"), F.shiftright("h", shift).alias("bucket"))
        # all rows at first, later only those of the boundary bucket; `state` has one row a source
        inside = _with(rows, state.select("source", "prefix"), ("source", "prefix"), "left_semi") if level else rows
        sums = inside.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("words").over(run))
        hit = (_with(sums, state.select("source", "rest"))
               .where((F.col("upto") - F.col("words") <= F.col("rest")) & (F.col("upto") > F.col("rest"))))
        state = hit.select("source", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"), F.col("bucket").alias("prefix"), "words")
        state = cut(state, "mix-level")
    last = state.select("source", (F.col("prefix") + (F.col("words") - F.col("rest") < F.col("rest")).cast("long")).alias("threshold"))
    return _with(plan, last, how="left")


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with the columns source and h get source_size, target and copies."""
    extra = F.coalesce(F.col("h") < F.col("threshold"), F.lit(False)).cast("int")
    # one row a source: broadcast once counted, else rows would be dealt by source, a third of them to one task
    return _with(rows, small(plan)).withColumn("copies", F.col("copies") + extra).drop("threshold")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"),
                       hash48(docs[id_col]).alias("h"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, most: int = 2) -> DataFrame:
    """One row per document: size, source_size, target, copies, and ``taken`` = copies * size."""
    sizes = cut(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    plan = cut(thresholds(sizes, weights, budget, most), "mix-plan")
    return _taken(sizes, plan).select(F.col("id").alias(id_col), "size", "source_size", "target",
                                      (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, most: int = 2) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of the input."""
    with scratch() as made:
        sizes = cut(_sized(docs, id_col, text_col, source_col).drop("id"), "mix-sizes")
        plan = cut(thresholds(sizes, weights, budget, most), "mix-plan")
    discard(docs.sparkSession, made[:-1])  # all but the last
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[source_col].alias("source"), hash48(docs[id_col]).alias("h"))
    taken = _taken(rows, plan).where(F.col("copies") > 0)
    return taken.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank
  FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS full_size FROM s),
l AS (SELECT *, CAST(full_size AS DOUBLE) / weight AS level FROM w),
k AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(full_size) OVER p, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS share,
         lag(level) OVER (ORDER BY level, rank) AS below
  FROM l WINDOW p AS (ORDER BY level, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
-- the common level: the sources below it overflow, the next one does not
c AS (SELECT min(share) AS share FROM k WHERE share <= level AND (below IS NULL OR below <= share)),
t AS (
  SELECT k.source, k.source_size, least(CAST(k.full_size AS DOUBLE), k.weight * c.share) AS target FROM k, c),
f AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
a AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
b AS (
  SELECT a.source, a.h + CASE WHEN a.upto - r.rest < r.rest - (a.upto - a.words) THEN 1 ELSE 0 END AS threshold
  FROM a JOIN (SELECT source, target - copies * source_size AS rest FROM f) r ON a.source IS NOT DISTINCT FROM r.source
  WHERE a.upto - a.words <= r.rest AND a.upto > r.rest)
SELECT d.doc_id, d.size, f.source_size, f.target,
       CAST(d.size * (f.copies + CASE WHEN d.h < b.threshold THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(f.copies + CASE WHEN d.h < b.threshold THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""
