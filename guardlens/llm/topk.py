"""Exact top-k by inner product: no-random-access aggregation over sorted lists.

Every component x becomes the integer floor(scale * x); a score is an integer inner product, so results are exact. Vectors are
dealt by row number into blocks of about ``BLOCK`` rows, queries into groups of about ``GROUP``; a cell is one block with one group.
In a cell each dimension has a list of the block's vectors sorted by component. Lists are read from both ends, side by side, ever deeper, once
for all queries of a group; a query takes each list from the end that adds most to it. Nothing is looked up by vector while lists are read:

* a vector's lower bound is the sum of what was read of it plus the least that its unread lists can add, its upper bound the same with what stands
  next in these lists;
* vectors never met have the sum of what stands next as their upper bound, and reading ends when that is below the k-th largest lower
  bound and few enough others can still reach it (or the lists end);
* the final scores of those are resolved from their components.

The k best of each block meet in one ranking by query, k rows a block, and Spark's rank limit cuts them before the shuffle. Neither
the queries nor the vectors are broadcast: both are copied to the cells by key, the queries once a block and the vectors once a group.

Equal vectors of a block are one list entry with its k + 1 first rows (others cannot be among the k best of any query), so that a third
of all rows being one vector costs one entry a block. Ties go to the smaller id, null ids last, then to the earlier row. A query is a
row, its own row is no candidate; another row with the same id is one. Vectors that are null or hold null, NaN or infinite components take no part;
shorter ones count as filled up with zeros, empty ones score 0. Rows with a null id are candidates, not queries. An empty
table gives no rows. If scores could leave 64 bits an error says so. Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardlens.session import cut

K, SCALE, STEP = 10, 1024, 100
BLOCK, GROUP = 4096, 1024
FIRST_DEPTH = 64
FEW, SHARE = 8, 2  # reading may end when at most FEW * k vectors, or one in SHARE, can still reach the k-th lower bound
QUERIES = 128      # of a group that read the lists side by side


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(row, id, dims, most, x): components as little-endian 64-bit integers; vectors that take no part are left out."""
    kind = vectors.schema[id_col].dataType.simpleString()
    src = vectors.select(F.monotonically_increasing_id().alias("row"), vectors[id_col].alias("id"), vectors[vec_col].cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, dims, most, out = [], [], [], []
            v = batch.column(2)
            for i, x in enumerate(v):
                if not x.is_valid or x.values.null_count:
                    continue
                y = np.floor(scale * x.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if not np.isfinite(y).all():
                    if np.isfinite(x.values.to_numpy(zero_copy_only=False)).all():
                        raise OverflowError("a component is too large for 64-bit scores")
                    continue
                top = float(np.abs(y).max(initial=0))
                if top >= 2.0 ** 62:
                    raise OverflowError("a component is too large for 64-bit scores")
                keep.append(i)
                dims.append(len(y))
                most.append(top)
                out.append(y.astype("<i8").tobytes())
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(dims, pa.int32()), pa.array(most, pa.float64()), pa.array(out, pa.binary())],
                                             names=["row", "id", "dims", "most", "x"])

    return src.mapInArrow(run, f"row long, id {kind}, dims int, most double, x binary")


class Lists:
    """A block's vectors sorted by each component."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.up = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)  # a row for each dimension
        self.value = np.take_along_axis(x.T, self.up, 1)

    def read(self, a: int, b: int, top: bool) -> tuple[np.ndarray, np.ndarray]:
        """Entries a to b of every list, from its largest or its smallest component."""
        n = self.x.shape[0]
        part = slice(n - b, n - a) if top else slice(a, b)
        return self.up[:, part], self.value[:, part]


def contenders(lists: Lists, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the vectors of the block that can be among its k best (all that are, and ties of the k-th).

    The lists are read once for all queries. What was read lies in one array for each end, so the bounds of all (query, vector) are
    two products of matrices: what was read, plus the sums over unread lists of what stands next, or of the least.
    """
    n, dims = lists.x.shape
    if n <= k or not dims:
        return [np.arange(n)] * len(queries)
    size = float(np.abs(lists.x).max()) * float(np.abs(queries).max(initial=0)) * dims
    kind = np.float64 if 4 * size < 2.0 ** 53 else np.int64  # sums of integers below 2**53 are exact in doubles
    both = np.zeros((n, 4 * dims), kind)
    read, shown = both[:, :2 * dims], both[:, 2 * dims:]
    q = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)]).astype(kind)  # read from the top, and from the bottom
    least = q * np.concatenate([lists.value[:, 0], lists.value[:, -1]]).astype(kind)
    dim = np.arange(dims)[:, None]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
    open_ = np.arange(len(queries))
    a, b = 0, min(n, FIRST_DEPTH)
    while True:
        for top, shift in ((True, 0), (False, dims)):
            ids, values = lists.read(a, b, top)
            read[ids, dim + shift], shown[ids, dim + shift] = values, 1
        mine = q[open_]
        if b == n:
            upper = lower = mine @ read.T
            outside = np.full(len(open_), np.iinfo(np.int64).min // 4, kind)
        else:
            following = mine * np.concatenate([lists.value[:, n - 1 - b], lists.value[:, b]]).astype(kind)
            outside = following.sum(1)
            upper = np.hstack([mine, -following]) @ both.T + outside[:, None]
            lower = np.hstack([mine, -least[open_]]) @ both.T + least[open_].sum(1)[:, None]
        bar = np.partition(lower, n - k, axis=1)[:, n - k]
        able = upper >= bar[:, None]
        ends = (outside < bar) & (np.count_nonzero(able, axis=1) <= max(FEW * k, n // SHARE)) | (b == n)
        for i in np.flatnonzero(ends).tolist():
            out[open_[i]] = np.flatnonzero(able[i])
        open_ = open_[~ends]
        if not len(open_):
            return out
        a, b = b, min(n, 2 * b)


def _blocks(t: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((t.num_rows, dims), np.int64)
    for i, v in enumerate(t.column("x").to_pylist()):
        y = np.frombuffer(v, "<i8")
        x[i, :len(y)] = y
    return t.column("row").to_numpy(), x


def cell(rows: pa.Table, queries: pa.Table, dims: int, k: int) -> pa.Table:
    """The k best rows of a block for each query of a group: positions in the two tables, and scores."""
    none = pa.table({"q": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
    if not rows.num_rows or not queries.num_rows:
        return none
    # smaller id first, null last, then the earlier row: positions stand for the order of ties
    rows_at = rows.append_column("at", pa.array(np.arange(rows.num_rows))).sort_by([("id", "ascending"), ("row", "ascending")])
    place = rows_at.column("at").to_numpy()
    row, x = _blocks(rows_at, dims)
    q_row, qs = _blocks(queries, dims)
    distinct, of = np.unique(x, axis=0, return_inverse=True)
    of = of.ravel()
    order = np.argsort(of, kind="stable")
    first = np.searchsorted(of[order], np.arange(len(distinct) + 1))
    lists = Lists(distinct)
    out: list[list[np.ndarray]] = [[], [], []]
    own = {r: i for i, r in enumerate(row.tolist())}
    # one more than k distinct vectors: the query's own may be one of them
    for i, able in enumerate(able for a in range(0, len(qs), QUERIES) for able in contenders(lists, qs[a:a + QUERIES], k + 1)):
        me = own.get(int(q_row[i]), -1)
        score = distinct[able] @ qs[i]
        members = np.concatenate([order[first[v]:min(first[v + 1], first[v] + k + 1)] for v in able.tolist()])
        scores = np.repeat(score, [min(first[v + 1] - first[v], k + 1) for v in able.tolist()])
        keep = members != me
        members, scores = members[keep], scores[keep]
        best = np.lexsort((members, -scores))[:k]
        out[0].append(np.full(len(best), i))
        out[1].append(place[members[best]])
        out[2].append(scores[best])
    q, c, s = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)
    return pa.table({"q": pa.array(q, pa.int64()), "c": pa.array(c, pa.int64()), "score": pa.array(s, pa.int64())})


def search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, step: int = STEP, scale: int = SCALE,
           block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_row, query_id, rank, row, vec_id, score): the k best candidates of each row whose id is divisible by ``step``."""
    kind = vectors.schema[id_col].dataType.simpleString()
    x = cut(integers(vectors, id_col, vec_col, scale), "vectors")
    asks = x.where(F.col("id") % step == 0)
    facts = x.agg(F.count(F.lit(1)).alias("n"), F.max("dims").alias("dims"), F.max("most").alias("most"),
                  F.count(F.when(F.col("id") % step == 0, 1)).alias("q")).first()
    dims, n_blocks, n_groups = facts.dims or 0, max(1, -(-facts.n // block)), max(1, -(-facts.q // group))
    if dims * (facts.most or 0) ** 2 >= 2.0 ** 62:
        raise OverflowError("scores could leave 64 bits")

    def deal(rows: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return rows.select("row", "id", "x", F.pmod(F.xxhash64("row"), F.lit(n_own)).cast("int").alias(own),
                           F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        got = cell(rows, queries, dims, k)
        q, c = queries.take(got.column("q")), rows.take(got.column("c"))
        return pa.table({"query_row": q.column("row"), "query_id": q.column("id"), "row": c.column("row"), "vec_id": c.column("id"), "score": got.column("score")})

    found = (deal(x, "b", n_blocks, "g", n_groups).groupBy("b", "g").cogroup(deal(asks, "g", n_groups, "b", n_blocks).groupBy("b", "g"))
             .applyInArrow(run, f"query_row long, query_id {kind}, row long, vec_id {kind}, score long"))
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("row"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "row", "vec_id", "score")


def report(vectors: DataFrame, **kw) -> DataFrame:
    return search(vectors, **kw).select("query_id", "rank", "vec_id", "score")


SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS cr, CAST(coalesce(list_sum(list_transform(range(1, least(len(q.x), len(c.x)) + 1), lambda p: q.x[p] * c.x[p])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id ASC NULLS LAST, cr) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 10
"""
