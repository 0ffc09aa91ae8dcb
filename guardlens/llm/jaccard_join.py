"""Exact Jaccard join of documents on word shingles, by pivots and regions.

A document's set: hashes of its distinct ``SHINGLE``-word shingles (of all its words, if it has fewer). Documents
link when 100 * intersection >= 75 * union; components of the links are what is returned. Equal sets are one
class from the start, so copies cost one comparison each.

The distance 1 - J is a metric, but nearly every pair of documents shares nothing and stands at distance 1
exactly, so windows around arbitrary pivots would copy every document into every region. Pivots are therefore
taken where distances can be below 1, among documents that share shingles:

1. *Prefixes.* In a fixed order of shingles, two linked sets share more than ``spare(n)`` of their first
   n - ceil(0.75 n) + 1 + spare(n) ones, n the smaller size. Only these are counted.
2. *Thinning.* A bitmap of fixed size of the shingles seen twice goes to the tasks. A set may leave out its most frequent
   shared shingles, as many as the smallest set that could link with it has to spare: both sides of a link keep their
   rarest common one. Sets with no more shared shingles than that are alone and go no further; frequent lines and
   passages, and the chance repeats of long texts, vanish here.
3. *Regions.* Each shingle that is left elects a pivot, the set whose shingles are the most frequent (the centre
   of a group of near copies). The region of a pivot holds all sets of the shingles that elected it, so both ends
   of every link meet in a region. Rows: at most one for each set and pivot.
4. *Windows.* Regions that overlap are joined together in one task as long as they stay within ``REGION_SETS`` and
   ``REGION_SHINGLES``. A larger one gets new pivots in Spark: each set goes to the nearest (its Voronoi cell) and, by the
   triangle inequality, as a guest to each cell whose pivot is at most 2 * 0.25 farther. Large cells are split again. A
   region whose windows copy it more than twice is cut into blocks instead, each pair of blocks a cell: slower, but whole.
5. *Cells.* In a task, overlaps come from the postings of all shingles at once, exactly. Sets that are in the cell's
   largest component already are put off; at the end those outside the component that is largest then are compared too.

Texts without words (null, empty, white space) have no set and link with nothing; a null id cannot be a component's
smallest id unless all its members' are null. An empty table gives no rows; only the id and text columns are read. Rows with equal ids and texts are copies of each other. Hashes
have 64 bits; two different sets or shingles meet with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlens.llm.bitmaps import bitmap, in_bitmap, without
from guardlens.llm.components import components
from guardlens.llm.rows import ROW, numbered
from guardlens.llm.text import BY_SPACE, chunks, gram_hashes, pieces
from guardlens.session import cut, discard, scratch

SHINGLE, PERCENT = 5, 75
SPARE, LARGE = 24, 40
SHARED_BITS, SET_BITS = 25, 24
REGION_SETS, REGION_SHINGLES = 20_000, 2_000_000
PIVOTS, MAX_DEPTH = 8, 6


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for c in chunks(texts, BY_SPACE):
        grams = gram_hashes(c.hash, k)
        for a, b in zip(c.bounds[:-1].tolist(), c.bounds[1:].tolist()):
            if b - a >= k:
                g = np.sort(grams[a:b - k + 1])
                yield g[np.concatenate(([True], g[1:] != g[:-1]))]
            else:
                yield gram_hashes(c.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def set_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def spare(n):
    """By how much the prefix of a set of n shingles is longer than it need be; 1 + spare(n) <= 0.75 n from LARGE on."""
    return SPARE + n // 8


def dropped(n):
    """How many shared shingles a set may leave out: what its smallest possible partner, of 0.75 n, has to spare."""
    least = PERCENT * n // 100
    return np.where(least >= LARGE, spare(least), 0)


def prefix_length(n: int) -> int:
    return n if n < LARGE else min(n, n - -(-PERCENT * n // 100) + 1 + spare(n))


def _profiles(docs: DataFrame) -> DataFrame:
    """(id, n, e, prefix): set size, set id, and the prefix in the order of the hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, e, size, parts = [], [], [0], []
            for s in (s for texts in pieces(batch.column(1)) for s in shingle_sets(texts)):
                n.append(len(s))
                e.append(set_id(s) if len(s) else 0)
                parts.append(s[:prefix_length(len(s))])
                size.append(size[-1] + len(parts[-1]))
            flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(e, pa.int64()),
                                              pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(flat))], names=["id", "n", "e", "prefix"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n long, e long, prefix array<bigint>")


def _shared_prefixes(profiles: DataFrame, bits) -> DataFrame:
    """(e, n, prefix) with the shingles that pass the bitmap, without sets that are alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            hit = in_bitmap(bits.value, flat)
            ends = np.cumsum(np.concatenate(([0], pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))))
            upto = np.concatenate(([0], np.cumsum(hit)))
            count = upto[ends[1:]] - upto[ends[:-1]]
            n = batch.column(1).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(count > dropped(n))
            take = np.concatenate([np.flatnonzero(hit[ends[i]:ends[i + 1]]) + ends[i] for i in keep]) if len(keep) else np.zeros(0, np.int64)
            size = np.concatenate(([0], np.cumsum(count[keep]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)),
                                              pa.ListArray.from_arrays(pa.array(size), pa.array(flat[take].view(np.int64)))], names=["e", "n", "prefix"])

    return profiles.where("n > 0").select("e", "n", "prefix").mapInArrow(run, "e long, n long, prefix array<bigint>")


def _region_members(profiles: DataFrame) -> DataFrame:
    """(p, e): which sets are in which pivot's region; regions of one set are left out."""
    sc = profiles.sparkSession.sparkContext
    counts = profiles.select(F.explode("prefix").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    shared = cut(counts.where("df > 1"), "shared-shingles")
    bits = sc.broadcast(bitmap(shared, "s", SHARED_BITS))
    rows = (_shared_prefixes(profiles, bits).dropDuplicates(["e"])
            .select("e", "n", F.explode("prefix").alias("s")).join(shared, "s"))
    # rarest first; the most frequent ones go
    own = Window.partitionBy("e")
    least = F.floor(F.col("n") * PERCENT / 100)
    left = F.count(F.lit(1)).over(own) - F.when(least >= LARGE, SPARE + F.floor(least / 8)).otherwise(0)
    kept = (rows.withColumn("left", left).withColumn("weight", F.sum("df").over(own) / F.col("n"))
            .withColumn("place", F.row_number().over(own.orderBy("df", "s"))).where(F.col("place") <= F.col("left")).select("e", "n", "weight", "s"))
    kept = cut(kept, "kept-shingles")
    top = (kept.groupBy("s").agg(F.max(F.struct("weight", "e")).alias("top"), F.count(F.lit(1)).alias("m"))
           .where("m > 1").select("s", F.col("top.e").alias("p")))
    return kept.select("s", "e", "n").join(top, "s").select("p", "e", "n").distinct()


def _sets_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(e, n, elements) of the member sets, made again from the texts."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(members, "e", SET_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in (t for batch in batches for t in pieces(batch.column(0))):
            e, n, raw = [], [], []
            for s in shingle_sets(texts):
                i = set_id(s) if len(s) else 0
                if len(s) and in_bitmap(bits.value, np.array([i]).view(np.uint64))[0]:
                    e.append(i)
                    n.append(len(s))
                    raw.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()), pa.array(n, pa.int64()), pa.array(raw, pa.binary())], names=["e", "n", "elements"])

    return docs.select("text").mapInArrow(run, "e long, n long, elements binary").dropDuplicates(["e"])


def link_cell(e: np.ndarray, n: np.ndarray, elements: list[bytes], percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """Links that join the sets of a cell as all their links do: (set, least set of its component)."""
    m = len(e)
    if m < 2:
        return
    flat = np.frombuffer(b"".join(elements), np.uint64)
    owner = np.repeat(np.arange(m, dtype=np.int32), n)
    ends = np.cumsum(np.concatenate(([0], n)))
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], flat[order][1:] != flat[order][:-1])))
    size = np.diff(np.append(first, len(flat)))
    group = np.empty(len(flat), np.int32)
    group[order] = np.repeat(np.arange(len(first), dtype=np.int32), size)
    posting = owner[order]
    del flat, order, owner
    comp = np.arange(m)
    weight = np.add.reduceat(size[group], ends[:-1]) / n

    def join_linked(x: int) -> None:
        g = group[ends[x]:ends[x + 1]]
        g = g[size[g] > 1]
        lens = size[g]
        if not len(g):
            return
        at = np.repeat(first[g] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
        inter = np.bincount(posting[at], minlength=m)
        linked = np.flatnonzero((inter > 0) & (100 * inter >= percent * (n[x] + n - inter)) & (comp != comp[x]))
        for c in np.unique(comp[linked]).tolist():
            comp[comp == c] = comp[x]

    skipped = []
    for x in np.argsort(-weight, kind="stable").tolist():  # the centre first: it links the most
        count = np.bincount(comp, minlength=m)
        if count.max() == m:
            break
        if comp[x] == count.argmax() and count.max() > 1:
            skipped.append(x)
        else:
            join_linked(x)
    # another component may have been the largest when a set was skipped: only the members of one need no comparison
    one = int(np.flatnonzero(comp == np.bincount(comp, minlength=m).argmax())[0])
    for x in skipped:
        if comp[x] != comp[one]:
            join_linked(x)
    least = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(least, comp, e)
    for i in np.flatnonzero(least[comp] != e).tolist():
        yield int(e[i]), int(least[comp[i]])


def _cell_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of cells: rows (p, e, n, elements), cells within bounds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            _, e, n, raw = zip(*held)
            found = list(zip(*link_cell(np.array(e), np.array(n), list(raw), percent))) or [[], []]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], names=["a", "b"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and held[-1][0] != row[0]:
                    yield done()
                held.append(row)
        if held:
            yield done()

    return rows.repartition("p").sortWithinPartitions("p").select("p", "e", "n", "elements").mapInArrow(run, "a long, b long")


def _voronoi(rows: DataFrame, depth: int, pivots: int, percent: int) -> DataFrame:
    """New cells of large regions: (q, kind, p, e, n, elements), q the region, kind 0 for cell members and 1 for links (e, p)."""
    picks = [F.min(F.struct(F.xxhash64("e", F.lit(depth), F.lit(j)).alias("h"), "e", "n", "elements")) for j in range(pivots)]
    heads = rows.groupBy("p").agg(F.array(*picks).alias("heads"))
    reach = 2 * (100 - percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for p, e, n, raw, hs in zip(*[c.to_pylist() for c in batch.columns]):
                own = np.frombuffer(raw, np.uint64)
                heads = {h["e"]: (h["n"], h["elements"]) for h in hs}
                ids = sorted(heads)
                inter = [int(np.isin(own, np.frombuffer(heads[i][1], np.uint64), assume_unique=True).sum()) for i in ids]
                union = [n + heads[i][0] - c for i, c in zip(ids, inter)]
                out.extend((p, 1, i, e, 0, b"") for i, c, u in zip(ids, inter, union) if i != e and 100 * c >= percent * u)
                far = [1 - c / u for c, u in zip(inter, union)]
                near = min(far) + reach / 100 + 1e-9
                # the cell of a pivot within a region: a number of its own
                out.extend((p, 0, int.from_bytes(hashlib.blake2b(f"{p} {i} {depth}".encode(), digest_size=8).digest(), "little", signed=True), e, n, raw)
                           for i, f in zip(ids, far) if f <= near)
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                             names=["q", "kind", "p", "e", "n", "elements"])

    return (rows.join(heads, "p").select("p", "e", "n", "elements", "heads")
            .mapInArrow(run, "q long, kind int, p long, e long, n long, elements binary"))


def _blocks(rows: DataFrame, sizes: DataFrame, cell: int, shingles: int) -> DataFrame:
    """Cells that are pairs of blocks of a region, half a cell each, by sets or by shingles, whichever makes more blocks."""
    m = F.greatest(F.ceil(F.col("sets") / F.lit(max(1, cell // 2))),
                   F.least("sets", F.ceil(F.col("shingles") / F.lit(max(1, shingles // 2))))).cast("int")
    r = rows.join(sizes.select("p", "sets", "shingles"), "p").withColumn("m", m).withColumn("b", F.pmod(F.xxhash64("e", F.lit(-1)), F.col("m")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.struct(F.least(F.col("b"), j).alias("i"), F.greatest(F.col("b"), j).alias("j")))
    return r.withColumn("c", F.explode(pair)).select(F.xxhash64("p", "c.i", "c.j").alias("p"), "e", "n", "elements")


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("p").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))


def _split(rows: DataFrame, percent: int, region_sets: int, region_shingles: int, beyond: Column) -> list[DataFrame]:
    """Links of regions that are too large for a task."""
    found = []
    for depth in range(MAX_DEPTH):
        sizes = cut(_sizes(rows), "region-sizes")
        new = cut(_voronoi(rows, depth, PIVOTS, percent), "cells")
        found.append(new.where("kind = 1").select(F.col("e").alias("a"), F.col("p").alias("b")))
        cells = new.where("kind = 0")
        # windows that copy most of a region into most of its cells do not get anywhere
        stuck = cut(cells.groupBy("q").agg(F.count(F.lit(1)).alias("made")).join(sizes, F.col("q") == F.col("p"))
                    .where(F.col("made") > 2 * F.col("sets")).select("p", "sets", "shingles"), "stuck")
        found.append(_cell_links(_blocks(rows, stuck, region_sets, region_shingles), percent))
        cells = cells.join(stuck.select(F.col("p").alias("q")), "q", "left_anti").select("p", "e", "n", "elements")
        after = cut(_sizes(cells), "region-sizes")
        found.append(_cell_links(cells.join(after.where(beyond), "p", "left_anti"), percent))
        if after.where(beyond).isEmpty():
            return found
        rows = cut(cells.join(after.where(beyond).select("p"), "p", "left_semi"), "region-sets")
    return [*found, _cell_links(_blocks(rows, _sizes(rows), region_sets, region_shingles), percent)]


def links(docs: DataFrame, profiles: DataFrame, percent: int = PERCENT, region_sets: int = REGION_SETS,
          region_shingles: int = REGION_SHINGLES) -> DataFrame:
    """Links (a, b) between set ids whose components are those of all links."""
    beyond = (F.col("sets") > region_sets) | (F.col("shingles") > region_shingles)
    members = cut(_region_members(profiles), "regions")
    # regions that overlap are one where that still fits a task: their sets then travel once
    joint = components(members.select(F.col("p").alias("a"), F.col("e").alias("b")))
    one = members.select("e", "n").distinct().join(joint, F.col("e") == F.col("v")).select(F.col("root").alias("p"), "e", "n")
    apart = cut(_sizes(one).where(beyond).select("p"), "apart")
    rest = members.join(one.join(apart, "p", "left_semi").select("e"), "e", "left_semi").select(F.xxhash64("p", F.lit(1)).alias("p"), "e", "n")
    cells = cut(one.join(apart, "p", "left_anti").union(rest), "cells")
    large = cut(_sizes(cells).where(beyond).select("p"), "large")
    several = _sizes(cells).where("sets > 1").select("p")
    sets = _sets_of(docs, members).drop("n")
    if large.isEmpty():
        return _cell_links(cells.join(several, "p", "left_semi").join(sets, "e"), percent)
    rows = cut(cells.join(sets, "e").select("p", "e", "n", "elements"), "region-sets")
    out = _cell_links(rows.join(large, "p", "left_anti"), percent)
    for f in _split(rows.join(large, "p", "left_semi"), percent, region_sets, region_shingles, beyond):
        out = out.union(f)
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, **bounds) -> DataFrame:
    """(id, n_shingles, component_id, set_id) for every document."""
    if percent < PERCENT:
        raise ValueError(f"prefixes are made for {PERCENT} percent and more")
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    profiles = cut(_profiles(src), "profiles")
    roots = components(links(src, profiles, percent, **bounds))
    least = profiles.where("n > 0").groupBy("e").agg(F.min("id").alias("first"))
    own = least.join(roots, least["e"] == roots["v"], "left").select("e", "first", F.coalesce("root", "e").alias("root"))
    own = cut(own, "set-roots")
    smallest = own.groupBy("root").agg(F.min("first").alias("component_id"))
    by_set = own.join(smallest, "root").select("e", "component_id")
    return (profiles.select("id", "n", "e").join(by_set, "e", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
                    F.when(F.col("n") > 0, F.col("e")).alias("set_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Of each component the row with the smallest id (null last, then the first row), once, with the input's columns.

    Rows are told apart by their place, so equal and null ids neither take rows along nor save them.
    """
    rows = numbered(docs)
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(ROW).alias("row"))
    with scratch() as made:
        found = classes(rows.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text", **kw)
        gone = cut(found.where("key.row <> component_id.row").select("key.row"), "gone-rows")
    discard(docs.sparkSession, made[:-1])  # all but the last
    return without(rows, gone, ROW).drop(ROW)
