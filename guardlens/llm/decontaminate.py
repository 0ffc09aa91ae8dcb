"""Benchmark decontamination by winnowing.

Words are runs of 0-9, a-z (A-Z lower-cased) and characters outside ASCII. A window is ``window`` consecutive
words of a benchmark item; an item of fewer words, but not none, is one window of its own length. Document
words inside an occurrence of a window are hit.

Fingerprints are the minimum k-gram hash of each sliding window of w = window - k + 1 grams, so that every
shared span of ``window`` words shares a fingerprint: none is missed. Short items use the hash of the whole
item (k = its length, w = 1), which documents compute for each short length that occurs.

1. The fingerprints of the benchmark set bits in a bitmap of fixed size (2**BITMAP_BITS bits, 1 MiB, however
   large the benchmark is). It goes to every task; a full bitmap would only pass on more candidates.
2. One pass over the documents keeps the windows whose fingerprint is in the bitmap, extends neighbouring
   hits to spans, and emits their words with the fingerprints. Documents without any emit one narrow row.
3. Spark joins candidate windows with the benchmark's windows on (fingerprint, salt) and compares the words
   themselves, so hash collisions cannot give a hit. A window that a third of the documents share is spread over
   ``SALTS`` keys, its occurrences in a document travel together.
4. Occurrences are united per document.

Null and empty texts have no words and no hits; the digest of no items is the sha256 of the empty string.
Rows are told apart by a row number, so repeated rows and equal or null ids each give their own result. Null
item ids are left out of the lists. Other columns are not read, in either table, and may have any name. A text of any length is
hashed in segments; of it only windows with a fingerprint of the benchmark are kept. An empty table gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlens.llm.bitmaps import bitmap, in_bitmap, without
from guardlens.llm.rows import ROW, numbered
from guardlens.llm.text import BY_ALNUM, as_bytes, chunks, gram_hashes
from guardlens.session import cut, discard, scratch

WINDOW, GRAM = 10, 5
BITMAP_BITS = 23
SALTS = 16
_LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    out = x[:max(0, len(x) - w + 1)].copy()
    for j in range(1, w):
        np.minimum(out, x[j:len(out) + j], out=out)
    return out


def fingerprints(h: np.ndarray, window: int, length: int, gram: int = GRAM) -> np.ndarray:
    """Fingerprint of the ``length`` words at each position."""
    if length < window:
        return gram_hashes(h, length)
    k = min(gram, window)
    return _sliding_min(gram_hashes(h, k), window - k + 1)


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(fp, words, length, item): every distinct window of every item."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            out: dict[tuple, None] = {}
            for c in chunks(texts, BY_ALNUM):
                low = c.raw.translate(_LOWER)
                for i in range(c.last - c.first):
                    a, b = c.bounds[i], c.bounds[i + 1]
                    m = min(window, b - a)
                    if m:
                        fps = fingerprints(c.hash[a:b], window, m).view(np.int64).tolist()
                        words = [low[s:e] for s, e in zip(c.start[a:b].tolist(), c.end[a:b].tolist())]
                        out.update(((fp, b" ".join(words[p:p + m]), int(m), ids[c.first + i]), None) for p, fp in enumerate(fps))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int32()),
                                              pa.array(cols[3], batch.column(0).type)], names=["fp", "words", "length", "item"])

    return items.select(id_col, text_col).mapInArrow(run, f"fp long, words binary, length int, item {kind}").distinct()


def _candidates(docs: DataFrame, bits, lengths: list[int], window: int) -> DataFrame:
    """Per row: number of words, and candidate windows as parallel arrays of fingerprint, position and words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = bits.value
        for batch in batches:
            texts, n_words, cand = as_bytes(batch.column(1)), [], []
            for c in chunks(texts, BY_ALNUM):
                n_words.extend(np.diff(c.bounds).tolist())
                doc = c.doc
                found: list[list] = [[] for _ in range(c.last - c.first)]
                low = None
                for m in lengths:
                    fp = fingerprints(c.hash, window, m)
                    at = np.flatnonzero(in_bitmap(have, fp))
                    at = at[doc[at] == doc[at + m - 1]]
                    if len(at):
                        low = low or c.raw.translate(_LOWER)
                        for p, f in zip(at.tolist(), fp[at].view(np.int64).tolist()):
                            s, e = c.start[p:p + m].tolist(), c.end[p:p + m].tolist()
                            found[doc[p]].append({"fp": f, "at": p - int(c.bounds[doc[p]]),
                                                  "words": b" ".join(low[a:b] for a, b in zip(s, e))})
                cand.extend(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()),
                 pa.array(cand, pa.list_(pa.struct([("fp", pa.int64()), ("at", pa.int32()), ("words", pa.binary())])))],
                names=["id", "n_words", "cand"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n_words long, cand array<struct<fp:bigint,at:int,words:binary>>")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(row, id, n_words, n_hit, items, spans) for each document; spans are the
    (start, end) word positions of the windows found, in order."""
    spark: SparkSession = docs.sparkSession
    wins = cut(benchmark_windows(items, item_col, item_text, window), "windows")
    lengths = sorted(r[0] for r in wins.select("length").distinct().collect())  # at most `window` numbers
    bits = spark.sparkContext.broadcast(bitmap(wins, "fp", BITMAP_BITS))
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    rows = cut(_candidates(src, bits, lengths, window).withColumn("row", F.monotonically_increasing_id()), "candidates")
    cand = (rows.where(F.size("cand") > 0).select("row", F.explode("cand").alias("c"))
            .select("row", "c.*").groupBy("row", "fp", "words").agg(F.collect_list("at").alias("at"))
            .withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")))
    # the items of one text travel as a list: a candidate meets a window once, not once for each item
    known = (wins.groupBy("fp", "words").agg(F.max("length").alias("length"), F.collect_set("item").alias("items"))
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    hits = (cand.join(known, ["fp", "words", "salt"])
            .groupBy("row").agg(F.flatten(F.collect_list(F.transform("at", lambda a: F.struct(a.alias("s"), (a + F.col("length")).alias("e"))))).alias("spans"),
                                F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")))
    merged = hits.select("row", F.sort_array(F.transform("items", lambda i: i.cast("string"))).alias("items"),
                         F.sort_array("spans").alias("spans"))
    zero = F.lit(0).cast("long")
    covered = F.aggregate("spans", F.struct(zero.alias("n"), F.lit(0).alias("upto")),
                          lambda a, x: F.struct((a.n + F.greatest(F.lit(0), x.e - F.greatest(a.upto, x.s))).alias("n"),
                                                F.greatest(a.upto, x.e).alias("upto")), lambda a: a.n)
    return (rows.drop("cand").join(merged, "row", "left")
            .withColumn("n_hit", F.coalesce(covered, zero))
            .withColumn("items", F.coalesce("items", F.array().cast("array<string>"))))


def digests(found: DataFrame, id_col: str) -> DataFrame:
    return found.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows without any hit, with their own columns; other rows with a hit row's id stay."""
    rows = numbered(docs)
    with scratch() as made:
        hit = decontaminate(rows, items, ROW, text_col, **kw).where("n_hit > 0").select("id")
        gone = cut(hit, "hit-rows")
    discard(docs.sparkSession, made[:-1])  # all but the last
    return without(rows, gone, ROW).drop(ROW)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
         lambda p: array_to_string(w[p:p + least(10, len(w)) - 1], ' '))) AS g
  FROM i WHERE len(w) > 0),
dw AS (
  SELECT r, l.m, unnest(range(1, len(w) - l.m + 2)) AS p, unnest(list_transform(range(1, len(w) - l.m + 2),
         lambda p: array_to_string(w[p:p + l.m - 1], ' '))) AS g
  FROM d, (SELECT DISTINCT m FROM iw) l WHERE len(w) >= l.m),
h AS (SELECT dw.r, dw.p, dw.m, iw.item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.g = iw.g),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS x FROM (SELECT DISTINCT r, p, m FROM h)) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(n.s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN n USING (r)
"""
