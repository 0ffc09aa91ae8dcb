"""Target-distribution importance resampling over hashed word n-grams.

Texts are lower-cased (A-Z) and an untrained regular-expression split of the tokenizers library returns their words with byte
offsets. Pairs of offsets (one word, or two neighbouring words joined by a space) are the features; the CRC-32 of their bytes,
modulo ``buckets``, is computed from the offsets for all words of a slice at once, without building the features.

1. One pass writes, for each document, the bucket of every feature (two bytes each) to a table. The library's split is the
   costly part, so texts are split once.
2. Histograms of all documents and of all target texts: each task adds up its own, Spark sums at most ``buckets`` rows a task. They
   give one gain a bucket, ``buckets`` numbers in all, which travel to the tasks.
3. A document's weight is the floored mean of its features' gains; a Gumbel number from the sha256 of its id is added.
4. The drawn documents: narrow rows (score, id, row) are dealt by range and sorted inside the partitions; the rank of a row is its
   place in its partition after the rows of the partitions before it (one count a partition).

Null, empty and wordless texts have no features, weight 0, and are not drawn; a text of one word has one feature. Long texts are
split in slices of about ``SLICE`` bytes that end between words, so memory stays near a slice plus two bytes a feature. Ties of score go to the smaller
id, null ids last, then to the earlier row; repeated rows take part each for itself. A null id is the empty string in the hash.
Empty tables: no documents give no rows; an empty target has T = 0. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardlens.llm.text import BY_ALNUM, pieces
from guardlens.session import cut

BUCKETS, SEED, MIN_WORDS, PERCENT = 10_000, 7, 20, 25
SLICE = 1 << 16
LONG_WORD = 48
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
_FULL = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_TABLE = _crc_table()


def crc_extend(crc: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of what each ``crc`` stands for, followed by ``length`` bytes of ``data`` from ``start``."""
    out = crc.copy()
    far = np.flatnonzero(length > LONG_WORD)
    for i in far.tolist():
        out[i] = zlib.crc32(data[start[i]:start[i] + length[i]].tobytes(), int(crc[i]))
    near = np.flatnonzero(length <= LONG_WORD)
    near = near[np.argsort(-length[near], kind="stable")]  # longest first: the words that have a byte k are the first ones
    state, at, n = crc[near] ^ _FULL, start[near], length[near]
    have = len(near) - np.searchsorted(n[::-1], np.arange(int(n[0]) if len(n) else 0), side="right")
    for k, m in enumerate(have.tolist()):
        s = state[:m]
        state[:m] = _TABLE[(s ^ data[at[:m] + k]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
    out[near] = state ^ _FULL
    return out


class Splitter:
    """Words of lower-cased bytes as byte offsets, by the library's split."""

    def __init__(self):
        from tokenizers import PreTokenizedString, Regex, pre_tokenizers

        self.split, self.string = pre_tokenizers.Split(Regex(SEPARATORS), "removed"), PreTokenizedString

    def __call__(self, low: bytes) -> tuple[np.ndarray, np.ndarray]:
        text = self.string(low.decode())
        self.split.pre_tokenize(text)
        at = np.array([o for _, o, _ in text.get_splits("original", "byte")], np.int64).reshape(-1, 2)
        return at[:, 0], at[:, 1]


def slices(data: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, start and end of the last word before it): slices that end between words."""
    at = word_start = word_end = 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        while end < len(data) and not len(gap := np.flatnonzero(~BY_ALNUM[data[at:end]])):
            end = min(len(data), end + SLICE)
        if end < len(data):
            end = at + int(gap[-1]) + 1
        word = BY_ALNUM[data[at:end]]
        if word.any():
            yield at, end, word_start, word_end
            stop = int(np.flatnonzero(word)[-1])
            gap = np.flatnonzero(~word[:stop])
            word_start, word_end = at + (int(gap[-1]) + 1 if len(gap) else 0), at + stop + 1
        at = end


def feature_crcs(low: np.ndarray, start: np.ndarray, end: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CRCs of the words, and of the pairs (word i, word i + 1) for the given i."""
    one = crc_extend(np.zeros(len(start), np.uint32), low, start, end - start)
    spaced = one[pair] ^ _FULL
    spaced = _TABLE[(spaced ^ np.uint32(32)) & np.uint32(0xFF)] ^ (spaced >> np.uint32(8)) ^ _FULL
    return one, crc_extend(spaced, low, start[pair + 1], (end - start)[pair + 1])


def group_buckets(texts: list[bytes], splitter: Splitter, buckets: int) -> tuple[list[int], list[bytes]]:
    """Number of words, and the buckets of all features, of each text."""
    words, found = [0] * len(texts), [b""] * len(texts)
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) <= SLICE):
            total += len(texts[j]) + 1
            j += 1
        raw = b"\n".join(texts[i:j]).translate(_LOWER)
        edges = np.cumsum([len(t) + 1 for t in texts[i:j]])
        low = np.frombuffer(raw, np.uint8)
        held: list[list[np.ndarray]] = [[] for _ in range(i, j)]
        for a, b, c, d in slices(low):
            part = raw[c:d] + b" " + raw[a:b] if c < d else raw[a:b]
            start, end = splitter(part)
            where = start + (a - d + c - 1 if c < d else a)
            if c < d:
                where[0] = c
            doc = np.searchsorted(edges, where, side="right")
            pair = np.flatnonzero(doc[:-1] == doc[1:])
            one, two = feature_crcs(np.frombuffer(part, np.uint8), start, end, pair)
            own = doc
            if c < d:  # the word before is only there for its pair
                one, own = one[1:], doc[1:]
            both, of = np.concatenate([one, two]) % np.uint32(buckets), np.concatenate([own, doc[pair]])
            order = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[order], np.arange(j - i + 1))
            both = both[order].astype(kind)
            for t, n in enumerate(np.bincount(own, minlength=j - i).tolist()):
                words[i + t] += n
                if cuts[t] < cuts[t + 1]:
                    held[t].append(both[cuts[t]:cuts[t + 1]])
        for t, h in enumerate(held):
            found[i + t] = b"".join(x.tobytes() for x in h)
        i = j
    return words, found


def _valid(text: bytes) -> bytes:
    try:
        text.decode()
        return text
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()


def features(docs: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, row_col: str | None = None) -> DataFrame:
    """(row, id, n_words, buckets): the bucket of each feature, two bytes each (four beyond 65,536 buckets)."""
    kind = docs.schema[id_col].dataType.simpleString()
    row = F.monotonically_increasing_id() if row_col is None else docs[row_col]
    src = docs.select(row.alias("row"), docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()
        for batch in batches:
            at = 0
            for texts in pieces(batch.column(2)):
                words, found = group_buckets([_valid(t) for t in texts], splitter, buckets)
                rows = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(words, pa.int64()), pa.array(found, pa.binary())],
                                                 names=["row", "id", "n_words", "buckets"])

    return src.mapInArrow(run, f"row long, id {kind}, n_words long, buckets binary")


def _numbers(column: pa.Array, buckets: int) -> Iterator[np.ndarray]:
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    for x in column:
        yield np.frombuffer(x.as_py(), kind)


def histogram(table: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all features of a table of ``features``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in _numbers(batch.column(0), buckets):
                total += np.bincount(x, minlength=buckets)
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array(total[have], pa.int64())], names=["bucket", "n"])

    return table.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets, from two histograms."""
    spark = source.sparkSession
    both = (spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
            .join(source.select("bucket", F.col("n").alias("s")), "bucket", "left")
            .join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").fillna(0, ["s", "t"]))
    d = lambda c: c.cast("double")
    every = Window.partitionBy(F.lit(0))  # one row a bucket
    ratio = (d(F.col("t") + 1) * d(F.sum("s").over(every) + buckets)) / (d(F.col("s") + 1) * d(F.sum("t").over(every) + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def weighted(table: DataFrame, gain: list[int], buckets: int = BUCKETS) -> DataFrame:
    """(row, id, n_words, n_features, weight)."""
    kind = table.schema["id"].dataType.simpleString()
    values = table.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = values.value
        for batch in batches:
            n, w = [], []
            for x in _numbers(batch.column(3), buckets):
                n.append(len(x))
                w.append(int(g[x].sum()) // len(x) if len(x) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(w, pa.int64())],
                                             names=["row", "id", "n_words", "n_features", "weight"])

    return table.select("row", "id", "n_words", "buckets").mapInArrow(run, f"row long, id {kind}, n_words long, n_features long, weight long")


def ranked(scores: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Adds ``rank``: 1, 2, 3... by falling score for the drawn rows, else null."""
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = cut(scores.where(F.col("n_words") >= min_words).repartitionByRange(*order).sortWithinPartitions(*order)
                .select("*", F.spark_partition_id().alias("part"), place.alias("place")), "ranked")
    every = Window.partitionBy(F.lit(0))  # one row a partition
    before = (dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
              .select("part", (F.sum("n").over(every.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(every).alias("all")))
    rank = F.col("before") + F.col("place") + 1
    drawn = dealt.join(F.broadcast(before), "part").withColumn("rank", F.when(rank <= F.expr(f"{percent} * all div 100"), rank))
    rest = scores.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*rest.columns).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text",
             buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS, row_col: str | None = None) -> DataFrame:
    """(row, id, n_words, n_features, weight, score, rank) of every document."""
    table = cut(features(docs, id_col, text_col, buckets, row_col), "features")
    wanted = cut(features(target, target_id, target_text, buckets), "target-features")
    per_bucket = gains(histogram(table, buckets), histogram(wanted, buckets), buckets).collect()  # `buckets` numbers
    gain = [r.gain for r in sorted(per_bucket, key=lambda r: r.bucket)]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scores = cut(weighted(table, gain, buckets).withColumn("score", F.col("weight") + gumbel), "scores")
    return ranked(scores, percent, min_words)


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The drawn rows with their own columns."""
    numbered = cut(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    drawn = resample(numbered, target, id_col, text_col, row_col="__row", **kw).where("rank IS NOT NULL")
    return numbered.join(drawn.select(F.col("row").alias("__row")), "__row", "left_semi").drop("__row")


def report(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    return resample(docs, target, id_col, **kw).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank", "n_words")


SQL = r"""
WITH RECURSIVE bits AS (
  SELECT 0 AS k, range AS b, CAST(range AS BIGINT) AS c FROM range(256)
  UNION ALL
  SELECT k + 1, b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (
  SELECT coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
df AS MATERIALIZED (
  SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda p: w[p] || ' ' || w[p + 1]))) AS f FROM d),
bf AS MATERIALIZED (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda p: w[p] || ' ' || w[p + 1]))) AS f FROM i),
names AS (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM bf)),
hexed AS (SELECT f, hex(encode(f)) AS x FROM names),
crc AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(x) // 2), lambda p: CAST('0x' || x[2 * p + 1:2 * p + 2] AS BIGINT))),
         lambda s, b: xor(s >> 8, t[CAST(xor(s, b) & 255 AS INTEGER) + 1])), 4294967295) % 10000 AS b FROM hexed, tab),
dc AS MATERIALIZED (SELECT df.r, crc.b, count(*) AS n FROM df JOIN crc USING (f) GROUP BY ALL),
sc AS (SELECT b, sum(n) AS s FROM dc GROUP BY b),
tc AS (SELECT crc.b, count(*) AS t FROM bf JOIN crc USING (f) GROUP BY crc.b),
tot AS (SELECT (SELECT coalesce(sum(s), 0) FROM sc)::DOUBLE AS s, (SELECT coalesce(sum(t), 0) FROM tc)::DOUBLE AS t),
gain AS (
  SELECT b, CAST(floor(1000 * ln((coalesce(tc.t, 0) + 1)::DOUBLE * (tot.s + 10000) / ((sc.s + 1)::DOUBLE * (tot.t + 10000)))) AS BIGINT) AS g
  FROM sc LEFT JOIN tc USING (b), tot),
weight AS (SELECT r, sum(n) AS n, CAST(floor(sum(n * g)::DOUBLE / sum(n)) AS BIGINT) AS w FROM dc JOIN gain USING (b) GROUP BY r),
score AS (
  SELECT d.r, doc_id, len(d.w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight.w, 0) AS weight,
         coalesce(weight.w, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weight USING (r)),
place AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST, r) AS k, count(*) OVER () AS n FROM score WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 25 * n // 100 THEN k END AS rank, CAST(n_words AS BIGINT) AS n_words
FROM score LEFT JOIN place USING (r)
"""
