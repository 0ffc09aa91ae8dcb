"""URL filter: rules first, then host word segmentation and naive Bayes.

* Host and path come from the url (host lower-cased, A-Z). The longest rule that fits decides.
* Word counts for the segmentation are those of all pages' HTML. Counts are kept by word hash; the substrings of the letter
  runs of distinct hosts that are as long as some word are joined to them, and a Viterbi pass over each run picks
  the split with the highest product of unigram probabilities. A substring of n bytes that is no word has
  probability 10 / (N * 10**n).
* Multinomial naive Bayes is fitted on all pages that a rule decides. Its tokens are the words of the host and the
  pieces of the path (digits become #). Their log odds are a table by the token itself, broadcast up to ``BROADCAST_TOKENS``
  tokens and beyond that joined to the pages' tokens, spread over ``SALTS`` keys each. Pages without a rule are blocked if the
  log odds are above 0.

A null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the prior alone.
Without any page decided by a rule every verdict is allow. Null HTML has no words. Repeated rows are judged
one by one; other columns are not read. A host of any length is handled: its substrings are rows of a few numbers, thinned by a bitmap of the
words, and the split is linear in its length. An empty table gives no rows.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlens.llm.bitmaps import bitmap, in_bitmap
from guardlens.llm.text import as_bytes, chunks, mix, prefix_sums
from guardlens.session import cut

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
BROADCAST_TOKENS, SALTS = 1 << 16, 16
WORD_BITS = 24  # a bitmap of the words' hashes, two megabytes, thins the substrings before they are joined
_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: words are letters: a-z (after lower-casing) and everything outside ASCII
BY_LETTER = np.array([97 <= b < 123 or 65 <= b < 91 or b >= 128 for b in range(256)])
_LETTERS = r"[a-z[^\x00-\x7F]]+"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOW)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest fitting rule as (rule, verdict), null if none fits."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r)):
        site, _, rest = rule.partition("/")
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(f"/{rest}")
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def word_counts(pages: DataFrame, text_col: str) -> DataFrame:
    """(h, n, size): hash, number and bytes of every letter word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(c.hash, c.end - c.start) for c in chunks(as_bytes(batch.column(0)), BY_LETTER)]
            every = np.concatenate([h for h, _ in found]) if found else np.zeros(0, np.uint64)
            size = np.concatenate([z for _, z in found]) if found else np.zeros(0, np.int64)
            h, at, n = np.unique(every, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64()), pa.array(size[at], pa.int64())], names=["h", "n", "size"])

    return pages.select(text_col).mapInArrow(run, "h long, n long, size long").groupBy("h").agg(F.sum("n").alias("n"), F.max("size").alias("size"))


def run_hashes(raw: bytes, size: int) -> np.ndarray:
    """Word hash of every ``size`` bytes of a run: from prefix sums, so that a hash costs the same for any size."""
    n = len(raw) - size + 1
    sums, down = prefix_sums(np.frombuffer(raw, np.uint8))
    return mix((sums[size:] - sums[:n]) * down[:n])


def substrings(runs: DataFrame, lengths: list[int], words) -> DataFrame:
    """(no, a, b, h): substrings [a, b) of numbered letter runs that have one of the lengths in bytes and a hash of the bitmap.

    A row carries the number of its run, not the run.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = words.value
        for batch in batches:
            for no, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = run.encode()
                for size in (k for k in lengths if k <= len(raw)):
                    h = run_hashes(raw, size)
                    a = np.flatnonzero(in_bitmap(have, h)).astype(np.int32)
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), no)), pa.array(a), pa.array(a + np.int32(size)), pa.array(h[a].view(np.int64))],
                                                         names=["no", "a", "b", "h"])

    return runs.select("no", "run").mapInArrow(rows, "no long, a int, b int, h long")


def best_split(run: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """Viterbi over the bytes of a run; of equal splits, the one with the longer last word."""
    raw = run.encode()
    best, back = [0.0] + [-math.inf] * len(raw), [0] * (len(raw) + 1)
    log_n = math.log10(max(1, total))
    ending: dict[int, list[tuple[int, int]]] = {}
    for (a, b), n in known.items():
        ending.setdefault(b, []).append((a, n))
    # a last word that is not known begins where best[a] + a is largest; as many starts are kept as known words can rule out
    keep = max(map(len, ending.values()), default=0) + 1
    starts: list[tuple[float, int]] = []
    for b in range(1, len(raw) + 1):
        insort(starts, (-(best[b - 1] + b - 1), b - 1))
        del starts[keep:]
        ways = [(best[a] + math.log10(n) - log_n, -a) for a, n in ending.get(b, [])]
        start = next((a for _, a in starts if (a, b) not in known), None)
        if start is not None:
            ways.append((best[start] + (1 - log_n - (b - start)), -start))
        best[b], a = max(ways)
        back[b] = -a
    out, b = [], len(raw)
    while b:
        out.append(raw[back[b]:b].decode("utf-8", "replace"))
        b = back[b]
    return out[::-1]


def segmented(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) for distinct letter runs."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lengths = sorted(r[0] for r in counts.select("size").distinct().collect())  # one number for each length
    numbered = cut(runs.withColumn("no", F.monotonically_increasing_id()), "runs")
    words = runs.sparkSession.sparkContext.broadcast(bitmap(counts, "h", WORD_BITS))
    # a run has at most as many rows as there are lengths for each of its bytes
    found = substrings(numbered, lengths, words).join(counts, "h").groupBy("no").agg(F.collect_list(F.struct("a", "b", "n")).alias("known"))
    known = numbered.join(found, "no", "left").select("run", "known")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [best_split(r, {(x["a"], x["b"]): x["n"] for x in k or []}, total)
                     for r, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["run", "words"])

    return known.mapInArrow(split, "run string, words array<string>")


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words) for distinct hosts: the words of its letter runs in order."""
    runs = hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit(_LETTERS), F.lit(0))).alias("k", "run"))
    split = segmented(runs.select("run").distinct(), counts)
    return (runs.join(split, "run").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("k", "words"))).alias("w"))
            .select("host", F.flatten(F.col("w.words")).alias("words")))


def fit(labelled: DataFrame) -> tuple[float, DataFrame, int, float]:
    """Prior log odds of block, (token, odds) of every token, their number, and the odds of a token not among them, from
    rows (verdict, tokens)."""
    docs = {r[0]: r[1] for r in labelled.groupBy("verdict").count().collect()}  # two rows
    of = [F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)).alias(v) for v in ("block", "allow")]
    t = cut(labelled.select("verdict", F.explode("tokens").alias("token")).groupBy("token").agg(*of), "token-counts")
    seen, block, allow = t.agg(F.count(F.lit(1)), F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("allow"), F.lit(0))).first()
    unseen = math.log(allow + max(1, seen)) - math.log(block + max(1, seen))
    prior = math.log((docs.get("block", 0) + 1) / (docs.get("allow", 0) + 1)) if docs else 0.0
    odds = F.log(F.col("block") + 1.0) - F.log(F.col("allow") + 1.0) + F.lit(unseen)
    return prior, t.select("token", odds.alias("odds")), seen, unseen


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html",
           rules: tuple[tuple[str, str], ...] = RULES, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """(id, host, path, rule, verdict, score, host_words): score is the log odds of block."""
    base = pages.select(pages[id_col].alias("id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    base = base.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    counts = cut(word_counts(pages, text_col), "word-counts")
    words = cut(host_words(base.select("host").distinct(), counts), "host-words")
    low = F.translate(F.regexp_replace("path", "[0-9]+", "#"), _UPPER, _LOW)
    pieces = F.regexp_extract_all(low, F.lit(r"[a-z#[^\x00-\x7F]]+"), F.lit(0))
    tokens = F.concat(F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w)),
                      F.transform(pieces, lambda w: F.concat(F.lit("p:"), w)))
    rows = base.join(words, "host", "left").select("id", "host", "path", "r.rule", "r.verdict", tokens.alias("tokens"), F.concat_ws(" ", "words").alias("host_words"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "pages")
    prior, odds, seen, unseen = fit(rows.where("rule is not null"))
    of_page = rows.select("row", F.explode("tokens").alias("token"))
    if seen <= broadcast_tokens:
        found = of_page.join(F.broadcast(odds), "token", "left")
    else:
        salted = odds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = of_page.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["token", "salt"], "left")
    # summed in order, so that reruns agree
    sums = found.groupBy("row").agg(F.sort_array(F.collect_list(F.coalesce("odds", F.lit(unseen)))).alias("odds"))
    score = F.lit(prior) + F.aggregate(F.coalesce("odds", F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x)
    out = rows.join(sums, "row", "left").withColumn("score", score)
    verdict = F.coalesce("verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score", "host_words")
