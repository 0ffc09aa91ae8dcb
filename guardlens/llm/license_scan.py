"""License scans by patience alignment.

Text and template are words (runs of 0-9, a-z after lower-casing, and characters outside ASCII). Words that occur once in
both are anchors; the longest increasing subsequence of their places keeps the anchors in order, and the gaps
between them are aligned in the same way. In a gap without anchors the common head and tail match, and what is left
by a longest common subsequence. Coverage is the share of the template's words that are matched.

Every document meets every template, but most pairs are settled by a bound: a template cannot match more words than
it shares with the document, counted with repetition. Only pairs whose bound reaches ``min_coverage`` are aligned;
none above it is lost. A match must also be dense: at least ``min_density`` of the words between its first and last
one, so it is at most ``reach`` words long. In a whole text repeated notices have no unique words and stray words stretch
a match; the alignment therefore runs in windows (see ``windows``) whose own bound reaches ``min_coverage``, and of each
alignment the longest dense run counts. Bounds of all windows are prefix sums, and the number of windows is linear in the
text, so that long texts take time in proportion. Memory is that of one group of texts and one long text's words.

Null and empty texts match nothing. The template with most matches, less the words left over in it and in its stretch, is reported
(so a notice wins over a shorter one that it contains and over a longer one of which it is a part), of equals the first by name; ``licenses`` has the names of all templates that reach both thresholds.
Rows are judged one by one, so repeated rows and equal or null ids each give a row; only id and text are read, so other columns may have
any name. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from guardlens.llm.license_texts import TEMPLATES
from guardlens.llm.text import BY_ALNUM, as_bytes, chunks, hash_words

MIN_COVERAGE, MIN_DENSITY = 80, 50


def lcs_pairs(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by bits: one big-integer step for each word of the text that the template has."""
    where: dict[int, int] = {}
    for j, x in enumerate(template):
        where[x] = where.get(x, 0) | 1 << j
    at = [i for i, x in enumerate(text) if x in where]
    full = (1 << len(template)) - 1
    rows = [full]
    for i in at:
        row = rows[-1]
        hit = row & where[text[i]]
        rows.append(((row + hit) | (row - hit)) & full)
    out, k, j = [], len(at), len(template)
    while k and j:
        if rows[k] >> (j - 1) & 1:   # the template's word adds nothing
            j -= 1
        elif rows[k - 1] >> (j - 1) & 1:
            k, j = k - 1, j - 1
            out.append((at[k], j))
        else:                        # an earlier word of the text does as well
            k -= 1
    return out[::-1]


def anchors(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of the words unique to both sides, the longest run of them in order."""
    def once(x: list[int]) -> dict[int, int]:
        seen: dict[int, int] = {}
        for i, w in enumerate(x):
            seen[w] = -1 if w in seen else i
        return seen

    ua, ub = once(a), once(b)
    pairs = sorted((i, ub[w]) for w, i in ua.items() if i >= 0 and ub.get(w, -1) >= 0)
    tails: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        if at == len(tails):
            tails.append(j)
            last.append(k)
        else:
            tails[at], last[at] = j, k
        back[k] = last[at - 1] if at else -1
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Matched places (text, template), in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and text[a0] == template[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and text[a1 - 1] == template[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        a, b = text[a0:a1], template[b0:b1]
        found = anchors(a, b)
        if not found:
            out += [(a0 + i, b0 + j) for i, j in lcs_pairs(a, b)]
            continue
        x, y = a0, b0
        for i, j in found:
            todo.append((x, a0 + i, y, b0 + j))
            x, y = a0 + i + 1, b0 + j + 1
            out.append((a0 + i, b0 + j))
        todo.append((x, a1, y, b1))
    return sorted(out)


def densest(pairs: list[tuple[int, int]], min_density: int) -> tuple[int, int, int]:
    """The longest run of matched places that is dense, the shortest and first of equals: matched words, text positions [first, end)."""
    if not pairs:
        return 0, 0, 0
    at = np.array([i for i, _ in pairs])
    k = np.arange(len(at))
    level = 100 * k - min_density * at  # [i, j] is dense where level[j] - level[i] >= min_density - 100
    ahead = np.maximum.accumulate(level[::-1])[::-1]
    reach = np.searchsorted(-ahead, -(level + min_density - 100), side="right") - 1
    m = reach - k + 1
    best = np.flatnonzero(m == m.max())
    i = int(best[np.argmin(at[reach[best]] - at[best])])
    return int(m[i]), int(at[i]), int(at[reach[i]]) + 1


def shared_words(h: np.ndarray, template: np.ndarray, length: int) -> np.ndarray:
    """For each position, how many words the next ``length`` words share with the template, counted with repetition."""
    words, need = np.unique(template, return_counts=True)
    slot = np.minimum(np.searchsorted(words, h), len(words) - 1)
    at = np.flatnonzero(words[slot] == h)
    by_word = at[np.argsort(slot[at], kind="stable")]
    w = slot[by_word]
    k = np.arange(len(w))
    # an occurrence counts for starts behind the one that is `need` occurrences earlier, as only so many are needed
    earlier = k - need[w]
    same = (earlier >= 0) & (w[np.maximum(earlier, 0)] == w)
    low = np.maximum(np.where(same, by_word[np.maximum(earlier, 0)] + 1, 0), by_word - length + 1).clip(0)
    steps = np.bincount(low, minlength=len(h) + 1) - np.bincount(by_word + 1, minlength=len(h) + 1)
    return np.cumsum(steps)[:len(h)]


def windows(h: np.ndarray, template: np.ndarray, min_coverage: int, min_density: int) -> Iterator[tuple[int, int]]:
    """Windows [a, b) of the text that may hold a dense match.

    A dense match is at most ``reach`` words long. For each stretch of starts: the window of the template's length and the one
    of ``reach`` that share most words with it (of equals, the one that begins as the template does), and one that holds every
    dense match that starts there. Stretches in which no start shares enough words have none.
    """
    size = len(template)
    reach = max(size, 100 * size // min_density if min_density else len(h))
    wide = shared_words(h, template, reach)
    tight = shared_words(h, template, size)
    head = np.zeros(len(h), np.int64)
    go = np.ones(len(h), bool)
    for j in range(min(4, size, len(h))):
        go[len(h) - j:] = False
        go[:len(h) - j] &= h[j:] == template[j]
        head += go
    step = max(1, size // 2)
    starts = np.flatnonzero(100 * wide >= min_coverage * size)
    for block in np.unique(starts // step).tolist():
        a, b = block * step, min(len(h), (block + 1) * step)
        for shared, length in ((tight, size), (wide, reach)):
            s = a + int(np.argmax(shared[a:b] * 8 + head[a:b]))
            if 100 * shared[s] >= min_coverage * size:
                yield s, min(len(h), s + length)
        yield a, min(len(h), b + reach)


def best_match(h: np.ndarray, template: np.ndarray, min_coverage: int = MIN_COVERAGE, min_density: int = MIN_DENSITY) -> tuple[int, int, int]:
    """Matched words and text positions [first, end) of the best dense alignment; (0, 0, 0) if none reaches both thresholds."""
    best, words, done = (0, 0, 0), template.tolist(), (0, 0)
    for a, b in windows(h, template, min_coverage, min_density):
        if (a, b) == done:
            continue
        done = (a, b)
        m, first, end = densest(align(h[a:b].tolist(), words), min_density)
        if 100 * m >= min_coverage * len(words) and (m, first - end) > (best[0], best[1] - best[2]):
            best = (m, a + first, a + end)
            if m == len(words) == end - first:
                break
    return best


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
         min_coverage: int = MIN_COVERAGE, min_density: int = MIN_DENSITY) -> DataFrame:
    """(id, n_words, license, matched, template_words, coverage, start_word, end_word, licenses); license is null without a match."""
    named = dict(sorted((templates or TEMPLATES).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = {k: hash_words(np.frombuffer(t.encode() + b"\n", np.uint8), BY_ALNUM)[2] for k, t in named.items()}
        names = [k for k in hashes if len(hashes[k])]
        vocabulary = np.unique(np.concatenate([hashes[k] for k in names])) if names else np.zeros(0, np.uint64)
        need = np.zeros((len(names), len(vocabulary)), np.int64)
        for row, k in zip(need, names):
            np.add.at(row, np.searchsorted(vocabulary, hashes[k]), 1)
        total = need.sum(axis=1)
        quick = np.zeros(1 << 16, bool)
        quick[vocabulary & np.uint64(0xFFFF)] = True
        for batch in batches:
            rows: list[tuple] = []
            for c in chunks(as_bytes(batch.column(1)), BY_ALNUM):
                n = c.last - c.first
                near = np.flatnonzero(quick[c.hash & np.uint64(0xFFFF)])
                at = np.minimum(np.searchsorted(vocabulary, c.hash[near]), max(0, len(vocabulary) - 1))
                real = vocabulary[at] == c.hash[near] if len(vocabulary) else np.zeros(0, bool)
                doc = np.searchsorted(c.bounds, near[real], side="right") - 1
                have = np.bincount(doc * len(vocabulary) + at[real], minlength=n * len(vocabulary)).reshape(n, -1)
                bound = np.stack([np.minimum(have, r).sum(axis=1) for r in need], axis=1) if names else np.zeros((n, 0))
                for i in range(n):
                    h = c.hash[c.bounds[i]:c.bounds[i + 1]]
                    best = (len(h), None, 0, None, None, None, None, [])
                    rank = None
                    for t in np.flatnonzero(100 * bound[i] >= min_coverage * total):
                        k, size = names[t], int(total[t])
                        m, a, b = best_match(h, hashes[k], min_coverage, min_density)
                        if m:
                            best[-1].append(k)
                            fit = 3 * m - size - (b - a)  # matches, less what is left over in the template and in the stretch
                            if rank is None or (fit, m) > rank:
                                rank = (fit, m)
                                best = (len(h), k, m, size, m / size, a, b, best[-1])
                    rows.append(best)
            cols = list(zip(*rows)) or [[]] * 8
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip(cols, kinds)]],
                                             names=[id_col, "n_words", "license", "matched", "template_words", "coverage", "start_word", "end_word",
                                                    "licenses"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, license string, matched long, template_words long, "
                                                         "coverage double, start_word long, end_word long, licenses array<string>")
