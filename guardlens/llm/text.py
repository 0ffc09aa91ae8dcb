"""Vectorised word hashing over Arrow batches.

Texts are handled as UTF-8 bytes: every word class used here is a set of ASCII bytes, and bytes of 0x80
and above always belong to words, so no decoding is needed. A word is hashed to 64 bits (lower-cased, A-Z
only, unless told otherwise); runs of words are hashed from the word hashes. Work goes through the bytes in cache-sized
segments cut at separators, so that memory stays near one segment plus 24 bytes a word.

Nulls and empty texts give no words. Equal words always have equal hashes; different words share a hash
with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 17
CHUNK = 1 << 19
_B = 0x9E3779B97F4A7C15
_BINV = pow(_B, -1, 1 << 64)
_M = np.uint64(0xD6E8FEB86659FD93)


def _mask(separators: bytes) -> np.ndarray:
    m = np.ones(256, bool)
    m[list(separators)] = False
    return m


_SAME = np.arange(1, 257, dtype=np.uint64)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
#: words are runs of anything but ASCII white space: [^\x20\x09-\x0D]+
BY_SPACE = _mask(b" \t\n\v\f\r")
#: words are runs of 0-9, a-z (after lower-casing) and everything outside ASCII
BY_ALNUM = _mask(bytes(i for i in range(128) if not (48 <= i < 58 or 65 <= i < 91 or 97 <= i < 123)))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    step, have = base, 1
    while have < n:  # doubling: the next `have` powers are the first ones times base**have
        take = min(have, n - have)
        out[have:have + take] = out[:take] * np.uint64(step)
        have += take
        step = step * step % (1 << 64)
    return out


_POW: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW["up"]) < n:
        size = max(SEGMENT + 1, n)
        _POW["up"], _POW["down"] = _powers(_B, size), _powers(_BINV, size)
    return _POW["up"], _POW["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(data: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(sums, down): the hash of the word [s, e) of the data is mix((sums[e] - sums[s]) * down[s])."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if fold else _SAME)[data] * up[:len(data)], out=sums[1:])
    return sums, down


def _segment(data: np.ndarray, is_word: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = is_word[data]
    edges = np.flatnonzero(np.diff(m, prepend=False, append=False))
    starts, ends = edges[0::2], edges[1::2]
    sums, down = prefix_sums(data, fold)
    return starts, ends, mix((sums[ends] - sums[starts]) * down[starts])


def hash_words(data: np.ndarray, is_word: np.ndarray = BY_SPACE, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (byte offsets) and hash of every word of a byte array; ``fold`` lower-cases A-Z."""
    n = len(data)
    if n <= SEGMENT:
        return _segment(data, is_word, fold)
    parts, at = [], 0
    while at < n:
        end = min(n, at + SEGMENT)
        while end < n:  # back to a separator; a longer word extends the segment
            cut = np.flatnonzero(~is_word[data[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
                break
            end = min(n, end + SEGMENT)
        s, e, h = _segment(data[at:end], is_word, fold)
        parts.append((s + at, e + at, h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each position (the last k-1 positions have none)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _M
        out += h[j:j + n]
    return mix(out + np.uint64(k))


@dataclass
class Chunk:
    """Consecutive texts: rows [first, last) of the batch, their joined bytes, and where words are."""

    first: int
    last: int
    data: np.ndarray
    raw: bytes
    text_start: np.ndarray  # byte offset of each text
    bounds: np.ndarray      # words of text i are bounds[i]:bounds[i+1]
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.last - self.first), np.diff(self.bounds))


def as_bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def pieces(column: pa.Array, rows: int = 256) -> Iterator[list[bytes]]:
    """The texts of a batch, some rows at a time."""
    for i in range(0, len(column), rows):
        yield as_bytes(column.slice(i, rows))


def chunks(texts: list[bytes], is_word: np.ndarray = BY_SPACE, size: int = CHUNK, fold: bool = True) -> Iterator[Chunk]:
    """Groups of whole texts of about ``size`` bytes with their word hashes. A longer text is a group of its own."""
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) <= size):
            total += len(texts[j]) + 1
            j += 1
        raw = b"\n".join(texts[i:j]) + b"\n"
        at = np.zeros(j - i + 1, np.int64)
        np.cumsum([len(x) + 1 for x in texts[i:j]], out=at[1:])
        data = np.frombuffer(raw, np.uint8)
        s, e, h = hash_words(data, is_word, fold)
        yield Chunk(i, j, data, raw, at[:-1], np.searchsorted(s, at), s, e, h)
        i = j


def union_length(start: np.ndarray, end: np.ndarray) -> int:
    """Number of positions covered by the intervals [start, end)."""
    if not len(start):
        return 0
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    return int((e - np.maximum(s, np.concatenate(([s[0]], e[:-1])))).clip(0).sum())
