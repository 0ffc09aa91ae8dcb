"""Token counts by a linear longest-match automaton.

Greedy longest-match word pieces of a word are found in one pass over its bytes, without building pieces. The
vocabulary is a trie; where a node has no edge for the next byte, its failure link leads to the node of the text
that is left once the pieces that are certain by then have been popped, and a number beside the link says how many
those are. A second number gives the pieces that come out if the text ends at the node. So a word costs at most two
steps a byte, whatever the longest piece.

A word (a run of anything but ASCII white space) is matched with a leading space, as byte-level vocabularies write
words. If some byte sequence has no match the word counts as one unknown piece. Lengths of words are kept in a
bounded table of the worker, so that a frequent word is walked once.

Null, empty and blank texts have no words and no pieces. Rows are counted one by one, so repeated rows and equal or null ids each give a
row. A text of any length needs memory for its own words; a word of any length is one pass over its bytes. An empty table gives no
rows. Only the id and text columns are read, so others may have any name. The vocabulary file must be readable under its path on every machine.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from guardlens.llm.text import as_bytes

CACHE = 500_000


class Automaton:
    """Trie with failure links; ``length(word)`` is the number of pieces, or 0 if the word cannot be split."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.edges: list[dict[int, int]] = [{}]
        final: list[bool] = [False]
        for token in vocabulary:
            node = 0
            for byte in token:
                nxt = self.edges[node].get(byte)
                if nxt is None:
                    nxt = len(self.edges)
                    self.edges[node][byte] = nxt
                    self.edges.append({})
                    final.append(False)
                node = nxt
            final[node] = bool(token)
        n = len(self.edges)
        self.fail: list[int] = [-1] * n    # -1: no way on
        self.popped: list[int] = [0] * n   # pieces given off on the failure link
        self.ending: list[int] = [-1] * n  # pieces if the word ends here; -1: it cannot
        self.ending[0] = 0
        queue = deque([0])
        while queue:  # by depth: links lead to shallower nodes, which are ready
            u = queue.popleft()
            for byte, v in self.edges[u].items():
                if final[v]:
                    self.fail[v], self.popped[v] = 0, 1
                else:
                    z, pops = self.fail[u], self.popped[u]
                    while z >= 0 and byte not in self.edges[z]:
                        pops += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.edges[z][byte], pops
                f = self.fail[v]
                if f >= 0 and self.ending[f] >= 0:
                    self.ending[v] = self.popped[v] + self.ending[f]
                queue.append(v)

    def length(self, word: bytes) -> int:
        edges, fail, popped = self.edges, self.fail, self.popped
        node = count = 0
        for byte in word:
            nxt = edges[node].get(byte)
            while nxt is None:
                count += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
                nxt = edges[node].get(byte)
            node = nxt
        end = self.ending[node]
        return count + end if end >= 0 else 0


def byte_vocabulary(path: str) -> list[bytes]:
    """Tokens of a byte-level tokenizer file as bytes.

    The file writes printable bytes as themselves and the others as the code points from 256 on, in order.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    with open(path, encoding="utf-8") as f:
        words = json.load(f)["model"]["vocab"]
    return [bytes(byte_of[c] for c in w) for w in words if all(c in byte_of for c in w)]


class _Lengths(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.length(b" " + word)
        self[word] = n
        return n


_LENGTHS: dict[str, _Lengths] = {}


def token_counts(docs: DataFrame, vocabulary_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_pieces, n_unknown) for each document; unknown words count one piece each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary_file not in _LENGTHS:
            _LENGTHS[vocabulary_file] = _Lengths(Automaton(byte_vocabulary(vocabulary_file)))
        known = _LENGTHS[vocabulary_file]
        for batch in batches:
            words, pieces, unknown = [], [], []
            for text in as_bytes(batch.column(1)):
                w = text.split()  # of bytes: exactly at ASCII white space
                lengths = list(map(known.__getitem__, w))
                zero = lengths.count(0)
                words.append(len(w))
                pieces.append(sum(lengths) + zero)
                unknown.append(zero)
                if len(known) > CACHE:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (words, pieces, unknown)]],
                                             names=[id_col, "n_words", "n_pieces", "n_unknown"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_pieces long, n_unknown long")
