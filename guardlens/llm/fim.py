"""Fill-in-middle transformation by secondary-sort assembly.

A text is cut into units, each a run of white space with the word behind it (white space at the end is a unit of its own). Two
cuts between units, drawn from the sha256 of the document's id, give prefix, middle and suffix. Half of the documents stay
``plain``; the others are written as ``<P>prefix<S>suffix<M>middle`` (psm) or ``<S>suffix<P>prefix<M>middle`` (spm).

1. ``pieces``: one pass emits chunks of at most ``UNITS`` units and ``PIECE_BYTES`` bytes, and the markers, keyed by (row,
   position in the output).
2. ``assembled``: pieces are dealt by row and sorted by (row, position) inside the partitions, so a task streams each output in
   order and holds one piece and one running digest, whatever the text's length.
3. ``restored``: markers in the output name the part that follows, which gives each piece its place in the text. The pieces stay
   in their partition and are sorted again by that place, without a second shuffle, and streamed into the digest of the rebuilt text.

Null and empty texts are plain and empty. A text that holds a marker is plain, so the first marker of each kind in an output is
always the one that was put there. A null id is the empty string in the hash. Rows are told apart by a row number: repeated
rows and equal ids each give a row, with equal cuts. An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlens.llm.text import BY_SPACE

UNITS, PIECE_BYTES = 4096, 1 << 16
BATCH_BYTES = 4 << 20
MARKS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
#: parts in the order of the output
ORDERS = {"psm": "PSM", "spm": "SPM"}
#: place of a part in the text; the row that closes a document comes after them
PLACE, CLOSING = {"P": 0, "M": 1, "S": 2}, 3
_SEGMENT = {mark: PLACE[k] for k, mark in MARKS.items()}


def draws(id_col: Column, seed: int) -> Column:
    """The first four 8-digit groups of the sha256 of ``seed:id`` as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Byte offsets at which units end."""
    if not len(data):
        return np.zeros(0, np.int64)
    word = BY_SPACE[data]
    return np.append(np.flatnonzero(word[:-1] & ~word[1:]) + 1, len(data))


def code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def layout(text: bytes, ends: np.ndarray, h: list[int], fim_percent: int, spm_percent: int) -> tuple[str, int, int]:
    """Form, and the numbers of units before the middle and before the suffix."""
    n = len(ends)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or h[2] % 100 >= fim_percent or any(m in text for m in MARKS.values()):
        return "plain", a, b
    return ("spm" if h[3] % 100 < spm_percent else "psm"), a, b


def _chunks(ends: np.ndarray, a: int, b: int, units: int = UNITS, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Byte ranges of the units a to b, in order."""
    at = int(ends[a - 1]) if a else 0
    for k in [*range(a + units, b, units), b] if b > a else []:
        end = int(ends[k - 1])
        for s in range(at, end, size):
            yield s, min(end, s + size)
        at = end


META = ("id", "n", "form", "prefix_chars", "middle_chars")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, fim_percent: int = 50,
           spm_percent: int = 80, units: int = UNITS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(row, pos, data, id, n, form, prefix_chars, middle_chars): the output in pieces; the first one of a row has the figures."""
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"),
                      draws(docs[id_col], seed).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.column(1).type
            cols: list[list] = [[] for _ in range(8)]
            held = 0
            for i, (row, ident, h) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                text = batch.column(2)[i].as_py() or b""
                data = np.frombuffer(text, np.uint8)
                ends = unit_ends(data)
                form, a, b = layout(text, ends, h, fim_percent, spm_percent)
                if form == "plain":
                    out = [text[s:e] for s, e in _chunks(ends, 0, len(ends), units, piece_bytes)] or [b""]
                    meta = (ident, len(ends), form, None, None)
                else:
                    bounds = {"P": (0, a), "M": (a, b), "S": (b, len(ends))}
                    out = [x for k in ORDERS[form] for x in (MARKS[k], *(text[s:e] for s, e in _chunks(ends, *bounds[k], units, piece_bytes)))]
                    cut = [int(ends[k - 1]) if k else 0 for k in (a, b)]
                    meta = (ident, len(ends), form, code_points(data[:cut[0]]), code_points(data[cut[0]:cut[1]]))
                for pos, x in enumerate(out):
                    for col, v in zip(cols, (row, pos, x, *(meta if pos == 0 else (None,) * 5))):
                        col.append(v)
                held += len(text)
                if held > BATCH_BYTES:
                    yield _piece_batch(cols, id_type)
                    cols, held = [[] for _ in range(8)], 0
            yield _piece_batch(cols, id_type)

    return src.mapInArrow(run, f"row long, pos int, data binary, id {kind}, n long, form string, prefix_chars long, middle_chars long")


def _piece_batch(cols: list[list], id_type: pa.DataType) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.binary(), id_type, pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["row", "pos", "data", *META])


def assembled(parts: DataFrame) -> DataFrame:
    """All pieces of a row in one partition, in the order of the output."""
    return parts.repartition("row").sortWithinPartitions("row", "pos")


def _documents(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def outputs(parts: DataFrame) -> DataFrame:
    """(row, id, form, text): the outputs themselves, one at a time in memory."""
    kind = parts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer({"row": pa.int64(), "id": None, "form": pa.string(), "text": pa.binary()})
        row, held, meta = None, [], (None, None)
        for r, pos, data, ident, form in _documents(out.typed(batches), ["row", "pos", "data", "id", "form"]):
            if r != row and row is not None:
                yield from out.put((row, *meta, b"".join(held)), sum(map(len, held)))
            if pos == 0:
                row, held, meta = r, [], (ident, form)
            held.append(data)
        if row is not None:
            yield from out.put((row, *meta, b"".join(held)), 0)
        yield from out.rest()

    return (assembled(parts).mapInArrow(run, f"row long, id {kind}, form string, text binary")
            .withColumn("text", F.col("text").cast("string")))


class _Writer:
    """Collects rows into batches of bounded size. The type of ``id`` is that of the batches read."""

    def __init__(self, types: dict[str, pa.DataType | None]):
        self.types, self.rows, self.held = types, [], 0

    def typed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            self.types["id"] = batch.schema.field("id").type
            yield batch

    def put(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.held += size + 64
        if self.held > BATCH_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            cols = zip(*self.rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, self.types.values())], names=list(self.types))
        self.rows, self.held = [], 0


def digests(parts: DataFrame) -> DataFrame:
    """(row, id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) from the pieces of the outputs."""
    kind = parts.schema["id"].dataType.simpleString()
    figures = {"id": None, "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output_sha256": pa.string()}
    figures_ddl = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string"
    nothing = (None,) * len(figures)

    def read_output(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digest each output; its pieces go on by their place in the text, and a last row has the figures."""
        out = _Writer({"row": pa.int64(), "part": pa.int32(), "seq": pa.int32(), "data": pa.binary(), **figures})
        row, meta, sha, part = None, (), None, 0
        for r, pos, data, *head in _documents(out.typed(batches), ["row", "pos", "data", *META]):
            if pos == 0:
                if row is not None:
                    yield from out.put((row, CLOSING, 0, None, *meta, sha.hexdigest()), 0)
                row, meta, sha, part = r, head, hashlib.sha256(), 0
            sha.update(data)
            if meta[2] != "plain" and data in _SEGMENT:
                part = _SEGMENT[data]
            else:
                yield from out.put((r, part, pos, data, *nothing), len(data))
        if row is not None:
            yield from out.put((row, CLOSING, 0, None, *meta, sha.hexdigest()), 0)
        yield from out.rest()

    def read_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digest each rebuilt text."""
        out = _Writer({"row": pa.int64(), **figures, "restored_sha256": pa.string()})
        sha = hashlib.sha256()
        for r, part, data, *rest in _documents(out.typed(batches), ["row", "part", "data", *figures]):
            if part != CLOSING:
                sha.update(data)
                continue
            yield from out.put((r, *rest, sha.hexdigest()), 0)
            sha = hashlib.sha256()
        yield from out.rest()

    return (assembled(parts).mapInArrow(read_output, f"row long, part int, seq int, data binary, {figures_ddl}")
            .sortWithinPartitions("row", "part", "seq")
            .mapInArrow(read_text, f"row long, {figures_ddl}, restored_sha256 string"))


def rebuild(output: bytes, form: str) -> bytes:
    """The text of a whole output, for readers of ``outputs``."""
    if form == "plain":
        return output
    first, second, third = (MARKS[k] for k in ORDERS[form])
    a, rest = output[len(first):].split(second, 1)
    b, middle = rest.split(third, 1)
    prefix, suffix = (a, b) if form == "psm" else (b, a)
    return prefix + middle + suffix


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    return digests(pieces(docs, id_col, text_col, **kw)).drop("row").withColumnRenamed("id", id_col)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
k AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
