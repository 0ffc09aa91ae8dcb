"""Token ids in binary files: ids ranked by frequency, byte-aligned lengths, separate control bytes.

File format (little endian). A file is a sequence of blocks; a block holds whole documents::

    8 bytes   magic "TOKVAR1\\0"
    4 x u64   documents, ids, control bytes, data bytes
    i64[]     document ids          u8[]  1 where the document id is null
    u64[]     ids of each document
    u8[]      control: two bits an id, four ids a byte, lowest bits first: bytes of the id less one
    u8[]      data: the ranks, one to four bytes each, lowest byte first

A rank is the place of an id by falling corpus frequency (ties by id), so frequent ids take one byte.
``ranks`` beside the files is the table rank -> id, at most one row for each id of the vocabulary.

1. Encode: texts are split at single spaces and newlines, where the byte-level pre-tokenizer splits too; each
   different piece is encoded once by the tokenizers library and kept in a bounded table of the worker. Texts
   with longer runs of white space or special tokens go to the library whole. Ids are stored once, compressed by document.
2. Count: each task adds a row with its count of each id, so Spark sums at most one row for each id and task.
3. Write: documents are range-partitioned and sorted by id (then row number); each task writes files under
   names of its own attempt and returns manifest rows. Only files in the manifest count, so a retried or
   speculative task leaves nothing that is read.
4. Read: a task opens the files of its manifest rows; numpy decodes blocks through a table of the 256 control bytes.

Null and empty texts have the end id alone. Repeated rows and equal ids are written one after the other, null
ids first. Document ids must be integral. An empty table gives an empty manifest and no rows. Files are written
through pyarrow's file systems (local or mounted paths, hdfs, s3, gs), chosen by the folder's URI.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from guardlens.session import cut, discard, scratch, work_folder

MAGIC = b"TOKVAR1\0"
BLOCK_IDS = 1 << 20
FILE_BYTES = 64 << 20
CACHE = 700_000
GROUP_CHARS = 1 << 20
#: white space that the pre-tokenizer may not split piece by piece
_RUNS = re.compile(r"\s\s\s|\s\s\Z")
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


class _Codes(dict):
    """Numbers words as they come; ``new`` holds those since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        self.new.append(word)
        return code


class Encoder:
    """Ids of whole texts, piece by piece.

    A word has two pieces: 2 * code with its space before it, and 2 * code + 1 without, as at the start of a text or line.
    Pieces lie end to end in one array of ids; a text is gathered from it by place and length.
    """

    def __init__(self, path: str, end_id: int = 2, cache: int = CACHE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tok, self.end_id, self.cache = Tokenizer.from_file(path), end_id, cache
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.opens = np.array([(self.tok.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        newline = self.ids("\n")
        self.newline_id = int(newline[0]) if len(newline) == 1 else -1
        self._reset(np.zeros(0, np.int64))

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _reset(self, keep: np.ndarray) -> None:
        """Start over with the words of the given codes; their pieces are kept."""
        old = (self.words, self.start, self.length, self.flat) if len(keep) else None
        self.codes, self.words = _Codes(), []
        self.start, self.length = np.zeros(1 << 16, np.int64), np.full(1 << 16, -1, np.int32)
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.seen = np.zeros(1 << 15, np.int32)
        # "\n" alone is a newline, "\n\n" the end of a text: neither can be a piece of a text split at newlines
        self._put(np.array([2 * self.codes["\n"] + 1]), [self.ids("\n")])
        self._put(np.array([2 * self.codes["\n\n"] + 1]), [np.array([self.end_id], np.uint32)])
        self.words, self.codes.new = self.codes.new, []
        if old is None:
            return
        words, start, length, flat = old
        self.words += [words[k] for k in keep.tolist()]
        self.codes.update(zip(self.words, range(len(self.words))))
        for lead in (0, 1):
            have = length[2 * keep + lead] >= 0
            n, at = length[2 * keep[have] + lead].astype(np.int64), start[2 * keep[have] + lead]
            if len(n):
                upto = np.cumsum(n)
                self._put_at(2 * (np.flatnonzero(have) + 2) + lead, flat[np.repeat(at - (upto - n), n) + np.arange(int(upto[-1]))], upto - n, n)

    def _put(self, pieces: np.ndarray, ids: list[np.ndarray]) -> None:
        n = np.array([len(x) for x in ids])
        self._put_at(pieces, np.concatenate(ids), np.cumsum(n) - n, n)

    def _put_at(self, pieces: np.ndarray, ids: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """Pieces lie in ``ids`` from ``at``, ``n`` ids each."""
        while int(pieces.max()) + 2 > len(self.length):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.full_like(self.length, -1)])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.start[pieces], self.length[pieces] = self.used + at, n
        self.used += len(ids)

    def _learn(self, pieces: np.ndarray) -> None:
        """Encode new pieces, many in one text, and take the ids apart at the separators."""
        for lead, sep, bare in ((" ", " ", 0), ("", "\n", 1)):
            mine = pieces[pieces % 2 == bare]
            words = [self.words[k] for k in (mine // 2).tolist()]
            plain = np.array([bool(w) and not w.isspace() for w in words], bool)
            for k in np.flatnonzero(~plain):
                self._put(mine[k:k + 1], [self.ids(lead + words[k])])
            mine, words = mine[plain], [w for w, x in zip(words, plain) if x]
            for i in range(0, len(words), 5000):
                part, at = words[i:i + 5000], mine[i:i + 5000]
                ids = self.ids(lead + sep.join(part))
                # every piece opens with its space, or stands between newlines
                cut_at = np.flatnonzero(self.opens[ids])[1:] if lead else np.flatnonzero(ids == self.newline_id)
                if len(cut_at) == len(part) - 1:
                    first = np.concatenate(([0], cut_at + bare))
                    self._put_at(at, ids, first, np.append(cut_at, len(ids)) - first)
                else:
                    self._put(at, [self.ids(lead + w) for w in part])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end id; number of ids of each text)."""
        whole = [k for k, t in enumerate(texts) if _RUNS.search(t) or any(s in t for s in self.special)]
        odd = set(whole)
        safe = [t for k, t in enumerate(texts) if k not in odd] if odd else texts
        ids, lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if safe:
            words = " \n\n ".join([t.replace("\n", " \n ") for t in safe]).split(" ")
            words.append("\n\n")
            code = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
            self.words += self.codes.new
            self.codes.new = []
            breaks = code <= 1  # newline and end have codes 0 and 1
            piece = 2 * code + np.concatenate(([True], breaks[:-1]))
            piece[breaks] = 2 * code[breaks] + 1
            while 2 * len(self.words) > len(self.length):
                self.start = np.concatenate([self.start, np.zeros_like(self.start)])
                self.length = np.concatenate([self.length, np.full_like(self.length, -1)])
            fresh = self.length[piece] < 0
            if fresh.any():
                self._learn(np.unique(piece[fresh]))
            n = self.length[piece].astype(np.int64)
            upto = np.cumsum(n)
            ids = self.flat[np.repeat(self.start[piece] - (upto - n), n) + np.arange(int(upto[-1]))]
            lengths = np.diff(upto[np.flatnonzero(code == 1)], prepend=0)
            self._age(code)
        if not odd:
            return ids, lengths
        mine = {k: np.append(self.ids(texts[k]), np.uint32(self.end_id)) for k in whole}
        rest = iter(np.split(ids, np.cumsum(lengths)[:-1]) if len(lengths) else [])
        parts = [mine[k] if k in odd else next(rest) for k in range(len(texts))]
        return np.concatenate(parts), np.array([len(x) for x in parts])

    def _age(self, code: np.ndarray) -> None:
        """Bounded memory: when the table is full the words that came back stay, the others are encoded again."""
        if len(self.words) > len(self.seen):
            self.seen = np.concatenate([self.seen, np.zeros(max(len(self.seen), len(self.words)), np.int32)])
        n = np.bincount(code, minlength=len(self.words))
        self.seen[:len(n)] += n.astype(np.int32)
        if len(self.words) > self.cache:
            seen = self.seen[:len(self.words)]
            least = max(1, int(np.partition(seen, len(seen) - self.cache // 2)[len(seen) - self.cache // 2]))
            keep = np.flatnonzero(seen > least)
            self._reset(keep[keep > 1])


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One encoder for each Python worker, kept from task to task."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def _squeeze(ids: np.ndarray) -> bytes:
    """Compressed ids, two bytes each where that is enough; the first byte tells."""
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    return (b"2" if narrow else b"4") + zstandard.compress(ids.astype("<u2" if narrow else "<u4").tobytes(), 3)


def _unsqueeze(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob[1:]), "<u2" if blob[:1] == b"2" else "<u4")


def encoded(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """(id, n, ids, row): compressed ids of each document, and the number of the row.

    The last row of each task has n = -1 and, for ids, the task's count of each token id.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, end_id)
        counts = np.zeros(len(enc.opens) + 1, np.int64)
        kind = None
        for batch in batches:
            texts, kind = [x or "" for x in batch.column(1).to_pylist()], batch.column(0).type
            n, blobs, i = [], [], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= GROUP_CHARS):
                    size += len(texts[j])
                    j += 1
                ids, lengths = enc.encode(texts[i:j])
                counts[:] += np.bincount(ids, minlength=len(counts))[:len(counts)]
                n += lengths.tolist()
                ends = np.cumsum(lengths).tolist()
                blobs += [_squeeze(ids[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
                i = j
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(blobs, pa.binary())], names=["id", "n", "ids"])
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([-1], pa.int64()), pa.array([zstandard.compress(counts.tobytes())], pa.binary())],
                                             names=["id", "n", "ids"])

    out = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(run, "id long, n long, ids binary")
    return out.withColumn("row", F.monotonically_increasing_id())


def ranks_of(ids: DataFrame) -> DataFrame:
    """(rank, id) by falling frequency over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                c = np.frombuffer(zstandard.decompress(blob), np.int64)
                seen = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(c[seen])], names=["id", "n"])

    counts = ids.where("n < 0").select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # one row for each id of the vocabulary
    return counts.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "id")) - 1).alias("rank"), "id")


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = values.astype(np.uint32)
    n = 1 + (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[:len(v)] = n - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    at = np.cumsum(n) - n
    data = np.zeros(int(n.sum()), np.uint8)
    for k in range(4):
        has = slice(None) if not k else np.flatnonzero(n > k)
        data[at[has] + k] = (v[has] >> np.uint32(8 * k)) & np.uint32(0xFF)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The values again: lengths come from the table of control bytes, four at a time."""
    n = _LENGTHS[control].reshape(-1)[:count]
    at = np.cumsum(n, dtype=np.int64) - n
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        has = np.flatnonzero(n > k)
        if not len(has):
            break
        out[has] |= data[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block(ids: list[int | None], docs: list[np.ndarray], rank: np.ndarray) -> bytes:
    values = rank[np.concatenate(docs)]
    control, data = pack(values)
    return b"".join([MAGIC, struct.pack("<4Q", len(ids), len(values), len(control), len(data)),
                     np.array([x or 0 for x in ids], "<i8").tobytes(), bytes(x is None for x in ids),
                     np.array([len(d) for d in docs], "<u8").tobytes(), control, data])


def blocks(file, token_of: np.ndarray) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(document ids, ids of each document, all token ids) of each block of an open file."""
    def take(n: int) -> bytes:
        got = file.read(n)
        if len(got) != n:
            raise ValueError(f"the file ends {n - len(got)} bytes early")
        return got

    while head := file.read(8):
        if head != MAGIC:
            raise ValueError("no block where one should begin")
        docs, n, nc, nd = struct.unpack("<4Q", take(32))
        ids = np.frombuffer(take(8 * docs), "<i8")
        null = np.frombuffer(take(docs), np.uint8)
        lengths = np.frombuffer(take(8 * docs), "<u8").astype(np.int64)
        control, data = np.frombuffer(take(nc), np.uint8), np.frombuffer(take(nd), np.uint8)
        yield [None if z else int(i) for i, z in zip(ids, null)], lengths, token_of[unpack(control, data, n)]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
                      file_bytes: int = FILE_BYTES, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode and write; returns the manifest (file, part, seq, n_docs, n_ids), stored in the folder as well."""
    spark: SparkSession = docs.sparkSession
    with scratch() as made:
        ids = cut(encoded(docs, id_col, text_col, tokenizer, end_id), "token-ids")
    ranks_of(ids).write.parquet(f"{folder}/ranks")
    token_of = _token_of(spark, folder)
    rank = np.zeros(int(token_of.max()) + 1 if len(token_of) else 1, np.uint32)
    rank[token_of] = np.arange(len(token_of))
    shared = spark.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        fs, base = pyarrow.fs.FileSystem.from_uri(f"{folder}/data")
        fs.create_dir(base, recursive=True)
        ids: list[int | None] = []
        docs: list[np.ndarray] = []
        rows: list[tuple] = []
        held, size, n_docs, n_ids = 0, 0, 0, 0
        out = None

        def flush() -> None:
            nonlocal out, held, size, n_docs, n_ids
            if out is None:
                out = fs.open_output_stream(f"{base}/part-{part:06d}-{len(rows):05d}-{attempt}.tok")
            b = block(ids, docs, shared.value)
            out.write(b)
            size, n_docs, n_ids, held = size + len(b), n_docs + len(ids), n_ids + held, 0
            ids.clear()
            docs.clear()

        def close() -> None:
            nonlocal out, size, n_docs, n_ids
            out.close()
            rows.append((f"part-{part:06d}-{len(rows):05d}-{attempt}.tok", part, len(rows), n_docs, n_ids))
            out, size, n_docs, n_ids = None, 0, 0, 0

        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                docs.append(_unsqueeze(blob))
                held += len(docs[-1])
                if held >= block_ids:
                    flush()
                    if size >= file_bytes:
                        close()
        if ids:
            flush()
        if out is not None:
            close()
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))],
                                         names=["file", "part", "seq", "n_docs", "n_ids"])

    (ids.where("n >= 0").repartitionByRange("id", "row").sortWithinPartitions("id", "row").select("id", "ids")
     .mapInArrow(run, "file string, part int, seq int, n_docs long, n_ids long").write.parquet(f"{folder}/manifest"))
    discard(spark, made)
    return spark.read.parquet(f"{folder}/manifest")


def _token_of(spark: SparkSession, folder: str) -> np.ndarray:
    """Token id of each rank; at most one row for each id of the vocabulary comes to the driver."""
    t = spark.read.parquet(f"{folder}/ranks").toArrow()
    out = np.zeros(len(t), np.uint32)
    out[t.column("rank").to_numpy()] = t.column("id").to_numpy()
    return out


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, ids): start counts the ids of all documents before, ids are little-endian unsigned 32-bit bytes."""
    schema = "id long, start long, ids binary"
    manifest = spark.read.parquet(f"{folder}/manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)
    token_of = spark.sparkContext.broadcast(_token_of(spark, folder))

    # one row for each file; files of attempts that did not count are not in the manifest
    order = Window.partitionBy(F.lit(0)).orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(f"{folder}/data")
        for batch in batches:
            for file, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_stream(f"{base}/{file}") as f:
                    for ids, lengths, tokens in blocks(f, token_of.value):
                        ends = np.concatenate(([0], np.cumsum(lengths)))
                        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(4 * ends), pa.py_buffer(tokens.astype("<u4"))])
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(before + ends[:-1]), raw.cast(pa.binary())], names=["id", "start", "ids"])
                        before += int(ends[-1])

    # a task for each file, up to a number that any cluster can hold
    tasks = max(1, min(20_000, manifest.count()))
    return files.repartition(tasks, "file").mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Write to a new work folder and read back, with the digests of each document."""
    folder = work_folder(docs.sparkSession, "token-files")
    write_token_files(docs, folder, tokenizer, end_id, id_col, text_col, **kw)
    back = read_token_files(docs.sparkSession, folder)
    return back.select(F.col("id").alias(id_col), "start", F.expr("length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
