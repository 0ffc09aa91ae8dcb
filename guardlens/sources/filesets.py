"""Named text files written and read by tasks: attempt files, committed by a manifest.

A task writes every file under a name of its own attempt and returns a manifest row for it. The manifest is stored by Spark, whose commit takes
the rows of one attempt a task, so files of lost, retried or speculative tasks are never read. Rows of a file are dealt by its name, sorted
inside the partitions and streamed, so a task holds one line. Where one file would take too much of the data, give ``part``: a file is then several, read
in order of their parts.

Files go through pyarrow's file systems, chosen by the folder's URI. Digests are of what is stored, and can be checked against the files by
``digests``, which reads byte ranges, so the size of a file does not matter.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

READ = 8 << 20
CHUNK = 256 << 20
MANIFEST = "name string, part int, file string, n_lines long, size long, sha256 string"
BATCH = 4096


def _row_batch(rows: list[tuple], names: Sequence[str], types: Sequence[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=list(names))


def write_files(lines: DataFrame, folder: str, name: str, line: str, order: Sequence[str], part: Column | None = None, header: str | None = None,
                suffix: str = ".txt", gzip: bool = False) -> DataFrame:
    """One file for each value of ``name`` (and part): its lines in order, each ended by a newline. Returns the manifest."""
    rows = lines.select(F.col(name).cast("string").alias("__name"), (F.lit(0) if part is None else part).cast("int").alias("__part"), F.col(line).cast("string").alias("__line"),
                        *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)])
    keys = ["__name", "__part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = uuid.uuid4().hex[:12]
        fs, base = pyarrow.fs.FileSystem.from_uri(f"{folder}/data")
        fs.create_dir(base, recursive=True)
        done: list[tuple] = []
        at, out, state = None, None, None

        def put(text: str) -> None:
            raw = (text + "\n").encode()
            data = state["zip"].compress(raw) if gzip else raw
            out.write(data)
            state["sha"].update(data)
            state["size"] += len(data)

        def close() -> None:
            if gzip:
                data = state["zip"].flush()
                out.write(data)
                state["sha"].update(data)
                state["size"] += len(data)
            out.close()
            done.append((*at, state["file"], state["n"], state["size"], state["sha"].hexdigest()))

        for batch in batches:
            for who, no, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (who, no) != at:
                    if at is not None:
                        close()
                    at = (who, no)
                    state = {"file": f"{len(done):06d}-{no:05d}-{attempt}{suffix}", "n": 0, "size": 0, "sha": hashlib.sha256(), "zip": zlib.compressobj(6, zlib.DEFLATED, 31)}
                    out = fs.open_output_stream(f"{base}/{state['file']}", compression=None)
                    if header is not None:
                        put(header)
                put(text or "")
                state["n"] += 1
        if at is not None:
            close()
        yield _row_batch(done, [c.split()[0] for c in MANIFEST.split(", ")], [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()])

    (rows.repartition(*keys).sortWithinPartitions(*keys, *[f"__o{i}" for i in range(len(order))]).select("__name", "__part", "__line")
     .mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest"))
    return manifest(lines.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_files(spark: SparkSession, folder: str, header: bool = False) -> DataFrame:
    """(name, part, line_no, line) of the committed files; a digest that differs from the manifest is an error."""
    files = manifest(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(f"{folder}/data")
        types = [pa.string(), pa.int32(), pa.int64(), pa.string()]
        rows: list[tuple] = []
        for batch in batches:
            for name, part, file, sha in zip(*(batch.column(i).to_pylist() for i in range(4))):
                digest, unzip, left, n = hashlib.sha256(), zlib.decompressobj(47) if file.endswith(".gz") else None, b"", -int(header)
                with fs.open_input_file(f"{base}/{file}") as f:
                    while data := f.read(READ):
                        digest.update(data)
                        *whole, left = (left + (unzip.decompress(data) if unzip else data)).split(b"\n")
                        for text in whole:
                            if n >= 0:
                                rows.append((name, part, n, text.decode()))
                            n += 1
                            if len(rows) >= BATCH:
                                yield _row_batch(rows, ("name", "part", "line_no", "line"), types)
                                rows = []
                if digest.hexdigest() != sha:
                    raise ValueError(f"{file} is not what the manifest says")
        yield _row_batch(rows, ("name", "part", "line_no", "line"), types)

    return (files.select("name", "part", "file", "sha256").repartition("file")
            .mapInArrow(run, "name string, part int, line_no long, line string"))


def _listed(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path relative to the root, uri, size) of every file below a folder; contents are not read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    scheme = root.split("://")[0] if "://" in root else root.split(":")[0]
    base = root.split(":", 1)[1].lstrip("/") if "://" not in root else root.split("://", 1)[1]
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length")
    bare = lambda c: F.regexp_replace(c, f"^{scheme}:/+", "")
    found = files.select(bare(F.col("path")).alias("bare"), F.col("path").alias("uri"), F.col("length").alias("size"))
    # a scan passes over files without bytes; the list of all files is at the driver anyhow
    every = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "uri string").select(bare(F.col("uri")).alias("bare"), "uri", F.lit(0).cast("long").alias("size"))
    both = found.unionByName(every.join(found.select("bare"), "bare", "left_anti"))
    return both.select(F.substring("bare", F.lit(len(base.rstrip("/")) + 2), F.length("bare")).alias("path"), "uri", "size")


def _open(uri: str):
    scheme, rest = uri.split(":", 1)
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    fs, path = pyarrow.fs.FileSystem.from_uri(quote(uri, safe=":/@"))
    return fs.open_input_file(path)


def digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, sha256) of every file below a folder, paths relative to it. A file is streamed by one task, whatever its size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, uri, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                sha = hashlib.sha256()
                with _open(uri) as f:
                    while data := f.read(READ):
                        sha.update(data)
                rows.append((name, size, sha.hexdigest()))
            yield _row_batch(rows, ("path", "size", "sha256"), [pa.string(), pa.int64(), pa.string()])

    return _listed(spark, path, glob).repartition("path").mapInArrow(run, "path string, size long, sha256 string")


def chunk_digests(spark: SparkSession, path: str, glob: str = "*", chunk: int = CHUNK) -> DataFrame:
    """(path, size, n_chunks, tree_sha256): byte ranges are digested side by side, and their digests folded in file order.

    For files so large that one task is not enough; the digest is the sha256 of the ranges' sha256 bytes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, uri, size, no in zip(*(batch.column(i).to_pylist() for i in range(4))):
                sha, left = hashlib.sha256(), min(chunk, size - no * chunk)
                with _open(uri) as f:
                    f.seek(no * chunk)
                    while left and (data := f.read(min(READ, left))):
                        sha.update(data)
                        left -= len(data)
                rows.append((name, size, no, sha.digest()))
            yield _row_batch(rows, ("path", "size", "no", "digest"), [pa.string(), pa.int64(), pa.int64(), pa.binary()])

    ranges = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr(f"(size - 1) div {chunk}")))
    parts = _listed(spark, path, glob).withColumn("no", F.explode(ranges)).repartition("path", "no").mapInArrow(run, "path string, size long, no long, digest binary")
    folded = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "digest"))), lambda x: F.hex(x.digest)), "")
    return parts.groupBy("path", "size").agg(F.count(F.lit(1)).alias("n_chunks"), F.sha2(F.unhex(folded), 256).alias("tree_sha256"))
