"""Corpus pipeline: quality rules, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor, and is written as Parquet and read
again before the next. All but the last return the columns of ``documents``.

* ``quality``: rejected documents go; in the others failing lines are removed and ``n_chars`` follows the text.
* ``near_duplicates``: the row with the smallest id of each group of linked documents stays, the first of equal ids.
* ``decontamination``: rows with an occurrence of a benchmark window go.
* ``mixing``: a document appears as often as the mix takes it (not at all, once or twice).
* ``token_files``: token ids in binary files; one row per document with the figures read back from them.

An empty table goes through every stage and gives no rows. Nulls, repeated rows and very long texts are
handled as the operators in ``guardlens.llm`` state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from guardlens.llm import decontaminate, jaccard_join, mixing, quality, queries, token_ids
from guardlens.session import work_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.ship(spark)
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.ship(spark)
    return jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.ship(spark)
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.ship(spark)
    return mixing.mix_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.ship(spark)
    return token_ids.round_trip(docs, queries.tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_files),
]

#: The library tokenizer of the last stage has no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries.ship(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = work_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
