"""Registered queries of the package: each operator on its whole table, at production parameters."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlens.llm import (chat_roles, decontaminate, fim, hpyp, importance, jaccard_join, license_scan, mixing, quality, token_ids, topk, url_filter,
                           wordpiece)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, as ``--py-files`` would: their Python need not have it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="guardlens-code-")) / "guardlens.zip"  # read by the driver only
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(_read(spark, sf_dir, "documents"))


def op7_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_read(spark, sf_dir, "documents")).drop("clean_text")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpyp.scores(_read(spark, sf_dir, "documents"), rarer=True)


def op2_license_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op3_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(_read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op4_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.round_trip(_read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op5_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return decontaminate.digests(found, "doc_id")


def op8_url_segment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_read(spark, sf_dir, "pages"))


def op9_chat_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_roles.recover(_read(spark, sf_dir, "conversations"))


def op10_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_read(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(_read(spark, sf_dir, "documents"))


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_sorted_list_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.report(_read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # beside the entry module; it imports this one

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pitman_yor_scores": op1_pitman_yor_scores,
    "op2_license_alignment": op2_license_alignment,
    "op3_wordpiece_counts": op3_wordpiece_counts,
    "op4_token_id_files": op4_token_id_files,
    "op5_winnowing_decontamination": op5_winnowing_decontamination,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_line_first_quality": op7_line_first_quality,
    "op8_url_segment_filter": op8_url_segment_filter,
    "op9_chat_roles": op9_chat_roles,
    "op10_hash_threshold_mix": op10_hash_threshold_mix,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_importance_resample": op12_importance_resample,
    "op13_sorted_list_topk": op13_sorted_list_topk,
    "pipeline": pipeline,
}

SQL: dict[str, str] = {
    "op5_winnowing_decontamination": decontaminate.SQL,
    "op10_hash_threshold_mix": mixing.SQL,
    "op11_fill_in_middle": fim.SQL,
    "op12_importance_resample": importance.SQL,
    "op13_sorted_list_topk": topk.SQL,
}
