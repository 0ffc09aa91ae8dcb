"""What the stages leave behind, and rows told apart by their place in files."""

import os
import uuid

import corpus_pipeline
from guardlens import session
from guardlens.llm import decontaminate, jaccard_join, rows, token_ids

from llm_rows import prose


def folders(root):
    return {d.split("-")[1]: os.path.join(root, d) for d in sorted(os.listdir(root)) if d.startswith("guardlens-")}


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_stages_leave_no_table_that_is_not_read_any_more(spark, sf, tmp_path, monkeypatch):
    for module in (session, token_ids, corpus_pipeline):
        monkeypatch.setattr(module, "work_folder", lambda spark, name: f"{tmp_path}/guardlens-{name}-{uuid.uuid4().hex[:12]}")
    corpus_pipeline.run(spark, sf)
    left = folders(tmp_path)
    # the stages' outputs, ids of dropped rows, one plan of the mix, and the token files
    assert set(left) == {"pipeline", "gone", "hit", "mix", "token"}
    docs = os.path.getsize(f"{sf}/documents.parquet")
    assert sum(size(f) for k, f in left.items() if k not in ("pipeline", "token")) < docs / 10
    assert not any("numbered" in d for d in os.listdir(tmp_path))


def test_rows_of_files_are_told_apart_by_their_place(spark, tmp_path):
    a, b = prose(801, 60), prose(802, 60)
    made = [[(1, a, 0), (1, b, 1), (None, a, 2)], [(1, a, 3), (None, b, 4), (2, prose(803, 60), 5)]]
    for k, r in enumerate(made):  # files of one name in two folders
        spark.createDataFrame(r, "doc_id long, text string, k long").coalesce(1).write.parquet(f"{tmp_path}/t/p={k}")
    for k in (0, 1):
        one = next(f for f in os.listdir(f"{tmp_path}/t/p={k}") if f.endswith(".parquet"))
        os.rename(f"{tmp_path}/t/p={k}/{one}", f"{tmp_path}/t/p={k}/x.parquet")
    docs = spark.read.parquet(f"{tmp_path}/t")
    placed = rows.numbered(docs)
    assert placed.schema[rows.ROW].dataType.simpleString() == "struct<file:string,row:bigint>" and placed.select(rows.ROW).distinct().count() == 6
    stay = jaccard_join.one_of_each(docs)
    assert sorted(r.k for r in stay.collect()) == [0, 1, 5] and stay.columns == docs.columns
    items = spark.createDataFrame([(1, " ".join(b.split()[20:34]))], "item_id long, text string")
    assert sorted(r.k for r in decontaminate.clean_documents(docs, items).collect()) == [0, 2, 3, 5]


def test_derived_tables_get_a_written_number(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    twice = docs.crossJoin(spark.range(2).select("id"))  # two rows from each place
    assert rows.numbered(twice).select(rows.ROW).distinct().count() == twice.count()
    assert dict(rows.numbered(docs.where("true")).dtypes)[rows.ROW] in ("bigint", "struct<file:string,row:bigint>")
