import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_rows import prose  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, source, kept): nulls, empty and long texts, copies, near copies, repeated rows, ties."""
    base, twin = prose(1, 120), prose(2, 90)
    near = base.split(" ")
    near[50] = "changed"
    out = [(0, base), (1, base), (2, " ".join(near)), (3, twin), (4, twin + " more"), (5, None), (6, ""), (7, " \n\t "), (8, "two words"),
           (9, "two words"), (10, "TWO  Words"), (11, prose(3, 20000)), (12, "a | b | c | d\n" * 40), (13, "same line here.\nsame line here.\n" * 20),
           (14, "x" * 5000), (15, prose(4, 60)), (15, prose(4, 60)), (None, prose(5, 70)), (None, None),
           (18, "\x00nul \u00a0nbsp \u2028 sep\x1cfs\r\nend  three   spaces \n\n\n x"), (19, prose(6, 55) + " { } $$ ## << >>"),
           (20, "<|endoftext|> \n <|endoftext|>"), (21, prose(7, 80)), (22, prose(7, 80).upper())]
    return [(i, t, f"s{k % 3}" if k % 7 else None, k) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    # "kept", "row" and "h" clash with names that operators use themselves
    return spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, source string, kept long, h string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
