"""Fixed-size bitmaps of keys: a test that never misses a key, to thin rows before they are shuffled.

A bitmap has 2**bits bits whatever the table's size; a fuller one passes on more rows, and the exact join that
follows takes them out again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmap(df: DataFrame, key: str, bits: int) -> np.ndarray:
    """Bytes with a bit set for each key (a long column). At most 2**bits / 64 rows come to the driver."""
    slot = F.pmod(F.col(key), F.lit(1 << bits))
    words = (df.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, int(pmod({key}, 64)))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out.view(np.uint8)


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For unsigned 64-bit keys: is the bit set?"""
    slot = keys & np.uint64(len(bits) * 8 - 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


BROADCAST_ROWS = 1 << 21


def small(ids: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow table, to be broadcast if it is counted and found within bounds; else the planner decides."""
    return F.broadcast(ids) if ids.limit(rows + 1).count() <= rows else ids


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id is not among the ids; a null id only goes if null is among them. Whole rows are not shuffled where
    the ids are few."""
    gone = small(ids.select(F.col(ids.columns[0]).alias("__gone")))
    return docs.join(gone, docs[id_col].eqNullSafe(F.col("__gone")), "left_anti")
