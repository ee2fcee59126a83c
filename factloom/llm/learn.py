"""What the trained operators share: bounded samples of labelled rows, folds, and a letter-run tokeniser."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .common import Scratch, maybe_broadcast


def remainder(id_col: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % by


def labelled_sample(scratch: Scratch, docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(id, label, text): of each label at most ``per_class`` ids, those of the lowest hashes, with whole texts.

    ``docs`` has id and text, ``labels`` id and label.  The limit is applied before the shuffle as well as after it, so
    a frequent label costs no more than a rare one.  Of an id that has several texts the first in order is taken.
    """
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    chosen = labels.where("id is not null and label is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_class)
    chosen = scratch.save(chosen.select("id", "label"))
    texts = docs.join(maybe_broadcast(chosen.select("id").distinct(), 24), "id", "left_semi").where("text is not null").groupBy("id").agg(F.min("text").alias("text"))
    return texts.join(maybe_broadcast(chosen, 48), "id")


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


def letter_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of letters, A-Z lower-cased; all bytes of non-ASCII characters count as letters."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, K.U64)
    solid = _LETTER[data]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    start[edges] = solid[edges]
    end[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return np.searchsorted(off, starts, "right") - 1, K.word_hashes(data, starts, ends, fold=True)
