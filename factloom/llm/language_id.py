"""Language identification by string kernels.

The kernel of two texts is the number of byte n-grams (n = 1 to 3, blended) present in both, over the root of the
product of their own numbers of n-grams.  Landmark texts of every language give a Nystroem feature map; kernel ridge
regression, one language against the rest, is solved in it from sums that the tasks accumulate.  A text is scored by products
of batches of presence vectors with the landmarks' presence matrix and the solved coefficients.  Only n-grams that a
landmark has can be in both, so those are the columns, all of them; a text's own number counts every n-gram of it.

A-Z count as a-z and whatever else of ASCII as one symbol; every other byte of UTF-8 is a symbol of its own.  The model learns from a
bounded, documented sample; it scores whole texts, very long ones piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .common import Scratch, lean, spread
from .learn import labelled_sample, remainder

PER_LANGUAGE = 600  # labelled texts of each language that the regression sees
LANDMARKS = 24  # landmark texts of each language, fewer if all would be more than ...
MOST_LANDMARKS = 1024  # ... so many, but one at least
RIDGE = 1e-3
UNKNOWN = "und"

_BASE = 27 + 64 + 51  # letters and the rest of ASCII, continuation bytes, leading bytes
_CODES = _BASE + _BASE**2 + _BASE**3
_SYMBOL = np.zeros(256, np.int32)
for _b in range(256):
    _SYMBOL[_b] = _b - 64 if 65 <= _b <= 90 else _b - 96 if 97 <= _b <= 122 else 0 if _b < 128 else _b - 101 if _b < 192 else 91 + min(max(_b - 194, 0), 50)
_PIECE = 1 << 20  # bytes of a text that are looked at at once


class Grams:
    """The n-grams of texts, one after another.  A table holds the number of the place where each code was last seen."""

    def __init__(self):
        self.seen = np.zeros(_CODES, np.int32)
        self.at = 1

    def _codes(self, data: np.ndarray) -> np.ndarray:
        one = _SYMBOL[data]
        two = one[:-1] * _BASE + one[1:]
        three = two[:-1] * _BASE + one[2:]
        return np.concatenate([one, two + _BASE, three + (_BASE + _BASE**2)])

    def read(self, data: np.ndarray) -> tuple[int, int]:
        """The number of distinct n-grams of one text; those have numbers from the second result on in ``seen``."""
        if self.at + 4 * len(data) + 16 > 2**31:
            self.seen[:], self.at = 0, 1
        begin, count = self.at, 0
        for lo in range(0, max(len(data), 1), _PIECE):
            codes = self._codes(data[lo : lo + _PIECE + 2])
            known = self.seen[codes] >= begin if lo else False
            places = np.arange(self.at, self.at + len(codes), dtype=np.int32)
            self.seen[codes] = places
            count += int(np.count_nonzero((self.seen[codes] == places) & ~np.asarray(known)))
            self.at += len(codes)
        return count, begin


def _presence(grams: Grams, data: np.ndarray, off: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Rows x columns: 1 over the root of the row's number of n-grams where it has the column's code."""
    hit = np.zeros((len(off) - 1, len(columns)), np.float32)
    for i, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        if hi > lo:
            count, begin = grams.read(data[lo:hi])
            hit[i] = (grams.seen[columns] >= begin) / np.float32(np.sqrt(count))
    return hit


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of at most 256 rows, so that presence matrices stay small however short texts are."""
    for lo in range(0, len(column), 256):
        for row, end, data, off in K.slices(column.slice(lo, 256), 1_000_000):
            yield lo + row, lo + end, data, off


@dataclass
class LanguageModel:
    languages: list[str]
    columns: np.ndarray  # the landmarks' n-grams
    weights: np.ndarray  # n-grams x languages: the landmarks' presences times the solved coefficients

    def scores(self, grams: Grams, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return _presence(grams, data, off, self.columns) @ self.weights


def landmark_kernel(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The landmarks' n-grams, their kernel matrix, and each one's own n-grams (as indexes of columns)."""
    grams, own = Grams(), []
    for t in texts:
        _, begin = grams.read(np.frombuffer(t.encode(), np.uint8))
        own.append(np.flatnonzero(grams.seen >= begin))
    columns = np.unique(np.concatenate(own))
    own = [np.searchsorted(columns, x) for x in own]
    kernel = np.zeros((len(texts), len(texts)))
    size = np.sqrt([max(len(x), 1) for x in own])
    for lo in range(0, len(columns), 16_384):
        hit = np.zeros((len(texts), min(16_384, len(columns) - lo)), np.float32)
        for i, x in enumerate(own):
            hit[i, x[(x >= lo) & (x < lo + 16_384)] - lo] = 1
        kernel += hit @ hit.T
    return columns, kernel / size[:, None] / size[None, :], own


def fit_languages(spark: SparkSession, scratch: Scratch, docs: DataFrame) -> LanguageModel | None:
    """From ``docs`` (id, text, lang), rows that may be learnt from.  None if there is no labelled text."""
    sample = scratch.save(labelled_sample(scratch, docs.select("id", "text"), docs.select("id", F.col("lang").alias("label")), PER_LANGUAGE))
    languages = sorted(r[0] for r in sample.select("label").distinct().collect())
    if not languages:
        return None
    each = max(1, min(LANDMARKS, MOST_LANDMARKS // len(languages)))
    order = Window.partitionBy("label").orderBy(F.xxhash64("id", F.lit(7)), "id")
    marks = sample.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).select("label", "n", "text").collect()
    columns, kernel, own = landmark_kernel([r["text"] for r in sorted(marks, key=lambda r: (r["label"], r["n"]))])
    values, vectors = np.linalg.eigh(kernel)
    keep = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    project = np.zeros((len(columns), root.shape[1]))  # n-grams x features: presence @ project is the Nystroem map
    for x, r in zip(own, root):
        project[x] += r / np.sqrt(max(len(x), 1))
    project = project.astype(np.float32)
    width, index = project.shape[1], {x: i for i, x in enumerate(languages)}
    shipped = spark.sparkContext.broadcast((columns, project))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, cross, n = np.zeros((width, width)), np.zeros((width, len(index))), 0
        columns, project = shipped.value
        grams = Grams()
        for batch in batches:
            labels = np.array([index[x] for x in batch.column(1).to_pylist()], np.int64)
            for lo, hi, data, off in _pieces(batch.column(2)):
                feature = (_presence(grams, data, off, columns) @ project).astype(np.float64)
                target = np.full((hi - lo, len(index)), -1.0)
                target[np.arange(hi - lo), labels[lo:hi]] = 1
                gram += feature.T @ feature
                cross += feature.T @ target
                n += hi - lo
        if n:
            yield pa.record_batch({"gram": [gram.tobytes()], "cross": [cross.tobytes()], "n": [n]})

    gram, cross, n = np.zeros((width, width)), np.zeros((width, len(languages))), 0
    for r in sample.select("id", "label", "text").mapInArrow(lean(sums), "gram binary, cross binary, n long").toLocalIterator():
        gram += np.frombuffer(r["gram"]).reshape(gram.shape)
        cross += np.frombuffer(r["cross"]).reshape(cross.shape)
        n += r["n"]
    shipped.destroy()
    solved = np.linalg.solve(gram / n + RIDGE * np.eye(width), cross / n)
    return LanguageModel(languages, columns, (project @ solved).astype(np.float32))


def identify_languages(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score (0 to 1).

    Learns from text and non-null language of the rows whose crc32(id as text) mod 3 is not 1; a null id is in no fold
    (not learnt from, not held out).  A null text, and one without a letter, is ``und`` with score 0; so is every text if
    there is nothing to learn from.  Rows that repeat are scored alike.  Other columns are not read.  An empty table gives no rows.
    """
    scratch = Scratch(spark, "language")
    named = spread(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    named = named.withColumn("letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    model = fit_languages(spark, scratch, named.where((remainder(F.col("id"), 3) != 1) & F.col("letter") & F.col("lang").isNotNull()).drop("letter"))
    shipped = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, grams = shipped.value, Grams()
        for batch in batches:
            letter = batch.column(3).to_numpy(zero_copy_only=False)
            best, sure = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            if model is not None:
                for lo, hi, data, off in _pieces(batch.column(2)):
                    found = model.scores(grams, data, off)
                    best[lo:hi] = found.argmax(1)
                    sure[lo:hi] = np.clip((found.max(1) + 1) / 2, 0, 1)
                best[~letter], sure[~letter] = -1, 0
            names = pa.array([*(model.languages if model else []), UNKNOWN], pa.string())
            yield pa.record_batch({"id": batch.column(0), "held_out": batch.column(1), "lang_pred": names.take(pa.array(np.where(best < 0, len(names) - 1, best))), "score": sure})

    held = F.coalesce(remainder(F.col("id"), 3) == 1, F.lit(False)).alias("held_out")
    out = named.select("id", held, "text", "letter").mapInArrow(lean(score), f"id {named.dtypes[0][1]}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
