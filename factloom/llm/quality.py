"""Document quality by Bradley-Terry ranking of pairs.

Each document has a utility, linear in features of its whole text; of two documents the better one is preferred with
probability sigmoid(difference of utilities).  Every labelled good document is preferred to every labelled bad one, and the
weights minimise the logistic loss of all those pairs.  The quantile of all those documents' utilities, at the share of bad
ones among them, becomes the threshold; the score is the calibrated sigmoid that is ``THRESHOLD`` exactly there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import Scratch, lean, maybe_broadcast, spread
from .learn import letter_runs, remainder

BINS = 2048  # of the utilities, in which pairs are counted
COARSE = 64  # of these, for the part of the curvature that mixes the labels
JOINED = 4  # tasks that add up what the others found
RIDGE = 1e-3
THRESHOLD = 0.3
_HASHED = 64

_KINDS = np.full(256, 37, np.int64)  # a symbol class for each byte
for _b in range(256):
    if 65 <= _b <= 90:
        _KINDS[_b] = 0
    elif 97 <= _b <= 122:
        _KINDS[_b] = 1
    elif 48 <= _b <= 57:
        _KINDS[_b] = 2
    elif _b == 32:
        _KINDS[_b] = 3
    elif _b in (9, 10, 11, 12, 13):
        _KINDS[_b] = 4
    elif 33 <= _b < 127:
        _KINDS[_b] = 5 + (_b - 33) % 32
WIDTH = 38 + 9 + _HASHED


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows x WIDTH: shares of symbol classes, lengths and repetition of words and lines, hashed letter-run shares."""
    rows = len(off) - 1
    out = np.zeros((rows, WIDTH))
    length = np.diff(off)
    if len(data):
        row = np.repeat(np.arange(rows), length)
        out[:, :38] = np.bincount(row * 38 + _KINDS[data], minlength=rows * 38).reshape(rows, 38) / np.maximum(length, 1)[:, None]
    starts, ends, first = K.word_bounds(data, off)
    words = K.word_hashes(data, starts, ends, fold=True)
    n = np.diff(first)
    row = np.repeat(np.arange(rows), n)
    size = (ends - starts).astype(float)
    some = np.maximum(n, 1)
    mean = np.bincount(row, size, rows) / some
    extra = out[:, 38:47]
    extra[:, 0] = np.log1p(length)
    extra[:, 1] = np.log1p(n)
    extra[:, 2] = np.minimum(mean, 50) / 10
    extra[:, 3] = np.minimum(np.sqrt(np.maximum(np.bincount(row, size**2, rows) / some - mean**2, 0)), 50) / 10
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    extra[:, 4] = np.bincount(row, same, rows) / some
    # repeated words and lines: a key of row and hash, sorted once
    key = K.mix(words ^ K.mix(row.astype(K.U64) + K.U64(1)))
    _, at = np.unique(key, return_index=True)
    extra[:, 5] = np.bincount(row[at], minlength=rows) / some
    extra[:, 6] = np.bincount(row[at], minlength=rows) / np.sqrt(some) / 10
    newline = data == 10
    edge = newline.copy() if len(data) else newline
    cut = off[1:] - 1
    edge[cut[length > 0]] = True
    line_end = np.flatnonzero(edge) + 1
    line_start = np.concatenate([[0], line_end[:-1]]).astype(np.int64) if len(line_end) else line_end
    line_row = np.searchsorted(off, line_start, "right") - 1
    lines = np.maximum(np.bincount(line_row, minlength=rows), 1) if len(line_end) else np.ones(rows)
    if len(line_end):
        key = K.mix(K.word_hashes(data, line_start, line_end, fold=False) ^ K.mix(line_row.astype(K.U64) + K.U64(1)))
        _, at = np.unique(key, return_index=True)
        extra[:, 7] = np.bincount(line_row[at], minlength=rows) / lines
    extra[:, 8] = np.log1p(n / lines)
    owner, runs = letter_runs(data, off)
    if len(runs):
        share = np.bincount(owner * _HASHED + (runs % K.U64(_HASHED)).astype(np.int64), minlength=rows * _HASHED).reshape(rows, _HASHED)
        out[:, 47:] = share / np.maximum(share.sum(1, keepdims=True), 1)
    return out


@dataclass
class QualityModel:
    weights: np.ndarray
    threshold: float
    scale: float

    def utility(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.utility(x) - self.threshold) / self.scale + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _utilities(x: np.ndarray, mean: np.ndarray, spread: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z = np.where(spread > 1e-9, (x - mean) / np.where(spread > 1e-9, spread, 1), 0)
    return z, z @ w


def _bin(u: np.ndarray, scale: float) -> np.ndarray:
    """The utilities' bins: all numbers have one, narrow ones are near 0."""
    return np.minimum(((1 + u / (scale + np.abs(u))) * (BINS / 2)).astype(np.int64), BINS - 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_all(total: Callable[..., np.ndarray]) -> QualityModel | None:
    """The maximum over the pairs of every good row with every bad one.  None without both labels.

    ``total(fn)`` is the sum of ``fn(features, good)`` over all pieces of the rows (or another reduction of it).  What a row adds depends on
    the other label's utilities only, whose bins are counted in a pass of their own; a bin's rows count at its mean.
    """
    first = total(lambda x, good: np.concatenate([[(~good).sum(), good.sum()], x.sum(0)]))
    n = first[:2]
    if not n.all():
        return None
    mean, width = first[2:] / n.sum(), len(first) - 2
    spread = np.sqrt(total(lambda x, good: ((x - mean) ** 2).sum(0)) / n.sum())

    def moments(x: np.ndarray, good: np.ndarray) -> np.ndarray:
        z, _ = _utilities(x, mean, spread, np.zeros(width))
        return np.concatenate([part for k in (~good, good) for part in (z[k].sum(0), (z[k].T @ z[k]).ravel())])

    m = total(moments).reshape(2, -1)
    centre = m[:, :width] / n[:, None]
    square = m[:, width:].reshape(2, width, width) / n[:, None, None]
    both = (square * n[:, None, None]).sum(0) / n.sum()
    cross = np.outer(centre[1], centre[0])
    # at zero weights all pairs are even, so that the first step follows from the moments
    w = np.linalg.solve((square.sum(0) - cross - cross.T) / 4 + RIDGE * np.eye(width), (centre[1] - centre[0]) / 2)
    for _ in range(30):  # Newton steps on the pairwise logistic loss
        scale = max(float(np.sqrt(w @ both @ w)), 1e-9)

        def counted(x: np.ndarray, good: np.ndarray) -> np.ndarray:
            _, u = _utilities(x, mean, spread, w)
            at = _bin(u, scale) + BINS * good
            return np.concatenate([np.bincount(at, minlength=2 * BINS), np.bincount(at, u, 2 * BINS)])

        count, sums = total(counted).reshape(2, 2, BINS)
        grid = np.sort(np.unique((sums / np.maximum(count, 1))[count > 0]))
        pull, bend = [], []  # for a bad row and for a good one, by its utility: what all rows of the other label give
        for other, sign in ((1, -1), (0, 1)):
            have = count[other] > 0
            p = _sigmoid(sign * (sums[other][have] / count[other][have] - grid[:, None]))
            pull.append(p @ count[other][have] / n[other])
            bend.append((p * (1 - p)) @ count[other][have] / n[other])

        def slopes(x: np.ndarray, good: np.ndarray) -> np.ndarray:
            z, u = _utilities(x, mean, spread, w)
            coarse = _bin(u, scale) // (BINS // COARSE)
            out = []
            for label, k in enumerate((~good, good)):
                g, h = np.interp(u[k], grid, pull[label]), np.interp(u[k], grid, bend[label])
                inside = np.zeros((COARSE, width))
                np.add.at(inside, coarse[k], z[k])
                out += [g @ z[k], ((z[k] * h[:, None]).T @ z[k]).ravel(), inside.ravel(), np.bincount(coarse[k], u[k], COARSE), np.bincount(coarse[k], minlength=COARSE)]
            return np.concatenate(out)

        gradient, outer, inside, level = [], [], [], []
        for label, part in enumerate(total(slopes).reshape(2, -1)):
            g, h, z, u, c = np.split(part, np.cumsum([width, width * width, COARSE * width, COARSE]))
            gradient.append(g / n[label])
            outer.append(h.reshape(width, width) / n[label])
            inside.append(z.reshape(COARSE, width) / n[label])
            level.append(u / np.maximum(c, 1))
        p = _sigmoid(level[1][:, None] - level[0])
        cross = inside[1].T @ (p * (1 - p)) @ inside[0]  # in coarse bins: it turns the step, not where the steps end
        step = np.linalg.solve(outer[0] + outer[1] - cross - cross.T + RIDGE * np.eye(width), gradient[1] - gradient[0] - RIDGE * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    threshold = _quantile(total, lambda x: _utilities(x, mean, spread, w)[1], int(n[0]))
    scale = np.sqrt(max(w @ both @ w, 0)) / 4
    raw = np.where(spread > 1e-9, w / np.where(spread > 1e-9, spread, 1), 0)
    return QualityModel(raw, float(threshold + mean @ raw), max(float(scale), 1e-9))


def _quantile(total: Callable[..., np.ndarray], utility: Callable[[np.ndarray], np.ndarray], below: int) -> float:
    """A number that ``below`` of all rows' utilities are under, or as many as ties allow: bins in bins until an edge is one."""
    low, high = total(lambda x, good: np.array([utility(x).min(), -utility(x).max()]), np.minimum) * [1, -1]
    high += max(abs(high), 1) * 1e-9
    while True:
        edges = np.linspace(low, high, BINS + 1)
        under = total(lambda x, good: np.searchsorted(np.sort(utility(x)), edges).astype(float))
        k = int(np.searchsorted(under, below))
        if k == 0 or under[k] == below or high - low < 1e-12 * max(abs(high), 1):
            return float(edges[k])
        low, high = edges[k - 1], edges[k]


def fit_ranking(x: np.ndarray, good: np.ndarray, population: tuple[int, int]) -> QualityModel | None:
    """``fit_all`` of rows in memory, which are the whole ``population`` (bad, good)."""
    if population != (int((~good).sum()), int(good.sum())):
        raise ValueError("the rows are a part of the population")
    return fit_all(lambda fn, reduce=np.add: np.asarray(fn(x, good), float))


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score (0 to 1, higher is better), predicted (1 from 0.3 on).

    Learns from labels of rows whose crc32(id as text) mod 5 is not 0; a null id or label is not learnt from, and a null id
    is not held out.  Null and empty texts are scored, as texts without symbols.  With one label only, or none, all
    scores are 0.5.  Repeated rows are scored alike; other columns are not read.
    """
    scratch = Scratch(spark, "quality")
    named = spread(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where((remainder(F.col("id"), 5) != 0) & F.col("label").isin(0, 1))
    known = scratch.save(known)

    def represent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = batch.column(0).to_numpy() == 1
            for lo, hi, data, off in K.slices(batch.column(1), 400_000):
                yield pa.record_batch({"good": pa.array([good[lo:hi].tobytes()], pa.binary()), "x": pa.array([features(data, off).tobytes()], pa.binary())})

    # one text of an id, the first in order
    texts = named.join(maybe_broadcast(known.select("id").distinct(), 24), "id", "left_semi").where("text is not null").groupBy("id").agg(F.min("text").alias("text"))
    learnt = scratch.save(texts.join(maybe_broadcast(known, 24), "id").select("label", "text").mapInArrow(lean(represent), "good binary, x binary"))

    def total(fn: Callable[[np.ndarray, np.ndarray], np.ndarray], reduce: np.ufunc = np.add) -> np.ndarray:
        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                for good, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    part = np.asarray(fn(np.frombuffer(x).reshape(-1, WIDTH), np.frombuffer(good, bool)), float)
                    out = part if out is None else reduce(out, part)
            if out is not None:
                yield pa.record_batch({"part": pa.array([out.tobytes()], pa.binary())})

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    out = np.frombuffer(part) if out is None else reduce(out, np.frombuffer(part))
            if out is not None:
                yield pa.record_batch({"part": pa.array([out.tobytes()], pa.binary())})

        few = learnt.mapInArrow(lean(pieces), "part binary").repartition(JOINED).mapInArrow(lean(joined), "part binary")
        return reduce.reduce([np.frombuffer(r["part"]) for r in few.collect()])

    model = None if learnt.isEmpty() else fit_all(total)
    shipped = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            if model is not None:
                for lo, hi, data, off in K.slices(batch.column(2), 1_000_000):
                    out[lo:hi] = model.score(features(data, off))
            yield pa.record_batch({"id": batch.column(0), "held_out": batch.column(1), "score": out, "predicted": (out >= THRESHOLD).astype(np.int32)})

    held = F.coalesce(remainder(F.col("id"), 5) == 0, F.lit(False)).alias("held_out")
    return named.select("id", held, "text").mapInArrow(lean(score), f"id {named.dtypes[0][1]}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
