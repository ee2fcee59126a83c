"""Toxicity as an ordered severity, by cumulative-link regression on sparse text features.

Features are the distinct letter runs of a text, hashed.  One weight vector is shared by all thresholds:
P(grade > k) = sigmoid(w x - theta_k) with theta_0 < theta_1, and the severity is the expected grade, the sum of these.

The labels only say toxic or not, so the grades of the toxic training rows are made from their texts: a toxic row with more
runs that are typical of toxic rows than the median toxic row has grade 2, another grade 1.

A labelled sample holds far more runs than rows, and any rare run would do to tell the sample's rows apart.  So a run is
a feature only if its document frequencies in the two labels differ by more than ``SIGNIFICANT`` standard deviations of
what chance gives, and its weight is held by a ridge: what is learnt has to hold for texts outside the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import Scratch, lean, spread
from .learn import labelled_sample, letter_runs

PER_LABEL = 4000  # labelled rows of each label that the regression sees
BUCKETS = 1 << 18
SIGNIFICANT = 4.0  # standard deviations by which a run's frequency among toxic rows stands out from chance
FEATURES = 1024  # the regression sees so many of the runs that stand out most
RIDGE = 1.0  # precision of the weights' normal prior; the likelihood counts as so many rows as the sample has
FLAG = 0.5


def sparse_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each distinct letter run of each row, sorted."""
    row, runs = letter_runs(data, off)
    both = np.unique((row.astype(np.int64) << 18) | (runs & K.U64(BUCKETS - 1)).astype(np.int64))
    return both >> 18, both & (BUCKETS - 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class SeverityModel:
    weights: np.ndarray  # one for each bucket
    thresholds: np.ndarray  # increasing

    def severity(self, rows: int, row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and most likely side of each threshold."""
        z = np.bincount(row, self.weights[bucket], rows)
        above = _sigmoid(z[:, None] - self.thresholds[None, :])
        return above.sum(1), (above >= 0.5).sum(1)


def typical_runs(row: np.ndarray, bucket: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The buckets that stand out, strongest first: those whose number of toxic rows is ``SIGNIFICANT`` standard deviations
    off the number that as many rows drawn without regard to labels would have."""
    n, share = len(toxic), toxic.mean()
    seen = np.bincount(bucket, minlength=BUCKETS)
    bad = np.bincount(bucket, toxic[row], BUCKETS)
    spread = np.sqrt(np.maximum(seen * share * (1 - share) * (1 - seen / n), 1e-9))
    off = np.abs(bad - seen * share) / spread
    found = np.flatnonzero((off > SIGNIFICANT) & (seen >= 3))
    return found[np.argsort(-off[found], kind="stable")][:FEATURES]


def _newton_step(design: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], params: np.ndarray, levels: int) -> np.ndarray:
    """One step up the ridged log likelihood of the cumulative-link model, over (x, grade, weight) blocks of the sample.

    ``params`` are the weights and then the thresholds.  P(grade = k) = S(k - 1) - S(k), S(k) = sigmoid(w x - theta_k).
    """
    d = len(params) - levels
    gradient, curve = np.zeros(len(params)), np.zeros((len(params), len(params)))
    gradient[:d] -= RIDGE * params[:d]
    curve[np.arange(d), np.arange(d)] += RIDGE
    for x, grade, weight in design:
        z = x @ params[:d]
        s = np.concatenate([np.ones((len(z), 1)), _sigmoid(z[:, None] - params[None, d:]), np.zeros((len(z), 1))], axis=1)
        at = np.arange(len(z))
        up, low = s[at, grade], s[at, grade + 1]
        p = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up), low * (1 - low)
        fu, fl = du / p, -dl / p  # derivatives of log p by the two links' arguments
        fuu, fll, ful = du * (1 - 2 * up) / p - fu**2, -dl * (1 - 2 * low) / p - fl**2, du * dl / p**2
        # a link's argument is w x - theta: the upper one's threshold is grade - 1, the lower one's is grade
        wide = np.zeros((len(z), levels + 2))
        wide[at, grade] -= weight * fu
        wide[at, grade + 1] -= weight * fl
        gradient[:d] += x.T @ (weight * (fu + fl))
        gradient[d:] += wide.sum(0)[1 : levels + 1]
        curve[:d, :d] -= (x * (weight * (fuu + 2 * ful + fll))[:, None]).T @ x
        cross = np.zeros((len(z), levels + 2))
        cross[at, grade] += weight * (fuu + ful)
        cross[at, grade + 1] += weight * (fll + ful)
        mixed = x.T @ cross[:, 1 : levels + 1]
        curve[:d, d:] += mixed
        curve[d:, :d] += mixed.T
        own = np.zeros((levels + 2, levels + 2))
        np.add.at(own, (grade, grade), weight * fuu)
        np.add.at(own, (grade + 1, grade + 1), weight * fll)
        np.add.at(own, (grade, grade + 1), weight * ful)
        np.add.at(own, (grade + 1, grade), weight * ful)
        curve[d:, d:] -= own[1 : levels + 1, 1 : levels + 1]
    return np.linalg.solve(curve + 1e-9 * np.eye(len(params)), gradient)


def fit_severity(row: np.ndarray, bucket: np.ndarray, toxic: np.ndarray) -> SeverityModel | None:
    """From the sparse features of labelled rows.  None without both labels."""
    n = len(toxic)
    if toxic.all() or not toxic.any():
        return None
    use = typical_runs(row, bucket, toxic)
    column = np.full(BUCKETS, -1)
    column[use] = np.arange(len(use))
    ok = column[bucket] >= 0
    r, c = row[ok], column[bucket[ok]]
    toxic_rows, clean_rows = np.bincount(c, toxic[r], len(use)) / toxic.sum(), np.bincount(c, ~toxic[r], len(use)) / (~toxic).sum()
    amount = np.bincount(r, (toxic_rows > clean_rows)[c], n)
    grade = np.where(toxic, np.where(amount > np.median(amount[toxic]), 2, 1), 0)
    levels = int(grade.max())
    weight = np.where(toxic, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean()))  # both labels count alike

    def design() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        cut = np.searchsorted(r, np.arange(0, n + 1000, 1000))
        for k, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])):
            rows = slice(1000 * k, min(n, 1000 * (k + 1)))
            x = np.zeros((len(grade[rows]), len(use)))
            x[r[lo:hi] - 1000 * k, c[lo:hi]] = 1
            yield x, grade[rows], weight[rows]

    params = np.concatenate([np.zeros(len(use)), np.arange(levels) * 1.0])
    for _ in range(40):
        step = _newton_step(design(), params, levels)
        step *= min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        while levels > 1 and (np.diff((params + step)[len(use) :]) <= 0).any():
            step /= 2
        params = params + step
        if np.abs(step).max() < 1e-6:
            break
    weights = np.zeros(BUCKETS)
    weights[use] = params[: len(use)]
    return SeverityModel(weights, params[len(use) :])


def grade_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: id, severity (expected grade, 0 to 2), grade (0, 1, 2), toxic.

    Null, empty and letterless texts have no feature: severity 0, grade 0, not toxic.  A null id or label is not learnt
    from; with one label only, or none, nothing is toxic.  Repeated rows are graded alike; other columns are not read.
    An empty table gives no rows.  A very long text is read whole, in pieces of bounded size.  The labelled rows are among
    those that are graded, so their own grades are no measure of the model; the tests hold back half of the labels.
    """
    scratch = Scratch(spark, "toxicity")
    named = spread(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1))

    def represent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(0).to_pylist()
            for lo, hi, data, off in K.slices(batch.column(1)):
                row, bucket = sparse_features(data, off)
                cut = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.record_batch({"label": pa.array(labels[lo:hi], pa.int32()), "buckets": pa.ListArray.from_arrays(pa.array(cut), pa.array(bucket.astype(np.int32)))})

    sample = labelled_sample(scratch, named, known, PER_LABEL).orderBy("id", "label").select("label", "text").mapInArrow(lean(represent), "label int, buckets array<int>").toArrow()
    buckets = sample.column("buckets").combine_chunks() if len(sample) else None
    model = None
    if buckets is not None:
        if isinstance(buckets, pa.ChunkedArray):
            buckets = pa.concat_arrays(buckets.chunks)
        counts = np.diff(buckets.offsets.to_numpy())
        model = fit_severity(np.repeat(np.arange(len(counts)), counts), buckets.flatten().to_numpy().astype(np.int64), sample.column("label").to_numpy() == 1)
    shipped = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            severity, grade = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int32)
            if model is not None:
                for lo, hi, data, off in K.slices(batch.column(1)):
                    row, bucket = sparse_features(data, off)
                    has = np.unique(row)
                    found = model.severity(hi - lo, row, bucket)
                    severity[lo + has], grade[lo + has] = found[0][has], found[1][has]
            yield pa.record_batch({"id": batch.column(0), "severity": severity, "grade": grade, "toxic": pa.array(severity >= FLAG)})

    return named.mapInArrow(lean(score), f"id {named.dtypes[0][1]}, severity double, grade int, toxic boolean").withColumnRenamed("id", id_col)
