"""Operator 11: toxicity, a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the n-grams of 3 to 5 code points of its lower-cased
text, white space as one kind of blank, hashed to buckets; a feature is present
or not. Over the fitted rows, each bucket's log-count ratio tells how much more
of the toxic texts than of the others have it (both counts smoothed). The
buckets whose counts differ most from chance are kept, and a logistic regression
is fitted whose inputs are presence times ratio. A score is the logistic of the
intercept and the summed weights of the buckets present.

Fitting takes at most MAX_FIT_ROWS labelled rows (those with the smallest hash
of doc_id, so any machine takes the same). Counts of buckets are summed by Spark;
what comes to the driver are two counts a bucket, and for each fitted row the
numbers of those kept buckets that it has: at most MAX_FIT_ROWS x KEPT of two
bytes. Scoring reads every row and whole texts, long ones in pieces.

Rows: null text counts as empty, which has no n-grams and scores by the
intercept; every row gets a score, repeated rows each their own; without labels,
or with labels of one kind, the score is the share of label 1 (one half without
any); a null doc_id is not held out and never fitted; labels of a doc_id that
disagree count as toxic; of rows with one doc_id and different texts one is
fitted; an empty table gives an empty result; columns other than doc_id and text
are never inputs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_FIT_ROWS = 12_000
SIZES = (3, 4, 5)
#: Buckets of the hash, and how many the model keeps.
BUCKETS, KEPT = 1 << 18, 2048
#: Rows a bucket must be in to be kept; smoothing of counts; strength of the penalty; steps of the fit.
LEAST_ROWS, SMOOTHING, RIDGE, STEPS = 4, 1.0, 2.0, 300
#: Code points that are worked on at once.
PIECE = 1 << 20
_MULTIPLIER, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(64 - 18)
_BLANKS = str.maketrans({c: " " for c in "\t\n\v\f\r "})


def buckets_of(text: str, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of a text's n-grams in order; wanted: a flag for each bucket, to leave out the others."""
    points = np.frombuffer(text.lower().translate(_BLANKS).encode("utf-32-le"), np.uint32)
    found = []
    for start in range(0, max(1, len(points)), PIECE):
        # a piece starts with the code points that n-grams from the one before need
        part = points[max(0, start - SIZES[-1] + 1) : start + PIECE].astype(np.uint64)
        if len(part) < SIZES[0]:
            continue
        key = part[:-1] * _MULTIPLIER + part[1:]
        for n in range(SIZES[0], min(SIZES[-1], len(part)) + 1):
            key = key[: len(part) - n + 1] * _MULTIPLIER + part[n - 1 :]
            at = (((key ^ (key >> np.uint64(29))) + np.uint64(n)) * _MIX) >> _SHIFT
            found.append(np.unique(at if wanted is None else at[wanted[at]]))
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)


@dataclass
class Model:
    """intercept, and a weight for each bucket (zero for those that are not kept)."""

    intercept: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))

    def score(self, text: str) -> float:
        raw = self.intercept + float(self.weights[buckets_of(text, self.weights != 0)].sum())
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, raw))))


def ratios(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Log-count ratio of each bucket from the rows of either kind that have it."""
    return np.log((toxic + SMOOTHING) / (n_toxic + 2 * SMOOTHING)) - np.log((other + SMOOTHING) / (n_other + 2 * SMOOTHING))


def kept_buckets(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int, most: int = KEPT) -> np.ndarray:
    """The buckets of most evidence (chi-squared of presence against label), in order; ties go to the lower number."""
    rows, n = toxic + other, n_toxic + n_other
    spread = rows * (n - rows) * (n_toxic * n_other / n)
    chi = np.where(spread > 0, n * (toxic * n_other - other * n_toxic) ** 2 / np.maximum(spread, 1) / n, 0.0)
    chi[rows < LEAST_ROWS] = 0
    best = np.lexsort((np.arange(len(chi)), -chi))[:most]
    return np.sort(best[chi[best] > 0])


def logistic(row: np.ndarray, column: np.ndarray, scale: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression with a penalty, by accelerated gradients.

    row, column: where the inputs are; an input's value is its column's scale.
    """
    n, k = len(y), len(scale)
    value = scale[column]
    # the steps' length: from the greatest sum of squares that a row has (the intercept's input is 1)
    length = 1 + float(np.bincount(row, value**2, n).max(initial=0.0))
    rate = 1 / (0.25 * length * n + RIDGE)
    share = y.mean()
    w, b = np.zeros(k), math.log(share / (1 - share))
    ahead_w, ahead_b, t = w, b, 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(ahead_b + np.bincount(row, value * ahead_w[column], n), -30, 30)))
        off = p - y
        new_w = ahead_w - rate * (np.bincount(column, value * off[row], k) + RIDGE * ahead_w)
        new_b = ahead_b - rate * float(off.sum())
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead_w, ahead_b = new_w + (t - 1) / after * (new_w - w), new_b + (t - 1) / after * (new_b - b)
        w, b, t = new_w, new_b, after
    return b, w


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_of(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """doc_id, toxic, text of up to `limit` labelled doc_ids that are not held out, written."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # at most `limit` rows of two numbers, so they may go to every task
    wanted = common.written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit), "toxic-labels")
    given = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    return common.written(given.groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), "toxic-sample")


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_FIT_ROWS) -> Model:
    sample = sample_of(docs, labels, limit)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        rows = [0, 0]
        for batch in batches:
            for label, text in zip(batch.column("toxic").to_pylist(), common.texts_of(batch)):
                sums[label, buckets_of(text)] += 1
                rows[label] += 1
        at = np.flatnonzero(sums.any(axis=0))
        # bucket -1 has the number of rows
        columns = [np.append(at, -1)] + [np.append(sums[i, at], rows[i]) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "other", "toxic"])

    counted = sample.select("toxic", "text").mapInArrow(count, "bucket bigint, other bigint, toxic bigint")
    sums = counted.groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toArrow()
    bucket = sums["bucket"].to_numpy()
    rows = {k: int(sums[k].to_numpy()[bucket == -1].sum()) for k in ("other", "toxic")}
    if not rows["other"] or not rows["toxic"]:
        share = rows["toxic"] / max(1, sum(rows.values())) if sum(rows.values()) else 0.5
        return Model(math.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    other, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    other[bucket[bucket >= 0]], toxic[bucket[bucket >= 0]] = (sums[k].to_numpy()[bucket >= 0] for k in ("other", "toxic"))
    kept = kept_buckets(toxic, other, rows["toxic"], rows["other"])
    scale = ratios(toxic, other, rows["toxic"], rows["other"])[kept]
    wanted = np.zeros(BUCKETS, bool)
    wanted[kept] = True

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.searchsorted(kept, buckets_of(t, wanted)).astype(np.int16) for t in common.texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.int16()))], ["doc_id", "toxic", "columns"])

    fitted = sample.mapInArrow(present, "doc_id bigint, toxic int, columns array<smallint>").toArrow().sort_by("doc_id").combine_chunks()
    lists = fitted["columns"].combine_chunks()
    column = lists.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    intercept, w = logistic(row, column, scale, fitted["toxic"].to_numpy().astype(float))
    model = Model(intercept)
    model.weights[kept] = scale * w
    return model


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([model.score(t) for t in common.texts_of(batch)], pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scores = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return classify(docs, train(docs, common.table(spark, sf_dir, "labels")))
