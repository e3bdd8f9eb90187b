"""Operator 9: quality classifier, a generalised additive model with pairwise interactions.

Features are counts of one text, cut in quantile bins. Boosting goes round the
features in turn; each step fits a shallow tree on the feature's bins and adds
it, shrunk, to the feature's lookup table, so the model is an intercept and a
table for each feature. Then the pairs of features whose residuals show most
interaction get tables of their own by two-way trees. A score is the logistic
of the intercept and one table entry a feature and pair: vectorised additions.

Fitting takes at most MAX_FIT_ROWS labelled rows (those with the smallest hash
of doc_id, so any machine takes the same), whose features alone come to the
driver; scoring reads every row.

Rows: null text counts as empty; every row gets a score, repeated rows each
their own; without labels, or with labels of one kind, the score is the share
of label 1 (one half without any); a null doc_id is not held out and never
fitted; of rows with one doc_id and different texts one is fitted; an empty table gives an empty result; columns other than doc_id and
text are never inputs.
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
from .text_stats import CLASSES, Stats

MAX_FIT_ROWS = 12_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 6
RATE, RIDGE, LEAF_ROWS = 0.1, 1.0, 8
FEATURES = (
    "log_words", "word_length", "unique_share", "repeat_share", "common_share", "top_share", "lower", "upper", "digit", "stop", "mark", "symbol",
    "control", "latin", "other", "log_line", "dup_line_share", "longest_word",
)


def features(text: str) -> list[float]:
    s = Stats(text)
    n, chars, part = max(1, s.n_words), max(1, s.n_chars), dict(zip(CLASSES, s.classes.tolist()))
    return [
        math.log1p(s.n_words), s.word_chars / n, s.n_unique / n, s.n_repeat_words / n, int(s.common.sum()) / n, s.most / n,
        *(part[c] / chars for c in ("lower", "upper", "digit", "stop", "mark", "symbol", "control", "latin", "other")),
        math.log1p(s.longest_line), s.n_dup_lines / max(1, s.n_lines), math.log1p(s.longest_word),
    ]


@dataclass
class Model:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.intercept)
        for i, t in enumerate(self.tables):
            out += t[bins[:, i]]
        for i, j, t in self.pairs:
            out += t[self.coarse[i][bins[:, i]], self.coarse[j][bins[:, j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.bins(x)), -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """A value for each bin: a tree over ordered bins with sums of gradients g, curvatures h and rows n."""
    left = [np.cumsum(x)[:-1] for x in (g, h, n)]
    right = [x.sum() - c for x, c in zip((g, h, n), left)]
    gain = np.where((left[2] >= LEAF_ROWS) & (right[2] >= LEAF_ROWS), _gain(left[0], left[1]) + _gain(right[0], right[1]), -1)
    if depth and len(gain) and gain.max() > _gain(g.sum(), h.sum()) + 1e-9:
        at = int(gain.argmax()) + 1
        return np.concatenate([_tree(g[:at], h[:at], n[:at], depth - 1), _tree(g[at:], h[at:], n[at:], depth - 1)])
    return np.full(len(g), -g.sum() / (h.sum() + RIDGE))


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values on a grid from the best cut of either side (four leaves), and what it gains."""
    cut = lambda x: np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))[1:-1, 1:-1]
    if min(g.shape) < 2:
        return np.zeros(g.shape), 0.0
    parts = []
    for x in (g, h):
        a, rows, columns, every = cut(x), x.sum(1).cumsum()[:-1, None], x.sum(0).cumsum()[None, :-1], x.sum()
        parts.append((a, rows - a, columns - a, every - rows - columns + a))
    gain = sum(_gain(a, b) for a, b in zip(*parts)) - _gain(g.sum(), h.sum())
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty(g.shape)
    value = [-p[i, j] / (q[i, j] + RIDGE) for p, q in zip(*parts)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        return Model(math.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    model = Model(math.log(share / (1 - share)))
    for i in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1]))
        model.edges.append(cuts)
        model.tables.append(np.zeros(len(cuts) + 1))
        model.coarse.append(np.arange(len(cuts) + 1) * PAIR_BINS // (len(cuts) + 1))
    bins, f = model.bins(x), np.full(len(y), model.intercept)
    sizes = [np.bincount(bins[:, i], minlength=len(t)) for i, t in enumerate(model.tables)]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for i, t in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[:, i], g, len(t)), np.bincount(bins[:, i], h, len(t)), sizes[i])
            t += step
            f += step[bins[:, i]]
    grid = np.stack([c[bins[:, i]] for i, c in enumerate(model.coarse)], axis=1)

    def sums(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(grid[:, i] * PAIR_BINS + grid[:, j], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)

    g, h = slopes()
    found = sorted(((_cross(sums(i, j, g), sums(i, j, h))[1], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for gain, i, j in found[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            g, h = slopes()
            step = RATE * _cross(sums(i, j, g), sums(i, j, h))[0]
            t += step
            f += step[grid[:, i], grid[:, j]]
    return model


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_FIT_ROWS) -> Model:
    """Fits on up to `limit` labelled rows that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([features(t) for t in common.texts_of(batch)], pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    # the sample has at most `limit` rows of two numbers, so it may go to every task
    sample = common.written(sample, "labels")
    given = docs.select("doc_id", "text")
    # of rows with one doc_id, the text with the least hash, so that no more rows than labels come to the driver
    one = given.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("text_key"))
    wanted = sample.join(common.written(one, "labelled"), "doc_id")
    found = given.withColumn("text_key", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "text_key"]).select("doc_id", "quality", "text")
    rows = found.mapInArrow(run, "doc_id bigint, quality int, x array<double>").groupBy("doc_id", "quality").agg(F.first("x").alias("x")).toArrow()
    order = sorted(range(rows.num_rows), key=lambda i: (rows["doc_id"][i].as_py(), rows["quality"][i].as_py(), rows["x"][i].as_py()))
    x = np.array([rows["x"][i].as_py() for i in order], float).reshape(len(order), len(FEATURES))
    return fit(x, np.array([rows["quality"][i].as_py() for i in order], float))


def scored(docs: DataFrame, model: Model, keep: list[str], name: str) -> DataFrame:
    """The columns in keep, and the score under this name."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    names = list(dict.fromkeys([*keep, "text"]))
    place = [names.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in common.texts_of(batch)], float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in place), pa.array(model.score(x))], [*keep, name])

    given = docs.select(*[F.col(f"`{c}`") for c in names])
    shape = StructType([*(given.schema[c] for c in keep), StructField(name, DoubleType())])
    return given.mapInArrow(run, shape)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return scored(docs, model, ["doc_id"], "score").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is at least `least`, with all their columns."""
    (name,) = common.free_names(docs.columns, "score")
    return scored(docs, model, docs.columns, name).where(F.col(name) >= least).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return classify(docs, train(docs, common.table(spark, sf_dir, "labels")))
