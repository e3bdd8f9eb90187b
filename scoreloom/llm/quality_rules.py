"""Operator 3: quality rules with distribution divergence.

The base rules are counts of one text. The method compares its histograms of
character classes and of frequent words with references by Jensen-Shannon
distance. References are sums over documents that are known to be good (the
query takes those that labels call so), one for each of LANGUAGES; a language
without such a document has the table's rows that pass the base rules instead
(rows of any other language are not in a reference but are judged). A text is
judged by the nearest reference, so a wrong or missing language does it no harm,
and only if it is long enough for the histogram to mean something.

Rows: null text counts as empty and fails the base rules; a null doc_id is known
to be good by no label; repeated rows are
judged each on their own; an empty table, or one without a reference, gives
base verdicts only; columns other than doc_id, text and lang are not read, and
a table without lang has one reference.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .text_stats import CLASSES, COMMON, WORDS, Stats

LANGUAGES = tuple(COMMON)
MIN_WORDS = 10
MAX_REPEAT = 20
#: Largest distances to the nearest reference, and the least lengths at which they count.
MAX_CHAR_DISTANCE, MIN_CHARS = 0.32, 200
MAX_WORD_DISTANCE, MIN_WORDS_FOR_WORDS = 0.45, 60


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, and histograms chars and words of each row."""

    def make() -> Callable[[str], tuple]:
        def one(text: str) -> tuple:
            s = Stats(text)
            return s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, s.classes.tolist(), [*s.common.tolist(), s.n_words - int(s.common.sum())]

        return one

    given = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(LANGUAGES[0]))
    return common.map_rows(given, ["doc_id", "lang"], make, "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, chars array<bigint>, words array<bigint>")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def references(counted: DataFrame, good: DataFrame | None = None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Histograms of each language as shares. good: doc_id. At most two rows for each of LANGUAGES come to the driver."""
    passed = counted.where(~base_failed() & F.col("lang").isin(*LANGUAGES))
    sums = [F.sum(F.get("chars", F.lit(i))) for i in range(len(CLASSES))] + [F.sum(F.get("words", F.lit(i))) for i in range(len(WORDS) + 1)]
    found = {r[0]: r[1:] for r in passed.groupBy("lang").agg(*sums).collect()}
    if good is not None:
        known = passed.join(good.select("doc_id").distinct(), "doc_id", "left_semi")
        found |= {r[0]: r[1:] for r in known.groupBy("lang").agg(*sums).collect()}
    out = {}
    for lang, values in sorted(found.items()):
        chars, words = np.array(values[: len(CLASSES)], float), np.array(values[len(CLASSES) :], float)
        out[lang] = chars / chars.sum(), words / words.sum()
    return out


def distance(rows: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence in bits) of each row of shares to the reference."""
    middle = (rows + reference) / 2

    def to_middle(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, p * np.log2(np.where(p > 0, p, 1) / np.where(middle > 0, middle, 1)), 0).sum(axis=1)

    return np.sqrt(np.maximum(0, (to_middle(rows) + to_middle(np.broadcast_to(reference, rows.shape))) / 2))


def judge(docs: DataFrame, good: DataFrame | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the distances char_distance and word_distance. good: doc_id of documents known to be good."""
    counted = common.written(counts(docs), "quality-counts")
    known = references(counted, good)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            near = []
            for k, name, size in ((0, "chars", len(CLASSES)), (1, "words", len(WORDS) + 1)):
                rows = batch.column(name).flatten().to_numpy().reshape(n, size).astype(float)
                shares = rows / np.maximum(1, rows.sum(axis=1, keepdims=True))
                found = [distance(shares, r[k]) for r in known.values()]
                near.append(np.min(found, axis=0) if found and n else np.zeros(n))
            chars = np.array(batch.column("chars").flatten()).reshape(n, len(CLASSES)).sum(axis=1)
            far = (chars >= MIN_CHARS) & (near[0] > MAX_CHAR_DISTANCE) | (batch.column("n_words").to_numpy() >= MIN_WORDS_FOR_WORDS) & (near[1] > MAX_WORD_DISTANCE)
            failed = batch.column("base_failed").to_numpy(zero_copy_only=False)
            kept = batch.select(["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(~failed & ~far), *map(pa.array, near)], [*kept.schema.names, "kept", "char_distance", "word_distance"])

    shape = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, char_distance double, word_distance double"
    return counted.withColumn("base_failed", base_failed()).drop("lang").mapInArrow(run, shape)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels").where("quality = 1"))
