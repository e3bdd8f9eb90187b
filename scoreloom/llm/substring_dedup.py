"""Operator 1: substring dedup with a log-structured fingerprint index.

A window is WINDOW consecutive words. Among its GRAM-word grams the one with
the smallest hash (leftmost on ties) is the window's anchor; equal windows have
equal anchors, so only anchors, about one word in fifteen, are indexed. The
consecutive windows of one anchor form a segment.

The index is a log of sorted immutable runs (gram hash, segments, a digest of
the segment or null if they differ), bucketed and sorted by gram hash. A batch
becomes a run, is merge-joined with each older run without shuffling it, and is
then part of the log; where there are more than FAN runs, the two smallest are
merge-joined into one (compacted). A gram that was met once leaves its windows
alone.

Nothing goes by gram alone, hits are verified: segments are equal by 64 bits of
BLAKE2b over their words' bytes, beside the gram; where the segments of a gram
differ, one of each kind is opened, and its windows are equal by 128 bits of
BLAKE2b over their 35 words. Gram hashes are made of XXH3 hashes of the words.

Counts are summed map-side before every exchange, and the joins that bring
them back to documents read written tables, so that Spark can split them: a
passage that a third of the documents share stays in no single task. A long text
is worked on in pieces that overlap by WINDOW - 1 words.

Rows: null text has no words; texts under WINDOW words lose none; repeated rows
(equal doc_id and text) repeat each other's windows; rows are told apart by
doc_id and 64 bits of hash of the text, so equal doc_ids are no trouble; a null
doc_id is kept as such; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from . import common

WINDOW = 35
GRAM = 8
#: Bytes of text that are worked on at once.
SLICE = 1 << 20
FAN = 2
#: Batches in which the query adds its table to the log.
BATCHES = 3

_blank = re.compile(rb"[\x20\x09-\x0D]").search
#: Odd multiplier of the polynomial over a gram's word hashes, and its inverse modulo 2**64.
_BASE = 0xC2B2AE3D27D4EB4F
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stretches(text: bytes, overlap: int = WINDOW - 1) -> Iterator[tuple[int, list[bytes]]]:
    """The words of a text in pieces: number of the first, words. A piece begins with the last words of the one before."""
    if len(text) <= SLICE:
        yield 0, text.split()
        return
    at, first, held = 0, 0, []
    while at < len(text):
        edge = _blank(text, at + SLICE)
        end = edge.start() if edge else len(text)
        words = held + text[at:end].split()
        yield first, words
        held = words[max(0, len(words) - overlap) :] if overlap else []
        first, at = first + len(words) - len(held), end


class Words:
    """Words of some pieces of texts, one after the other."""

    def __init__(self, pieces: list[tuple[int, int, list[bytes]]]):
        """pieces: row, number of the first word, words."""
        self.words = [w for _, _, words in pieces for w in words]
        self.size = np.array([len(words) for _, _, words in pieces], np.int64)
        self.head = np.cumsum(self.size) - self.size
        self.row, self.first = (np.array([p[i] for p in pieces], np.int64) for i in (0, 1))
        self.line = b" ".join(self.words)
        self.at = list(accumulate([len(w) + 1 for w in self.words], initial=0))

    def digests(self, start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
        """BLAKE2b of the words from start to before end, as rows of signed longs."""
        line, at = self.line, self.at
        if not len(start):
            return np.zeros((0, size // 8), np.int64)
        raw = b"".join([blake2b(line[at[a] : at[b] - 1], digest_size=size).digest() for a, b in zip(start.tolist(), end.tolist())])
        return np.frombuffer(raw, "<i8").reshape(-1, size // 8)

    def grams(self) -> np.ndarray:
        word = np.frombuffer(b"".join(map(xxh3_128_digest, self.words)), "<u8").reshape(-1, 2)
        n = len(word)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((word[:, 0] ^ _mix(word[:, 1])) * _powers(_BASE, n), out=sums[1:])
        return _mix((sums[GRAM:] - sums[:-GRAM]) * _powers(_BACK, n + 1)[: n + 1 - GRAM])

    def anchors(self) -> tuple[np.ndarray, ...]:
        """Of all segments: row, first window, windows, gram hash, segment digest."""
        n, none = len(self.words) - WINDOW + 1, np.zeros(0, np.int64)
        if n <= 0 or self.size.max() < WINDOW:
            return none, none, none, none, none
        low = gram = self.grams()
        where, span = np.arange(len(gram)), 1
        while span < WINDOW - GRAM + 1:  # leftmost minimum of ever longer stretches
            step = min(span, WINDOW - GRAM + 1 - span)
            less = low[step:] < low[:-step]
            low, where = np.where(less, low[step:], low[:-step]), np.where(less, where[step:], where[:-step])
            span += step
        piece = np.repeat(np.arange(len(self.size)), self.size)
        good = piece[:n] == piece[WINDOW - 1 :]
        new = good.copy()
        new[1:] &= (where[1:] != where[:-1]) | ~good[:-1]
        last = good.copy()
        last[:-1] &= new[1:] | ~good[1:]
        a, b = np.flatnonzero(new), np.flatnonzero(last)
        own = piece[a]
        return self.row[own], a - self.head[own] + self.first[own], b - a + 1, gram[where[a]].view(np.int64), self.digests(a, b + WINDOW, 8)[:, 0]


def _plain(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (text.encode() for text in common.texts_of(batch))


def _slices(batch: pa.RecordBatch, texts_of: Callable[[pa.RecordBatch], Iterator[bytes]] = _plain) -> Iterator[Words]:
    """The texts of a batch in slices of about SLICE bytes."""
    held, size = [], 0
    for row, text in enumerate(texts_of(batch)):
        for first, words in stretches(text):
            held.append((row, first, words))
            size += min(len(text), SLICE) + 1
            if size >= SLICE:
                yield Words(held)
                held, size = [], 0
    if held:
        yield Words(held)


KEY = ["doc_id", "text_key"]


def with_key(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def squeezed(docs: DataFrame) -> DataFrame:
    """with_key(docs), the text compressed, for exchanges: texts are most of what they write."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array([press(t.encode()) for t in common.texts_of(batch)], pa.binary())], [*KEY, "text"])

    return with_key(docs).mapInArrow(run, "doc_id bigint, text_key bigint, text binary")


def _bytes(batch: pa.RecordBatch) -> Iterator[bytes]:
    """Texts of squeezed() one by one."""
    for x in batch.column("text"):
        yield zstandard.decompress(x.as_py())


SEGMENT = "doc_id bigint, text_key bigint, a int, n int, h bigint, g bigint"


def segments(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, a (first window), n (windows), h (gram hash), g (segment digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in _slices(batch):
                row, a, n, h, g = words.anchors()
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in KEY), pa.array(a, pa.int32()), pa.array(n, pa.int32()), pa.array(h), pa.array(g)], [*KEY, "a", "n", "h", "g"])

    return with_key(docs).mapInArrow(run, SEGMENT)


class WindowIndex:
    """The log: segment tables, and runs of their summed gram hashes.

    The runs are tables of the session's catalogue while the index is open;
    close() drops the names and leaves the files.
    """

    run_schema = "h BIGINT, n BIGINT, g BIGINT"

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        #: name and rows of each run, oldest first
        self.runs: list[tuple[str, int]] = []
        self.batches: list[str] = []
        self.names: list[str] = []

    def _write(self, rows: DataFrame) -> None:
        """rows: h, n, g, one row a gram, dealt and sorted by h."""
        name = f"window_run_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({self.run_schema}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        self.names.append(name)
        rows.write.insertInto(name)
        self.runs.append((name, self.spark.table(name).count()))

    def _run(self, name: str, mark: str = "") -> DataFrame:
        return self.spark.table(name).select(*[F.col(c).alias(c + mark) for c in ("h", "n", "g")])

    def all_segments(self) -> DataFrame:
        return self.spark.read.schema(SEGMENT).parquet(*self.batches)

    def add(self, docs: DataFrame, batches: int = 1) -> DataFrame:
        """Indexes docs, in so many batches; returns the grams of docs that repeat, there or in older runs: h, mixed."""
        path = f"{self.path}/segments_{len(self.batches)}"
        segments(docs).write.parquet(path)
        self.batches.append(path)
        whole = self.spark.read.schema(SEGMENT).parquet(path)
        hits = []
        for k in range(batches):
            self.compact(FAN - 1)
            batch = whole.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k) if batches > 1 else whole
            sums = batch.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("g").alias("low"), F.max("g").alias("high"))
            one = sums.select("h", "n", F.when(F.col("low") == F.col("high"), F.col("low")).alias("g"))
            older = [name for name, _ in self.runs]
            self._write(one.repartition(self.buckets, "h").sortWithinPartitions("h"))
            found = self._run(self.runs[-1][0])
            for name in older:  # merge join, run by run; both sides are bucketed and sorted
                both = found.join(self._run(name, "_").hint("merge"), F.col("h") == F.col("h_"), "left")
                same = F.col("h_").isNull() | F.col("g").eqNullSafe(F.col("g_"))
                found = both.select("h", (F.col("n") + F.coalesce("n_", F.lit(0))).alias("n"), F.when(same, F.col("g")).alias("g"))
            hits.append(common.written(found.where("n > 1").select("h", F.col("g").isNull().alias("mixed")), "hits"))
        if batches == 1:
            return hits[0]
        every = hits[0]
        for more in hits[1:]:
            every = every.unionByName(more)
        return common.written(every.groupBy("h").agg(F.max("mixed").alias("mixed")), "hits")

    def compact(self, fan: int = FAN) -> None:
        """Merges the two smallest runs while there are more than `fan`; their files stay for readers."""
        while len(self.runs) > max(1, fan):
            small = sorted(self.runs, key=lambda r: r[1])[:2]
            a, b = self._run(small[0][0]), self._run(small[1][0], "_")
            both = a.join(b.hint("merge"), F.col("h") == F.col("h_"), "full_outer")
            one = F.when(F.col("h").isNull(), F.col("g_")).when(F.col("h_").isNull() | (F.col("g") == F.col("g_")), F.col("g"))
            self.runs = [r for r in self.runs if r not in small]
            # bucket by bucket, as it is read: nothing is shuffled
            self._write(both.select(F.coalesce("h", "h_").alias("h"), (F.coalesce("n", F.lit(0)) + F.coalesce("n_", F.lit(0))).alias("n"), one.alias("g")).sortWithinPartitions("h"))

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []


def _joined(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """docs (with key) and the array of their spans, each once, from a written table."""
    sets = common.written(spans.groupBy(*KEY).agg(F.collect_set(F.struct("a", "n")).alias("spans")), "spans")
    sets = sets.select(F.col("doc_id").alias("d_"), F.col("text_key").alias("t_"), "spans")
    return docs.join(sets, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("text_key") == F.col("t_")), how).select(*KEY, "text", "spans")


def _spans(x: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """First windows and numbers of windows, in order."""
    if not x.is_valid or not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, n = (x.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    order = np.argsort(a, kind="stable")
    return a[order], n[order]


def windows(docs: DataFrame) -> DataFrame:
    """Of the windows in the spans of docs: doc_id, text_key, a, and a digest of the 35 words in two longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_spans(x) for x in batch.column("spans")]
            for words in _slices(batch, _bytes):
                rows, starts = [], []
                for row, first, head, size in zip(words.row.tolist(), words.first.tolist(), words.head.tolist(), words.size.tolist()):
                    a, n = spans[row]
                    low, high = np.maximum(a, first), np.minimum(a + n, first + size - WINDOW + 1)
                    n = np.maximum(high - low, 0)
                    at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    starts.append(at - first + head)
                    rows.append(np.full(len(at), row))
                at, row = np.concatenate(starts), np.concatenate(rows)
                piece = np.searchsorted(words.head + words.size, at, "right")
                lanes, rows = words.digests(at, at + WINDOW, 16), pa.array(row)
                a = at - words.head[piece] + words.first[piece]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in KEY), pa.array(a, pa.int32()), pa.array(lanes[:, 0].copy()), pa.array(lanes[:, 1].copy())], [*KEY, "a", "w1", "w2"])

    return docs.mapInArrow(run, "doc_id bigint, text_key bigint, a int, w1 bigint, w2 bigint")


def repeats(docs: DataFrame, index: WindowIndex, corpus: DataFrame, batches: int = 1) -> DataFrame:
    """Spans of windows of docs that start elsewhere too: doc_id, text_key, a, n.

    corpus: the texts of all batches of the index, docs included.
    """
    grams = index.add(docs, batches)
    hits = common.written(index.all_segments().join(grams, "h"), "repeated-segments")
    # spans of older documents go at the join with docs
    sure = hits.where("not mixed").select(*KEY, "a", "n")
    # kinds of segment under grams that have several; any one stands for the others
    mixed = hits.where("mixed").drop("mixed")
    kinds = mixed.groupBy("h", "g").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in (*KEY, "a", "n")])
    kinds = common.written(kinds, "segment-kinds")
    again = mixed.join(kinds.where("copies > 1").select("h", "g"), ["h", "g"]).select(*KEY, "a", "n")
    opened = common.written(windows(_joined(squeezed(corpus), kinds.select(*KEY, "a", "n"), "inner")), "windows")
    twice = common.written(opened.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("w1", "w2"), "twice")
    parts = opened.join(twice, ["w1", "w2"]).select(*KEY, "a", F.lit(1).alias("n"))
    return sure.unionByName(again).unionByName(parts)


def kept_words(text: bytes, a: np.ndarray, n: np.ndarray) -> tuple[int, bytes]:
    """How many words the text has, and those in none of the windows (a: first windows in order, n: windows), joined by a blank."""
    out, count = [], 0
    end = a + n + WINDOW - 1
    for first, words in stretches(text, 0):
        count = first + len(words)
        i, j = np.searchsorted(np.maximum.accumulate(end), first, "right"), np.searchsorted(a, count, "left")
        if j > i:
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, np.maximum(a[i:j] - first, 0), 1)
            np.add.at(edge, np.clip(end[i:j] - first, 0, len(words)), -1)
            words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
        if words:
            out.append(b" ".join(words))
    return count, b" ".join(out)


def dedup(docs: DataFrame, index: WindowIndex, corpus: DataFrame | None = None, batches: int = 1) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_removed, kept_text (words joined by a blank)."""
    spans = repeats(docs, index, docs if corpus is None else corpus, batches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, left, kept = [], [], []
            for text, x in zip(_bytes(batch), batch.column("spans")):
                count, line = kept_words(text, *_spans(x))
                counts.append(count)
                left.append(line.count(b" ") + 1 if line else 0)
                kept.append(line.decode())
            counts = np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(counts - np.array(left, np.int64)), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return _joined(squeezed(docs), spans, "left").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = WindowIndex(spark, common.shared_dir(spark, "window-index"), buckets)
    try:
        return dedup(docs, index, batches=BATCHES).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
    finally:
        index.close()


OP1_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
w AS (SELECT doc_id, s, array_to_string(words[s:s + 34], ' ') AS body
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS s FROM d WHERE len(words) >= 35)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY body) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM again),
sets AS (SELECT doc_id, list(i) AS ids FROM gone GROUP BY doc_id),
k AS (SELECT d.doc_id, len(words) AS n_words, len(coalesce(ids, [])) AS n_removed,
             CASE WHEN ids IS NULL THEN words ELSE list_filter(list_transform(range(1, len(words) + 1), lambda i: CASE WHEN list_contains(ids, i) THEN NULL ELSE words[i] END), lambda w: w IS NOT NULL) END AS kept
      FROM d LEFT JOIN sets USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
