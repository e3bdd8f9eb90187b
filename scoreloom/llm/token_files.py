"""Operator 7: token ids in patched frame-of-reference blocks.

Documents are encoded where they are read and dealt, as ids in 16 bits where they
fit, by ranges of doc_id (quantiles of the column), then sorted, so the files in
order of their part number hold the ids in order of doc_id. A part is a row of segments;
a segment holds whole documents and is one row of a Parquet table (written by
Spark, so that a lost task's attempt leaves nothing behind and any store will
do): part, seq, the ids and documents of the part before it, and a payload.

Payload, little-endian:
  magic "PFR1", u32 documents, u64 ids, u32 blocks
  documents x i64 doc_id (a flag byte each says if it is null), documents x u32 ids
  blocks x u32 minimum, blocks x u8 width, blocks x u16 exceptions, blocks + 1 x u64 block start
  the blocks: BLOCK values less the minimum in `width` bits each, as u64 words,
  then the exceptions: u16 positions, u32 values less the minimum
The width of a block is that of its differences at PERCENTILE; larger ones are
exceptions. Block starts let a reader take single blocks (see Segment.ids).

Rows: null text counts as empty and holds the end id alone; rows with equal
doc_id stand side by side, ordered by length (null first), then by a hash of the
text; one that fills several parts is dealt over them by that hash, and ordered so
in each; a null doc_id comes first; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .stretches import StretchEncoder

BLOCK = 128
PERCENTILE = 0.9
SEGMENT_IDS = 1 << 20
END_ID = 0
#: Stands for a null doc_id in the order of parts.
NONE = -(1 << 63)


def bits(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) values of up to `width` bits to (blocks, words) u64."""
    out = np.zeros((BLOCK * width // 64, len(values)), np.uint64)
    values = np.ascontiguousarray(values.T)  # places of all blocks side by side
    for j in range(BLOCK if width else 0):
        word, shift = divmod(j * width, 64)
        out[word] |= values[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= values[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((BLOCK, len(words)), np.uint64)
    mask, words = np.uint64((1 << width) - 1), np.ascontiguousarray(words.T)
    for j in range(BLOCK if width else 0):
        word, shift = divmod(j * width, 64)
        v = words[word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (words[word + 1] << np.uint64(64 - shift))
        out[j] = v & mask
    return out.T


def exception_places(end: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block of each exception, and places of its position and value, in units of two bytes. end: of the blocks."""
    block = np.repeat(np.arange(len(count)), count)
    rank = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
    return block, end[block] - 3 * count[block] + rank, end[block] - 2 * count[block] + 2 * rank


def encode_segment(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    full = np.empty(blocks * BLOCK, np.uint64)
    full[:n] = ids
    full[n:] = ids[-1] if n else 0
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1) if blocks else np.zeros(0, np.uint64)
    rest = full - low[:, None]
    at = min(BLOCK - 1, int(PERCENTILE * BLOCK))
    width = bits(np.partition(rest, at, axis=1)[:, at]) if blocks else np.zeros(0, np.int64)
    over = rest >> width.astype(np.uint64)[:, None] > 0
    exceptions = over.sum(axis=1)
    starts = np.zeros(blocks + 1, "<u8")
    np.cumsum(BLOCK // 8 * width + 6 * exceptions, out=starts[1:])
    # all sizes are even
    at_, body = (starts // 2).astype(np.int64), np.empty(int(starts[-1]) // 2, "<u2")
    packed = np.where(over, np.uint64(0), rest)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        body[at_[own][:, None] + np.arange(BLOCK * int(w) // 16)] = pack(packed[own], int(w)).astype("<u8", copy=False).view("<u2")
    block, position, value = exception_places(at_[1:], exceptions)
    where = np.nonzero(over)[1]
    body[position] = where
    body[value[:, None] + np.arange(2)] = rest[block, where].astype("<u4").view("<u2").reshape(-1, 2)
    head = b"PFR1" + np.array([len(doc_ids)], "<u4").tobytes() + np.array([n], "<u8").tobytes() + np.array([blocks], "<u4").tobytes()
    docs = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + bytes(x is None for x in doc_ids) + counts.astype("<u4").tobytes()
    return b"".join([head, docs, low.astype("<u4").tobytes(), width.astype("u1").tobytes(), exceptions.astype("<u2").tobytes(), starts.tobytes(), body.tobytes()])


class Segment:
    """A reader of one payload."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"PFR1":
            raise ValueError("not a segment of token ids")
        self.raw, self.at = raw, 4
        docs, self.n, self.blocks = int(self.take("<u4", 1)[0]), int(self.take("<u8", 1)[0]), int(self.take("<u4", 1)[0])
        ids, nulls = self.take("<i8", docs), self.take("u1", docs)
        self.doc_ids = [None if null else x for x, null in zip(ids.tolist(), nulls.tolist())]
        self.counts = self.take("<u4", docs).astype(np.int64)
        self.low, self.width = self.take("<u4", self.blocks), self.take("u1", self.blocks)
        self.exceptions, self.starts = self.take("<u2", self.blocks), self.take("<u8", self.blocks + 1).astype(np.int64)

    def take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.raw, kind, n, self.at)
        self.at += out.nbytes
        return out

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of the blocks from first to before last, found by their starts."""
        last = self.blocks if last is None else last
        out, body = np.zeros((last - first, BLOCK), np.uint64), np.frombuffer(self.raw, "<u2", offset=self.at)
        width, starts = self.width[first:last], self.starts[first : last + 1] // 2
        for w in np.unique(width):
            own, size = np.flatnonzero(width == w), BLOCK * int(w) // 16
            words = body[starts[own][:, None] + np.arange(size)].view("<u8") if size else np.zeros((len(own), 0), np.uint64)
            out[own] = unpack(words, int(w))
        block, position, value = exception_places(starts[1:], self.exceptions[first:last].astype(np.int64))
        out[block, body[position]] = body[value[:, None] + np.arange(2)].view("<u4")[:, 0]
        out += self.low[first:last, None]
        return out.reshape(-1)[: max(0, self.n - first * BLOCK)].astype("<u4")


#: Words of ASCII and Latin letters, whose class no version of Unicode has changed.
PLAIN = re.compile(" ?[A-Za-zªµºÀ-ÖØ-öø-ƺ]{1,64}").fullmatch


class LibraryCodec:
    """Ids as the tokenizers library gives them, for the stretches of a StretchEncoder.

    A stretch is cut once more where that is a match edge of the pattern: after
    a single line feed, and between letters or digits and the marks behind them.
    Plain words go to the library's model and are remembered, all else to the
    library as it is.
    """

    #: Marks that begin no contraction.
    marks = ".,;:!?%&#*$|"
    #: Words remembered; stretches are, too, so this is for what they share.
    most = 1 << 17

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.special = sorted(t.content for t in self.library.get_added_tokens_decoder().values())
        split = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.letters = {b: chr(b) for b in range(33, 127)}
        for c in map(chr, (32, *range(128, 0x200))):  # the library's own letters for the bytes, seen one character at a time
            self.letters |= dict(zip(c.encode(), split.pre_tokenize_str(c)[0][0]))
        self.known: dict[str, list[int]] = {}

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def word(self, text: str) -> list[int]:
        out = self.known.get(text)
        if out is None:
            if PLAIN(text):
                out = [t.id for t in self.library.model.tokenize(text.encode().decode("latin-1").translate(self.letters))]
            else:
                out = self.whole(text)
            if len(text) <= 64:
                if len(self.known) >= self.most:
                    self.known = {}
                self.known[text] = out
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a stretch: no white space but at its start, or line feeds cut off by no rule."""
        if text[0] == "\n" and len(text) > 1 and not text[1].isspace():
            return self.word("\n") + self.encode(text[1:])
        word = text.rstrip(self.marks)
        if len(word) < len(text) and word[-1:].isalnum() and word[-1:].isascii():
            return self.word(word) + self.word(text[len(word) :])
        return self.word(text)


@lru_cache(maxsize=4)
def encoder_for(path: str) -> StretchEncoder:
    """One a Python worker, so that its tasks share what it has met."""
    codec = LibraryCodec(path)
    return StretchEncoder(codec.encode, codec.whole, codec.special)


def packed_ids(ids: np.ndarray) -> bytes:
    """Ids in 16 bits each where they fit, else 32; a first byte says which."""
    return b"\x02" + ids.astype("<u2").tobytes() if len(ids) == 0 or ids.max() < 1 << 16 else b"\x04" + ids.astype("<u4").tobytes()


def unpacked_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.uint32)


def bounds(docs: DataFrame, parts: int) -> np.ndarray:
    """Last doc_id of each part but the last, about equal rows in each; one value a part comes to the driver."""
    if parts < 2:
        return np.zeros(0, np.int64)
    shares = [i / parts for i in range(1, parts)]
    got = docs.agg(F.percentile_approx(F.coalesce("doc_id", F.lit(NONE)), shares, max(10_000, 20 * parts))).first()[0]
    return np.array(got or [], np.int64)


def part_of(ids: np.ndarray, keys: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Part of each row. A doc_id that fills several parts is dealt over them by the key."""
    low, high = np.searchsorted(last, ids, "left"), np.searchsorted(last, ids, "right")
    share = keys.view(np.uint64).astype(np.float64) / 2.0**64
    return low + np.minimum(np.maximum(high - low - 1, 0), ((high - low) * share).astype(np.int64))


def encoded(docs: DataFrame, vocabulary: str, last: np.ndarray, end_id: int = END_ID) -> DataFrame:
    """part, doc_id, n_chars, text_key, ids (as packed_ids) with the end id."""
    given = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(-1)).alias("n_chars"), F.xxhash64("text").alias("text_key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(vocabulary)
        for batch in batches:
            ids, keys = batch.column("doc_id").fill_null(NONE), batch.column("text_key")
            part = pa.array(part_of(ids.to_numpy(zero_copy_only=False), keys.to_numpy(zero_copy_only=False), last), pa.int32())
            for first, ids, count in encoder.encoded(batch.column("text")):
                ends, rows = np.cumsum(count).tolist(), batch.slice(first, len(count))
                raw = [packed_ids(np.append(ids[a:b], np.uint32(end_id))) for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([part.slice(first, len(count)), *rows.columns[:3], pa.array(raw, pa.binary())], ["part", "doc_id", "n_chars", "text_key", "ids"])

    return given.mapInArrow(run, "part int, doc_id bigint, n_chars int, text_key bigint, ids binary")


def write(docs: DataFrame, path: str, vocabulary: str, parts: int | None = None, end_id: int = END_ID) -> None:
    """Encodes docs and writes the files at path."""
    spark = docs.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, doc_ids, rows, held, seq, before = None, [], [], 0, 0, 0

        def segment() -> pa.RecordBatch:
            counts, ids = np.array([len(r) for r in rows], np.int64), np.concatenate(rows)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "seq": [seq], "ids_before": [before], "n_ids": [held], "payload": pa.array([encode_segment(doc_ids, counts, ids)], pa.binary())})

        for batch in batches:
            for now, doc_id, ids in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):
                if now != part or held >= SEGMENT_IDS:
                    if rows:
                        yield segment()
                    before, seq = (before + held, seq + 1) if now == part else (0, 0)
                    part, doc_ids, rows, held = now, [], [], 0
                doc_ids.append(doc_id)
                rows.append(unpacked_ids(ids.as_py()))
                held += len(rows[-1])
        if rows:
            yield segment()

    # ids are what is shuffled, not texts, and each text is encoded once
    order = ["part", F.col("doc_id").asc_nulls_first(), "n_chars", "text_key"]
    dealt = encoded(docs, vocabulary, bounds(docs, parts), end_id).repartitionById(parts, "part").sortWithinPartitions(*order).select("part", "doc_id", "ids")
    segments = dealt.mapInArrow(run, "part bigint, seq bigint, ids_before bigint, n_ids bigint, payload binary")
    segments.write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    files = spark.read.schema("part bigint, seq bigint, ids_before bigint, n_ids bigint, payload binary").parquet(path)
    # one row a part, whose number the writer chose: the running total over parts
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                got = Segment(batch.column("payload")[i].as_py())
                ids, ends = got.ids(), np.cumsum(got.counts)
                start = batch.column("part_start")[i].as_py() + batch.column("ids_before")[i].as_py()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(got.doc_ids, pa.int64()), "start": pa.array(start + ends - got.counts), "n_tokens": pa.array(got.counts),
                    "ids_crc32": pa.array([zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), got.counts.tolist())], pa.int64()),
                })

    # at most one row for each of the writer's partitions, so small enough to send to all tasks; payloads stay where they are
    return files.join(F.broadcast(starts), "part").select("part_start", "ids_before", "payload").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.shared_dir(spark, "token-files")
    write(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, path)
