"""Operator 8: best-fit packing into bins of several permitted sequence lengths.

Documents are encoded in op4's vocabulary with an end token; one longer than the
largest capacity is cut in pieces of that size and a rest, so nothing is dropped.
Pieces are dealt into groups by a hash, so many that each holds about 2 *
GROUP_TOKENS bytes of text, and so no more tokens, and each group is packed on its own: pieces in falling order
of size; each goes to the open bin that it leaves least room in. Where none has
room, a bin is opened, of the size whose cost for each token that it will hold is
least: each permitted size is tried on the pieces still to come, largest that
fits first. Finally each bin is brought down to the smallest permitted length
that holds its contents. Groups are bounded, so no task holds the corpus, and
with more documents there are more groups.

Cost of a bin of capacity c, padding included: c for its tokens, c * c /
ATTENTION for attention between them, and OVERHEAD for the bin itself. So long
bins are dear by attention, short ones by overhead and by what doesn't fit.

Bins are rows of a Parquet table: group, bin, capacity, the ids of their pieces
one after the other (16 bits each where they fit), and of each piece doc_id,
piece number and start.

Rows: null text counts as empty; an empty text is a piece of its end token
alone; repeated rows are each packed, and where any have over SAME copies all rows are
dealt by their place in the table, too; a null doc_id is kept as such; an empty table gives an empty
result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import ranks_from
from .stretches import StretchEncoder
from .token_files import packed_ids, unpacked_ids

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 32
ATTENTION = 1 << 14
GROUP_TOKENS = 1 << 21
SAME = 64


def cost(capacity: int) -> float:
    return capacity + capacity * capacity / ATTENTION + OVERHEAD


def end_id(ranks: dict[bytes, int]) -> int:
    """The first id that the vocabulary leaves free."""
    return max(ranks.values()) + 1


@lru_cache(maxsize=4)
def encoder_for(path: str, pattern: str) -> tuple[StretchEncoder, int]:
    """One a Python worker, so that its tasks share what it has met; and the id that ends a document."""
    import tiktoken

    ranks = ranks_from(path)
    return StretchEncoder(tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary), end_id(ranks)


def pieces(docs: DataFrame, largest: int) -> DataFrame:
    """doc_id, text_key, row, piece, size, ids: the ids of each of docs (with text_key and row) and the end id, cut every `largest`."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_for(path, pattern)
        for batch in batches:
            for first, ids, count in encoder.encoded(batch.column("text")):
                rows, number, size, raw, ends = [], [], [], [], np.cumsum(count).tolist()
                for i, (a, b) in enumerate(zip([0, *ends], ends)):
                    own = np.append(ids[a:b], np.uint32(end))
                    for k in range(0, len(own), largest):
                        rows.append(first + i)
                        number.append(k // largest)
                        size.append(min(largest, len(own) - k))
                        raw.append(packed_ids(own[k : k + largest]))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("doc_id", "text_key", "row")), pa.array(number, pa.int32()), pa.array(size, pa.int32()), pa.array(raw, pa.binary())], ["doc_id", "text_key", "row", "piece", "size", "ids"])

    return docs.mapInArrow(run, "doc_id bigint, text_key bigint, row bigint, piece int, size int, ids binary")


def pack(sizes: np.ndarray, capacities: tuple[int, ...] = CAPACITIES) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and place in the bin of each piece; sizes fall. Bins are numbered as they are opened."""
    falling = sizes.tolist()
    rising = [-s for s in falling]
    costs = [(c, cost(c)) for c in sorted(capacities)]
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    number, at, held = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []

    def filled(i: int, capacity: int) -> int:
        """Tokens in a bin opened for piece i, if it gets the largest pieces to come that fit."""
        room, j = capacity - falling[i], i
        while room and (j := bisect_left(rising, -room, j + 1)) < len(rising):
            room += rising[j]
        return capacity - room

    for i, size in enumerate(falling):
        k = bisect_left(rooms, (size, -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            # by what the bin will cost once it is brought down to its contents, for each token in it
            tried = []
            for c, _ in costs:
                if c >= size:
                    full = filled(i, c)
                    tried.append((next(price for d, price in costs if d >= full) / full, c))
            room, b = min(tried)[1], len(held)
            held.append(0)
        number[i], at[i] = b, held[b]
        held[b] += 1
        if room > size:
            insort(rooms, (room - size, b))
    return number, at


def bins(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row a bin: group, bin, capacity, used (ids in it), ids, and arrays doc_ids, pieces, starts."""
    capacities = tuple(sorted(capacities))
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    # a token is a byte at least, and each row has an end
    groups = max(1, -(-(rows + (size or 0)) // (2 * group_tokens)))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text", F.lit(0).cast("bigint").alias("row"))
    if groups > 1 and not keyed.groupBy("doc_id", "text_key").count().where(F.col("count") > SAME).isEmpty():
        keyed = keyed.withColumn("row", F.monotonically_increasing_id())
    keys = ["doc_id", "text_key", "piece", "row"]
    dealt = pieces(keyed, capacities[-1]).withColumn("group", F.pmod(F.xxhash64(*keys), F.lit(groups)))

    def out(group: int, rows: list[tuple]) -> pa.RecordBatch:
        """rows: doc_id, piece, size, ids of a group, by falling size."""
        number, at = pack(np.array([r[2] for r in rows], np.int64), capacities)
        order = np.lexsort([at, number]).tolist()
        rows, number = [rows[i] for i in order], number[order]
        first = np.flatnonzero(np.diff(number, prepend=-1))
        each = [rows[i:j] for i, j in zip(first.tolist(), [*first[1:].tolist(), len(rows)])]
        used = np.array([sum(r[2] for r in own) for own in each], np.int64)
        columns = {
            "group": pa.array(np.full(len(each), group)), "bin": pa.array(number[first]), "capacity": pa.array(np.array(capacities)[np.searchsorted(capacities, used)], pa.int32()), "used": pa.array(used, pa.int32()),
            "ids": pa.array([packed_ids(np.concatenate([unpacked_ids(r[3]) for r in own])) for own in each], pa.binary()), "doc_ids": pa.array([[r[0] for r in own] for own in each], pa.list_(pa.int64())),
            "pieces": pa.array([[r[1] for r in own] for own in each], pa.list_(pa.int32())), "starts": pa.array([[0, *accumulate(r[2] for r in own[:-1])] for own in each], pa.list_(pa.int32())),
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for now, *row in zip(*(batch.column(c).to_pylist() for c in ("group", "doc_id", "piece", "size", "ids"))):
                if now != group:
                    if held:
                        yield out(group, held)
                    group, held = now, []
                held.append(row)
        if held:
            yield out(group, held)

    # a group is a stretch of one partition, and the only one in memory
    order = ["group", F.col("size").desc(), *keys]
    parts = min(groups, max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ready = dealt.repartitionById(parts, F.pmod("group", F.lit(parts)).cast("int")).sortWithinPartitions(*order).select("group", "doc_id", "piece", "size", "ids")
    return ready.mapInArrow(run, "group bigint, bin bigint, capacity int, used int, ids binary, doc_ids array<bigint>, pieces array<int>, starts array<int>")


def rows_of(packed_bins: DataFrame) -> DataFrame:
    """One row a piece: doc_id, piece, size, group, bin, place, start, capacity, used, ids_crc32 (of the bin's ids as they are stored)."""
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array("used"))
    each = F.posexplode(F.arrays_zip(F.col("doc_ids"), F.col("pieces"), F.col("starts"), ends.alias("ends"))).alias("place", "x")
    flat = packed_bins.select("group", "bin", "capacity", "used", F.crc32("ids").alias("ids_crc32"), each)
    return flat.select(F.col("x.doc_ids").alias("doc_id"), F.col("x.pieces").alias("piece"), (F.col("x.ends") - F.col("x.starts")).alias("size"), "group", "bin", "place", F.col("x.starts").alias("start"), "capacity", "used", "ids_crc32")


def packed(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Writes the bins, and from the written ones gives the rows of rows_of()."""
    return rows_of(common.written(bins(docs, capacities, group_tokens), "bins"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.table(spark, sf_dir, "documents"))
