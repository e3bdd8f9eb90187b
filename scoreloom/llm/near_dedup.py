"""Operator 2: SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints that differ in at most 3 of 64 bits agree in one of four 16-bit
blocks, so each distinct fingerprint goes to four buckets, and any link is seen
in one of them; with more fingerprints buckets are by two of five blocks, then by
three of six. Rows of a bucket over CAP are dealt anew by five of eight blocks,
and what is still over CAP is cut in stretches along the Gray order, whose pairs are
searched one by one where their shared bits allow a link; no row is dropped and no task holds more than 2 * CAP rows of a bucket.

In a bucket rows are sorted by Gray rank, which sets codes with few different
bits side by side. FAN rows make a leaf node, FAN nodes the next, and a node
has the bits that all below it share. A query walks down, adds the differences
in the bits that a node shares and its parent doesn't, and leaves a whole group
once they are over 3. Found links join the rows of the bucket; only the edges
of its spanning stars leave the task, so edges are fewer than rows.

Components come from alternating large and small stars over written tables, by
joins that Spark can split. Exact copies share a fingerprint and are one row
throughout; fingerprints, edges and components never come to the driver.

keep_one() can link by Jaccard similarity of shingle sets instead. SimHash of
pairs at 0.8 differs in 15 to 19 of 100 bits, too many for four blocks of 64, so
fingerprints are then wider: a row goes to the buckets of many keys of sampled
bits, is sorted there by the Gray rank of further bits, and the same index finds
what is near in these. Rows are sets of shingles, named by a hash. What near
codes connect in a bucket is a group (a pair at 0.8 is in none in 3 cases of a
million at most, by calculation from FLIP). What groups connect is searched as one
where it has no more than SET_CAP rows and SET_BYTES, so that a row is sent once however
many groups have it; up to CHUNKS times as much is cut in chunks, whose pairs are searched
one by one. Links are verified on the whole sets. A search from row to row
looks at what it hasn't reached only. Of what is larger, groups are searched: those with
the same rows once, and small ones only if their rows aren't in one component yet. In a group (called bucket from here on)
over SET_CAP rows or SET_BYTES all rows are measured against a few central ones, its pivots; those
that link to one leave the bucket, and the others go on with pivots of their own
until few are left. Rows near a pivot's links, but not linked by then, are searched
beside those links that the triangle inequality allows. What ROUNDS rounds leave
of a bucket (thousands of rows that are close, but linked to none) is cut in
chunks, whose pairs are searched one by one.

Rows: null text counts as empty and has fingerprint zero, linked like any
other; repeated rows share a component; a null doc_id never names a component
(it is null where all its doc_ids are); an empty table gives an empty result;
other columns are kept by keep_one() and not read otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHINGLE = 3
SEED = 42
DISTANCE = 3
CAP = 2000
FAN = 8
BLOCK_ROWS = 1 << 14
PAIRS = 1 << 17
#: Words of 64 bits of a wide fingerprint: those that bucket keys take bits from, and those that are compared.
KEY_WORDS, CODE_WORDS = 16, 3
#: Words that the rows of a group are compared in.
CHECK_WORDS = 8
FULL = 128
#: Share of differing bits of a link at SIMILARITY at most (four of five shingles; 0.15 to 0.17 for larger sets), and the links that may be missed.
FLIP, MISS = 0.1875, 1e-6
SET_CAP = 512
SET_BYTES = 1 << 25
PIVOTS, ROUNDS = 4, 8
#: Chunks of what groups connect, up to which all pairs of chunks are searched: a row is then sent 8 times at most, as by two rounds of pivots.
CHUNKS = 9
#: The similarity that near copies have at least, 4/5.
SIMILARITY = (4, 5)


# fingerprints


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """One hash a shingle; a text with fewer words is one shingle, without words none."""
    words = text.encode().lower().split()
    line, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([hashed(line, SEED)] if words else [], np.uint64)
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends]
    return np.array([hashed(line[s : e - 1], SEED) for s, e in zip(starts, ends[shingle - 1 :])], np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    hashes = shingle_hashes(text, shingle)
    if len(hashes) <= 1:
        return int(hashes.sum())
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.flatnonzero(2 * ones > len(hashes))
    return sum(1 << int(b) for b in bits)


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """The columns in keep, and fp (the fingerprint as a signed long)."""

    def make() -> Callable[[str], tuple]:
        def one(text: str) -> tuple:
            fp = fingerprint(text, shingle)
            return (fp - (1 << 64) if fp >> 63 else fp,)

        return one

    return common.map_rows(docs, keep, make, "fp bigint")


# links


def gray_rank(x: Column) -> Column:
    """Place of a code in Gray order, as a signed long that sorts alike."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, k))
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def _part(x: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << bits) - 1))


def _split_hot(rows: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """rows (g, ...) of buckets up to cap rows, and those of larger ones with the bucket's count n."""
    large = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap)
    both = rows.join(large, "g", "left")
    return both.where("n is null").drop("n"), both.where("n is not null")


def blocks(parts: int, equal: int) -> list[list[tuple[int, int]]]:
    """Choices of `equal` of so many near equal blocks of 64 bits, each block as (first bit, bits)."""
    edges = [64 * i // parts for i in range(parts + 1)]
    return [[(edges[i], edges[i + 1] - edges[i]) for i in chosen] for chosen in combinations(range(parts), equal)]


def _keys(fp: Column, parts: int, equal: int) -> Column:
    """An array of bucket keys. Codes that differ in at most parts - equal bits share one at least."""
    keys = []
    for i, chosen in enumerate(blocks(parts, equal)):
        key, width = F.lit(i).cast("bigint"), 0
        for shift, bits in chosen:
            key, width = F.shiftleft(key, bits).bitwiseOR(_part(fp, shift, bits)), width + bits
        assert width + len(blocks(parts, equal)).bit_length() < 64
        keys.append(key)
    return F.array(*keys)


def chunk_pairs(dense: DataFrame, cap: int, distance: int) -> DataFrame:
    """g, part, fp: the rows of buckets over cap in stretches of cap along the Gray order, and of two stretches all rows where both may hold a link.

    A stretch is a node of the Gray tree: it has the bits that all its rows share, and two stretches
    that differ in more shared bits than the distance are left as a whole.
    """
    place = F.row_number().over(Window.partitionBy("g").orderBy(gray_rank(F.col("fp")))) - 1
    rows = common.written(dense.select("g", "fp", F.floor(place / cap).cast("bigint").alias("chunk")), "chunks")
    nodes = rows.groupBy("g", "chunk").agg(F.bit_and("fp").alias("value"), F.bitwise_not(F.bit_and("fp").bitwiseXOR(F.bit_or("fp"))).alias("mask"))
    other = nodes.select("g", *[F.col(c).alias(f"{c}_") for c in ("chunk", "value", "mask")])
    differ = F.bit_count(F.col("value").bitwiseXOR(F.col("value_")).bitwiseAND(F.col("mask")).bitwiseAND(F.col("mask_")))
    near = nodes.join(other, "g").where((F.col("chunk") <= F.col("chunk_")) & (differ <= distance))
    part = F.shiftleft("chunk", 31).bitwiseOR(F.col("chunk_"))
    sides = near.select("g", part.alias("part"), F.explode(F.array_distinct(F.array("chunk", "chunk_"))).alias("chunk"))
    return rows.join(sides, ["g", "chunk"]).select("g", "part", "fp")


def bucketed(distinct: DataFrame, cap: int = CAP, distance: int = DISTANCE) -> DataFrame:
    """kind, g, part, fp: rows to be searched with each other are those with equal kind, g and part.

    Buckets by one of four blocks hold CAP rows up to some 65 million fingerprints, by two of
    five up to some 10**11, by three of six beyond. Rows of a larger bucket are dealt anew by five
    of eight, and what is still larger is cut along the Gray order: see chunk_pairs().
    """
    n = distinct.count()
    equal = 1 if n <= cap << 15 else 2 if n <= cap << 25 else 3
    rows = common.written(distinct.select("fp", F.explode(_keys(F.col("fp"), equal + distance, equal)).alias("g")), "blocks")
    cold, hot = _split_hot(rows, cap)
    deeper = hot.select("fp").distinct().select("fp", F.explode(_keys(F.col("fp"), 5 + distance, 5)).alias("g"))
    cool, dense = _split_hot(common.written(deeper, "deeper-blocks"), cap)
    pairs = chunk_pairs(dense, cap, distance)
    return (
        cold.select(F.lit(0).alias("kind"), "g", F.lit(0).cast("bigint").alias("part"), "fp")
        .unionByName(cool.select(F.lit(1).alias("kind"), "g", F.lit(0).cast("bigint").alias("part"), "fp"))
        .unionByName(pairs.select(F.lit(2).alias("kind"), "g", "part", "fp"))
    )


class GrayIndex:
    """Index over rows sorted by bucket and Gray rank; a node never spans buckets."""

    def __init__(self, bucket: np.ndarray, code: np.ndarray, fan: int = FAN):
        self.code, self.levels = code, []
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        # level 0: the rows, which share all bits with themselves
        mask, value, start, end = np.full(len(code), ~np.uint64(0)), code, np.arange(len(code)), np.arange(len(code)) + 1
        self.levels.append((mask, value, start, end))
        heads, ends = first, np.append(first[1:], len(code))
        while (sizes := ends - heads).max(initial=0) > 1:
            counts = -(-sizes // fan)
            base = np.cumsum(counts) - counts
            place = np.arange(counts.sum()) - np.repeat(base, counts)
            lo = np.repeat(heads, counts) + place * fan
            hi = np.minimum(lo + fan, np.repeat(ends, counts))
            below_mask, below_value = self.levels[-1][:2]
            ones, any_ = np.bitwise_and.reduceat(below_value, lo), np.bitwise_or.reduceat(below_value, lo)
            shared = np.bitwise_and.reduceat(below_mask, lo) & ~(ones ^ any_)
            self.levels.append((shared, ones & shared, lo, hi))
            heads, ends = base, base + counts
        self.roots = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(code))))
        # last row below each node, to look at each pair from its first row only
        self.last = [np.arange(len(code))]
        for _, _, _, hi in self.levels[1:]:
            self.last.append(self.last[-1][hi - 1])

    def links(self, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of one bucket within the distance, in pieces of bounded size."""
        top = len(self.levels) - 1
        mask, value = self.levels[top][:2]
        query = np.arange(len(self.code))
        acc = np.bitwise_count((self.code ^ value[self.roots]) & mask[self.roots]).astype(np.int64)
        live = (acc <= distance) & (self.last[top][self.roots] > query)
        stack = [(top, query[live], self.roots[live], acc[live])]
        while stack:
            level, query, node, acc = stack.pop()
            if not len(query):
                continue
            if level == 0:
                yield query, node
                continue
            mask, _, start, end = self.levels[level]
            count = end[node] - start[node]
            if count.sum() > PAIRS and len(query) > 1:
                half = len(query) // 2
                stack += [(level, query[:half], node[:half], acc[:half]), (level, query[half:], node[half:], acc[half:])]
                continue
            child = np.repeat(start[node] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            q, known = np.repeat(query, count), np.repeat(mask[node], count)
            mask, value = self.levels[level - 1][:2]
            acc = np.repeat(acc, count) + np.bitwise_count((self.code[q] ^ value[child]) & mask[child] & ~known)
            live = (acc <= distance) & (self.last[level - 1][child] > q)
            stack.append((level - 1, q[live], child[live], acc[live]))


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest row of a set) after a[i] and b[i] are in one set."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (labels != (up := labels[labels])).any():
            labels = up


def star_edges(bucket: np.ndarray, code: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    labels = np.arange(len(code))
    for a, b in GrayIndex(bucket, code).links(distance):
        labels = joined(labels, a, b)
    rows = np.flatnonzero(labels != np.arange(len(code)))
    return code[rows], code[labels[rows]]


def edges(distinct: DataFrame, cap: int = CAP, distance: int = DISTANCE) -> DataFrame:
    """u, v: links that connect what is connected. distinct: fp, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(rows: np.ndarray) -> pa.RecordBatch:
            change = np.any(rows[1:, :3] != rows[:-1, :3], axis=1)
            bucket = np.concatenate([[0], np.cumsum(change)])
            u, v = star_edges(bucket, rows[:, 3].copy().view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1))
            if sum(map(len, held)) < BLOCK_ROWS:
                continue
            rows = np.concatenate(held)
            whole = np.flatnonzero(np.any(rows[1:, :3] != rows[:-1, :3], axis=1))
            cut = int(whole[-1]) + 1 if len(whole) else 0
            held = [rows[cut:]]
            if cut:
                yield out(rows[:cut])
        if held and len(rows := np.concatenate(held)):
            yield out(rows)

    place = ["kind", "g", "part"]
    dealt = bucketed(distinct, cap, distance).repartition(*place).sortWithinPartitions(*place, gray_rank(F.col("fp")))
    return dealt.mapInArrow(run, "u bigint, v bigint")


# links by Jaccard similarity


@lru_cache(maxsize=1)
def seeds() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors that make further hashes of a shingle's, one for each word of a wide fingerprint."""
    first, second = np.random.default_rng(SEED).integers(0, 1 << 63, (2, KEY_WORDS + CODE_WORDS), np.uint64)
    return first * np.uint64(2) + np.uint64(1), second * np.uint64(2) + np.uint64(1)


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingle hashes, KEY_WORDS + CODE_WORDS words of 64 bits; a tie is as in the smallest hash."""
    first, second = seeds()
    ones, least = np.zeros(64 * len(first), np.int64), None
    for i in range(0, len(shingles), 255):
        more = shingles[i : i + 255, None] * first
        more = (more ^ (more >> np.uint64(32))) * second
        more ^= more >> np.uint64(29)
        found = np.unpackbits(more.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        least = found[0] if least is None else least
        ones += found.sum(axis=0, dtype=np.uint8)
    if least is None:
        return np.zeros(len(first), np.uint64)
    return np.packbits(2 * ones + least > len(shingles), bitorder="little").view(np.uint64)


@lru_cache(maxsize=8)
def reach(bits: int) -> int:
    """Differing bits of so many that a link exceeds in MISS of the cases at most."""
    rest = 1.0
    for r in range(bits):
        rest -= math.comb(bits, r) * FLIP**r * (1 - FLIP) ** (bits - r)
        if rest < MISS:
            return r
    return bits


def sampled_bits(n: int) -> np.ndarray:
    """Places of the bits of each bucket key, one row a key.

    So many bits that a bucket has some FULL of n fingerprints, and so many keys that a link shares none in MISS of the cases at most.
    """
    bits = max(8, math.ceil(math.log2(max(n, 1) / FULL)))
    keys = math.ceil(math.log(MISS) / math.log1p(-((1 - FLIP) ** bits)))
    rng, a_turn = np.random.default_rng(SEED), 64 * KEY_WORDS // bits
    turns = [rng.permutation(64 * KEY_WORDS)[: a_turn * bits].reshape(a_turn, bits) for _ in range(-(-keys // a_turn))]
    return np.concatenate(turns)[:keys]


def sampled_buckets(sets: DataFrame, n: int) -> DataFrame:
    """g, fp, a, code: each of n sets (fp, a, code) in the bucket of each key, with the words that are compared."""
    places = sampled_bits(n)
    keys, bits = places.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power, number = np.int64(1) << np.arange(bits), np.arange(keys, dtype=np.int64) << bits
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                fp, a, raw = (batch.slice(i, 256).column(k) for k in range(3))
                words = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(len(fp), -1)
                ones = np.unpackbits(words[:, : 8 * KEY_WORDS], axis=1, bitorder="little")
                g = ones[:, places] @ power + number
                each = np.repeat(np.arange(len(fp)), keys)
                rest = pa.array([x.tobytes() for x in words[:, 8 * KEY_WORDS :]], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(g.ravel()), *(c.take(pa.array(each)) for c in (fp, a, rest))], ["g", "fp", "a", "code"])

    return sets.select("fp", "a", "code").mapInArrow(run, "g bigint, fp bigint, a bigint, code binary")


def gray_groups(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """g, fp: in each bucket of rows (g, fp, a, code) what near codes connect; a bucket over cap rows is a group as it is.

    Rows come by bucket and Gray rank of a; the index finds pairs that are near in a, and a and code have to be near together.
    """
    narrow = reach(64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: np.ndarray) -> pa.RecordBatch:
            bucket, code = np.concatenate([[0], np.cumsum(rows[1:, 0] != rows[:-1, 0])]), rows[:, 2:].copy().view(np.uint64)
            size = np.bincount(bucket)
            labels = (np.cumsum(size) - size)[bucket]
            small = np.flatnonzero(size[bucket] <= cap)
            labels[small] = small
            for x, y in GrayIndex(bucket[small], code[small, 0]).links(narrow) if len(small) else ():
                x, y = small[x], small[y]
                near = np.bitwise_count(code[x] ^ code[y]).sum(axis=1, dtype=np.int64) <= reach(64 * code.shape[1])
                labels = joined(labels, x[near], y[near])
            own = np.flatnonzero((np.bincount(labels, minlength=len(labels)) > 1)[labels])
            # a row that begins a bucket over cap isn't known where the bucket comes in several pieces: zero stands for it
            first = np.where(size[bucket] > cap, 0, rows[labels, 1])
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[own, 0], first[own], rows[own, 1])], ["g", "first", "fp"])

        held, passing = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64).reshape(batch.num_rows, -1)
            more = np.column_stack([*(batch.column(i).to_numpy() for i in range(3)), code])
            held = more if held is None else np.concatenate([held, more])
            if passing is not None:
                own = int(np.searchsorted(held[:, 0] != passing, True))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (held[:own, 0], np.zeros(own, np.int64), held[:own, 1])], ["g", "first", "fp"])
                held, passing = held[own:], passing if own == len(held) else None
            if len(held) < BLOCK_ROWS:
                continue
            whole = np.flatnonzero(held[1:, 0] != held[:-1, 0])
            cut = int(whole[-1]) + 1 if len(whole) else 0
            if len(held) - cut > cap:
                cut, passing = len(held), held[-1, 0]
            yield out(held[:cut])
            held = held[cut:]
        if held is not None and len(held):
            yield out(held)

    ready = rows.select("g", "fp", "a", "code").repartition("g").sortWithinPartitions("g", gray_rank(F.col("a")))
    return ready.mapInArrow(run, "g bigint, first bigint, fp bigint").select(F.xxhash64("g", "first").alias("g"), "fp")


def shingle_sets(docs: DataFrame, keep: list[str], shingle: int) -> DataFrame:
    """The columns in keep, fp (hash of the shingle set), size (shingles in it), and a and code (last word and others of its wide fingerprint)."""

    def make() -> Callable[[str], tuple]:
        def one(text: str) -> tuple:
            shingles = np.unique(shingle_hashes(text, shingle))
            fp = xxhash.xxh64_intdigest(shingles.tobytes(), SEED)
            return fp - (1 << 64) if fp >> 63 else fp, len(shingles), *parted(wide_fingerprint(shingles))

        def parted(words: np.ndarray) -> tuple[int, bytes]:
            return int(words[-1].astype(np.int64)), words[:-1].tobytes()

        return one

    return common.map_rows(docs, keep, make, "fp bigint, size bigint, a bigint, code binary")


def similar(sets: list[np.ndarray], similarity: tuple[int, int] = SIMILARITY) -> np.ndarray:
    """For each set the first row of its component, linked at the similarity or over; hashes are sorted, each once."""
    num, den = similarity
    sizes = np.array([len(x) for x in sets])
    labels = np.arange(len(sets))
    # i / (a + b - i) >= num / den, in whole numbers
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.zeros(2, np.int64) if both and (num + den) * both >= num * sizes.sum() else labels
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), sizes)
    ends = np.cumsum(sizes)
    by_id = np.argsort(ids, kind="stable")
    post, start = owner[by_id], np.concatenate([[0], np.cumsum(np.bincount(ids))])
    left = np.ones(len(sets), bool)
    held = len(sets)
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue and left.any():
            row = queue.pop()
            own = ids[ends[row] - sizes[row] : ends[row]]
            count = start[own + 1] - start[own]
            place = np.repeat(start[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            both = np.bincount(post[place], minlength=len(sets))
            found = np.flatnonzero(left & (both > 0) & ((num + den) * both >= num * (sizes + sizes[row])))
            labels[found], left[found] = seed, False
            queue += found.tolist()
            if left.sum() <= held // 2:
                # keep the places of what is still to be reached
                stays = left[post]
                start = np.concatenate([[0], np.cumsum(stays)])[start]
                post, held = post[stays], int(left.sum())
    return labels


def searched(rows: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """u, v: links that connect what is similar among rows with equal g and part. rows: g, part, fp; sets: fp, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, fps, held = None, [], []

        def out() -> pa.RecordBatch:
            code = np.array(fps, np.int64)
            labels = similar(held, similarity) if len(held) > 1 else np.zeros(len(held), np.int64)
            far = np.flatnonzero(labels != np.arange(len(labels)))
            return pa.RecordBatch.from_arrays([pa.array(code[far]), pa.array(code[labels[far]])], ["u", "v"])

        for batch in batches:
            for g, part, fp, shingles in zip(*(batch.column(i) for i in range(4))):
                if (now := (g.as_py(), part.as_py())) != place:
                    if held:
                        yield out()
                    place, fps, held = now, [], []
                fps.append(fp.as_py())
                held.append(np.frombuffer(shingles.as_py(), np.uint64))
        if held:
            yield out()

    placed = rows.join(sets, "fp").select("g", "part", "fp", "shingles").repartition("g", "part").sortWithinPartitions("g", "part", "fp")
    return placed.mapInArrow(run, "u bigint, v bigint")


def measured(pairs: DataFrame, sets: DataFrame, cap: int, similarity: tuple[int, int]) -> DataFrame:
    """fp, pivot, far (Jaccard distance), linked of each of the pairs (fp, pivot).

    A pivot goes to each part of its rows, so a task holds one pivot and one row at a time, however many rows a pivot has.
    """
    num, den = similarity
    parts = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / cap).cast("int").alias("parts"))
    rows = pairs.join(parts, "pivot").select("pivot", F.pmod(F.xxhash64("fp"), "parts").cast("int").alias("part"), "fp", F.lit(1).alias("kind"))
    heads = parts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("pivot").alias("fp"), F.lit(0).alias("kind"))
    place = ["pivot", "part", "kind"]
    placed = rows.unionByName(heads).join(sets, "fp").select(*place, "fp", "shingles").repartition("pivot", "part").sortWithinPartitions(*place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            fps, pivots, far, linked = [], [], [], []
            for pivot, _, kind, fp, shingles in zip(*(batch.column(i) for i in range(5))):
                own = np.frombuffer(shingles.as_py(), np.uint64)
                if not kind.as_py():
                    head = own
                    continue
                both = int((head[np.minimum(np.searchsorted(head, own), len(head) - 1)] == own).sum())
                either = len(head) + len(own) - both
                fps.append(fp.as_py())
                pivots.append(pivot.as_py())
                far.append(1 - both / either)
                linked.append(den * both >= num * either)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((fps, pivots, far, linked), kinds)], ["fp", "pivot", "far", "linked"])

    return placed.mapInArrow(run, "fp bigint, pivot bigint, far double, linked boolean")


def _too_large(rows: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """rows (g, fp, size) of buckets that one task may search, and those of larger ones, with their rows (n) and number of chunks."""
    sums = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all"))
    chunks = F.greatest(F.ceil(F.col("n") / cap), F.ceil(F.col("all") * 8 / SET_BYTES)).cast("int")
    both = rows.join(sums.select("g", "n", chunks.alias("chunks")), "g")
    return both.where("chunks <= 1"), both.where("chunks > 1")


def _pairs_of_chunks(hot: DataFrame) -> DataFrame:
    """g, part, fp: each two chunks of a bucket side by side. hot: g, fp, chunks."""
    dealt = hot.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("own != other")
    part = F.least("own", "other") * F.col("chunks") + F.greatest("own", "other")
    return dealt.select("g", part.alias("part"), "fp")


def star_rounds(hot: DataFrame, sets: DataFrame, cap: int, similarity: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Rows still to be searched (g, part, fp), and all distances to pivots (fp, pivot, far, linked).

    hot: g, fp, size, central (rows in the large buckets of a row) of the buckets that are too large. In each round a
    bucket's pivots are the most central rows of PIVOTS slots by hash: rows in the midst of near copies share most
    buckets with others. Slots and order are the same in all buckets, so that a pair is measured once however many
    buckets have it. A row leaves the bucket once a pivot links to it.
    """
    spark, seen, left, now = hot.sparkSession, [], [], hot
    for turn in range(ROUNDS):
        small, large = _too_large(now, cap)
        left.append(small.select("g", F.lit(0).alias("part"), "fp"))
        now = common.written(large.select("g", "fp", "size", "central"), "open")
        if now.isEmpty():
            break
        slot = F.pmod(F.xxhash64("fp", F.lit(-turn - 1)), F.lit(PIVOTS))
        least = now.groupBy("g", slot.alias("slot")).agg(F.min(F.struct(-F.col("central"), F.xxhash64("fp", F.lit(turn)), "fp")).alias("least"))
        pivots = least.groupBy("g").agg(F.collect_list("least.fp").alias("pivots"))
        asked = common.written(now.join(pivots, "g").select("g", "fp", "size", "central", F.explode("pivots").alias("pivot")), "asked")
        far = common.written(measured(asked.select("fp", "pivot").distinct(), sets, cap, similarity), "far")
        seen.append(far)
        reached = asked.join(far, ["fp", "pivot"]).groupBy("g", "fp", "size", "central").agg(F.bool_or("linked").alias("linked"))
        now = common.written(reached.where("not linked").drop("linked"), "rest")
    else:
        small, large = _too_large(now, cap)
        left += [small.select("g", F.lit(0).alias("part"), "fp"), _pairs_of_chunks(large)]
    rows, far = left[0], spark.createDataFrame([], "fp bigint, pivot bigint, far double, linked boolean")
    for more in left[1:]:
        rows = rows.unionByName(more)
    for more in seen:
        far = far.unionByName(more)
    return rows, far


def border_rows(far: DataFrame, roots: DataFrame, cap: int, similarity: tuple[int, int]) -> DataFrame:
    """g, part, fp: what stars can't tell. Rows that no pivot links to may link to rows round a pivot.

    Distances obey the triangle inequality: a row at distance b of a pivot links to none at distance a where b - a is
    over the limit of a link, so only pairs within it are searched, and only where the row isn't in the pivot's component yet.
    """
    reach = 1 - similarity[0] / similarity[1] + 1e-9
    named = roots.select(F.col("u").alias("fp"), F.col("v").alias("root"))
    outer = far.where((~F.col("linked")) & (F.col("far") <= 2 * reach)).distinct()
    outer = outer.join(named, "fp", "left").join(named.select(F.col("fp").alias("pivot"), F.col("root").alias("pivot_root")), "pivot", "left")
    outer = outer.where(F.coalesce("root", "fp") != F.coalesce("pivot_root", "pivot")).select("pivot", "fp", "far")
    outer = common.written(outer, "border")
    nearest = outer.groupBy("pivot").agg(F.min("far").alias("nearest"), F.ceil(F.count(F.lit(1)) / cap).cast("int").alias("outers"))
    inner = far.where("linked").select("fp", "pivot", "far").distinct().join(nearest, "pivot").where(F.col("far") >= F.col("nearest") - reach)
    inner = common.written(inner.select("pivot", "fp", "outers"), "round-pivots")
    inners = inner.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / cap).cast("int").alias("inners"), F.first("outers").alias("outers"))

    sides = [
        inner.drop("outers").join(inners, "pivot").select("pivot", "fp", "outers", F.pmod(F.xxhash64("fp"), "inners").alias("i"), F.explode(F.sequence(F.lit(0), F.col("outers") - 1)).alias("o")),
        outer.join(inners, "pivot").select("pivot", "fp", "outers", F.pmod(F.xxhash64("fp"), "outers").alias("o"), F.explode(F.sequence(F.lit(0), F.col("inners") - 1)).alias("i")),
    ]
    both = sides[0].unionByName(sides[1])
    return both.select(F.col("pivot").alias("g"), (F.col("i") * F.col("outers") + F.col("o")).alias("part"), "fp")


def unjoined(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (g, ...) of the buckets that are not in one component yet. roots: u, v as of stars()."""
    named = rows.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("g", F.coalesce("root", "fp").alias("root"))
    return rows.join(named.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high"), "g", "left_semi")


def similar_edges(key: DataFrame, marked: DataFrame, shingle: int, cap: int = SET_CAP, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """u, v: links that connect the shingle sets of the similarity or over. key: text_key, text; marked: text_key, fp, size, a, code."""
    num, den = similarity
    if num * SIMILARITY[1] < den * SIMILARITY[0]:
        raise ValueError("FLIP is for links at SIMILARITY or over")
    distinct = marked.groupBy("fp").agg(F.min("text_key").alias("text_key"), *[F.first(c).alias(c) for c in ("size", "a", "code")])
    distinct = common.written(distinct, "sets")
    # of two different sets the smaller one, of s shingles, is at s / (s + 1) at most
    able = distinct.where(F.col("size") * (den - num) >= num)
    groups = common.written(gray_groups(sampled_buckets(able, able.count())), "gray-groups")
    # fewer once they are compared in more words
    words = able.select("fp", "a", F.substring("code", -8 * (CHECK_WORDS - 1), 8 * (CHECK_WORDS - 1)).alias("code"))
    groups = common.written(gray_groups(groups.join(words, "fp")), "near-groups")

    def make() -> Callable[[str], tuple]:
        return lambda text: (np.unique(shingle_hashes(text, shingle)).tobytes(),)

    named = distinct.select("fp", "text_key").join(groups.select("fp").distinct(), "fp", "left_semi")
    texts = key.select("text_key", "text").join(named, "text_key")
    sets = common.written(common.map_rows(texts, ["fp"], make, "shingles binary").dropDuplicates(["fp"]), "near-sets")

    # a row is in many groups that share most of their rows: what these connect is searched once, so a set is sent once
    least = groups.groupBy("g").agg(F.min("fp").alias("v"))
    roots = stars(groups.join(least, "g").select(F.col("fp").alias("u"), "v"))
    whole = roots.select(F.col("v").alias("g"), F.col("u").alias("fp")).unionByName(roots.select(F.col("v").alias("g"), F.col("v").alias("fp")).distinct())
    small, large = _too_large(whole.join(distinct.select("fp", "size"), "fp").select("g", "fp", "size"), cap)
    placed = common.written(small.unionByName(large).select("g", "fp", "size", "chunks"), "candidates")
    few = placed.where("chunks <= 1").select("g", F.lit(0).alias("part"), "fp")
    links = searched(few.unionByName(_pairs_of_chunks(placed.where((F.col("chunks") > 1) & (F.col("chunks") <= CHUNKS)))), sets, similarity)
    large = placed.where(F.col("chunks") > CHUNKS).select("fp", "size")
    if large.isEmpty():
        return links

    rows = groups.join(large, "fp").select("fp", "size", "g")
    sums = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("y"))
    buckets = sums.groupBy("n", "x", "y", "size").agg(F.min("g").alias("g"))
    cold, hot = _too_large(common.written(rows.join(buckets.select("g"), "g"), "groups"), cap)
    cold = cold.select("g", F.lit(0).alias("part"), "fp")
    hot = common.written(hot.select("g", "fp", "size", "n"), "large-buckets")
    if hot.isEmpty():
        return links.unionByName(searched(cold, sets, similarity))
    hot = hot.join(hot.groupBy("fp").agg(F.sum("n").alias("central")), "fp").drop("n")
    left, far = star_rounds(hot, sets, cap, similarity)
    linked = far.where("linked").select(F.col("fp").alias("u"), F.col("pivot").alias("v"))
    roots = stars(searched(left, sets, similarity).unionByName(linked))
    still = unjoined(cold, roots).unionByName(border_rows(far, roots, cap, similarity))
    return links.unionByName(roots).unionByName(searched(still, sets, similarity))


# components


def stars(links: DataFrame) -> DataFrame:
    """u, v of each node but the roots: v is the smallest node of its component. As many rounds as it takes."""
    ends = lambda df: df.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen = common.written(ends(links), "edges"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return now
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = common.written(ends(large), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined_ = large.join(least, "u")
        small = joined_.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = common.written(ends(small), "small-star")


def components(marked: DataFrame, cap: int = CAP, links: DataFrame | None = None) -> DataFrame:
    """fp, root, component_id of each distinct fingerprint. marked: doc_id, fp; links: u, v, if not those of edges()."""
    distinct = common.written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    roots = stars(edges(distinct.select("fp"), cap) if links is None else links)
    named = distinct.join(roots.select(F.col("u").alias("fp"), "v"), "fp", "left").withColumn("root", F.coalesce("v", "fp"))
    named = common.written(named.select("fp", "first_id", "root"), "rooted")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return named.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, cap: int = CAP) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of docs."""
    marked = common.written(fingerprints(docs, ["doc_id"], shingle), "marked")
    return marked.join(components(marked, cap), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, cap: int = CAP, similarity: tuple[int, int] | None = None) -> DataFrame:
    """Of each component the row with the smallest doc_id (then text hash), with all columns of docs.

    With a similarity, links are the pairs whose shingle sets have it or more, not those of near fingerprints.
    """
    names = docs.columns
    mark, keep_id, keep_text, first = common.free_names(names, "text_key", "keep_id", "keep_text", "first")
    key = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    if similarity is None:
        marked, links = common.written(fingerprints(key, ["doc_id", "text_key"], shingle), "marked"), None
    else:
        marked = common.written(shingle_sets(key, ["doc_id", "text_key"], shingle), "marked")
        links = similar_edges(key, marked, shingle, min(cap, SET_CAP), similarity)
    found = marked.select("doc_id", "text_key", "fp").join(components(marked, cap, links), "fp")
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best"))
    kept = least.select(F.col("best.doc_id").alias(keep_id), F.col("best.text_key").alias(keep_text))
    rows = docs.withColumn(mark, F.xxhash64("text")).join(kept, F.col("doc_id").eqNullSafe(F.col(keep_id)) & (F.col(mark) == F.col(keep_text)), "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id", mark).orderBy("text"))
    return rows.withColumn(first, place).where(F.col(first) == 1).select(*[F.col(f"`{c}`") for c in names])


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
