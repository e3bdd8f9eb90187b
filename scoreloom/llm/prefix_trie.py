"""Operator 12: a prefix trie of conversations, in shards of succinct level-order tries.

A node is a distinct sequence of first turns. Its key is the exclusive or of one
128-bit number for each turn, made of the turn's SHA-256 and its place, so that
keys are running folds: rows are sorted by range, each partition folds its own,
and what a partition is to add (one row of it) is known after one small
aggregate. No conversation, however long, has to be in one task.

Counts of a node are a plain aggregate over keys. A node of more than `heavy`
conversations is heavy; the trie below falls apart into the subtrees whose top is
not heavy but whose parent is: the shards. Many shards are worked on at once as a
forest: numpy sorts its nodes by level, writes the LOUDS bits (a one for each
child, a zero after each node) and the labels, gets parents from the bits, and
rolls leaves and savings up level by level in reverse order with np.add.at. The
shards' sums are added by parent; the heavy nodes are a trie of their own (at most
conversations / heavy a level) and rolled up by the same code, separately. Below
its first node, the part of a conversation that no other one shares is no part of
a shard: it is a path with one leaf and nothing to save.

Lists of members that end at a node are joined to stretches by ranges, and the
stretches hashed as a stream, so no list is ever held whole.

Rows: a turn without conv_id belongs to no conversation and is left out; null
role and text are empty; turns of one number go by the SHA-256 of role and text,
repeated rows count each; conversations without turns are members of the root;
an empty table gives an empty result; columns other than conv_id, turn, role and
text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common

#: Conversations that share by number, and the most turns that one takes from another.
GROUP, MOST_TAKEN = 20, 3
#: A node with more members is heavy; of a large table, one with more than this share of all.
LEAST_HEAVY, MOST_UPPER = 256, 20_000
#: Nodes of whole shards worked on at once; members in a stretch of a list.
FOREST, STRETCH = 1 << 17, 4096
_NODE = "ka bigint, kb bigint, pa bigint, pb bigint, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, total bigint, top boolean"
_ADDED = ("extra_children", "extra_leaves", "extra_saved")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, key (16 bytes for role and text), words."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    key = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    words = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), words.alias("words"))


def folded(rows: DataFrame, order: list[str], rank: str, values: Callable[[pa.RecordBatch], np.ndarray], names: list[str], fold: np.ufunc, undo: np.ufunc, what: str) -> DataFrame:
    """The rows with running folds of values (a column for each name) within a conversation.

    order: columns that rows of a conversation are sorted by; rank: a column, one
    of the names maybe, that grows along a conversation; undo takes a fold back.
    Partitions are ranges; each folds its own rows, and the first conversation of
    a partition gets the fold of those before, two values a partition.
    """
    spark, columns = rows.sparkSession, rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry = TaskContext.get().partitionId(), None, np.zeros(len(names), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            group, v = batch.column("conv_id").to_numpy(), values(batch)
            total = fold.accumulate(v, axis=0)
            start = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), np.arange(len(group)), 0))
            out = undo(total, undo(total, v)[start])
            if group[0] == last:
                first = start == 0
                out[first] = fold(out[first], carry)
            last, carry = group[-1], out[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(group), part)), *map(pa.array, out.T.copy())], [*columns, "part", *names])

    shape = StructType([*rows.schema.fields, *(StructField(n, LongType()) for n in ("part", *names))])
    table = common.written(rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order).mapInArrow(run, shape), what)
    ends = table.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", rank, *(n for n in names if n != rank))).alias("last"))
    before, held, sums = [], None, np.zeros(len(names), np.int64)
    for row in ends.orderBy("part").collect():  # a row for each partition
        own = np.array([row["last"][n] for n in names])
        if row["first"] == held:
            before.append((row["part"], row["first"], *sums.tolist()))
        sums = fold(sums, own) if row["last"]["conv_id"] == held else own
        held = row["last"]["conv_id"]
    added = spark.createDataFrame(before, "part bigint, conv_id bigint, " + ", ".join(f"{n}_before bigint" for n in names))
    join = table.join(F.broadcast(added), ["part", "conv_id"], "left")
    back = F.coalesce
    whole = {n: (back(f"{n}_before", F.lit(0)).bitwiseXOR(F.col(n)) if fold is np.bitwise_xor else back(f"{n}_before", F.lit(0)) + F.col(n)) for n in names}
    return join.select(*columns, *(whole[n].alias(n) for n in names))


def mixed(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Two numbers for a turn's two at a place."""
    x = key + place.astype(np.uint64)[:, None] * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def turn_numbers(batch: pa.RecordBatch) -> np.ndarray:
    key = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint64).reshape(-1, 2)
    return mixed(key, batch.column("depth").to_numpy())


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths: conv_id, depth, total, words, key of the node and of its parent; and conv_id, total of each conversation."""
    ones = lambda batch: np.ones((batch.num_rows, 1), np.int64)
    given = folded(turns(conversations), ["turn", "key"], "place", ones, ["place"], np.add, np.subtract, "turns")
    sizes = given.groupBy("conv_id").agg(F.count("*").alias("size"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_TAKEN + 1)).alias("taken")
    plan = sizes.select("conv_id", "size", taken, (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    plan = plan.join(sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size")), "base", "left")
    plan = plan.withColumn("head", F.least("taken", F.coalesce("base_size", F.lit(0))))
    plan = common.written(plan.select("conv_id", "base", "taken", "head", (F.col("head") + F.greatest(F.lit(0), F.col("size") - F.col("taken"))).alias("total")), "conversations")
    # a conversation's first turns go to those of its own twenty numbers
    heads = given.where((F.col("place") <= MOST_TAKEN) & (F.col("conv_id") % GROUP == 0)).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "key", "words")
    shared = plan.where("head > 0").join(heads, "base").where("depth <= head").select("conv_id", "depth", "total", "key", "words")
    own = given.join(plan, "conv_id").where("place > taken").select("conv_id", (F.col("head") + F.col("place") - F.col("taken")).alias("depth"), "total", "key", "words")
    keyed = folded(shared.union(own), ["depth"], "depth", turn_numbers, ["ka", "kb"], np.bitwise_xor, np.bitwise_xor, "paths")
    return keyed, plan.select("conv_id", "total")


class Louds:
    """A forest in level order: bits (a one for each child, then a zero) for the root above its tops and for every node, and labels.

    level: of each node; key, parent: pairs of numbers, a pair of -1 rows for tops not needed as they have level 0.
    order: the given nodes in the forest's order, which is the order of the ones.
    """

    def __init__(self, level: np.ndarray, key: np.ndarray, parent: np.ndarray):
        by_key = np.lexsort((key[:, 1], key[:, 0], level))
        self.starts = np.searchsorted(level[by_key], np.arange(int(level.max(initial=-1)) + 2))
        order, counts = [], []
        above = np.zeros(0, np.int64)
        for first, last in zip(self.starts, self.starts[1:]):
            nodes = by_key[first:last]
            if first:
                # above is sorted by key; numbers that agree in their first half are told apart by the second
                at = np.searchsorted(key[above, 0], parent[nodes, 0])
                while (off := key[above[at], 1] != parent[nodes, 1]).any():
                    at[off] += 1
                rank = self.rank[at]
                counts.append(np.bincount(rank, minlength=len(above)))
                place = np.lexsort((key[nodes, 0], rank))
            else:
                counts.append(np.array([last]))
                place = np.arange(last)
            self.rank = np.empty(len(nodes), np.int64)
            self.rank[place] = np.arange(len(nodes))
            above = nodes
            order.append(nodes[place])
        counts.append(np.zeros(len(above), np.int64))
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)
        ends = np.cumsum(np.concatenate(counts) + 1) - 1 if order else np.zeros(1, np.int64)
        self.bits = np.ones(int(ends[-1]) + 1, bool)
        self.bits[ends] = False
        self.labels = key[self.order, 0]

    def parents(self) -> np.ndarray:
        """For each node the place of its parent, counted from the root above the tops: zeros before the node's one."""
        return np.cumsum(~self.bits)[self.bits]

    def children(self) -> np.ndarray:
        """For the root above and each node the number of ones between two zeros."""
        return np.diff(np.flatnonzero(~self.bits), prepend=-1) - 1

    def rolled(self, values: np.ndarray) -> np.ndarray:
        """Sums of values (in the forest's order) over subtrees: levels in reverse, each added to its parents."""
        out, parent = np.concatenate([np.zeros((1, values.shape[1]), np.int64), values]), self.parents()
        for first, last in zip(self.starts[-2::-1], self.starts[:0:-1]):
            np.add.at(out, parent[first:last], out[first + 1 : last + 1])
        return out[1:]


def rolled_up(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Nodes with their sums, from rows sorted by shard; a forest has whole shards and some `size` nodes."""

    def forest(table: pa.Table) -> pa.RecordBatch:
        c = {n: table[n].to_numpy() for n in table.column_names}
        tree = Louds(c["level"], np.stack([c["ka"], c["kb"]], axis=1), np.stack([c["pa"], c["pb"]], axis=1))
        c = {n: v[tree.order] for n, v in c.items()}
        n_children = tree.children()[1:] + c["extra_children"]
        own = np.stack([c["extra_leaves"] + (n_children == 0), c["extra_saved"] + (c["n_convs"] - 1) * c["words"]], axis=1)
        leaves, saved = tree.rolled(own).T
        parent, top = tree.parents(), c["level"] == 0
        above = np.where(top, c["up"], np.append(0, c["conv_id"])[parent])
        found = c | {"n_children": n_children, "n_leaves": leaves, "saved_tokens": saved, "parent_conv_id": above, "top": top}
        names = [f.split()[0] for f in _NODE.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[n])) for n in names], names)

    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if rows >= size:
            # what belongs to the last shard goes with the rows held
            shard, last = (np.stack([b.column(n).to_numpy() for n in ("sa", "sb")], axis=1) for b in (batch, held[-1]))
            new = np.flatnonzero((shard != last[-1]).any(axis=1))
            cut = int(new[0]) if len(new) else batch.num_rows
            held.append(batch.slice(0, cut))
            rows, batch = rows + cut, batch.slice(cut)
            if batch.num_rows:
                yield forest(pa.Table.from_batches(held))
                held, rows = [], 0
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
    if held:
        yield forest(pa.Table.from_batches(held))


def end_hashes(members: DataFrame) -> DataFrame:
    """ka, kb, ends_sha256 from ka, kb, conv_id: SHA-256 of the numbers in order, with commas between."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ka", "kb", "first", "ids"]
        for batch in batches:
            key, ids = np.stack([batch.column(n).to_numpy() for n in names[:2]], axis=1), batch.column("conv_id").to_numpy()
            if len(ids):
                starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
                starts = np.concatenate([np.arange(a, b, STRETCH) for a, b in zip(starts, np.append(starts[1:], len(ids)))])
                text = [",".join(map(str, x.tolist())) for x in np.split(ids, starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(key[starts, 0]), pa.array(key[starts, 1]), pa.array(ids[starts]), pa.array(text)], names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], ["ka", "kb", "ends_sha256"])
            done.clear()
            return out

        for batch in batches:
            for ka, kb, ids in zip(*(batch.column(n).to_pylist() for n in ("ka", "kb", "ids"))):
                if (ka, kb) == key:
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (ka, kb), hashlib.sha256()
                state.update(ids.encode())
            yield sent()
        if key is not None:
            done.append((*key, state.hexdigest()))
        yield sent()

    ranges = members.select("ka", "kb", "conv_id").repartitionByRange("ka", "kb", "conv_id").sortWithinPartitions("ka", "kb", "conv_id")
    parts = ranges.mapInArrow(stretches, "ka bigint, kb bigint, first bigint, ids string")
    return parts.repartition("ka", "kb").sortWithinPartitions("ka", "kb", "first").mapInArrow(hashed, "ka bigint, kb bigint, ends_sha256 string")


def nodes_of(conversations: DataFrame, heavy: int | None = None, forest: int = FOREST) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node.

    heavy: members from which on a node is not in a shard, if not by the table's size.
    """
    spark = conversations.sparkSession
    paths, members = rebuilt(conversations)
    count, least = members.agg(F.count("*"), F.min("conv_id")).first()
    heavy = max(LEAST_HEAVY, count // MOST_UPPER) if heavy is None else heavy
    found = paths.groupBy("ka", "kb", "depth").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.max("total").alias("total"),
        F.min(F.struct("conv_id", "key")).alias("last"),
    )
    # the parent's key is the node's without its last turn
    found = common.written(without_last(found), "nodes")
    single = found.where("n_convs = 1").groupBy("conv_id").agg(F.min("depth").alias("single"))
    upper = found.where(F.col("n_convs") > heavy)
    # for each conversation its deepest heavy node; all others hang below the root
    up = paths.join(upper.select("ka", "kb", F.col("conv_id").alias("up")), ["ka", "kb"]).groupBy("conv_id").agg(F.max(F.struct("depth", "up")).alias("deep"))
    tops = paths.select("conv_id", "depth", "ka", "kb").join(up, "conv_id", "left").withColumn("base", F.coalesce("deep.depth", F.lit(0)))
    tops = tops.where("depth = base + 1").select("conv_id", F.col("ka").alias("sa"), F.col("kb").alias("sb"), "base", F.coalesce("deep.up", F.lit(least)).alias("up"))
    below = found.join(tops, "conv_id").where("depth > base").join(single, "conv_id", "left")
    alone = (F.col("n_convs") == 1) & (F.col("total") > F.col("depth"))
    inside = below.where("single is null or depth <= single").select(
        "sa", "sb", (F.col("depth") - F.col("base") - 1).alias("level"), "ka", "kb", "pa", "pb", "depth", "conv_id", "up", "n_convs", "words", "total",
        alone.cast("long").alias("extra_children"), alone.cast("long").alias("extra_leaves"), F.lit(0).cast("long").alias("extra_saved"),
    )
    rows = inside.repartition("sa", "sb").sortWithinPartitions("sa", "sb")
    shards = common.written(rows.mapInArrow(lambda batches: rolled_up(batches, forest), _NODE), "shards")
    tails = below.where("depth > single").select(
        "ka", "kb", "depth", "conv_id", F.col("conv_id").alias("parent_conv_id"), "n_convs", alone.cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), "total",
    )
    sums = shards.where("top").groupBy("pa", "pb").agg(F.count("*").alias("extra_children"), F.sum("n_leaves").alias("extra_leaves"), F.sum("saved_tokens").alias("extra_saved"))
    zero = F.lit(0).cast("long")
    root = members.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(*(zero.alias(n) for n in ("ka", "kb", "pa", "pb", "depth")), "conv_id", "n_convs", zero.alias("words"), zero.alias("total"))
    upper = root.union(upper.select(root.columns)).join(sums.select(F.col("pa").alias("ka"), F.col("pb").alias("kb"), *_ADDED), ["ka", "kb"], "left")
    upper = upper.select(
        zero.alias("sa"), zero.alias("sb"), F.col("depth").alias("level"), "ka", "kb", "pa", "pb", "depth", "conv_id", zero.alias("up"), "n_convs", "words", "total",
        *(F.coalesce(n, zero).alias(n) for n in _ADDED),
    )
    # at most conversations / heavy nodes a level
    heads = upper.repartition(1).mapInArrow(lambda batches: rolled_up(batches, forest), _NODE)
    columns = tails.columns
    made = shards.select(columns).union(heads.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("parent_conv_id"))).select(columns))
    # members that end where others still are; those that end alone are known from their node
    shared = paths.where("depth = total").join(single, "conv_id", "left_anti").select("ka", "kb", "conv_id")
    ends = end_hashes(shared.union(members.where("total = 0").select(zero, zero, "conv_id")))
    made = made.join(ends, ["ka", "kb"], "left").select(columns + ["ends_sha256"]).union(tails.withColumn("ends_sha256", F.lit(None).cast("string")))
    own = F.when((F.col("n_convs") == 1) & (F.col("total") == F.col("depth")) & (F.col("depth") > 0), F.col("conv_id").cast("string")).otherwise("")
    return made.select(*(c for c in columns[2:] if c != "total"), F.coalesce("ends_sha256", F.sha2(own.cast("binary"), 256)).alias("ends_sha256"))


def without_last(found: DataFrame) -> DataFrame:
    """Adds pa and pb: the key without the number of the last turn."""
    columns = [c for c in found.columns if c != "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key = np.stack([batch.column(n).to_numpy() for n in ("ka", "kb")], axis=1)
                above = key ^ turn_numbers(batch)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(above[:, 0].copy()), pa.array(above[:, 1].copy())], [*columns, "pa", "pb"])

    given = found.select(*columns, F.col("last.key").alias("key"))
    shape = StructType([*found.select(columns).schema.fields, StructField("pa", LongType()), StructField("pb", LongType())])
    return given.mapInArrow(run, shape)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes_of(common.table(spark, sf_dir, "conversations"))


OP12_SQL = """
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) - 1 AS p FROM turns
), sizes AS (
    SELECT conv_id, count(*) AS size, hex(encode(CAST(conv_id AS VARCHAR))) AS x, conv_id - conv_id % 20 AS base FROM placed GROUP BY conv_id
), hashed AS (
    SELECT conv_id, base, size, xor(list_reduce(
        list_transform(range(0, 4 * length(x)), lambda j: (CAST('0x' || substr(x, CAST(2 * (j // 8) + 1 AS INTEGER), 2) AS BIGINT) >> (j % 8)) & 1),
        lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), CAST(4294967295 AS BIGINT)), 4294967295) % 4 AS h
    FROM sizes
), plan AS (
    SELECT a.conv_id, a.base, a.h, least(a.h, coalesce(b.size, 0)) AS m FROM hashed a LEFT JOIN hashed b ON b.conv_id = a.base
), rebuilt AS (
    SELECT c.conv_id, t.p + 1 AS d, t.role, t.text FROM plan c JOIN placed t ON t.conv_id = c.base AND t.p < c.m
    UNION ALL
    SELECT c.conv_id, c.m + t.p - c.h + 1, t.role, t.text FROM plan c JOIN placed t ON t.conv_id = c.conv_id AND t.p >= c.h
), paths AS (
    SELECT conv_id, d, text, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY d) AS path, count(*) OVER (PARTITION BY conv_id) = d AS ended FROM rebuilt
    UNION ALL
    SELECT conv_id, 0, '', [], conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM plan
), nodes AS (
    SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\\x20\\x09-\\x0D]+')) AS saved,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
    FROM paths GROUP BY path, d
), below AS (
    SELECT path[1:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), known AS (
    SELECT n.*, coalesce(b.n_children, 0) AS n_children FROM nodes n LEFT JOIN below b ON b.path = n.path
), sums AS (
    SELECT path[1:i] AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens FROM known, unnest(range(0, d + 1)) t(i) GROUP BY 1
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(n.n_children AS BIGINT) AS n_children,
    CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM known n JOIN sums s ON s.path = n.path LEFT JOIN known p ON n.d > 0 AND p.path = n.path[1:n.d - 1]
"""
