"""Operator 6: exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is summed to one
row a digest (map-side first, so a digest that a third of the rows share costs
no more than another), anti-joined with the index by sort-merge without
shuffling the index, and what is new is appended. A digest that the index knows
keeps the row that it came with; all rows of a later batch that have it go.

Rows: null text counts as empty, and empty texts are equal to each other; a
null doc_id comes after any other; of repeated rows (equal doc_id and equal
text) one stays; an empty table gives an empty result; other columns are kept
by keep_first() and not read otherwise. group_size counts rows of the batch
that brought the digest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BUCKETS = 32


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), common.BLANKS + "+", "")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normal(text), 256))


class DigestIndex:
    """Persistent index at `path`; `buckets` grows with the corpus (each bucket should sort in memory)."""

    schema = "digest BINARY, keep_id BIGINT, keep_chars INT, group_size BIGINT, batch INT"

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({self.schema}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def rows(self) -> DataFrame:
        """The same rows without their bucketing, for joins whose other side may be skewed."""
        return self.spark.read.schema(self.schema).parquet(self.path)

    def add(self, batch: DataFrame, number: int = 0) -> None:
        """batch: doc_id, digest, chars. Appends one row for each digest that the index lacks."""
        best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id"))
        new = batch.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        # written first: else the anti-join is pushed below the sums, and rows of a frequent digest meet unsummed
        new = common.written(new, "batch-digests")
        fresh = new.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        rows = fresh.select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("keep_chars"), "group_size", F.lit(number).cast("int").alias("batch"))
        self._append(rows)

    def _append(self, rows: DataFrame) -> None:
        rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)

    def compacted(self) -> DigestIndex:
        """The same rows in a new folder, one file a bucket again (each batch adds one)."""
        new = DigestIndex(self.spark, f"{self.path}-{uuid.uuid4().hex}", self.buckets)
        new._append(self.rows())
        return new

    def close(self) -> None:
        """Drops the name; the files stay, and an index over the same path goes on with them."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", digest(F.col("text")).alias("digest"), F.length(F.coalesce("text", F.lit(""))).alias("chars"))


def buckets_for(spark: SparkSession) -> int:
    return max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def decide(docs: DataFrame, index: DigestIndex, number: int = 0) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    batch = common.written(keyed(docs), "digests")
    index.add(batch, number)
    # rows that are alike in all three are counted first and told apart at the end, so the join can be split anywhere
    alike = batch.groupBy("digest", "doc_id", "chars").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    found = alike.join(index.rows(), "digest")
    mine = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars")) & (F.col("batch") == number)
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select("doc_id", "keep_id", "group_size", (mine & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, index: DigestIndex, number: int = 0) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    names = docs.columns
    mark, size, own, keep, first = common.free_names(names, "digest", "chars", "own_digest", "keep_id", "first")
    index.add(common.written(keyed(docs), "digests"), number)
    kept = index.rows().where(F.col("batch") == number).select(F.col("digest").alias(own), F.col("keep_id").alias(keep))
    marked = docs.withColumn(mark, digest(F.col("text"))).withColumn(size, F.length(F.coalesce("text", F.lit(""))))
    # dealt by digest and doc_id: the many rows of one digest spread
    found = marked.join(kept, (F.col(mark) == F.col(own)) & F.col("doc_id").eqNullSafe(F.col(keep)), "left_semi")
    place = F.row_number().over(Window.partitionBy(mark, "doc_id").orderBy(F.col(size).desc(), "text"))
    return found.withColumn(first, place).where(F.col(first) == 1).select(*[F.col(f"`{c}`") for c in names])


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, common.shared_dir(spark, "digest-index"), buckets_for(spark))
    try:
        return decide(common.table(spark, sf_dir, "documents"), index)
    finally:
        index.close()


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM t
WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
