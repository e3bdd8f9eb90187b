"""What the operators of this folder share: tables, scratch folders, Arrow maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_dir

#: White space of the word rules: blank, tab, line feed, vertical tab, form feed, return.
#: bytes.split() without arguments splits at exactly these.
BLANKS = "[\\x20\\x09-\\x0D]"
#: Rows whose new values a task holds at once.
ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, what: str, **options: str) -> DataFrame:
    """The rows as a table in the shared folder, read back: cuts the lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Names for columns of an operator's own that no column of the table has (Spark doesn't tell case apart)."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """Texts one by one, so that a batch of long texts is never held twice; null is empty."""
    for x in batch.column(column):
        yield x.as_py() or ""


def map_rows(df: DataFrame, keep: list[str], make: Callable[[], Callable[[str], tuple]], schema: str) -> DataFrame:
    """Adds columns computed from ``text``, one row in, one row out.

    keep: columns handed through. make() is called once in each task and
    returns a function from a text to the values of the added columns.
    schema: DDL of the added columns.
    """
    given = df.select(*keep, "text")
    out = given.drop("text") if "text" not in keep else given
    full = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields] + [schema])
    from pyspark.sql.types import _parse_datatype_string

    added = _parse_datatype_string(schema)
    names = [f.name for f in added.fields]
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, max(1, whole.num_rows), ROWS)):
            rows = [one(text) for text in texts_of(batch)]
            columns = [batch.column(c) for c in keep]
            columns += [pa.array(list(v), k) for v, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, keep + names)

    return given.mapInArrow(run, full)
