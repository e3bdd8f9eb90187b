"""Missing answers, their retries and the merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring

VALID = (*scoring.LETTERS, scoring.DECLINED)
META = ("retry_run_id", "retry_timestamp", "retry_attempt", "retry_source")


def id_column(columns: list[str]) -> str:
    """M03."""
    for c in ("question_id", "id"):
        if c in columns:
            return c
    raise ValueError("no id column: question_id or id")


def missing(rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows without a valid prediction, and why."""
    p = scoring.normalized("predicted")
    return rows.where(p.isNull() | ~p.isin(*VALID)).select(key, F.when(p.isNull(), "missing").otherwise("invalid").alias("why"), p.alias("value"))


def invalid_counts(rows: DataFrame) -> DataFrame:
    return missing(rows).where("why = 'invalid'").groupBy("value").agg(F.count(F.lit(1)).alias("count"))


def subset(dataset: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """J08."""
    return dataset.join(ids.select(key), key, "left_semi").orderBy(key)


def with_origin(retry: DataFrame, run_id: str, source: str) -> DataFrame:
    """The timestamp is the text before the first underscore."""
    return retry.withColumns({"retry_run_id": F.lit(run_id), "retry_timestamp": F.lit(run_id.split("_")[0]), "retry_attempt": F.lit(1), "retry_source": F.lit(source)})


def id_issues(expected: DataFrame, got: DataFrame, key: str = "id") -> DataFrame:
    """Ids that are missing from the retry, and those that it has beyond."""
    lost = expected.select(key).join(got.select(key), key, "left_anti").distinct().withColumn("issue", F.lit("missing"))
    more = got.select(key).join(expected.select(key), key, "left_anti").distinct().withColumn("issue", F.lit("unexpected"))
    return lost.unionByName(more)


def merged(rows: DataFrame, retry: DataFrame, order: str, key: str = "id") -> DataFrame:
    """Rows without a valid prediction take all shared columns of the retry row that is first by `order`, if it has a prediction."""
    first = Window.partitionBy(key).orderBy(order)
    once = retry.withColumn("place_", F.row_number().over(first)).where("place_ = 1")
    fill = once.where(scoring.normalized("predicted").isNotNull())
    shared = [c for c in rows.columns if c in retry.columns and c not in (key, *META)]
    other = fill.select(F.col(key).alias("key_"), *[F.col(c).alias(f"{c}_r_") for c in shared], *META)
    p = scoring.normalized("predicted")
    lost = p.isNull() | ~p.isin(*VALID)
    both = rows.withColumn("lost_", lost).join(other, (F.col(key) == F.col("key_")) & F.col("lost_"), "left")
    hit = F.col("key_").isNotNull()
    columns = [F.when(hit, F.col(f"{c}_r_")).otherwise(F.col(c)).alias(c) if c in shared else F.col(c) for c in rows.columns]
    filled = F.when(hit, F.col("predicted_r_")).otherwise(F.col("predicted"))
    return both.select(
        *columns, F.col("predicted").alias("predicted_original"), filled.alias("predicted_filled"), hit.alias("filled_by_retry"),
        F.when(hit, F.col("retry_run_id")).alias("filled_run_id"), F.when(hit, F.col("retry_timestamp")).alias("filled_timestamp"), F.when(hit, F.col("retry_attempt")).alias("retry_attempt"), F.when(hit, F.col("retry_source")).alias("retry_source"),
    )


def unresolved(rows: DataFrame, retry: DataFrame, key: str = "id") -> DataFrame:
    good = retry.where(scoring.normalized("predicted").isNotNull()).select(key)
    return missing(rows, key).join(good, key, "left_anti").select(key)
