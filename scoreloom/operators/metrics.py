"""Run-level metrics over scored result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.scoring import ratio
from .quantiles import quantiles

TOKENS = ("total_tokens", "prompt_tokens", "completion_tokens", "reasoning_tokens")


def answered() -> Column:
    return F.col("predicted").isNotNull() & F.col("error").isNull()


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def status_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Counts and accuracy over answered rows."""
    a = answered()
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), _n(a).alias("answered"), _n(a & scoring.declined("predicted")).alias("declined"), _n(F.col("error").isNotNull()).alias("failed"),
        _n(a & F.col("is_correct")).alias("correct"),
    )
    return out.withColumn("accuracy", F.coalesce(ratio(F.col("correct"), F.col("answered")), F.lit(0.0)))


def start_totals(rows: DataFrame, *by: str) -> DataFrame:
    """Start capital once for each (year, group) with points over 0, of any rows."""
    keys = rows.where((scoring.finite("points") > 0) & F.col("group").isNotNull()).select(*by, scoring.key_text("year").alias("y"), scoring.key_text("group").alias("g")).distinct()
    return keys.groupBy(*by).agg(F.sum(scoring.start_capital("g")).alias("start_points"))


def point_totals(rows: DataFrame, *by: str) -> DataFrame:
    """Points with start capital, and the share of all that could be had; one pass, summed by exam first."""
    year, group = scoring.key_text("year"), scoring.key_text("group")
    exams = rows.groupBy(*by, year.alias("y"), group.alias("g")).agg(F.sum("points_earned").alias("earned"), F.sum("points").alias("possible"), F.max((scoring.finite("points") > 0) & F.col("group").isNotNull()).alias("scored"))
    start = F.when(F.col("scored"), scoring.start_capital("g"))
    both = exams.groupBy(*by).agg(F.sum("earned").alias("earned"), F.sum("possible").alias("possible"), F.coalesce(F.sum(start), F.lit(0.0)).alias("start_points"))
    total, most = F.col("earned") + F.col("start_points"), F.col("possible") + F.col("start_points")
    return both.select(*by, "earned", "possible", "start_points", total.alias("total_points"), F.when(most > 1e-12, total / most).otherwise(0.0).alias("weighted_accuracy"))


def latency(rows: DataFrame, *by: str) -> DataFrame:
    """A05."""
    known = rows.where(answered())
    means, middle = known.groupBy(*by).agg(F.avg("latency_ms").alias("mean_latency")), quantiles(known, "latency_ms", {"median_latency": 0.5}, *by)
    return means.join(middle, list(by), "left")


def token_usage(rows: DataFrame, *by: str) -> DataFrame:
    """Means, sums and counts of known values over answered rows; cost; rows of unknown usage."""
    aggs = [f(c).alias(f"{name}_{c}") for c in TOKENS for name, f in (("mean", F.avg), ("sum", F.sum), ("known", F.count))]
    return rows.where(answered()).groupBy(*by).agg(*aggs, F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("known_cost"), (F.count(F.lit(1)) - F.count("total_tokens")).alias("unknown_usage"))


def answered_breakdown(rows: DataFrame, key: str, *by: str) -> DataFrame:
    """Over answered rows; no start capital; rows without a key go."""
    good = rows.where(answered() & F.col(key).isNotNull())
    out = good.groupBy(*by, key).agg(F.count(F.lit(1)).alias("count"), _n(F.col("is_correct")).alias("correct"), F.sum("points_earned").alias("earned"), F.sum("points").alias("possible"))
    return out.select(*by, key, "count", ratio(F.col("correct"), F.col("count")).alias("accuracy"), F.when(F.col("possible") > 0, F.col("earned") / F.col("possible")).otherwise(0.0).alias("weighted_accuracy"))


def warning_counts(rows: DataFrame, *by: str) -> DataFrame:
    """A09, A24 without its limit."""
    return rows.select(*by, F.explode("warnings").alias("warning")).groupBy(*by, "warning").agg(F.count(F.lit(1)).alias("count"))


def profile(rows: DataFrame, *by: str) -> DataFrame:
    """A11."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col("multimodal").cast("int")).alias("multimodal_share"), F.avg("points").alias("mean_points"))


def reduced_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Without start capital; earned counts successful calls only, possible every row with an answer key."""
    a = answered()
    out = rows.groupBy(*by).agg(
        _n(a).alias("answered"), _n(a & scoring.declined("predicted")).alias("declined"), _n(F.col("error").isNotNull()).alias("failed"), _n(a & F.col("is_correct")).alias("correct"),
        F.sum(F.when(F.col("error").isNull(), F.col("points_earned")).otherwise(0.0)).alias("earned"), F.sum(F.when(F.col("answer").isNotNull(), F.col("points")).otherwise(0.0)).alias("possible"),
    )
    return out.select(*by, "answered", "declined", "failed", F.coalesce(ratio(F.col("correct"), F.col("answered")), F.lit(0.0)).alias("accuracy"), F.when(F.col("possible") > 0, F.col("earned") / F.col("possible")).otherwise(0.0).alias("weighted_accuracy"))
