"""Correlation, regression, bootstrap and decision rules.

Moments that SQL has are aggregates; regressions with several terms and bootstraps
are sums that add up as well (resampling).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import ratio
from . import resampling


def pearson(x: str, y: str) -> Column:
    """N01; null where either has no spread."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x))) * F.stddev_pop(F.when(F.col(x).isNotNull(), F.col(y))))


def line(rows: DataFrame, x: str, y: str, *by: str, least: int = 3) -> DataFrame:
    """Slope, intercept, r and its t statistic, by group of at least `least` rows."""
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), pearson(x, y).alias("r"))
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2.0, 1 - F.col("r") * F.col("r")))
    return out.where(F.col("n") >= least).withColumn("t", t)


def bootstrap(rows: DataFrame, kind: str, x: str, y: str, by: str, times: int = resampling.TIMES) -> DataFrame:
    """N07, N08, N15, N20 by group: value, low, high, n."""
    return resampling.of_two(rows.select(by, x, y), kind, x, y, [by], times)


def bootstrap_fit(rows: DataFrame, y: str, terms: list[str], by: str, times: int = resampling.TIMES) -> DataFrame:
    """Each coefficient with its interval, and R squared; a row each."""
    found = resampling.of_terms(rows.select(by, y, *terms), y, terms, [by], times)
    none = F.lit(None).cast("double")
    parts = [F.struct(F.lit(t).alias("term"), *(F.col(f"c{i}")[v].alias(v) for v in ("value", "low", "high"))) for i, t in enumerate(["intercept", *terms])]
    return found.select(by, F.inline(F.array(*parts, F.struct(F.lit("r2").alias("term"), F.col("r2").alias("value"), none.alias("low"), none.alias("high")))))


def agreement(rows: DataFrame, x: str, y: str, *by: str, threshold: float = 1.0) -> DataFrame:
    """Share on the same side of 0, peaks that are met and peaks that are right, pairs of unlike sign."""
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    same = (F.col(x) > 0) == (F.col(y) > 0)
    px, py = F.abs(x) >= threshold, F.abs(y) >= threshold
    n = lambda c: F.count(F.when(c, 1))
    return pairs.groupBy(*by).agg(ratio(n(same), F.count(F.lit(1))).alias("same_side"), ratio(n(px & py & same), n(px)).alias("recall"), ratio(n(px & py & same), n(py)).alias("precision"), n(~same).alias("unlike"))


def real(x: Column) -> Column:
    """NaN as null, as Spark sorts NaN above all numbers."""
    return F.when(~F.isnan(x), x)


def scale_difficulty(rows: DataFrame, value: str, group: str) -> DataFrame:
    """Minus the z-score on the ensemble's scale (sample deviation), and the band of its mean."""
    per = Window.partitionBy(group)
    spread = F.stddev_samp(value).over(per)
    difficulty = F.when(spread > 0, -(F.col(value) - F.avg(value).over(per)) / spread).otherwise(0.0)
    return rows.withColumn("difficulty", difficulty).withColumn("band", 1.96 * spread / F.sqrt(F.count(value).over(per)))
