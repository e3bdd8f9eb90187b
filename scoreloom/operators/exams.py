"""Exam totals, slices and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.scoring import ratio
from .quantiles import quantiles

def count() -> Column:
    return F.count(F.lit(1))


def _n(c: Column) -> Column:
    return F.count(F.when(c, 1))


def derived(rows: DataFrame) -> DataFrame:
    """What later slices need of a row; net counts an attempted miss -1/4 and an unanswered row 0."""
    p = scoring.normalized("predicted")
    declined, has = F.coalesce(p == scoring.DECLINED, F.lit(False)), p.isNotNull()
    attempted = has & ~declined
    correct = attempted & F.coalesce(p == F.upper("answer"), F.lit(False))
    worth = scoring.finite("points")
    net = F.when(correct, worth).when(attempted & F.col("answer").isNotNull(), -worth * scoring.PENALTY).otherwise(0.0)
    return rows.withColumns({
        "has_answer": has, "declined": declined, "attempted": attempted, "correct": correct, "wrong": attempted & ~correct, "raw": F.when(correct, worth).otherwise(0.0), "net": net, "worth": worth,
        "modality": F.when(F.col("multimodal"), "multimodal").otherwise("text"), "band": scoring.grade_band("group"), "bucket": scoring.grade_bucket("group"),
    })


def totals(rows: DataFrame, definition: int, *by: str) -> DataFrame:
    """Exam totals with start capital: 1 as stored (E04), 2 raw points (E05), 3 net points (E06). rows: derived()."""
    value = {1: "points_earned", 2: "raw", 3: "net"}[definition]
    out = rows.groupBy(*by, "year", "group").agg(F.sum(value).alias("sum"), F.sum("worth").alias("worth"))
    start = scoring.start_capital("group")
    return out.select(*by, "year", "group", (F.col("sum") + start).alias("total"), (F.col("worth") + start).alias("possible"), ratio(F.col("sum") + start, F.col("worth") + start).alias("pct"))


def slice_columns() -> list[Column]:
    """E11."""
    correct, attempts, n = _n(F.col("correct")), _n(F.col("attempted")), count()
    return [
        n.alias("questions"), correct.alias("correct"), attempts.alias("attempts"), _n(F.col("declined")).alias("declines"), ratio(correct, n).alias("recall"), ratio(attempts, n).alias("attempt_rate"),
        ratio(_n(F.col("declined")), n).alias("decline_rate"), ratio(correct, attempts).alias("precision"), (100 * ratio(F.sum("net"), F.sum("worth"))).alias("net_pct"),
    ]


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def run_summary(rows: DataFrame) -> DataFrame:
    """E12."""
    base = rows.groupBy("run_id").agg(*slice_columns(), F.sum("raw").alias("raw_score"), F.sum("net").alias("net_score"), F.sum("completion_tokens").alias("tokens"))
    exams = totals(rows, 2, "run_id").groupBy("run_id").agg(F.sum("total").alias("total_score"), count().alias("exams"))
    per_k = lambda x: 1000 * ratio(x, F.col("tokens"))
    out = base.join(exams, "run_id").withColumn("f1", f1(F.col("precision"), F.col("recall")))
    return out.withColumns({"points_per_k": per_k(F.col("raw_score")), "correct_per_k": per_k(F.col("correct")), "net_per_k": per_k(F.col("net_score")), "tokens_per_point": ratio(F.col("tokens"), F.col("raw_score"))})


def policy(rows: DataFrame, *by: str) -> DataFrame:
    """Over all, by modality, by band and by both, in one pass."""
    sets = rows.groupingSets([[*by], [*by, "modality"], [*by, "band"], [*by, "modality", "band"]], *by, "modality", "band")
    out = sets.agg(F.grouping_id().alias("level"), *slice_columns())
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def leaderboard(rows: DataFrame) -> DataFrame:
    """By accuracy; the points to be had are the first run's."""
    out = rows.groupBy("run_id").agg(ratio(_n(F.col("correct")), count()).alias("accuracy"), F.sum("points_earned").alias("earned"), F.sum("worth").alias("possible_own"), F.sum("total_tokens").alias("tokens"))
    first = out.agg(F.min_by("possible_own", "run_id").alias("possible"))
    return out.join(F.broadcast(first)).select("run_id", "accuracy", "earned", "possible", ratio(F.col("tokens"), F.col("earned")).alias("tokens_per_point")).orderBy(F.desc("accuracy"), "run_id")


def exam_wins(exams: DataFrame) -> DataFrame:
    """Share of exams each run wins (ties by run)."""
    first = Window.partitionBy("year", "group").orderBy(F.desc("pct"), "run_id")
    won = exams.withColumn("place", F.row_number().over(first))
    return won.groupBy("run_id").agg(count().alias("exams"), _n(F.col("place") == 1).alias("wins")).withColumn("win_share", ratio(F.col("wins"), F.col("exams")))


def modality_gap(rows: DataFrame) -> DataFrame:
    """Recall with images less recall without, in points of a hundred."""
    part = lambda m: ratio(_n(F.col("correct") & (F.col("modality") == m)), _n(F.col("modality") == m))
    return rows.groupBy("run_id").agg(part("multimodal").alias("with_images"), part("text").alias("text_only")).withColumn("gap_pp", 100 * (F.col("with_images") - F.col("text_only")))


def token_efficiency(rows: DataFrame, *by: str) -> DataFrame:
    """E20."""
    return rows.groupBy(*by).agg(F.sum("completion_tokens").alias("tokens"), ratio(F.sum("completion_tokens"), _n(F.col("correct"))).alias("per_correct"), ratio(F.sum("completion_tokens"), F.sum("raw")).alias("per_point"))


def declined_profile(rows: DataFrame) -> DataFrame:
    """E23."""
    gone = rows.where("declined")
    out = gone.groupBy("modality").agg(count().alias("count"), F.avg("worth").alias("mean_points"))
    return out.join(quantiles(gone, "worth", {"median_points": 0.5}, "modality"), "modality", "left")


def missing_cause(columns: list[str]) -> Column:
    """From whichever columns there are: error, timeout, status, finish, no response, zero tokens."""
    tests = [
        ("error", lambda c: F.when(F.length(F.trim(c)) > 0, "error")), ("timed_out", lambda c: F.when(c.cast("boolean"), "timeout")), ("status_code", lambda c: F.when(c.cast("int") >= 400, "status")),
        ("finish_reason", lambda c: F.when(c.isin("length", "content_filter"), "finish")), ("raw_text_response", lambda c: F.when(c.isNull() | (F.trim(c) == ""), "no_response")),
        ("total_tokens", lambda c: F.when(F.coalesce(c, F.lit(0)) == 0, "zero_tokens")),
    ]
    return F.coalesce(*[f(F.col(c)) for c, f in tests if c in columns], F.lit("no_output"))


def structure(rows: DataFrame) -> DataFrame:
    """Items, shares of 3, 4 and 5 points, share with images."""
    return rows.groupBy("year", "group").agg(count().alias("items"), *[ratio(_n(F.col("worth") == p), count()).alias(f"share_{p}") for p in (3, 4, 5)], ratio(_n(F.col("multimodal")), count()).alias("multimodal_share"))


def over_runs(exams: DataFrame) -> DataFrame:
    """Mean exam over runs; sample deviation."""
    return exams.groupBy("year", "group").agg(F.avg("total").alias("total"), F.min_by("possible", "run_id").alias("possible"), F.count_distinct("run_id").alias("runs"), F.stddev_samp("pct").alias("spread"), F.min("pct").alias("low"), F.max("pct").alias("high"))
