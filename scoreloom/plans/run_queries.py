"""Queries on run metrics, filters and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import filters, metrics
from ..sources.adapters import results
from .registry import query

ANSWERED = "predicted IS NOT NULL AND error IS NULL"


@query("S01_results_view", "SELECT id, run_id, question_id, year, \"group\", points, answer, predicted, points_earned, is_correct, latency_ms, total_tokens, reasoning_tokens, cost_usd, language, multimodal, error, len(warnings) AS n_warnings FROM results")
def results_view(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).select("id", "run_id", "question_id", "year", "group", "points", "answer", "predicted", "points_earned", "is_correct", "latency_ms", "total_tokens", "reasoning_tokens", "cost_usd", "language", "multimodal", "error", F.size("warnings").cast("bigint").alias("n_warnings"))


@query("P01_P02_filters", "SELECT id, year, \"group\", points FROM results WHERE year IN (1996, 1997) AND \"group\" IN ('3-4', '11-13') AND language = 'de' AND points BETWEEN 4 AND 5")
def in_lists(spark, sf):
    low, high = filters.parse_range("4-5")
    wanted = filters.RowFilter(years=[1996, 1997], groups=["3-4", "11-13"], languages=["de"], ranges={"points": (low, high)})
    return results(spark, sf).where(wanted.condition()).select("id", "year", "group", "points")


@query("P03_modality", "SELECT run_id, count(*) FILTER (WHERE multimodal) AS vision, count(*) FILTER (WHERE NOT multimodal) AS text, count(*) AS rows FROM results GROUP BY run_id")
def modality(spark, sf):
    rows = results(spark, sf)
    n = F.count(F.lit(1))
    vision, text = filters.modality(rows, vision_only=True).groupBy("run_id").agg(n.alias("vision")), filters.modality(rows, sees=False).groupBy("run_id").agg(n.alias("text"))
    return rows.groupBy("run_id").agg(n.alias("rows")).join(vision, "run_id", "left").join(text, "run_id", "left").select("run_id", F.coalesce("vision", F.lit(0)).alias("vision"), F.coalesce("text", F.lit(0)).alias("text"), "rows")


@query("P04_limit_first", "SELECT id FROM results ORDER BY id LIMIT 500")
def limit_first(spark, sf):
    return filters.sampled(results(spark, sf).select("id"), 500)


@query("P04_sample_seeded")
def sample_seeded(spark, sf):
    return filters.sampled(results(spark, sf).select("id"), 500, seed=7)


@query("P05_row_predicate", """
SELECT id FROM results WHERE NOT multimodal AND is_correct IS NOT NULL AND NOT is_correct AND upper(predicted) IN ('A', 'DECLINED')
  AND latency_ms >= 1000 AND total_tokens <= 800 AND len(warnings) > 0 AND (list_contains(warnings, 'declined_explicit') OR list_contains(warnings, 'regex_fallback'))""")
def row_predicate(spark, sf):
    given = {"multimodal": ["false"], "correctness": ["false"], "predicted": ["a", "declined"], "latency_ms_min": ["1000"], "total_tokens_max": ["800"], "has_warnings": ["true"], "warning_types": ["declined_explicit", "regex_fallback"]}
    return results(spark, sf).where(filters.RowFilter.parse(given).condition()).select("id")


@query("P06_null_range", "SELECT count(*) AS rows, count(*) FILTER (WHERE reasoning_tokens BETWEEN 50 AND 300) AS in_range, count(*) FILTER (WHERE reasoning_tokens IS NULL) AS unknown FROM results")
def null_range(spark, sf):
    inside = filters.every(filters.in_range("reasoning_tokens", 50, 300))
    return results(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(inside, 1)).alias("in_range"), F.count(F.when(F.col("reasoning_tokens").isNull(), 1)).alias("unknown"))


@query("P07_correctness_unknown", "SELECT id FROM results WHERE is_correct IS NULL AND multimodal")
def correctness_unknown(spark, sf):
    return results(spark, sf).where(filters.RowFilter(correctness="unknown", multimodal=True).condition()).select("id")


@query("P15_unanswered", "SELECT id, points FROM results WHERE predicted IS NULL")
def unanswered(spark, sf):
    return results(spark, sf).where(F.col("predicted").isNull() & ~scoring.declined("predicted")).select("id", "points")


@query("E01_scores", "SELECT is_correct, predicted IS NULL AS unanswered, coalesce(predicted = 'DECLINED', false) AS declined, count(*) AS n, sum(points_earned) AS earned, sum(CASE WHEN answer IS NULL OR predicted IS NULL THEN 0 ELSE points_earned END) AS earned_unpenalized FROM results GROUP BY ALL")
def scores(spark, sf):
    mild = scoring.points_earned("points", "answer", "predicted", penalize_unanswered=False)
    return results(spark, sf).groupBy("is_correct", F.col("predicted").isNull().alias("unanswered"), scoring.declined("predicted").alias("declined")).agg(F.count(F.lit(1)).alias("n"), F.sum("points_earned").alias("earned"), F.sum(mild).alias("earned_unpenalized"))


@query("E02_E03_E08_E09_group_labels", """
SELECT "group", CASE WHEN "group" = 'Junior' THEN [] ELSE list_transform(string_split("group", '-'), lambda x: CAST(x AS INTEGER)) END AS numbers,
  CASE WHEN "group" IN ('3-4', '5-6') THEN 24.0 WHEN "group" IN ('7-8', '9-10', '11-13') THEN 30.0 ELSE 0.0 END::DOUBLE AS start,
  CASE WHEN "group" IN ('3-4', '5-6') THEN 'Lower' WHEN "group" IN ('7-8', '9-10', '11-13') THEN 'Upper' ELSE 'Unknown' END AS band,
  CASE WHEN "group" <> 'Junior' THEN "group" END AS bucket,
  CASE "group" WHEN '3-4' THEN 0 WHEN '5-6' THEN 1 WHEN '7-8' THEN 2 WHEN '9-10' THEN 3 WHEN '11-13' THEN 4 ELSE 99 END AS bucket_order
FROM (SELECT DISTINCT "group" FROM results WHERE "group" IS NOT NULL)""")
def group_labels(spark, sf):
    groups = results(spark, sf).where(F.col("group").isNotNull()).select("group").distinct()
    return groups.select("group", scoring.grade_numbers("group").alias("numbers"), scoring.start_capital("group").alias("start"), scoring.grade_band("group").alias("band"), scoring.grade_bucket("group").alias("bucket"), scoring.bucket_order(scoring.grade_bucket("group")).alias("bucket_order"))


@query("E10_F17_run_names", """
SELECT run_id, 'model-' || lower(run_id) AS model, TIMESTAMP '2024-05-01 12:00:00' AS started FROM (SELECT DISTINCT run_id FROM results)""")
def run_names(spark, sf):
    runs = results(spark, sf).select("run_id").distinct().withColumn("run_name", F.concat(F.lit("20240501_120000_model-"), F.lower("run_id"), F.lit("_x_y")))
    return runs.select("run_id", scoring.model_label("run_name").alias("model"), scoring.run_time("run_name").cast("timestamp_ntz").alias("started"))


@query("A01_A02_status_counts", f"SELECT run_id, count(*) AS rows, count(*) FILTER (WHERE {ANSWERED}) AS answered, count(*) FILTER (WHERE {ANSWERED} AND predicted = 'DECLINED') AS declined, count(error) AS failed, count(*) FILTER (WHERE {ANSWERED} AND is_correct) AS correct, coalesce(count(*) FILTER (WHERE {ANSWERED} AND is_correct) / count(*) FILTER (WHERE {ANSWERED}), 0) AS accuracy FROM results GROUP BY run_id")
def status_counts(spark, sf):
    return metrics.status_counts(results(spark, sf), "run_id")


START = "CASE WHEN \"group\" IN ('3-4', '5-6') THEN 24.0 WHEN \"group\" IN ('7-8', '9-10', '11-13') THEN 30.0 ELSE 0.0 END::DOUBLE"


@query("A03_A04_point_totals", f"""
WITH s AS (SELECT run_id, sum(start) AS start_points FROM (SELECT DISTINCT run_id, year, "group", {START} AS start FROM results WHERE "group" IS NOT NULL AND points > 0) GROUP BY run_id),
t AS (SELECT run_id, sum(points_earned) AS earned, sum(points) AS possible FROM results GROUP BY run_id)
SELECT t.run_id, earned, possible, start_points, earned + start_points AS total_points, (earned + start_points) / (possible + start_points) AS weighted_accuracy FROM t JOIN s USING (run_id)""")
def point_totals(spark, sf):
    return metrics.point_totals(results(spark, sf), "run_id")


@query("A05_latency", f"SELECT run_id, avg(latency_ms) AS mean_latency, median(latency_ms) AS median_latency FROM results WHERE {ANSWERED} GROUP BY run_id")
def latency(spark, sf):
    return metrics.latency(results(spark, sf), "run_id")


@query("A06_A07_token_usage", f"SELECT run_id, {', '.join(f'avg({c}) AS mean_{c}, CAST(sum({c}) AS BIGINT) AS sum_{c}, count({c}) AS known_{c}' for c in metrics.TOKENS)}, coalesce(sum(cost_usd), 0) AS known_cost, count(*) - count(total_tokens) AS unknown_usage FROM results WHERE {ANSWERED} GROUP BY run_id")
def token_usage(spark, sf):
    return metrics.token_usage(results(spark, sf), "run_id")


def _breakdown(key: str) -> str:
    return f'SELECT run_id, "{key}", count(*) AS count, count(*) FILTER (WHERE is_correct) / count(*) AS accuracy, CASE WHEN sum(points) > 0 THEN sum(points_earned) / sum(points) ELSE 0 END AS weighted_accuracy FROM results WHERE {ANSWERED} AND "{key}" IS NOT NULL GROUP BY run_id, "{key}"'


@query("A08_breakdown_by_group", _breakdown("group"))
def breakdown_by_group(spark, sf):
    return metrics.answered_breakdown(results(spark, sf), "group", "run_id")


@query("A08_breakdown_by_year", _breakdown("year"))
def breakdown_by_year(spark, sf):
    return metrics.answered_breakdown(results(spark, sf), "year", "run_id")


@query("A09_warning_counts", "SELECT run_id, warning, count(*) AS count FROM (SELECT run_id, unnest(warnings) AS warning FROM results) GROUP BY ALL")
def warning_counts(spark, sf):
    return metrics.warning_counts(results(spark, sf), "run_id")


@query("A10_backfill", f"""
WITH s AS (SELECT run_id, sum(start) AS start_points FROM (SELECT DISTINCT run_id, year, "group", {START} AS start FROM results WHERE "group" IS NOT NULL AND points > 0) GROUP BY run_id),
m AS (SELECT run_id, count(*) FILTER (WHERE {ANSWERED}) AS answered, sum(points_earned) AS earned, avg(completion_tokens) FILTER (WHERE {ANSWERED}) AS mean_tokens FROM results GROUP BY run_id)
SELECT m.run_id, CASE WHEN answered > 0 THEN earned + start_points ELSE 0 END AS total_points_earned, mean_tokens AS mean_completion_tokens FROM m JOIN s USING (run_id)""")
def backfill(spark, sf):
    rows = results(spark, sf)
    stored = rows.groupBy("run_id").agg(F.count(F.when(metrics.answered(), 1)).alias("answered_count"), F.lit(0.0).alias("total_points_earned"), F.lit(None).cast("double").alias("mean_completion_tokens"))
    fresh = metrics.point_totals(rows, "run_id").select("run_id", "total_points").join(metrics.token_usage(rows, "run_id").select("run_id", "mean_completion_tokens").withColumnRenamed("mean_completion_tokens", "tokens"), "run_id", "left")
    points = F.when((F.col("total_points_earned") == 0) & (F.col("answered_count") > 0), F.col("total_points")).otherwise(F.col("total_points_earned"))
    return stored.join(fresh, "run_id").select("run_id", points.alias("total_points_earned"), F.coalesce("mean_completion_tokens", "tokens").alias("mean_completion_tokens"))


@query("A11_profile", "SELECT year, count(*) AS rows, avg(CAST(multimodal AS INTEGER)) AS multimodal_share, avg(points) AS mean_points FROM results GROUP BY year")
def profile(spark, sf):
    return metrics.profile(results(spark, sf), "year")


@query("A12_reduced_summary", f"SELECT run_id, count(*) FILTER (WHERE {ANSWERED}) AS answered, count(*) FILTER (WHERE {ANSWERED} AND predicted = 'DECLINED') AS declined, count(error) AS failed, count(*) FILTER (WHERE {ANSWERED} AND is_correct) / count(*) FILTER (WHERE {ANSWERED}) AS accuracy, sum(CASE WHEN error IS NULL THEN points_earned ELSE 0 END) / sum(CASE WHEN answer IS NOT NULL THEN points ELSE 0 END) AS weighted_accuracy FROM results GROUP BY run_id")
def reduced_summary(spark, sf):
    return metrics.reduced_summary(results(spark, sf), "run_id")
