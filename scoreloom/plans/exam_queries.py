"""Queries on exam totals, slices and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exams as e
from ..sources.adapters import results
from .registry import query

#: Rows with what the slices need.
D = """(SELECT *, predicted IS NOT NULL AND predicted <> 'DECLINED' AS attempted, coalesce(predicted = 'DECLINED', false) AS declined, coalesce(predicted <> 'DECLINED' AND predicted = answer, false) AS correct,
  CASE WHEN coalesce(predicted <> 'DECLINED' AND predicted = answer, false) THEN points ELSE 0.0 END::DOUBLE AS raw,
  CASE WHEN coalesce(predicted <> 'DECLINED' AND predicted = answer, false) THEN points WHEN predicted IS NOT NULL AND predicted <> 'DECLINED' AND answer IS NOT NULL THEN -points * 0.25 ELSE 0.0 END::DOUBLE AS net,
  CASE WHEN multimodal THEN 'multimodal' ELSE 'text' END AS modality,
  CASE WHEN "group" IN ('3-4', '5-6') THEN 24.0 WHEN "group" IN ('7-8', '9-10', '11-13') THEN 30.0 ELSE 0.0 END::DOUBLE AS start,
  CASE WHEN "group" IN ('3-4', '5-6') THEN 'Lower' WHEN "group" IN ('7-8', '9-10', '11-13') THEN 'Upper' ELSE 'Unknown' END AS band FROM results)"""
SLICES = "count(*) AS questions, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE attempted) AS attempts, count(*) FILTER (WHERE declined) AS declines, count(*) FILTER (WHERE correct) / count(*) AS recall, count(*) FILTER (WHERE attempted) / count(*) AS attempt_rate, count(*) FILTER (WHERE declined) / count(*) AS decline_rate, count(*) FILTER (WHERE correct) / count(*) FILTER (WHERE attempted) AS precision, 100 * (sum(net) / sum(points)) AS net_pct"


def rows(spark, sf):
    return e.derived(results(spark, sf))


def _totals(value: str) -> str:
    return f'SELECT run_id, year, "group", sum({value}) + min(start) AS total, sum(points) + min(start) AS possible, (sum({value}) + min(start)) / (sum(points) + min(start)) AS pct FROM {D} GROUP BY ALL'


for _definition, (_id, _value) in enumerate((("E04_totals_stored", "points_earned"), ("E05_totals_raw", "raw"), ("E06_totals_net", "net")), 1):

    def _query(spark, sf, definition=_definition):
        return e.totals(rows(spark, sf), definition, "run_id")

    query(_id, _totals(_value))(_query)


@query("E07_derived_rows", f"SELECT id, attempted, declined, correct, raw, net, modality, band FROM {D}")
def derived_rows(spark, sf):
    return rows(spark, sf).select("id", "attempted", "declined", "correct", "raw", "net", "modality", "band")


@query("E11_E13_segments", f'SELECT run_id, "group", {SLICES} FROM {D} GROUP BY ALL')
def segments(spark, sf):
    return rows(spark, sf).groupBy("run_id", "group").agg(*e.slice_columns())


@query("E12_run_summary", f"""
WITH x AS (SELECT run_id, {SLICES}, sum(raw) AS raw_score, sum(net) AS net_score, CAST(sum(completion_tokens) AS BIGINT) AS tokens FROM {D} GROUP BY run_id),
t AS (SELECT run_id, sum(total) AS total_score, count(*) AS exams FROM ({_totals('raw')}) GROUP BY run_id)
SELECT x.*, total_score, exams, 2 * precision * recall / (precision + recall) AS f1, 1000 * (raw_score / tokens) AS points_per_k, 1000 * (correct / tokens) AS correct_per_k, 1000 * (net_score / tokens) AS net_per_k, tokens / raw_score AS tokens_per_point FROM x JOIN t USING (run_id)""")
def run_summary(spark, sf):
    return e.run_summary(rows(spark, sf))


@query("E19_policy", f"SELECT run_id, modality, band, CAST(grouping(run_id, modality, band) AS BIGINT) AS level, {SLICES}, 2 * (count(*) FILTER (WHERE correct) / count(*) FILTER (WHERE attempted)) * (count(*) FILTER (WHERE correct) / count(*)) / (count(*) FILTER (WHERE correct) / count(*) FILTER (WHERE attempted) + count(*) FILTER (WHERE correct) / count(*)) AS f1 FROM {D} GROUP BY GROUPING SETS ((run_id), (run_id, modality), (run_id, band), (run_id, modality, band))")
def policy(spark, sf):
    return e.policy(rows(spark, sf), "run_id")


@query("E14_leaderboard", f"WITH x AS (SELECT run_id, count(*) FILTER (WHERE correct) / count(*) AS accuracy, sum(points_earned) AS earned, sum(points) AS p, sum(total_tokens) AS t FROM {D} GROUP BY run_id) SELECT run_id, accuracy, earned, (SELECT arg_min(p, run_id) FROM x) AS possible, t / earned AS tokens_per_point FROM x")
def leaderboard(spark, sf):
    return e.leaderboard(rows(spark, sf))


@query("E15_exam_wins", f'SELECT run_id, count(*) AS exams, count(*) FILTER (WHERE place = 1) AS wins, count(*) FILTER (WHERE place = 1) / count(*) AS win_share FROM (SELECT run_id, row_number() OVER (PARTITION BY year, "group" ORDER BY pct DESC, run_id) AS place FROM ({_totals("net")})) GROUP BY run_id')
def exam_wins(spark, sf):
    return e.exam_wins(e.totals(rows(spark, sf), 3, "run_id"))


@query("E17_modality_gap", f"SELECT *, 100 * (with_images - text_only) AS gap_pp FROM (SELECT run_id, count(*) FILTER (WHERE correct AND multimodal) / count(*) FILTER (WHERE multimodal) AS with_images, count(*) FILTER (WHERE correct AND NOT multimodal) / count(*) FILTER (WHERE NOT multimodal) AS text_only FROM {D} GROUP BY run_id)")
def modality_gap(spark, sf):
    return e.modality_gap(rows(spark, sf))


@query("E18_decline_rate", f"SELECT run_id, modality, count(*) FILTER (WHERE declined) / count(*) AS decline_rate FROM {D} GROUP BY ALL")
def decline_rate(spark, sf):
    return rows(spark, sf).groupBy("run_id", "modality").agg((F.count(F.when(F.col("declined"), 1)) / F.count(F.lit(1))).alias("decline_rate"))


@query("E20_token_efficiency", f"SELECT modality, CAST(sum(completion_tokens) AS BIGINT) AS tokens, sum(completion_tokens) / count(*) FILTER (WHERE correct) AS per_correct, sum(completion_tokens) / sum(raw) AS per_point FROM {D} GROUP BY modality")
def token_efficiency(spark, sf):
    return e.token_efficiency(rows(spark, sf), "modality")


@query("E21_recall_slices", f"SELECT band, points, problem_number, count(*) FILTER (WHERE correct) / count(*) AS recall FROM {D} GROUP BY ALL")
def recall_slices(spark, sf):
    return rows(spark, sf).groupBy("band", "points", "problem_number").agg((F.count(F.when(F.col("correct"), 1)) / F.count(F.lit(1))).alias("recall"))


@query("E22_E25_J12_structure", 'SELECT year, "group", count(*) AS items, count(*) FILTER (WHERE points = 3) / count(*) AS share_3, count(*) FILTER (WHERE points = 4) / count(*) AS share_4, count(*) FILTER (WHERE points = 5) / count(*) AS share_5, count(*) FILTER (WHERE multimodal) / count(*) AS multimodal_share FROM results GROUP BY ALL')
def structure(spark, sf):
    return e.structure(rows(spark, sf))


@query("E23_declined_profile", f"SELECT modality, count(*) AS count, avg(points) AS mean_points, median(points) AS median_points FROM {D} WHERE declined GROUP BY modality")
def declined_profile(spark, sf):
    return e.declined_profile(rows(spark, sf))


@query("E24_missing_cause", "SELECT CASE WHEN error IS NOT NULL THEN 'error' WHEN coalesce(total_tokens, 0) = 0 THEN 'zero_tokens' ELSE 'no_output' END AS cause, count(*) AS n FROM results WHERE predicted IS NULL GROUP BY ALL")
def missing_cause(spark, sf):
    gone = results(spark, sf).where("predicted is null")
    return gone.groupBy(e.missing_cause(gone.columns).alias("cause")).agg(F.count(F.lit(1)).alias("n"))


@query("E26_J14_over_runs", f'SELECT year, "group", avg(total) AS total, arg_min(possible, run_id) AS possible, count(DISTINCT run_id) AS runs, round(stddev_samp(pct), 9) AS spread, min(pct) AS low, max(pct) AS high FROM ({_totals("net")}) GROUP BY ALL')
def over_runs(spark, sf):
    return e.over_runs(e.totals(rows(spark, sf), 3, "run_id")).withColumn("spread", F.round("spread", 9))


@query("J11_J13_exam_points", f'SELECT a.run_id, a.year, a."group", a.total, b.items FROM ({_totals("points_earned")}) a LEFT JOIN (SELECT year, "group", count(*) AS items FROM results GROUP BY ALL) b ON a.year = b.year AND a."group" = b."group"')
def exam_points(spark, sf):
    r = rows(spark, sf)
    return e.totals(r, 1, "run_id").join(e.structure(r).select("year", "group", "items"), ["year", "group"], "left").select("run_id", "year", "group", "total", "items")
