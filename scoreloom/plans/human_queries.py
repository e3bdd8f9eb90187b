"""Queries on comparisons with human score distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import filters
from ..operators import humans as h
from ..sources.adapters import human_bins, results
from .registry import query

STATS = """(SELECT year, grade, CAST(sum(n) AS BIGINT) AS students, sum(n * mid) / sum(n) AS mean, sqrt(greatest(0, sum(n * mid * mid) / sum(n) - (sum(n * mid) / sum(n)) ** 2)) AS stddev, max(hi) FILTER (WHERE n > 0) AS best, max(hi) AS max_points
  FROM (SELECT *, (lo + hi) / 2 AS mid FROM human_bins) GROUP BY year, grade)"""
#: A score of 0 to 120 in quarters for each run, year and grade.
SCORES = "(SELECT run_id, year, CAST(CAST(ln AS INTEGER) + 2 AS VARCHAR) AS grade, greatest(0, floor(sum(points_earned) / sum(points) * 320) / 4) AS earned, 96.0::DOUBLE AS available FROM results WHERE ln BETWEEN 1 AND 5 GROUP BY ALL)"


def scores(spark, sf):
    rows = results(spark, sf).where("pos.ln between 1 and 5")
    out = rows.groupBy("run_id", "year", (F.col("pos.ln") + 2).cast("string").alias("grade")).agg((F.sum("points_earned") / F.sum("points")).alias("p"))
    return out.select("run_id", "year", "grade", F.greatest(F.lit(0.0), F.floor(F.col("p") * 320) / 4).alias("earned"), F.lit(96.0).alias("available"))


@query("H01_H22_grade_stats", f"SELECT year, grade, students, mean, round(stddev, 6) AS stddev, best, max_points FROM {STATS}")
def grade_stats(spark, sf):
    return h.grade_stats(human_bins(spark, sf)).withColumn("stddev", F.round("stddev", 6))


@query("H01_W02_N21_cdf", "SELECT year, grade, hi, sum(n) OVER (PARTITION BY year, grade ORDER BY idx DESC) / sum(n) OVER (PARTITION BY year, grade) AS share FROM human_bins")
def cdf(spark, sf):
    return h.cdf(human_bins(spark, sf))


@query("H03_H06_H08_shares", "SELECT year, grade, idx, n / sum(n) OVER (PARTITION BY year, grade) AS share FROM human_bins")
def shares(spark, sf):
    return h.shares(human_bins(spark, sf)).select("year", "grade", "idx", "share")


VERSUS = f"""(SELECT v.*, earned + start AS llm_total, s.max_points AS llm_max, (earned + start) / s.max_points AS llm_pct, s.mean, s.stddev, s.best, s.students, s.max_points
  FROM (SELECT *, CASE WHEN grade IN ('3', '4', '5', '6') THEN 24.0 ELSE 30.0 END::DOUBLE AS start FROM {SCORES}) v JOIN {STATS} s USING (year, grade))"""
#: First percentile of each entry, by a join with the bins.
PERCENTILES = f"""(SELECT run_id, year, grade, llm_total, (sum(n) FILTER (WHERE hi < s) + coalesce(sum(n * least(1.0, greatest(0.0, (s - lo) / (hi - lo)))) FILTER (WHERE idx = hit), 0)) / sum(n) AS percentile FROM (
    SELECT e.*, b.lo, b.hi, b.n, b.idx, least(llm_total, max_points) AS s, max(b.idx) FILTER (WHERE b.n > 0 AND b.hi >= least(llm_total, max_points)) OVER (PARTITION BY run_id, e.year, e.grade) AS hit
    FROM {VERSUS} e JOIN human_bins b ON b.year = e.year AND b.grade = e.grade) GROUP BY run_id, year, grade, llm_total)"""
ENTRIES = f"(SELECT e.*, coalesce(p.percentile, 0) AS percentile FROM {VERSUS} e JOIN {PERCENTILES} p USING (run_id, year, grade))"


def entries(spark, sf):
    return h.versus(scores(spark, sf), human_bins(spark, sf))


@query("H04_H05_H09_J04_versus", f"SELECT run_id, year, grade, start, llm_total, llm_max, llm_pct, round(percentile, 9) AS percentile, round((llm_total - mean) / stddev, 6) AS z FROM {ENTRIES}")
def versus(spark, sf):
    return entries(spark, sf).select("run_id", "year", "grade", "start", "llm_total", "llm_max", "llm_pct", F.round("percentile", 9).alias("percentile"), F.round("z", 6).alias("z"))


@query("H19_H20_percentile_definitions", f"""
SELECT run_id, e.year, e.grade, 100 - 100 * (sum(n) FILTER (WHERE (lo + hi) / 2 >= llm_total - 1e-9) / sum(n)) AS at_least,
  100 * (greatest(coalesce(sum(n) FILTER (WHERE (lo + hi) / 2 <= llm_total), 0), sum(n) FILTER (WHERE idx = 9)) / sum(n)) AS up_to
FROM {VERSUS} e JOIN human_bins b ON b.year = e.year AND b.grade = e.grade GROUP BY run_id, e.year, e.grade""".replace("sum(n) FILTER (WHERE (lo + hi) / 2 >= llm_total - 1e-9)", "coalesce(sum(n) FILTER (WHERE (lo + hi) / 2 >= llm_total - 1e-9), 0)"))
def percentile_definitions(spark, sf):
    both = entries(spark, sf).join(h.with_bins(human_bins(spark, sf)), h.GRADE)
    return both.select("run_id", "year", "grade", h.percentile_at_least(F.col("llm_total"), F.col("bins")).alias("at_least"), h.percentile_up_to(F.col("llm_total"), F.col("bins")).alias("up_to"))


@query("J07_H11_bin_comparison", f"""
WITH x AS (SELECT e.run_id, e.year, e.grade, b.idx, b.n / sum(b.n) OVER w AS human_share, llm_total AS s, b.lo, b.hi,
    row_number() OVER (PARTITION BY run_id, e.year, e.grade ORDER BY CASE WHEN least(llm_total, max_points) BETWEEN b.lo AND b.hi THEN 0 WHEN least(llm_total, max_points) < b.lo THEN b.lo - least(llm_total, max_points) ELSE least(llm_total, max_points) - b.hi END, b.idx) AS hit,
    row_number() OVER (PARTITION BY run_id, e.year, e.grade ORDER BY abs(llm_total - (b.lo + b.hi) / 2), b.idx) AS near, abs(llm_total - (b.lo + b.hi) / 2) AS d
  FROM {VERSUS} e JOIN human_bins b ON b.year = e.year AND b.grade = e.grade WINDOW w AS (PARTITION BY run_id, e.year, e.grade)),
y AS (SELECT *, CASE WHEN min(d) OVER v = 0 THEN CASE WHEN near = 1 THEN 1.0 ELSE 0.0 END WHEN near <= 2 THEN (1 / d) / sum(CASE WHEN near <= 2 THEN 1 / d END) OVER v ELSE 0.0 END::DOUBLE AS soft, CASE WHEN hit = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS raw FROM x WINDOW v AS (PARTITION BY run_id, year, grade))
SELECT run_id, year, grade, idx, human_share, raw AS llm_share, round(soft, 9) AS smoothed_share, raw - human_share AS delta, round(soft - human_share, 9) AS smoothed_delta FROM y""")
def bin_comparison(spark, sf):
    scored = entries(spark, sf).select("run_id", "year", "grade", F.col("llm_total").alias("score"), F.col("llm_max").alias("max_points"))
    out = h.bin_comparison(scored, human_bins(spark, sf), ["run_id", "year", "grade"])
    return out.withColumn("smoothed_share", F.round("smoothed_share", 9)).withColumn("smoothed_delta", F.round("smoothed_delta", 9))


@query("C05_heatmap", f"""
WITH b AS (SELECT year, grade, idx, n / sum(n) OVER (PARTITION BY year, grade) AS share FROM human_bins) SELECT year, grade, round(max(share) * 100, 6) AS peak FROM b GROUP BY ALL""")
def heatmap(spark, sf):
    return h.shares(human_bins(spark, sf)).groupBy("year", "grade").agg(F.round(F.max("share") * 100, 6).alias("peak"))


def grades(spark, sf):
    g = human_bins(spark, sf).select("year", "grade").distinct()
    return g.select("year", "grade", F.concat(F.lit("Grade "), F.col("grade")).alias("label"), F.array(F.col("grade").cast("int")).alias("members"), F.col("grade").cast("int").alias("position"))


@query("J05_match_grade", """
WITH g AS (SELECT DISTINCT year, grade FROM human_bins), l AS (SELECT DISTINCT year, unnest(['3', 'Grade 4', 'grade_5', 'Kl. 6', '3-4', 'Junior']) AS "group" FROM g)
SELECT l.year, l."group", g.grade, CASE WHEN l."group" IN ('3', 'Grade 4') THEN 1 WHEN l."group" = 'grade_5' THEN 2 ELSE 3 END AS stage FROM l JOIN g ON g.year = l.year AND g.grade = regexp_extract(l."group", '[0-9]+') WHERE l."group" NOT IN ('3-4', 'Junior')""")
def match_grade(spark, sf):
    g = grades(spark, sf)
    labels = g.select("year").distinct().withColumn("group", F.explode(F.array(*map(F.lit, ("3", "Grade 4", "grade_5", "Kl. 6", "3-4", "Junior")))))
    return h.match_grade(labels, g)


@query("J06_J18_H23_range_members", """
WITH g AS (SELECT DISTINCT year, grade FROM human_bins) SELECT year, '4-6' AS "group", grade FROM g WHERE year >= 1997 AND CAST(grade AS INTEGER) BETWEEN 4 AND 6""")
def range_members(spark, sf):
    g = grades(spark, sf)
    return h.range_members(g.select("year").distinct().withColumn("group", F.lit("4-6")), g, since=1997)


@query("H07_J15_J17_merged_grades", """
WITH b AS (SELECT year, idx, lo, hi, sum(n) AS n FROM human_bins WHERE grade IN ('3', '4') GROUP BY ALL)
SELECT year, '3-4' AS grade, CAST(sum(n) AS BIGINT) AS students, sum(n * (lo + hi) / 2) / sum(n) AS mean, max(hi) FILTER (WHERE n > 0) AS best FROM b GROUP BY year""")
def merged_grades(spark, sf):
    bins = human_bins(spark, sf)
    members = grades(spark, sf).where("grade in ('3', '4')").select("year", "grade", F.lit("3-4").alias("into"))
    return h.grade_stats(h.merged(bins, members)).select("year", "grade", "students", "mean", "best")


@query("H12_best_member", f"SELECT year, '3-6' AS \"group\", grade, mean FROM {STATS} WHERE grade IN ('3', '4', '5', '6') AND year >= 1995 QUALIFY row_number() OVER (PARTITION BY year ORDER BY mean DESC, grade) = 1")
def best_member(spark, sf):
    g = grades(spark, sf)
    inside = h.range_members(g.select("year").distinct().withColumn("group", F.lit("3-6")), g, since=1995)
    return h.best_member(inside, h.grade_stats(human_bins(spark, sf))).select("year", "group", "grade", "mean")


@query("H14_C11_cohort", f"""
SELECT year, grade, count(*) AS runs, avg(llm_pct) AS macro_pct, round(avg(percentile), 9) AS macro_percentile, round(median(percentile), 9) AS median, round(quantile_cont(percentile, 0.25), 9) AS p25, round(quantile_cont(percentile, 0.75), 9) AS p75, round(max(percentile), 9) AS high,
  arg_max(run_id, percentile - (ascii(run_id[1]) * 100 + ascii(run_id[2])) * 1e-13) AS best_run FROM {ENTRIES} GROUP BY year, grade""".replace("avg(llm_pct) AS macro_pct", "round(avg(llm_pct), 9) AS macro_pct"))
def cohort(spark, sf):
    out = h.cohort(entries(spark, sf))
    r = lambda c: F.round(c, 9).alias(c)
    return out.select("year", "grade", "runs", r("macro_pct"), r("macro_percentile"), r("median"), r("p25"), r("p75"), r("high"), "best_run")


@query("H15_H17_summary", f"""
SELECT run_id, count(*) AS cells, count(*) FILTER (WHERE llm_total - mean > 1e-9) AS llm_wins, count(*) FILTER (WHERE llm_total - mean < -1e-9) AS human_wins, count(*) FILTER (WHERE abs(llm_total - mean) <= 1e-9) AS ties,
  round(sum(percentile * llm_max) / sum(llm_max), 9) AS avg_percentile, round(sum((llm_total - mean) / llm_max * llm_max) / sum(llm_max), 9) AS avg_gap_pct FROM {ENTRIES} GROUP BY run_id""")
def summary(spark, sf):
    out = h.summary(entries(spark, sf), "mean", "run_id")
    return out.withColumn("avg_percentile", F.round("avg_percentile", 9)).withColumn("avg_gap_pct", F.round("avg_gap_pct", 9))


@query("H15_P12_thresholds", f"SELECT t AS threshold, count(*) FILTER (WHERE gap >= t) AS llm, count(*) FILTER (WHERE gap <= -t) AS human FROM (SELECT (llm_total - mean) / llm_max AS gap, unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.25::DOUBLE]) AS t FROM {VERSUS}) GROUP BY t")
def threshold_counts(spark, sf):
    return h.threshold_counts(entries(spark, sf), [0.05, 0.1, 0.25])


@query("H16_weights", f"SELECT run_id, round(sum(w), 9) AS total FROM (SELECT run_id, 1.0::DOUBLE / ((SELECT count(DISTINCT run_id) FROM {SCORES}) * count(*) OVER (PARTITION BY run_id)) AS w FROM {VERSUS}) GROUP BY run_id")
def weights(spark, sf):
    e = entries(spark, sf)
    return h.weighted(e, "macro").groupBy("run_id").agg(F.round(F.sum("w"), 9).alias("total"))


@query("H18_baseline_summary", f"SELECT grade, CAST(sum(students) AS BIGINT) AS students, round(sum(mean * students / max_points) / sum(students), 9) AS mean_pct FROM {STATS} GROUP BY grade")
def baseline_summary(spark, sf):
    return h.baseline_summary(h.grade_stats(human_bins(spark, sf)), "grade").withColumn("mean_pct", F.round("mean_pct", 9))


@query("H24_positions", """
SELECT year, grade, max(idx) FILTER (WHERE cum >= total / 2) AS median_bin, CAST(sum(n) FILTER (WHERE idx = 0) AS BIGINT) AS top, CAST(sum(n) FILTER (WHERE idx > 6) AS BIGINT) AS bottom3
FROM (SELECT *, sum(n) OVER (PARTITION BY year, grade ORDER BY idx DESC) AS cum, sum(n) OVER (PARTITION BY year, grade) AS total FROM human_bins) GROUP BY year, grade""")
def positions(spark, sf):
    return h.positions(human_bins(spark, sf))


@query("H26_H27_C08_tiers", f"""
SELECT CASE WHEN llm_pct >= 0.95 THEN 'excellent' WHEN llm_pct >= 0.75 THEN 'good' WHEN llm_pct >= 0.5 THEN 'average' ELSE 'below' END AS tier,
  CASE WHEN percentile >= 0.99 THEN 4 WHEN percentile >= 0.95 THEN 3 WHEN percentile >= 0.75 THEN 2 WHEN percentile >= 0.5 THEN 1 ELSE 0 END AS stars, count(*) AS n, count(*) FILTER (WHERE llm_total > best) AS above_best, count(*) FILTER (WHERE llm_total > mean) AS above_mean FROM {ENTRIES} GROUP BY ALL""")
def tiers(spark, sf):
    return entries(spark, sf).groupBy(filters.tier(F.col("llm_pct")).alias("tier"), h.stars(F.col("percentile")).alias("stars")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("llm_total") > F.col("best"), 1)).alias("above_best"), F.count(F.when(F.col("llm_total") > F.col("mean"), 1)).alias("above_mean"))


@query("H13_C01_C10_member_overrides", f"SELECT run_id, year, arg_max(grade, percentile * 1000000 - CAST(grade AS INTEGER) * 1e-6) AS best_grade, round(max(percentile), 9) AS percentile FROM {ENTRIES} GROUP BY run_id, year")
def member_overrides(spark, sf):
    order = F.struct("percentile", (-F.col("grade").cast("int")).alias("g"))
    return entries(spark, sf).groupBy("run_id", "year").agg(F.max_by("grade", order).alias("best_grade"), F.round(F.max("percentile"), 9).alias("percentile"))


@query("H10_null_earned", "SELECT run_id, sum(CASE WHEN is_correct THEN points ELSE 0 END) AS earned FROM results GROUP BY run_id")
def null_earned(spark, sf):
    rows = results(spark, sf).withColumn("points_earned", F.lit(None).cast("double"))
    earned = F.coalesce("points_earned", F.when(F.col("is_correct"), scoring.finite("points")).otherwise(0.0))
    return rows.groupBy("run_id").agg(F.sum(earned).alias("earned"))
