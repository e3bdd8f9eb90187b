"""Queries on difficulty, calibration and decision rules.

The runs whose name begins with R stand for people, the others are models, and AF is the anchor.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import calibration as c
from ..operators import exams as e
from ..operators import stats
from ..sources.adapters import results
from .dashboard_queries import EXAM, exam_scores
from .registry import query

SERIES = f"""x AS (SELECT run_id, year, "group", pct FROM {EXAM}),
people AS (SELECT year, "group", avg(pct) AS human FROM x WHERE run_id LIKE 'R%' GROUP BY ALL),
series AS (
  SELECT year, "group", 'ensemble_equal' AS series, avg(pct) AS value FROM x WHERE run_id NOT LIKE 'R%' GROUP BY ALL
  UNION ALL SELECT year, "group", 'anchor', max(pct) FILTER (WHERE run_id = 'AF') FROM x WHERE run_id NOT LIKE 'R%' GROUP BY ALL
  UNION ALL SELECT a.year, a."group", 'without_' || a.run_id, avg(b.pct) FROM x a LEFT JOIN x b ON a.year = b.year AND a."group" = b."group" AND a.run_id <> b.run_id AND b.run_id NOT LIKE 'R%' WHERE a.run_id NOT LIKE 'R%' GROUP BY ALL),
pairs AS (
  SELECT year, "group", series, CASE WHEN stddev_pop(human) OVER w > 1e-12 THEN -(human - avg(human) OVER w) / stddev_pop(human) OVER w WHEN human IS NOT NULL THEN 0 END AS human,
         CASE WHEN stddev_pop(value) OVER w > 1e-12 THEN -(value - avg(value) OVER w) / stddev_pop(value) OVER w WHEN value IS NOT NULL THEN 0 END AS llm
  FROM series JOIN people USING (year, "group") WINDOW w AS (PARTITION BY "group", series))"""

#: Fits by plain regression functions over the rows of each era.
FITS = """eras AS (SELECT *, year < median(year) OVER (PARTITION BY "group", series) AS early FROM (SELECT * FROM pairs WHERE human IS NOT NULL AND llm IS NOT NULL)),
one AS (
  SELECT "group", series, count(*) AS n, corr(human, llm) AS correlation, avg(CASE WHEN (human > 0) = (llm > 0) THEN 1 ELSE 0 END) AS same_side,
         count(*) FILTER (WHERE abs(human) >= 1) AS peaks, count(*) FILTER (WHERE abs(llm) >= 1) AS seen, count(*) FILTER (WHERE abs(human) >= 1 AND abs(llm) >= 1 AND (human > 0) = (llm > 0)) AS met,
         regr_intercept(human, llm) AS alpha, regr_slope(human, llm) AS beta, regr_r2(human, llm) AS r2,
         (covar_pop(human, year) * var_pop(llm) - covar_pop(llm, year) * covar_pop(human, llm)) / nullif(var_pop(llm) * var_pop(year) - covar_pop(llm, year) ** 2, 0) AS gamma,
         count(*) FILTER (WHERE early) >= 3 AND count(*) FILTER (WHERE NOT early) >= 3 AS both_eras,
         regr_intercept(human, llm) FILTER (WHERE early) AS a1, regr_slope(human, llm) FILTER (WHERE early) AS b1, regr_intercept(human, llm) FILTER (WHERE NOT early) AS a2, regr_slope(human, llm) FILTER (WHERE NOT early) AS b2,
         avg(human) FILTER (WHERE early) AS m1, avg(human) FILTER (WHERE NOT early) AS m2
  FROM eras GROUP BY "group", series),
tried AS (
  SELECT "group", series, 1 - sum((human - a1 - b1 * llm) ** 2) FILTER (WHERE NOT early) / sum((human - m2) ** 2) FILTER (WHERE NOT early) AS early_to_late,
         1 - sum((human - a2 - b2 * llm) ** 2) FILTER (WHERE early) / sum((human - m1) ** 2) FILTER (WHERE early) AS late_to_early
  FROM eras JOIN one USING ("group", series) GROUP BY "group", series),
fits AS (
  SELECT "group", series, n, correlation, same_side, met / nullif(peaks, 0) AS peak_recall, CASE WHEN peaks > 0 THEN met / nullif(seen, 0) END AS peak_precision, alpha, beta, r2, gamma,
         CASE WHEN both_eras THEN a1 END AS alpha_early, CASE WHEN both_eras THEN b1 END AS beta_early, CASE WHEN both_eras THEN a2 END AS alpha_late, CASE WHEN both_eras THEN b2 END AS beta_late,
         CASE WHEN both_eras THEN a2 - a1 END AS delta_alpha, CASE WHEN both_eras THEN b2 - b1 END AS delta_beta,
         CASE WHEN both_eras THEN early_to_late END AS early_to_late, CASE WHEN both_eras THEN late_to_early END AS late_to_early
  FROM one JOIN tried USING ("group", series))"""
NUMBERS = ("correlation", "same_side", "peak_recall", "peak_precision", "alpha", "beta", "r2", "gamma", "alpha_early", "beta_early", "alpha_late", "beta_late", "delta_alpha", "delta_beta", "early_to_late", "late_to_early")


def pairs(spark, sf):
    return c.difficulties(c.series_of(exam_scores(spark, sf), F.col("run_id").startswith("R"), "AF"))


def _rounded(rows, numbers, digits=6):
    """Rounded, and never a negative zero."""
    return rows.select(*[(F.round(x, digits) + F.lit(0.0)).alias(x) if x in numbers else x for x in rows.columns])


def _sql_rounded(numbers, digits=6):
    return ", ".join(f"round({x}, {digits}) + 0.0::DOUBLE AS {x}" for x in numbers)


@query("N05_difficulties", f'WITH {SERIES} SELECT year, "group", series, {_sql_rounded(("human", "llm"))} FROM pairs')
def difficulties(spark, sf):
    return _rounded(pairs(spark, sf).select("year", "group", "series", "human", "llm"), ("human", "llm"))


@query("N05_composition")
def composition(spark, sf):
    """The equal ensemble less what its make-up explains, as difficulty."""
    rows = results(spark, sf)
    made = e.structure(e.derived(rows)).select("year", "group", "multimodal_share", "share_5", "share_3", F.col("items").cast("double").alias("items"))
    whole = c.series_of(exam_scores(spark, sf), F.col("run_id").startswith("R"), "AF").where("series = 'ensemble_equal'")
    return c.composition_residuals(whole.join(made, ["year", "group"]), ["multimodal_share", "share_5", "share_3", "items"], ["year"])


@query("N11_N12_calibration", f'WITH {SERIES}, {FITS} SELECT "group", series, n, {_sql_rounded(NUMBERS)} FROM fits')
def calibration(spark, sf):
    return _rounded(c.calibration(pairs(spark, sf)), NUMBERS)


@query("N11_trend_intervals")
def trend_intervals(spark, sf):
    return c.trend_intervals(pairs(spark, sf))


@query("N13_decisions")
def decisions(spark, sf):
    both = pairs(spark, sf).where("series in ('anchor', 'ensemble_equal')")
    return c.decisions(c.calibration(both), c.trend_intervals(both))


@query("N13_N22_reading")
def reading(spark, sf):
    return c.interpretation(decisions(spark, sf))


LOO = """checked AS (SELECT *, CASE WHEN correlation >= 0.3 THEN 1 ELSE 0 END + CASE WHEN same_side >= 0.5 THEN 1 ELSE 0 END + CASE WHEN peak_recall >= 0.4 THEN 1 ELSE 0 END + CASE WHEN beta BETWEEN 0.5 AND 1.5 THEN 1 ELSE 0 END AS passed FROM fits WHERE series LIKE 'without%'),
judged AS (SELECT "group", series, passed, CASE WHEN passed >= 3 THEN 'usable' WHEN passed >= 2 THEN 'uncertain' ELSE 'not_usable' END AS verdict FROM checked)"""


@query("N14_robustness", f"WITH {SERIES}, {FITS}, {LOO} SELECT * FROM judged")
def robustness(spark, sf):
    return c.robustness(c.calibration(pairs(spark, sf)).where("series like 'without%'"))


@query("N14_N22_reading", f"""
WITH {SERIES}, {FITS}, {LOO}
SELECT series, count(*) AS groups, count(*) FILTER (WHERE verdict = 'usable') AS usable, count(*) FILTER (WHERE verdict = 'uncertain') AS uncertain, count(*) FILTER (WHERE verdict = 'not_usable') AS not_usable,
       CASE WHEN count(*) FILTER (WHERE verdict = 'usable') = count(*) THEN 'reliable' WHEN count(*) FILTER (WHERE verdict = 'usable') >= 0.6 * count(*) THEN 'depends on the group'
            WHEN count(*) FILTER (WHERE verdict = 'usable') >= 0.3 * count(*) THEN 'limited' ELSE 'not suitable' END AS reading
FROM judged GROUP BY series""")
def robust_reading(spark, sf):
    return c.interpretation(robustness(spark, sf))


@query("N15_alignment_tables", f"""
WITH {SERIES}
SELECT a."group", a.series, round(corr(a.human, a.llm), 6) + 0.0::DOUBLE AS corr, round(regr_slope(a.llm, a.year), 6) + 0.0::DOUBLE AS slope, round(regr_slope(a.human, a.year), 6) + 0.0::DOUBLE AS human_slope, round(max(abs(a.llm - b.llm)), 6) + 0.0::DOUBLE AS max_abs_delta
FROM pairs a LEFT JOIN pairs b ON a."group" = b."group" AND a.year = b.year AND b.series = 'ensemble_equal' GROUP BY ALL""")
def alignment(spark, sf):
    return _rounded(c.alignment(pairs(spark, sf)), ("corr", "slope", "human_slope", "max_abs_delta"))


@query("N15_alignment_intervals")
def alignment_intervals(spark, sf):
    return c.alignment_intervals(pairs(spark, sf))


@query("N16_composition_effects")
def composition_effects(spark, sf):
    made = e.structure(e.derived(results(spark, sf))).select("year", "group", "multimodal_share", "share_5")
    both = pairs(spark, sf).where("series in ('anchor', 'ensemble_equal')").join(made, ["year", "group"])
    return c.composition_effects(both, ["multimodal_share", "share_5"])


@query("N01_N02_p_values")
def p_values(spark, sf):
    """Lines of points over years, by run and grade band, with p-values."""
    rows = exam_scores(spark, sf).withColumn("band", scoring.grade_band("group"))
    return c.with_p(stats.line(rows, "year", "pct", "run_id", "band"))


@query("N02_lines_by_band", f"""
WITH x AS (SELECT run_id, year, pct, CASE WHEN "group" IN ('3-4', '5-6') THEN 'Lower' WHEN "group" = 'Junior' THEN 'Unknown' ELSE 'Upper' END AS band FROM {EXAM})
SELECT run_id, band, count(*) AS n, round(regr_slope(pct, year), 9) AS slope, round(regr_intercept(pct, year), 6) AS intercept, round(corr(year, pct), 6) AS r FROM x GROUP BY ALL HAVING count(*) >= 3""")
def lines_by_band(spark, sf):
    rows = exam_scores(spark, sf).withColumn("band", scoring.grade_band("group"))
    return stats.line(rows, "year", "pct", "run_id", "band").select("run_id", "band", "n", F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r", 6).alias("r"))
