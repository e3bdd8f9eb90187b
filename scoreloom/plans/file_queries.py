"""Queries that go through files, and the remaining small operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters
from ..operators import humans as h
from ..operators import metrics
from ..operators import quality as v
from ..operators import stats
from ..sources import readers, sinks
from ..sources.adapters import human_bins, results, table
from ..streaming import telemetry as t
from .dashboard_queries import RUNS, exam_scores, runs
from .data_queries import IMAGES, questions
from .human_queries import ENTRIES, entries, grades
from .registry import query

RUN = "SELECT id, year, \"group\", points, predicted, is_correct, points_earned, total_tokens, warnings FROM results"


def stored(spark, sf):
    return results(spark, sf).select("id", F.col("year").cast("string").alias("year"), "group", "points", "predicted", "is_correct", "points_earned", "total_tokens", "warnings")


def _as_stored(rows):
    return rows.select("id", F.col("year").cast("int").alias("year"), "group", "points", "predicted", "is_correct", "points_earned", "total_tokens", "warnings")


@query("K01_K07_S03_S06_parquet_results", RUN)
def parquet_results(spark, sf):
    folder = t.shared_dir(spark, "results")
    sinks.results(stored(spark, sf), folder, ("parquet", "jsonl"))
    return _as_stored(readers.run_results(spark, folder))


@query("K02_K03_S04_S05_S13_S14_json_results", RUN)
def json_results(spark, sf):
    folder = t.shared_dir(spark, "results")
    sinks.results(stored(spark, sf), folder, ("jsonl",))
    return _as_stored(readers.any_table(spark, f"{folder}/results.jsonl"))


@query("K06_export_csv", "SELECT id, points FROM results WHERE multimodal")
def export_csv(spark, sf):
    path = t.shared_dir(spark, "export")
    sinks.export(results(spark, sf).where("multimodal").select("id", "points"), path, "csv")
    return spark.read.schema("id string, points double").option("header", True).csv(path)


RUN_FOLDERS = """
SELECT run_id, 'm' AS model, count(*) FILTER (WHERE predicted IS NOT NULL AND error IS NULL) AS answered, coalesce(count(*) FILTER (WHERE predicted IS NOT NULL AND error IS NULL AND is_correct) / count(*) FILTER (WHERE predicted IS NOT NULL AND error IS NULL), 0) AS accuracy
FROM results GROUP BY run_id"""


@query("K04_S07_snapshots", RUN_FOLDERS)
def run_snapshots(spark, sf):
    """All runs by one write, read by its manifest."""
    top = t.shared_dir(spark, "runs")
    counts = metrics.status_counts(results(spark, sf), "run_id")
    sinks.snapshots(counts.select("run_id", F.struct(F.col("answered").alias("answered_count"), "accuracy").alias("metrics"), F.struct(F.lit("m").alias("model_id")).alias("config")), top)
    return readers.snapshots(spark, top).select("run_id", F.col("config.model_id").alias("model"), F.col("metrics.answered_count").alias("answered"), F.col("metrics.accuracy").alias("accuracy"))


@query("K04_K08_K09_S07_S18_run_folders", RUN_FOLDERS)
def run_folders(spark, sf):
    top, counts = t.shared_dir(spark, "runs"), metrics.status_counts(results(spark, sf), "run_id")
    names = [r.run_id for r in counts.select("run_id").distinct().orderBy("run_id").collect()]  # one row a run
    for run in names:  # a snapshot a run, as a runner leaves it
        one = counts.where(F.col("run_id") == run)
        sinks.as_json(one.select(F.col("answered").alias("answered_count"), "accuracy")).coalesce(1).write.text(f"{top}/{run}/metrics.json")
        sinks.as_json(one.select(F.lit("m").alias("model_id"))).coalesce(1).write.text(f"{top}/{run}/config.json")
    return readers.pick_runs(readers.runs(spark, top), names).select("run_id", F.col("config.model_id").alias("model"), F.col("metrics.answered_count").alias("answered"), F.col("metrics.accuracy").alias("accuracy"))


@query("S08_S09_H03_H21_baselines", "SELECT year, grade, idx, lo, hi, n FROM human_bins")
def baselines(spark, sf):
    """A baseline file a year, written from the bins and loaded through its invariants."""
    top, bins = t.shared_dir(spark, "baselines"), human_bins(spark, sf)
    per = bins.groupBy("year", "grade").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "n"))), lambda x: x["n"]).alias("counts"), F.sum("n").alias("total"))
    ranges = F.transform(F.array_sort(F.collect_set(F.struct("idx", "lo", "hi"))), lambda b: F.struct(b["idx"].cast("string").alias("id"), F.struct(b["lo"].alias("min"), b["hi"].alias("max"), F.lit("both").alias("inclusive")).alias("range_default")))
    years = per.groupBy("year").agg(
        F.array_sort(F.collect_list(F.struct(F.col("grade").alias("id"), F.col("grade").alias("label"), F.array(F.col("grade").cast("int")).alias("members"), F.lit(120.0).alias("max_points")))).alias("grades"),
        F.map_from_entries(F.collect_list(F.struct("grade", "counts"))).alias("counts_by_grade"), F.map_from_entries(F.collect_list(F.struct("grade", "total"))).alias("totals_by_grade"),
    ).join(bins.groupBy("year").agg(ranges.alias("bins")), "year")
    whole = years.select(F.lit("2.0").alias("schema_version"), *years.columns)
    sinks.as_json(whole).write.option("maxRecordsPerFile", 1).text(f"{top}/human_baseline_all.json")
    good, _ = readers.baselines(spark, top)
    return readers.baseline_bins(good)


@query("S16_models", "SELECT * FROM (VALUES ('a', 2.0::DOUBLE), ('b', 0.25::DOUBLE), ('c', NULL)) m(id, min_interval)")
def models(spark, sf):
    path = t.shared_dir(spark, "models")
    text = '{"models": [{"id": "a", "rate_limit": {"requests_per_minute": 30}}, {"id": "b", "rate_limit": {"requests_per_second": 4, "requests_per_minute": 1}}, {"id": "c"}]}'
    spark.createDataFrame([(text,)], "value string").write.text(path)
    return readers.models(spark, path).select("id", "min_interval")


@query("S17_T14_failures", "SELECT id, error, CAST(NULL AS VARCHAR) AS message, -points * 0.25 AS points_earned FROM results WHERE error IS NOT NULL AND answer IS NOT NULL")
def failures(spark, sf):
    """Failed rows as logged, scored as unanswered."""
    path, rows = t.shared_dir(spark, "failures"), results(spark, sf).where("error is not null and answer is not null")
    rows.select("id", "error").write.json(path)
    return readers.failures(spark, path).join(rows.select("id", "points_earned").distinct(), "id").select("id", "error", "message", "points_earned")


@query("S01_S10_required_columns", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS problem_statement FROM part")
def required_columns(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("problem_statement"))
    return readers.require(rows, ("id", "problem_statement"))


@query("P09_P10_overview_query", f"SELECT run_id, model, failed FROM {RUNS} WHERE failed > 0 AND mode = 'full' ORDER BY failed")
def overview_query(spark, sf):
    asked = filters.OverviewQuery.parse({"has_failures": ["true"], "modes": ["full"], "sort": ["failed"], "order": ["asc"]})
    return asked.apply(runs(spark, sf)).select("run_id", "model", "failed")


@query("P14_extra_images", "SELECT count(*) FILTER (WHERE p_partkey % 14 = 0 OR p_partkey % 61 = 0) AS with_images, count(*) AS rows FROM part")
def extra_images(spark, sf):
    return questions(spark, sf).agg(F.count(F.when(filters.has_extra_images(["img"]), 1)).alias("with_images"), F.count(F.lit(1)).alias("rows"))


@query("P16_winner_view", f"SELECT run_id, year, grade FROM {ENTRIES} WHERE llm_pct >= 0.5 AND llm_pct < 0.75 AND llm_total > mean")
def winner_view(spark, sf):
    e = entries(spark, sf)
    return e.where((filters.tier(F.col("llm_pct")) == "average") & (h.outcome(F.col("llm_total") - F.col("mean")) == "llm")).select("run_id", "year", "grade")


@query("J16_H25_cover", """
WITH y AS (SELECT DISTINCT year FROM human_bins), g AS (SELECT year, list(DISTINCT grade ORDER BY grade) AS have FROM human_bins GROUP BY year)
SELECT year, "group", CASE "group" WHEN '5' THEN ['5'] WHEN 'Kl. 4' THEN ['4'] WHEN '3-5' THEN ['3', '5'] ELSE ['6', '7'] END AS grades, CASE "group" WHEN '5' THEN 'id' WHEN 'Kl. 4' THEN 'members' ELSE 'components' END AS how
FROM (SELECT year, have, unnest(['5', 'Kl. 4', '3-5', '6, 7', '3-9', 'Junior']) AS "group" FROM g) WHERE "group" NOT IN ('3-9', 'Junior') AND list_has_all(have, ['3', '4', '5', '6', '7'])""")
def cover(spark, sf):
    labels = grades(spark, sf).select("year").distinct().withColumn("group", F.explode(F.array(*map(F.lit, ("5", "Kl. 4", "3-5", "6, 7", "3-9", "Junior")))))
    return h.cover(labels, grades(spark, sf))


@query("C02_grade_years", "SELECT CAST(grade AS INTEGER) AS number, list_sort(list(DISTINCT year)) AS years FROM human_bins GROUP BY grade")
def grade_years(spark, sf):
    return h.grade_years(grades(spark, sf))


@query("C03_client_stats", f"SELECT count(*) FILTER (WHERE llm_total > mean) AS llm_wins, count(*) FILTER (WHERE llm_total < mean) AS human_wins, round(avg(percentile), 9) AS mean_percentile, (SELECT arg_max(year, p) FROM (SELECT year, avg(percentile) AS p FROM {ENTRIES} GROUP BY year)) AS best_year FROM {ENTRIES}")
def client_stats(spark, sf):
    return h.client_stats(entries(spark, sf)).withColumn("mean_percentile", F.round("mean_percentile", 9))


@query("C04_quick_stats", f"SELECT count(*) AS entries, min(year) AS first_year, max(year) AS last_year, count(DISTINCT grade) AS grades, sum(earned) AS awarded, sum(llm_max) AS most FROM {ENTRIES}")
def quick_stats(spark, sf):
    return h.quick_stats(entries(spark, sf))


@query("C09_five_numbers", f"SELECT year, grade, median(llm_pct) AS median, CASE WHEN count(*) > 5 THEN min(llm_pct) ELSE median(llm_pct) END AS low, median(llm_pct) AS p25, median(llm_pct) AS p75, max(llm_pct) AS high FROM {ENTRIES} GROUP BY year, grade")
def five_numbers(spark, sf):
    out = entries(spark, sf).groupBy("year", "grade").agg(F.median("llm_pct").alias("median"), F.when(F.count(F.lit(1)) > 5, F.min("llm_pct")).alias("low"), F.lit(None).cast("double").alias("p25"), F.lit(None).cast("double").alias("p75"), F.max("llm_pct").alias("high"))
    return h.five_numbers(out)


@query("V07_answer_without_option", "SELECT CASE WHEN p_partkey % 97 = 0 THEN 'dup' ELSE CAST(p_partkey AS VARCHAR) END AS id FROM part WHERE p_partkey % 53 = 0 AND p_partkey % 14 > 0 AND p_partkey % 61 > 0 AND p_partkey % 19 > 0 AND p_partkey % 5 = 0")
def answer_without_option(spark, sf):
    return questions(spark, sf).where(v.answer_without_option(IMAGES)).select("id")


@query("V10_missing_paths", "SELECT 'error' AS severity, 'image_path_missing' AS code, CASE WHEN p_partkey % 97 = 0 THEN 'dup' ELSE CAST(p_partkey AS VARCHAR) END AS id, 'img' AS path FROM part WHERE p_partkey % 14 = 0 OR p_partkey % 61 = 0")
def missing_paths(spark, sf):
    return v.missing_paths(questions(spark, sf), ["img"], spark.createDataFrame([("other",)], "path string"))


@query("V18_sample")
def sample(spark, sf):
    return filters.sampled(questions(spark, sf), 50, seed=0)


@query("N15_N20_alignment")
def alignment(spark, sf):
    """Each run's percentages against the mean of the others, by group, with bootstrap intervals."""
    from ..operators.dashboard import leave_one_out

    pairs = leave_one_out(exam_scores(spark, sf), ["year", "group"], "pct").where("others is not null")
    return stats.bootstrap(pairs, "r", "pct", "others", "run_id")
