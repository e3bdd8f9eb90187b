"""Queries on telemetry (streams) and statistics."""

from __future__ import annotations

import os
from functools import partial

from pyspark.sql import functions as F

from ..operators import dashboard as d
from ..operators import resampling, stats
from ..sources.adapters import usage_events
from ..streaming import telemetry as t
from .dashboard_queries import EXAM, exam_scores
from .registry import query

COUNTERS = """(SELECT model, count(*) FILTER (WHERE type = 'success') AS success, count(*) FILTER (WHERE type = 'failure') AS failure, count(*) FILTER (WHERE type = 'skipped') AS skipped, count(*) AS completed,
  CAST(coalesce(sum(prompt_tokens) FILTER (WHERE prompt_tokens > 0), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(completion_tokens) FILTER (WHERE completion_tokens > 0), 0) AS BIGINT) AS completion_tokens, CAST(sum(total) AS BIGINT) AS total_tokens, count(*) FILTER (WHERE total > 0) AS with_usage,
  CAST(sum(greatest(attempts, 1)) AS BIGINT) AS attempts, avg(latency_ms) FILTER (WHERE latency_ms > 0) AS mean_latency, sum(cost_usd) AS known_cost, count(cost_usd) AS with_cost, sum(cost_usd) FILTER (WHERE total > 0) AS token_cost,
  CAST(sum(total) FILTER (WHERE cost_usd IS NOT NULL) AS BIGINT) AS tokens_with_cost, CAST(sum(total) FILTER (WHERE cost_usd IS NULL) AS BIGINT) AS tokens_without_cost
  FROM (SELECT *, coalesce(nullif(given_tokens, 0), coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)) AS total FROM usage) GROUP BY model)"""


class _Streaming:
    """A session whose parquet reader gives streams, for adapters that take a session."""

    def __init__(self, spark):
        self.read, self.spark = self, spark

    def parquet(self, path: str):
        schema = self.spark.read.parquet(path).schema
        folder, name = os.path.split(path)
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name[:-1]}[{name[-1]}]")


def stream(spark, sf):
    return usage_events(_Streaming(spark), sf)


@query("T01_T02_T13_stream_counters", f"SELECT * FROM {COUNTERS}")
def stream_counters(spark, sf):
    return t.drained(t.counters(stream(spark, sf), "model"), "complete", "counters")


@query("T01_T08_T09_counters", f"SELECT * FROM {COUNTERS}")
def counters(spark, sf):
    return t.counters(usage_events(spark, sf), "model")


@query("T05_cost_projection", f"""
WITH p AS (SELECT *, known_cost + tokens_without_cost * (token_cost / tokens_with_cost) + greatest(0, 20000 - completed) * (total_tokens / with_usage) * (token_cost / tokens_with_cost) AS projected FROM {COUNTERS})
SELECT model, round(projected, 6) AS projected, round(greatest(known_cost, projected - greatest(0.01, projected * 0.05)), 6) AS projected_low, round(projected + greatest(0.01, projected * 0.05), 6) AS projected_high, 'high' AS confidence FROM p""")
def cost_projection(spark, sf):
    out = t.project(t.counters(usage_events(spark, sf), "model"), 20000)
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("model", r("projected"), r("projected_low"), r("projected_high"), "confidence")


TOTALS = "(SELECT *, coalesce(nullif(given_tokens, 0), coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)) AS total FROM usage)"


TOKEN_SAMPLE = f"""
SELECT m.model, mean, median, CAST(p90 AS BIGINT) AS p90, samples FROM (SELECT model, avg(total) AS mean FROM {TOTALS} WHERE total > 0 GROUP BY model) m
JOIN (SELECT model, median(total) AS median, quantile_disc(total, 0.9) AS p90, count(*) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY seq DESC) AS place FROM {TOTALS} WHERE total > 0) WHERE place <= 512 GROUP BY model) s USING (model)"""


@query("T03_token_sample", TOKEN_SAMPLE)
def token_sample(spark, sf):
    return t.token_sample(usage_events(spark, sf), "model")


RECENT = "SELECT model, seq, type, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY model ORDER BY seq DESC) AS INTEGER) AS place FROM usage) WHERE place <= 5"


@query("T04_recent", RECENT)
def recent(spark, sf):
    return t.recent(usage_events(spark, sf), 5, "model").select("model", "seq", "type", "place")


@query("T03_stream_token_sample", TOKEN_SAMPLE)
def stream_token_sample(spark, sf):
    return t.drained(t.token_sample_of_stream(stream(spark, sf)), "update", "sample", ("model",))


@query("T04_stream_recent", RECENT)
def stream_recent(spark, sf):
    return t.drained(t.recent_of_stream(stream(spark, sf), 5), "update", "recent", ("model", "place"))


@query("T06_T07_stream_pace")
def stream_pace(spark, sf):
    events = stream(spark, sf).withColumn("total", t.total_tokens())
    last = t.drained(t.pace(events.select("model", "seq", "total", "latency_ms", "ts")), "update", "pace", ("model",))
    return t.estimate(last, F.lit(1000), F.lit(500_000.0), F.lit(500.0), workers=4, min_interval=0.5)


@query("T11_throttled", "SELECT model, round(list_reduce(list_prepend(0.0::DOUBLE, list(CASE WHEN type = 'failure' THEN 1.0 ELSE 0.0 END::DOUBLE ORDER BY seq)), lambda wait, slow: CASE WHEN slow = 1 THEN CASE WHEN wait = 0 THEN 0.5 ELSE least(wait * 2, 30) END ELSE wait * 0.8 END::DOUBLE), 9) AS interval, count(*) AS events FROM usage GROUP BY model")
def throttled(spark, sf):
    return t.throttled(usage_events(spark, sf), "model").withColumn("interval", F.round("interval", 9))


@query("T10_windowed_events", "SELECT time_bucket(INTERVAL '6 hours', ts) AS start, type, count(*) AS n FROM usage GROUP BY ALL")
def windowed_events(spark, sf):
    """Counts are told whenever they change, and a window's state goes a day after the newest event."""
    counts = stream(spark, sf).withWatermark("ts", "1 day").groupBy(F.window("ts", "6 hours"), "type").agg(F.count(F.lit(1)).alias("n"))
    flat = counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "type", "n")
    return t.drained(flat, "update", "windows", ("start", "type"))


@query("N01_N02_lines", f'SELECT run_id, count(*) AS n, round(regr_slope(pct, year), 9) AS slope, round(corr(year, pct), 6) AS r FROM {EXAM} GROUP BY run_id')
def lines(spark, sf):
    return stats.line(exam_scores(spark, sf), "year", "pct", "run_id").select("run_id", "n", F.round("slope", 9).alias("slope"), F.round("r", 6).alias("r"))


@query("N18_N19_drift", f'SELECT "group", round(regr_slope(gap, year), 9) AS slope, round(median(gap), 9) AS median_gap FROM (SELECT year, "group", max(pct) - min(pct) AS gap FROM {EXAM} GROUP BY ALL) GROUP BY "group"')
def drift(spark, sf):
    gap = exam_scores(spark, sf).groupBy("year", "group").agg((F.max("pct") - F.min("pct")).alias("gap"))
    return gap.groupBy("group").agg(F.round(F.regr_slope("gap", "year"), 9).alias("slope"), F.round(F.median("gap"), 9).alias("median_gap"))


def difficulties(spark, sf):
    """year, group: z of a first and a second half of runs, within the group."""
    rows = exam_scores(spark, sf).groupBy("year", "group").agg(F.avg(F.when(F.col("run_id") < "NF", F.col("pct"))).alias("a"), F.avg(F.when(F.col("run_id") >= "NF", F.col("pct"))).alias("b"), F.sum("possible").alias("size"))
    x = d.z_scores(rows, ["group"], "a").withColumnRenamed("z", "za")
    return d.z_scores(x, ["group"], "b").withColumnRenamed("z", "zb").withColumn("za", -F.col("za")).withColumn("zb", -F.col("zb"))


DIFFICULTIES = f"""(SELECT year, "group", CASE WHEN stddev_pop(a) OVER w > 0 THEN -(a - avg(a) OVER w) / stddev_pop(a) OVER w ELSE 0 END AS za, CASE WHEN stddev_pop(b) OVER w > 0 THEN -(b - avg(b) OVER w) / stddev_pop(b) OVER w ELSE 0 END AS zb
  FROM (SELECT year, "group", avg(pct) FILTER (WHERE run_id < 'NF') AS a, avg(pct) FILTER (WHERE run_id >= 'NF') AS b FROM {EXAM} GROUP BY ALL) WINDOW w AS (PARTITION BY "group"))"""


@query("N05_N10_N17_agreement", f"""
SELECT "group", count(*) FILTER (WHERE (za > 0) = (zb > 0)) / count(*) AS same_side, count(*) FILTER (WHERE abs(za) >= 1 AND abs(zb) >= 1 AND (za > 0) = (zb > 0)) / nullif(count(*) FILTER (WHERE abs(za) >= 1), 0) AS recall,
  count(*) FILTER (WHERE abs(za) >= 1 AND abs(zb) >= 1 AND (za > 0) = (zb > 0)) / nullif(count(*) FILTER (WHERE abs(zb) >= 1), 0) AS precision, count(*) FILTER (WHERE (za > 0) <> (zb > 0)) AS unlike FROM {DIFFICULTIES} GROUP BY "group" """)
def agreement(spark, sf):
    return stats.agreement(difficulties(spark, sf), "za", "zb", "group")


@query("N06_scale_difficulty", f'SELECT run_id, year, "group", round(CASE WHEN stddev_samp(pct) OVER w > 0 THEN -(pct - avg(pct) OVER w) / stddev_samp(pct) OVER w ELSE 0 END, 6) AS difficulty, round(1.96 * stddev_samp(pct) OVER w / sqrt(count(*) OVER w), 9) AS band FROM {EXAM} WINDOW w AS (PARTITION BY "group")')
def scale_difficulty(spark, sf):
    return stats.scale_difficulty(exam_scores(spark, sf), "pct", "group").select("run_id", "year", "group", F.round("difficulty", 6).alias("difficulty"), F.round("band", 9).alias("band"))


@query("N03_N04_residuals", f"""
WITH x AS (SELECT run_id, year, "group", total, possible FROM {EXAM}), l AS (SELECT "group", regr_slope(total, possible) AS b, regr_intercept(total, possible) AS a FROM x GROUP BY "group")
SELECT x."group", run_id, year, round(total - a - b * possible, 4) AS residual FROM x JOIN l ON l."group" = x."group" """)
def residuals(spark, sf):
    return resampling.residuals(exam_scores(spark, sf), "total", ["possible"], "group", ["run_id", "year"]).withColumn("residual", F.round("residual", 4))


for _kind in ("r", "slope"):

    def _bootstrap(spark, sf, kind):
        return stats.bootstrap(difficulties(spark, sf), kind, "za", "zb", "group")

    query(f"N0{7 + (_kind == 'slope')}_bootstrap_{_kind}")(partial(_bootstrap, kind=_kind))


@query("N09_bootstrap_fit")
def bootstrap_fit(spark, sf):
    return stats.bootstrap_fit(difficulties(spark, sf), "zb", ["za", "size"], "group")
