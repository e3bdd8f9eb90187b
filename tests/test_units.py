"""Known values of the rules, and readers and sinks over small files."""

import json
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scoreloom.functions import parsing, scoring
from scoreloom.operators import filters, humans, quality, retry
from scoreloom.sources import readers, schemas, sinks
from scoreloom.streaming.telemetry import Pace, counters, estimate, project, throttled


def answers(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [(r.answer, r.rationale, r.warning) for r in parsing.parse_answers(rows).orderBy("i").collect()]


def test_answer_cascade(spark):
    got = answers(spark, [
        '{"answer": "B", "reason": "r"}', "I think A.\nFinal answer: C.", "Final answer: Declined.", "I choose not to answer.", "ICH WÄHLE, nicht zu antworten", "the answer is d.",
        'text {"answer": "a"} more', "   ", None, "xyz", "Final answer: 42\nb", '{"answer": "B"', "{'answer': 'B'} E", "Antwort — „x“ \n**Antwort**: A",
    ])
    assert got[:8] == [("B", "r", None), ("C", None, None), ("DECLINED", None, "declined_explicit"), ("DECLINED", None, "declined_phrase"), ("DECLINED", None, "declined_phrase"), ("D", None, "regex_fallback"), ("A", None, "json_extracted"), (None, None, "empty_response")]
    assert got[8:] == [(None, None, "empty_response"), (None, None, "no_parse"), ("B", None, "regex_fallback"), ("B", None, "regex_fallback"), ("B", None, "regex_fallback"), ("A", None, "regex_fallback")]


def test_scores(spark):
    rows = spark.createDataFrame([(5.0, "A", "A"), (5.0, "A", " a "), (4.0, "A", "B"), (4.0, "A", None), (4.0, "A", "declined"), (4.0, None, "A"), (0.0, "A", "A"), (math.nan, "A", "A")], "p double, a string, x string")
    got = rows.select(scoring.points_earned("p", "a", "x"), scoring.is_correct("p", "a", "x"), scoring.points_earned("p", "a", "x", False)).collect()
    assert [tuple(r) for r in got] == [(5.0, True, 5.0), (5.0, True, 5.0), (-1.0, False, -1.0), (-1.0, False, 0.0), (0.0, False, 0.0), (0.0, None, 0.0), (0.0, None, 0.0), (0.0, None, 0.0)]


def test_start_capital(spark):
    rows = spark.createDataFrame([("3-4",), ("11-13",), ("Junior",), (None,), ("6/7",), ("14",)], "g string")
    assert [r[0] for r in rows.select(scoring.start_capital("g")).collect()] == [24.0, 30.0, 0.0, 0.0, 24.0, 0.0]


BINS = [("y", "3", 0, 120.0, 120.0, 1), ("y", "3", 1, 112.0, 119.75, 2), ("y", "3", 2, 0.0, 111.75, 3)]


def test_grade_stats(spark):
    bins = spark.createDataFrame(BINS, "year string, grade string, idx int, lo double, hi double, n bigint")
    assert humans.grade_stats(bins).first()["mean"] == pytest.approx(86.5625)
    scores = spark.createDataFrame([(0.0,), (115.0,), (120.0,), (118.0,), (500.0,)], "s double").join(humans.with_bins(bins))
    got = [(r[0], r[1]) for r in scores.orderBy("s").select(humans.percentile(F.col("s"), F.col("bins"), F.lit(120.0)), humans.bin_of(F.col("s"), F.col("bins"), F.lit(120.0))).collect()]
    assert [g[0] for g in got] == pytest.approx([0, (3 + 2 * 3 / 7.75) / 6, (3 + 2 * 6 / 7.75) / 6, 1, 1])
    assert [g[1] for g in got] == [2, 1, 1, 0, 0]


def test_baseline_files(spark, tmp_path):
    base = {
        "schema_version": "2.0", "year": 2008, "grades": [{"id": "3", "label": "3", "members": [3], "max_points": 120}],
        "bins": [{"id": "a", "range_default": {"min": 120, "max": 120, "inclusive": "both"}}, {"id": "b", "range_default": {"min": 0, "max": 111.75, "inclusive": "both"}, "ranges_by_grade": {"3": {"min": 1, "max": 100, "inclusive": "left"}}}],
        "counts_by_grade": {"3": [1, 2]}, "totals_by_grade": {"3": 3},
    }
    (tmp_path / "human_baseline_2008.json").write_text(json.dumps(base, indent=1))
    good, bad = readers.baselines(spark, str(tmp_path))
    assert [(r.idx, r.lo, r.n) for r in readers.baseline_bins(good).orderBy("idx").collect()] == [(0, 120.0, 1), (1, 1.0, 2)]
    (tmp_path / "human_baseline_2009.json").write_text(json.dumps(base | {"totals_by_grade": {"3": 4}}))
    (tmp_path / "human_baseline_2010.json").write_text("{broken")
    with pytest.raises(ValueError):
        readers.baselines(spark, str(tmp_path))
    good, bad = readers.baselines(spark, str(tmp_path), strict=False)
    assert good.count() == 1 and sorted(len(r.broken) for r in bad.collect())[0] == 1 and bad.count() == 2


def test_runs_and_results(spark, tmp_path):
    for name, files in (("a", ("metrics.json", "config.json")), ("b", ("metrics.json",))):
        (tmp_path / name).mkdir()
        for f in files:
            (tmp_path / name / f).write_text('{"accuracy": 0.5,\n "model_id": "m"}')
    assert [(r.run_id, r.metrics.accuracy, r.config.model_id) for r in readers.runs(spark, str(tmp_path)).collect()] == [("a", 0.5, "m")]
    (tmp_path / "a/results.json").write_text('[{"id": "1", "predicted": "A"}]')
    assert readers.run_results(spark, str(tmp_path / "a")).first().results_source == "json"
    (tmp_path / "a/results.jsonl").write_text('{"id": "1", "predicted": "B"}\n\n{"id": "2"}\n')
    rows = readers.run_results(spark, str(tmp_path / "a"))
    assert rows.first().results_source == "jsonl" and rows.count() == 2
    sinks.results(rows.drop("results_source").limit(0), str(tmp_path / "b"), ("parquet", "csv"))
    assert readers.run_results(spark, str(tmp_path / "b")).columns == [*spark.createDataFrame([], schemas.RESULTS).columns, "results_source"]
    with pytest.raises(Exception):
        sinks.results(rows.drop("results_source"), str(tmp_path / "b"))
    with pytest.raises(ValueError):
        readers.pick_runs(readers.runs(spark, str(tmp_path)), ["a", "zz"])
    with pytest.raises(ValueError):
        readers.questions(spark, str(tmp_path / "b/results.parquet"))
    assert readers.resolved(spark, "results.parquet", (str(tmp_path / "b"),)).endswith("b/results.parquet")
    assert sinks.run_name("x/y", datetime(2024, 5, 1, 2, 3, 4)) == "20240501_020304_x-y"
    (tmp_path / "m.json").write_text('{"models": [{"id": "a", "rate_limit": {"requests_per_minute": 30}}, {"id": "b", "rate_limit": {"requests_per_second": 4, "requests_per_minute": 1}}, {"id": "c"}]}')
    assert [r.min_interval for r in readers.models(spark, str(tmp_path / "m.json")).orderBy("id").collect()] == [2.0, 0.25, None]
    (tmp_path / ".env").write_text("export A='1'\n# x\nB=2\n")
    assert readers.dotenv(str(tmp_path / ".env"), {"B": "9"}) == {"A": "1", "B": "9"}


def test_retry(spark):
    rows = spark.createDataFrame([("q1", None, None, None), ("q2", "B", True, 4.0), ("q3", " f ", False, -1.0)], "id string, predicted string, is_correct boolean, points_earned double")
    assert sorted(r.id for r in retry.missing(rows).collect()) == ["q1", "q3"]
    assert [(r.value, r["count"]) for r in retry.invalid_counts(rows).collect()] == [("F", 1)]
    again = retry.with_origin(spark.createDataFrame([("q1", "C", True, 5.0), ("q3", None, None, None)], rows.schema), "20240601_1_m", "x")
    got = {r.id: r for r in retry.merged(rows, again, "predicted").collect()}
    assert (got["q1"].predicted, got["q1"].filled_by_retry, got["q1"].filled_timestamp, got["q1"].predicted_original) == ("C", True, "20240601", None)
    assert (got["q2"].predicted, got["q2"].filled_by_retry, got["q2"].filled_run_id) == ("B", False, None)
    assert [r.id for r in retry.unresolved(rows, again).collect()] == ["q3"]


def test_pace(spark):
    def go(p, items, tokens_left, mean_tokens, **limits):
        middle, deviation = p.spread()
        state = spark.createDataFrame([(p.samples, p.tokens, p.requests, middle, deviation)], "samples bigint, token_rate double, request_rate double, middle double, deviation double")
        return estimate(state, F.lit(items), F.lit(tokens_left).cast("double"), F.lit(mean_tokens).cast("double"), **limits).first()

    p = Pace()
    for i in range(6):
        p.add(90, 900, i * 0.9)
    e = go(p, 3, 270, 90)
    assert 2.6 <= e.seconds <= 2.8 and e.confidence == "low" and not e.capped
    q = Pace()
    for i in range(8):
        q.add(100, 1000, float(i))
    q.add(10_000, 10, 8.0)
    assert q.samples == 8 and go(q, 10, None, None, min_interval=0.2).requests_per_second <= 5
    # rates of all workers, capped by the limit on requests; no rate of requests is the limit itself
    both = go(q, 10, 1000, 100, workers=4, min_interval=2.0)
    assert both.requests_per_second == 2 and both.tokens_per_second == 200 and both.capped and both.seconds == pytest.approx(0.8 * 5 + 0.2 * 5)
    none = go(Pace(), 10, None, None, workers=2, min_interval=1.0)
    assert none.requests_per_second == 2 and none.capped and none.seconds == 5 and go(Pace(), 10, None, None).seconds is None


def test_throttled(spark):
    """Stretches folded on their own and then together come to what one fold over all events gives."""
    import random

    rng = random.Random(1)
    rows = [(i * rng.randint(1, 3) if i % 50 == 0 else i * 3 + 1, "m" + str(i % 2), "failure" if rng.random() < 0.3 else "success") for i in range(3000)]
    rows = sorted({r[0]: r for r in rows}.values())
    want = {}
    for _, model, kind in rows:
        wait = want.get(model, 0.0)
        want[model] = (0.5 if wait == 0 else min(30.0, wait * 2)) if kind == "failure" else wait * 0.8
    events = spark.createDataFrame(rows, "seq bigint, model string, type string").repartition(3)
    for chunk in (4096, 64, 1):
        assert {r.model: r.interval for r in throttled(events, "model", chunk=chunk).collect()} == pytest.approx(want, rel=1e-9)


def test_projection(spark):
    events = spark.createDataFrame([(1, "success", 600, 400, None, 0.12, 10.0, 1)], "seq int, type string, prompt_tokens bigint, completion_tokens bigint, given_tokens bigint, cost_usd double, latency_ms double, attempts int")
    assert project(counters(events), 10).first()["projected"] == pytest.approx(1.2)


def test_header_usage(spark):
    rows = spark.createDataFrame([('{"prompt_tokens": 17, "completion_tokens": 5}',), ("input_tokens=12, output_tokens=2; cost=0.5",), (None,)], "h string")
    got = parsing.header_usage(F.col("h"))
    assert [tuple(r) for r in rows.select(got["prompt_tokens"], got["completion_tokens"], got["total_tokens"], got["cost_usd"]).collect()] == [(17, 5, 22, None), (12, 2, 14, 0.5), (None, None, None, None)]


def test_filter_parsing():
    f = filters.RowFilter.parse({"years": ["2001"], "points_min": ["3"], "multimodal": ["true"]})
    assert f.years == [2001] and f.ranges == {"points": (3.0, None)} and f.multimodal is True
    with pytest.raises(ValueError):
        filters.RowFilter.parse({"years": ["x"]})
    with pytest.raises(ValueError):
        filters.parse_range("5-")


def test_blobs(spark):
    rows = spark.createDataFrame([("data:x",), ("http://a",), ("QUJDREVGR0hJSktMTU5P",), ("a/b.png",), (" ",), (None,)], "t string")
    assert [r[0] for r in rows.select(quality.blob_kind(F.col("t"))).collect()] == ["data_url", "http_url", "base64", "path", None, None]
