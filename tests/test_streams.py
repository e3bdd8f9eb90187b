"""Ordered state over late events, and a sink that batches may reach twice."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scoreloom.sources.shared import shared_dir
from scoreloom.streaming import telemetry as t

SHAPE = "model string, seq bigint, ts timestamp, total bigint, latency_ms double"


def events(n=400):
    rng = random.Random(4)
    base = pd.Timestamp("2024-01-01")
    return [(f"m{i % 2}", i, (base + pd.Timedelta(seconds=3 * i + rng.randrange(3))).to_pydatetime(), rng.choice([0, 50, 100, 5000, None]), rng.choice([100.0, 900.0, None, 0.0])) for i in range(n)]


def answer(rows, model):
    pace = t.Pace()
    for _, seq, ts, total, latency in sorted((r for r in rows if r[0] == model), key=lambda r: (r[2], r[1])):
        pace.add(total, latency, ts.timestamp())
    return pace.samples, pace.tokens, pace.requests, *pace.spread()


def run(spark, batches, **options):
    path = shared_dir(spark, "events")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.parquet(f"{path}/{i}")
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    got = t.drained(t.pace(stream, **options), "update", "pace", ("model",))
    return {r.model: (r.samples, r.token_rate, r.request_rate, r.middle, r.deviation) for r in got.collect()}


def test_late_events_take_their_place(spark):
    """Events dealt to three batches at random, late by up to twenty minutes, give what one pass in order gives."""
    rows = events()
    rng = random.Random(8)
    dealt = [[], [], []]
    for r in rows:
        dealt[rng.randrange(3)].append(r)
    for waiting in (t.WAITING, 200):
        got = run(spark, dealt, delay="1 hour", waiting=waiting)
        for model in ("m0", "m1"):
            assert got[model] == pytest.approx(answer(rows, model), rel=1e-9)


def test_what_waits_is_bounded():
    """Of more events than may wait the earliest are applied; the state never has more."""

    class State:
        def __init__(self):
            self.value = None

        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

        put = update

        def clear(self):
            self.value = None

    class Handle:
        timers = []
        getValueState = getListState = lambda self, *_: State()

        def registerTimer(self, at):
            self.timers.append(at)

    class Times:
        getCurrentWatermarkInMs = lambda self: 0

    one = t.PaceInOrder(10)
    one.init(Handle())
    rows = [r for r in events() if r[0] == "m0"]
    frame = pd.DataFrame([(r[2].timestamp(), r[1], r[3], r[4]) for r in rows], columns=["at", "seq", "total", "latency_ms"]).sample(frac=1, random_state=1)
    frame = frame.sort_values("at")
    for start in range(0, len(frame), 37):
        out = list(one.handleInputRows(("m0",), iter([frame[start : start + 20], frame[start + 20 : start + 37]]), Times()))
        assert len(one.waiting.value) <= 10 and len(one.rates.value[4]) <= t.RATES
    assert tuple(out[0].iloc[0, 1:]) == pytest.approx(answer(rows, "m0"), rel=1e-9)


def test_a_batch_that_is_run_again(spark):
    sink = t.BatchSink(spark, shared_dir(spark, "sink"))
    frame = lambda *x: spark.createDataFrame([(v,) for v in x], "x int")
    sink.put(frame(1, 2, 3), 0)
    sink.put(frame(4), 1)
    sink.put(frame(1, 2, 3), 0)  # after a failure the same batch comes once more
    frame(9, 9).write.parquet(f"{sink.path}/rows/batch_=2")  # rows of a batch that died before its marker
    assert sorted((r.x, r.batch_) for r in sink.rows().collect()) == [(1, 0), (2, 0), (3, 0), (4, 1)]
    sink.put(frame(5), 2)
    assert sorted(r.x for r in sink.rows().select(F.col("x")).collect()) == [1, 2, 3, 4, 5]


def test_last_events_of_batches(spark):
    """What is kept over batches that come in any order is what one pass over all events gives."""
    shape = "model string, seq bigint, type string, given_tokens bigint, prompt_tokens bigint, completion_tokens bigint"
    rng = random.Random(6)
    rows = [(f"m{i % 2}", i, rng.choice(["success", "failure"]), rng.choice([None, 0, 7 * i + 1]), None, rng.choice([None, 3])) for i in range(300)]
    rng.shuffle(rows)
    path = shared_dir(spark, "events")
    for i in range(3):
        spark.createDataFrame(rows[i::3], shape).coalesce(1).write.parquet(f"{path}/{i}")
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    whole = spark.createDataFrame(rows, shape)
    got = t.drained(t.token_sample_of_stream(stream, 20), "update", "sample", ("model",))
    names = ["model", "mean", "median", "p90", "samples"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, t.token_sample(whole, "model", size=20).select(names).collect()))
    got = t.drained(t.recent_of_stream(stream, 4), "update", "recent", ("model", "place"))
    names = ["model", "seq", "type", "place"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, t.recent(whole, 4, "model").select(names).collect()))
