"""Live usage telemetry (T01 to T09, T13) on Structured Streaming.

Counters are a streaming aggregate by model; the time estimate keeps running
rates and a bounded buffer of events in state, as it depends on their order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions.scoring import ratio
from ..sources.shared import shared_dir

SAMPLE, RATES, ALPHA = 512, 128, 0.2
#: Events of a key that wait for earlier ones.
WAITING = 4096
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def total_tokens() -> Column:
    """The given total, else prompt and completion."""
    return F.coalesce(F.nullif("given_tokens", F.lit(0)), F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0)))


def counters(events: DataFrame, *by: str) -> DataFrame:
    """Works on a stream and on a table alike."""
    n = lambda c: F.count(F.when(c, 1))
    positive = lambda c: F.coalesce(F.sum(F.when(F.col(c) > 0, F.col(c))), F.lit(0))
    marked = events.withColumn("total", total_tokens())
    cost = F.col("cost_usd").isNotNull()
    return marked.groupBy(*by).agg(
        n(F.col("type") == "success").alias("success"), n(F.col("type") == "failure").alias("failure"), n(F.col("type") == "skipped").alias("skipped"), F.count(F.lit(1)).alias("completed"),
        positive("prompt_tokens").alias("prompt_tokens"), positive("completion_tokens").alias("completion_tokens"), positive("total").alias("total_tokens"), n(F.col("total") > 0).alias("with_usage"),
        F.sum(F.greatest("attempts", F.lit(1))).alias("attempts"), F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))).alias("mean_latency"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("known_cost"), n(cost).alias("with_cost"), F.coalesce(F.sum(F.when(cost & (F.col("total") > 0), F.col("cost_usd"))), F.lit(0.0)).alias("token_cost"),
        F.coalesce(F.sum(F.when(cost & (F.col("total") > 0), F.col("total"))), F.lit(0)).alias("tokens_with_cost"), F.coalesce(F.sum(F.when(~cost & (F.col("total") > 0), F.col("total"))), F.lit(0)).alias("tokens_without_cost"),
    )


def project(counted: DataFrame, total_items: int) -> DataFrame:
    """Projected cost with a band and how sure it is."""
    per_token, per_item = ratio(F.col("token_cost"), F.col("tokens_with_cost")), ratio(F.col("known_cost"), F.col("with_cost"))
    left = F.greatest(F.lit(0), F.lit(total_items) - F.col("completed"))
    mean_tokens = ratio(F.col("total_tokens"), F.col("with_usage"))
    by_token = F.col("known_cost") + F.col("tokens_without_cost") * per_token + F.coalesce(left * mean_tokens * per_token, F.lit(0.0))
    projected = F.coalesce(by_token, per_item * total_items, F.col("known_cost"))
    band = F.greatest(F.lit(0.01), projected * F.when(F.col("with_cost") >= 50, 0.05).when(F.col("with_cost") >= 20, 0.07).otherwise(0.1))
    more = projected > F.col("known_cost")
    sure = F.when((F.col("with_cost") >= 50) & per_token.isNotNull(), "high").when(F.col("with_cost") >= 10, "medium").otherwise("low")
    return counted.withColumns({
        "projected": F.when(projected > 0, projected), "projected_low": F.when(more, F.greatest("known_cost", projected - band)), "projected_high": F.when(more, projected + band), "confidence": sure,
    })


def throttled(events: DataFrame, *by: str, first: float = 0.5, most: float = 30.0, chunk: int = 4096) -> DataFrame:
    """The interval that a limiter ends with: doubled by a throttle (from 0 to `first`, `most` at most), cut by a fifth by a success.

    What a stretch of events does to an interval d over 0 is least(cap, factor * d), and to 0
    some number, and two such steps make another one; so stretches of `chunk` sequence
    numbers are folded each on their own, and then the stretches of a group in order.
    """
    start = F.struct(F.lit(1.0).alias("factor"), F.lit(float("inf")).alias("cap"), F.lit(0.0).alias("zero"))

    def step(f: Column, slow: Column) -> Column:
        up = F.struct((f["factor"] * 2).alias("factor"), F.least(F.lit(most), f["cap"] * 2).alias("cap"), F.when(f["zero"] == 0, first).otherwise(F.least(F.lit(most), f["zero"] * 2)).alias("zero"))
        return F.when(slow, up).otherwise(F.struct((f["factor"] * 0.8).alias("factor"), (f["cap"] * 0.8).alias("cap"), (f["zero"] * 0.8).alias("zero")))

    kinds = F.transform(F.array_sort(F.collect_list(F.struct("seq", (F.col("type") == "failure").alias("slow")))), lambda e: e["slow"])
    parts = events.groupBy(*by, F.floor(F.col("seq") / chunk).alias("chunk_")).agg(F.count(F.lit(1)).alias("n_"), F.aggregate(kinds, start, step).alias("f_"))
    after = lambda d, p: F.when(d == 0, p["f_"]["zero"]).otherwise(F.least(p["f_"]["cap"], p["f_"]["factor"] * d))
    folded = F.aggregate(F.array_sort(F.collect_list(F.struct("chunk_", "f_"))), F.lit(0.0), after)
    return parts.groupBy(*by).agg(folded.alias("interval"), F.sum("n_").alias("events"))


def recent(events: DataFrame, k: int, *by: str) -> DataFrame:
    """Newest k events of each group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("seq")))
    return events.withColumn("place", place).where(F.col("place") <= k)


def token_sample(events: DataFrame, *by: str, size: int = SAMPLE) -> DataFrame:
    """Mean over all, median and nearest-rank 90th percentile over the last `size` totals."""
    known = events.withColumn("total", total_tokens()).where("total > 0")
    last = recent(known, size, *by)
    means = known.groupBy(*by).agg(F.avg("total").alias("mean"))
    cuts = last.groupBy(*by).agg(F.median("total").alias("median"), F.expr("percentile_disc(0.9) within group (order by total)").cast("bigint").alias("p90"), F.count(F.lit(1)).alias("samples"))
    return means.join(cuts, list(by))


class Pace:
    """Running rates; a rate far off the median of its predecessors is left out."""

    def __init__(self, state: tuple | None = None):
        self.last, self.requests, self.tokens, self.samples, rates = state or (None, None, None, 0, [])
        self.rates = list(rates)

    def state(self) -> tuple:
        return self.last, self.requests, self.tokens, self.samples, self.rates

    @staticmethod
    def blend(now: float | None, value: float) -> float:
        return value if now is None else (1 - ALPHA) * now + ALPHA * value

    def spread(self) -> tuple[float | None, float | None]:
        """Median, and scaled median deviation once there are five rates."""
        if not self.rates:
            return None, None
        middle = median(self.rates)
        return middle, 1.4826 * median([abs(r - middle) for r in self.rates]) if len(self.rates) >= 5 else None

    def add(self, tokens: float | None, latency_ms: float | None, at: float | None) -> None:
        if at is not None:
            if self.last is not None:
                self.requests = self.blend(self.requests, 1 / max(at - self.last, 1e-6))
            self.last = at
        if not tokens or not latency_ms or latency_ms <= 0:
            return
        rate = tokens / (latency_ms / 1000)
        middle, mad = self.spread()
        if mad is not None and abs(rate - middle) > 4 * mad:
            return
        self.rates = [*self.rates, rate][-RATES:]
        self.tokens = self.blend(self.tokens, rate)
        self.samples += 1


def estimate(rows: DataFrame, items: Column, tokens_left: Column, mean_tokens: Column, workers: int = 1, min_interval: float | None = None) -> DataFrame:
    """Rows of pace() with seconds to go and how sure that is: rates of all workers, capped by the limit on requests, blended four to one."""
    most = F.lit(workers / max(min_interval, 1e-6) if min_interval and workers > 0 else None).cast("double")
    positive = lambda c: F.when(c > 0, c)
    tokens, requests = (positive(F.col(c) * max(1, workers)) for c in ("token_rate", "request_rate"))
    # least() passes over nulls, so a missing limit caps nothing and a missing rate of requests is the limit
    slower, fewer = F.least(tokens, most * positive(mean_tokens)), F.least(requests, most)
    rated = rows.select("*", F.when(tokens.isNotNull(), slower).alias("tokens_per_second"), fewer.alias("requests_per_second"), (F.coalesce(slower < tokens, F.lit(False)) | (most.isNotNull() & F.coalesce(fewer < requests, F.lit(True)))).alias("capped"))
    by_tokens, by_items = F.try_divide(tokens_left, F.col("tokens_per_second")), F.try_divide(positive(items), F.col("requests_per_second"))
    seconds = F.coalesce(0.8 * by_tokens + 0.2 * by_items, by_tokens, by_items)
    wide = F.coalesce(F.col("deviation") > 0.4 * F.col("middle"), F.lit(False))
    sure = F.when((F.col("samples") < 10) | seconds.isNull(), "low").when((F.col("samples") < 30) | wide, "medium").otherwise("high")
    return rated.withColumn("seconds", seconds).withColumn("confidence", sure)


class PaceInOrder(StatefulProcessor):
    """T06 with state: running rates of a key (value state) and events that wait for their turn (list state).

    An event is applied once the watermark has passed it, in the order of time and
    number, so that what arrives late but before the watermark takes its place. At
    most `waiting` events wait; of more, the earliest are applied at once, and what
    is still earlier than those is left out, as is what comes behind the watermark.
    Events without a time are applied as they come. Rows told count the waiting
    events as well, so that they stand for all that has come.
    """

    def __init__(self, waiting: int = WAITING):
        self.most = waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rates = handle.getValueState("rates", "last double, requests double, tokens double, samples bigint, rates array<double>, upto double")
        self.waiting = handle.getListState("waiting", "at double, seq bigint, total double, latency_ms double")

    def held(self) -> tuple[Pace, float, list[tuple]]:
        state = tuple(self.rates.get()) if self.rates.exists() else None
        pace = Pace(state[:-1] if state else None)
        return pace, state[-1] if state else float("-inf"), [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []

    def settle(self, key: tuple, pace: Pace, upto: float, events: list[tuple], watermark: float) -> pd.DataFrame:
        """Applies what is due, keeps the rest, and tells where that leads."""
        events.sort()
        due = max(sum(e[0] <= watermark for e in events), len(events) - self.most)
        for at, _, total, latency in events[:due]:
            pace.add(total, latency, at)
        rest = events[due:]
        upto = events[due - 1][0] if due else upto
        self.rates.update((*pace.state(), upto))
        self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self.handle.registerTimer(int(rest[-1][0] * 1000) + 1)
        ahead = Pace(pace.state())
        for at, _, total, latency in rest:
            ahead.add(total, latency, at)
        middle, deviation = ahead.spread()
        return pd.DataFrame({"model": [key[0]], "samples": [ahead.samples], "token_rate": [ahead.tokens], "request_rate": [ahead.requests], "middle": [middle], "deviation": [deviation]}).astype({c: "float64" for c in ("token_rate", "request_rate", "middle", "deviation")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        pace, upto, events = self.held()
        value = lambda v: None if pd.isna(v) else float(v)
        for part in rows:
            for at, seq, total, latency in zip(part["at"], part["seq"], part["total"], part["latency_ms"]):
                if pd.isna(at):
                    pace.add(value(total), value(latency), None)
                elif at >= upto:
                    events.append((float(at), int(seq), value(total), value(latency)))
            if len(events) > 2 * self.most:
                # long batches are worked off as they are read
                events.sort()
                for at, _, total, latency in events[: -self.most]:
                    pace.add(total, latency, at)
                    upto = at
                events = events[-self.most :]
        yield self.settle(key, pace, upto, events, timerValues.getCurrentWatermarkInMs() / 1000)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.settle(key, *self.held(), timerValues.getCurrentWatermarkInMs() / 1000)

    def close(self) -> None:
        pass


def pace(events: DataFrame, delay: str = "1 hour", waiting: int = WAITING) -> DataFrame:
    """T06 on a stream: model, samples, rates and their spread after each batch. events: model, seq, ts, total, latency_ms; delay: how late an event may come."""
    given = events.withWatermark("ts", delay).select("model", "ts", F.col("ts").cast("double").alias("at"), F.col("seq").cast("bigint").alias("seq"), F.col("total").cast("double").alias("total"), F.col("latency_ms").cast("double").alias("latency_ms"))
    return given.groupBy("model").transformWithStateInPandas(PaceInOrder(waiting), "model string, samples bigint, token_rate double, request_rate double, middle double, deviation double", "Update", "EventTime")


class LastEvents(StatefulProcessor):
    """T03, T04 with state: of a key the `size` events of the highest numbers (list state), whenever they come, and sums over all (value state).

    tell makes rows of the key, the events (seq, total, type) with the newest first, their number and the sum of all totals.
    """

    def __init__(self, size: int, known: bool, tell: Callable[[str, list[tuple], int, float], pd.DataFrame]):
        self.size, self.known, self.tell = size, known, tell

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "seq bigint, total double, type string")
        self.sums = handle.getValueState("sums", "n bigint, total double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last = [tuple(x) for x in self.last.get()] if self.last.exists() else []
        n, total = tuple(self.sums.get()) if self.sums.exists() else (0, 0.0)
        for part in rows:
            part = part[part["total"] > 0] if self.known else part
            n, total = n + len(part), total + float(part["total"].sum())
            newest = part.nlargest(self.size, "seq")
            last += [(int(s), None if pd.isna(x) else float(x), k) for s, x, k in zip(newest["seq"], newest["total"], newest["type"])]
            last = sorted(last, key=lambda e: -e[0])[: self.size]
        if last:
            self.last.put(last)
            self.sums.update((n, total))
            yield self.tell(key[0], last, n, total)

    def close(self) -> None:
        pass


def _last(events: DataFrame, processor: LastEvents, shape: str) -> DataFrame:
    given = events.select("model", F.col("seq").cast("bigint").alias("seq"), total_tokens().cast("double").alias("total"), "type")
    return given.groupBy("model").transformWithStateInPandas(processor, shape, "Update", "None")


def recent_of_stream(events: DataFrame, k: int) -> DataFrame:
    """T04 on a stream: model, seq, type, place of the newest k events of a model after each batch."""

    def tell(model: str, last: list[tuple], n: int, total: float) -> pd.DataFrame:
        return pd.DataFrame({"model": model, "seq": [e[0] for e in last], "type": [e[2] for e in last], "place": range(1, len(last) + 1)})

    return _last(events, LastEvents(k, False, tell), "model string, seq bigint, type string, place int")


def token_sample_of_stream(events: DataFrame, size: int = SAMPLE) -> DataFrame:
    """T03 on a stream: model, mean over all known totals, median and nearest-rank 90th percentile over the last `size`, and how many those are."""

    def tell(model: str, last: list[tuple], n: int, total: float) -> pd.DataFrame:
        values = sorted(e[1] for e in last)
        rank = max(0, math.ceil(0.9 * len(values)) - 1)
        return pd.DataFrame({"model": [model], "mean": [total / n], "median": [float(median(values))], "p90": [int(values[rank])], "samples": [len(values)]})

    return _last(events, LastEvents(size, True, tell), "model string, mean double, median double, p90 bigint, samples bigint")


class BatchSink:
    """A sink for foreachBatch that a batch may reach more than once.

    A batch has a folder of its own, which is overwritten when the batch is run
    again, and a marker that is written after its rows; rows() reads what markers
    name, so a batch is there once and whole, or not at all.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/batch_={batch}")
        self.spark.range(1).select(F.lit(batch).cast("int").alias("batch_")).write.mode("overwrite").parquet(f"{self.path}/done/{batch}")

    def rows(self) -> DataFrame:
        done = self.spark.read.parquet(f"{self.path}/done/*")
        return self.spark.read.parquet(f"{self.path}/rows").join(done, "batch_", "left_semi")


def drained(stream: DataFrame, mode: str, what: str, key: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over all there is and gives what its sink has: of complete batches the last one, of updates the last one of each key."""
    spark, path = stream.sparkSession, shared_dir(stream.sparkSession, what)
    sink = BatchSink(spark, f"{path}/out")
    with state_in_files(spark):
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(sink.put).start().awaitTermination()
    rows = sink.rows()
    if mode == "complete":
        return rows.where(F.col("batch_") == rows.agg(F.max("batch_")).first()[0]).drop("batch_")
    if key:
        names = [c for c in rows.columns if c != "batch_"]
        return rows.groupBy(*key).agg(F.max_by(F.struct(*names), "batch_").alias("x")).select("x.*")
    return rows.drop("batch_")


@contextmanager
def state_in_files(spark: SparkSession) -> Iterator[None]:
    """While it lasts, streams keep their state in RocksDB, which state of several columns needs."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)
