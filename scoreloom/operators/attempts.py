"""What a runner makes of a row's recorded attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attempts a row, waits between them, statuses that are tried again, limits on tokens.
ATTEMPTS, WAITS, RETRYABLE, FIRST_TOKENS, MOST_TOKENS = 5, (2.0, 4.0, 8.0), (408, 425, 429, 500, 502, 503, 504, 520, 521, 522, 523, 524), 256, 4096
CUT = ("length", "max_tokens", "max_tokens_exceeded")
STATE = "struct<used:int,done:boolean,asked_again:boolean,max_tokens:int,answer:string,status:int,error:string,waited:double,tokens:bigint,latency_ms:double,warnings:array<string>>"


def replayed(attempts: DataFrame, by: list[str], order: str, max_tokens: int | None = None) -> DataFrame:
    """Each row's attempts in order, as the runner's rules take them.

    attempts: by, order, status, finish, answer, warning, tokens, latency_ms. A retryable status
    waits and goes on; another one is a failure. An answer cut short is asked for again with twice the
    tokens (256 at first, 4096 at most); one that can't be parsed or is empty is asked for once more.
    Five attempts at most count; tokens and latencies are summed over those that are used. Attempts
    of one row are few, so they are gathered and folded.
    """
    fields = ("status", "finish", "answer", "warning", "tokens", "latency_ms")
    start = F.struct(
        F.lit(0).alias("used"), F.lit(False).alias("done"), F.lit(False).alias("asked_again"), F.lit(max_tokens).cast("int").alias("max_tokens"), F.lit(None).cast("string").alias("answer"), F.lit(None).cast("int").alias("status"),
        F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("waited"), F.lit(0).cast("bigint").alias("tokens"), F.lit(0.0).alias("latency_ms"), F.array().cast("array<string>").alias("warnings"),
    ).cast(STATE)

    def step(s: Column, a: Column) -> Column:
        used = s["used"] + 1
        more, failed = used < ATTEMPTS, a["status"] != 200
        again = failed & a["status"].isin(*RETRYABLE) & more
        cut = ~failed & a["answer"].isNull() & F.coalesce(F.lower(a["finish"]).isin(*CUT), F.lit(False)) & more
        asked = ~failed & ~cut & a["answer"].isNull() & F.coalesce(a["warning"].isin("no_parse", "empty_response"), F.lit(False)) & ~s["asked_again"] & more
        doubled = F.when(s["max_tokens"].isNull(), FIRST_TOKENS).otherwise(F.least(s["max_tokens"] * 2, F.lit(MOST_TOKENS)))
        wait = F.get(F.array(*map(F.lit, WAITS)), F.least(used - 1, F.lit(len(WAITS) - 1)))
        said = F.array_compact(
            F.array(
                F.when(failed, F.concat(F.lit("http_status_"), a["status"].cast("string"))),
                F.when(cut, F.concat(F.lit("max_tokens_retry_"), F.coalesce(s["max_tokens"].cast("string"), F.lit("auto")), F.lit("->"), doubled.cast("string"))),
                F.when(~failed & ~cut, a["warning"]),
                F.when(asked, F.concat(F.lit("retry_due_to_"), a["warning"])),
            )
        )
        after = F.struct(
            used.alias("used"), (~again & ~cut & ~asked).alias("done"), (s["asked_again"] | asked).alias("asked_again"), F.when(cut, doubled).otherwise(s["max_tokens"]).alias("max_tokens"),
            F.when(~failed, a["answer"]).otherwise(s["answer"]).alias("answer"), a["status"].alias("status"), F.when(failed & ~again, F.concat(F.lit("http_error_"), a["status"].cast("string"))).alias("error"),
            (s["waited"] + F.when(again, wait).otherwise(0.0)).alias("waited"), (s["tokens"] + F.coalesce(a["tokens"], F.lit(0))).cast("bigint").alias("tokens"), (s["latency_ms"] + F.coalesce(a["latency_ms"], F.lit(0.0))).alias("latency_ms"),
            F.concat(s["warnings"], said).alias("warnings"),
        ).cast(STATE)
        return F.when(s["done"] | (s["used"] >= ATTEMPTS), s).otherwise(after)

    gathered = attempts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("order_"), *fields))).alias("all"))
    folded = gathered.select(*by, F.aggregate("all", start, step).alias("s"))
    return folded.select(*by, F.col("s.used").alias("attempts"), "s.answer", "s.status", "s.error", "s.max_tokens", "s.waited", "s.tokens", "s.latency_ms", "s.warnings")


def outcomes(events: DataFrame) -> DataFrame:
    """What a worker reports of each event, row by row and in no order; workers are the partitions."""
    done = F.col("type") != "skipped"
    return events.select("seq", "model", "type", F.when(done, F.greatest("attempts", F.lit(1))).otherwise(0).alias("attempts"), F.when(F.col("type") == "success", F.col("latency_ms")).alias("latency_ms"))
