"""Domain tables derived from the driver's parquet tables by exact integer arithmetic.

Every number is a multiple of a power of two, so sums do not depend on order.
The *_SQL strings say the same for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring

#: Group labels by line number.
GROUPS = ("3-4", "5-6", "7-8", "9-10", "11-13", "Junior")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored result rows of six runs, from lineitem."""
    ok, pk, sk, ln = (F.col(c).cast("bigint") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    q = F.col("l_quantity").cast("bigint")
    letter = lambda n: F.substring(F.lit("ABCDE"), (n % 5 + 1).cast("int"), F.lit(1))
    group = F.get(F.array(*map(F.lit, GROUPS)), (ln - 1).cast("int"))
    failed = sk % 23 == 0
    predicted = F.when(failed | (sk % 11 == 0), F.lit(None).cast("string")).when(sk % 7 == 0, scoring.DECLINED).when(q % 4 < 3, letter(pk)).otherwise(letter(pk + 1))
    total = F.when(F.col("l_discount") != 0, q * 20)
    base = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", ok, ln, pk, sk).alias("id"),
        F.concat("l_returnflag", "l_linestatus").alias("run_id"),
        F.concat_ws("-", pk % 200, ln).alias("question_id"),
        F.year("l_shipdate").alias("year"),
        group.alias("group"),
        (pk % 30 + 1).cast("string").alias("problem_number"),
        F.when(ok % 29 == 0, F.lit(None).cast("string")).when(ok % 3 < 2, "de").otherwise("en").alias("language"),
        (F.col("l_tax") >= 0.04).alias("multimodal"),
        (3 + q % 3).cast("double").alias("points"),
        F.when(pk % 17 != 0, letter(pk)).alias("answer"),
        predicted.alias("predicted"),
        F.when(sk % 5 == 0, "high").when(sk % 5 == 1, "low").when(sk % 5 < 4, "none").alias("reasoning_mode"),
        F.when(~failed, F.floor(F.col("l_extendedprice")).cast("double") / 8).alias("latency_ms"),
        F.when(total.isNotNull(), ln * 10).alias("prompt_tokens"),
        (total - ln * 10).alias("completion_tokens"),
        total.alias("total_tokens"),
        F.when(ln % 2 == 0, F.floor((total - ln * 10) / 2)).alias("reasoning_tokens"),
        (total / F.lit(1024.0)).alias("cost_usd"),
        F.when(failed, "HTTP 500").alias("error"),
        F.array_compact(F.array(F.when(sk % 7 == 0, "declined_explicit"), F.when(q % 10 == 0, "regex_fallback"), F.when((F.col("l_tax") >= 0.04) & (ln == 1), "image_skipped"))).alias("warnings"),
        F.struct(ok.alias("ok"), ln.alias("ln"), pk.alias("pk"), sk.alias("sk"), q.alias("q"), F.col("l_extendedprice").alias("price")).alias("pos"),
    )
    return base.withColumns({"points_earned": scoring.points_earned("points", "answer", "predicted"), "is_correct": scoring.is_correct("points", "answer", "predicted")})


RESULTS_SQL = """
SELECT *, CASE WHEN answer IS NULL THEN 0.0 WHEN predicted IS NULL THEN -points * 0.25 WHEN predicted = 'DECLINED' THEN 0.0
               WHEN predicted = answer THEN points ELSE -points * 0.25 END::DOUBLE AS points_earned,
       CASE WHEN answer IS NULL THEN NULL ELSE coalesce(predicted = answer, false) END AS is_correct
FROM (
  SELECT ok || '-' || ln || '-' || pk || '-' || sk AS id, l_returnflag || l_linestatus AS run_id, (pk % 200) || '-' || ln AS question_id,
         CAST(year(l_shipdate) AS INTEGER) AS year, ['3-4', '5-6', '7-8', '9-10', '11-13', 'Junior'][ln] AS "group",
         CAST(pk % 30 + 1 AS VARCHAR) AS problem_number,
         CASE WHEN ok % 29 = 0 THEN NULL WHEN ok % 3 < 2 THEN 'de' ELSE 'en' END AS language, l_tax >= 0.04 AS multimodal,
         CAST(3 + q % 3 AS DOUBLE) AS points, CASE WHEN pk % 17 <> 0 THEN substr('ABCDE', pk % 5 + 1, 1) END AS answer,
         CASE WHEN sk % 23 = 0 OR sk % 11 = 0 THEN NULL WHEN sk % 7 = 0 THEN 'DECLINED' WHEN q % 4 < 3 THEN substr('ABCDE', pk % 5 + 1, 1) ELSE substr('ABCDE', (pk + 1) % 5 + 1, 1) END AS predicted,
         CASE WHEN sk % 5 = 0 THEN 'high' WHEN sk % 5 = 1 THEN 'low' WHEN sk % 5 < 4 THEN 'none' END AS reasoning_mode,
         CASE WHEN sk % 23 <> 0 THEN floor(l_extendedprice) / 8 END AS latency_ms,
         CASE WHEN l_discount <> 0 THEN ln * 10 END AS prompt_tokens, CASE WHEN l_discount <> 0 THEN q * 20 - ln * 10 END AS completion_tokens,
         CASE WHEN l_discount <> 0 THEN q * 20 END AS total_tokens,
         CASE WHEN l_discount <> 0 AND ln % 2 = 0 THEN CAST(floor((q * 20 - ln * 10) / 2) AS BIGINT) END AS reasoning_tokens,
         CASE WHEN l_discount <> 0 THEN q * 20 / 1024.0::DOUBLE END AS cost_usd, CASE WHEN sk % 23 = 0 THEN 'HTTP 500' END AS error,
         list_filter([CASE WHEN sk % 7 = 0 THEN 'declined_explicit' END, CASE WHEN q % 10 = 0 THEN 'regex_fallback' END, CASE WHEN l_tax >= 0.04 AND ln = 1 THEN 'image_skipped' END], lambda x: x IS NOT NULL) AS warnings,
         ok, ln, pk, sk, q, l_extendedprice AS price
  FROM (SELECT *, l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln, l_partkey AS pk, l_suppkey AS sk, CAST(l_quantity AS BIGINT) AS q FROM lineitem))
"""


def human_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """year, grade (text), idx (0 = highest scores), lo, hi, n: ten bins of 12 points a year and grade, from orders."""
    orders = table(spark, sf_dir, "orders")
    bin_ = F.least(F.lit(9), F.floor(F.col("o_totalprice") / 50000)).cast("int")
    counted = orders.select(F.year("o_orderdate").alias("year"), (F.substring("o_orderpriority", 1, 1).cast("int") + 2).cast("string").alias("grade"), bin_.alias("bin")).groupBy("year", "grade", "bin").agg(F.count(F.lit(1)).alias("n"))
    every = counted.select("year", "grade").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(9))))
    full = every.join(counted, ["year", "grade", "bin"], "left")
    return full.select("year", "grade", (9 - F.col("bin")).alias("idx"), (F.col("bin") * 12).cast("double").alias("lo"), (F.col("bin") * 12 + F.when(F.col("bin") == 9, 12.0).otherwise(11.75)).cast("double").alias("hi"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


HUMAN_BINS_SQL = """
SELECT y.year, y.grade, CAST(9 - b.bin AS INTEGER) AS idx, b.bin * 12.0::DOUBLE AS lo, b.bin * 12 + CASE WHEN b.bin = 9 THEN 12.0 ELSE 11.75 END::DOUBLE AS hi, coalesce(c.n, 0) AS n
FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) + 2 AS VARCHAR) AS grade FROM orders) y
CROSS JOIN (SELECT unnest(range(10)) AS bin) b
LEFT JOIN (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) + 2 AS VARCHAR) AS grade, least(9, CAST(floor(o_totalprice / 50000) AS INTEGER)) AS bin, count(*) AS n FROM orders GROUP BY ALL) c
  ON c.year = y.year AND c.grade = y.grade AND c.bin = b.bin
"""

#: Endings of the recorded answers, one for each branch of the parser.
TAILS = ('{"answer": "B", "reason": "r"}', "Final answer: C.", "Antwort: DECLINED", "I choose not to answer.", "the answer is d.", "xyz 123", "   ", 'so {"answer": "e"} done')


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text: each assistant turn as it is, with one of TAILS on a line of its own; and that ending alone."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    tail = F.get(F.array(*map(F.lit, TAILS)), (F.col("conv_id") % 8).cast("int"))
    name = F.concat_ws("-", "conv_id", "turn")
    both = F.array(F.struct(name.alias("id"), F.concat_ws("\n", "text", tail).alias("text")), F.struct(F.concat(name, F.lit("-tail")).alias("id"), tail.alias("text")))
    return turns.select(F.explode(both).alias("x")).select("x.id", "x.text")


RESPONSES_SQL = """
SELECT conv_id || '-' || turn || suffix AS id, CASE suffix WHEN '' THEN coalesce(text || chr(10), '') || tail ELSE tail END AS text
FROM (SELECT *, ['{"answer": "B", "reason": "r"}', 'Final answer: C.', 'Antwort: DECLINED', 'I choose not to answer.', 'the answer is d.', 'xyz 123', '   ', 'so {"answer": "e"} done'][conv_id % 8 + 1] AS tail, unnest(['', '-tail']) AS suffix
      FROM conversations WHERE role = 'assistant')
"""


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts, type, model, prompt/completion/total tokens, cost, latency, attempts: from events."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "view", "skipped").otherwise("success")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("type"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"),
        F.when(k % 4 != 0, k).alias("prompt_tokens"), F.when(k % 5 != 0, k * 2).alias("completion_tokens"), F.when(k % 3 == 0, k * 3).alias("given_tokens"),
        F.when(k % 2 == 0, k / F.lit(256.0)).alias("cost_usd"), (F.floor("value").cast("double") / 4).alias("latency_ms"), (k % 3).cast("int").alias("attempts"),
        F.when(k % 10 == 0, F.array(F.lit("no_parse"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


EVENTS_SQL = """
SELECT event_id AS seq, ts, CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'view' THEN 'skipped' ELSE 'success' END AS type, 'm' || (user_id % 3) AS model,
       CASE WHEN k % 4 <> 0 THEN k END AS prompt_tokens, CASE WHEN k % 5 <> 0 THEN k * 2 END AS completion_tokens, CASE WHEN k % 3 = 0 THEN k * 3 END AS given_tokens,
       CASE WHEN k % 2 = 0 THEN k / 256.0::DOUBLE END AS cost_usd, floor(value) / 4 AS latency_ms, CAST(k % 3 AS INTEGER) AS attempts, CASE WHEN k % 10 = 0 THEN ['no_parse'] ELSE [] END AS warnings
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
"""


def sql(body: str) -> str:
    """A query over results, human_bins, responses and usage as DuckDB SQL."""
    parts = {"results": RESULTS_SQL, "human_bins": HUMAN_BINS_SQL, "responses": RESPONSES_SQL, "usage": EVENTS_SQL}
    used = [f"{name} AS ({text})" for name, text in parts.items() if name in body]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*used, body[5:]])
    return ("WITH " + ", ".join(used) + "\n" if used else "") + body
