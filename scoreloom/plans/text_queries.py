"""Queries on recorded responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing, scoring
from ..sources.adapters import responses, results, table
from .registry import query


def _clean(raw: str) -> str:
    """F03 in SQL."""
    return rf"""regexp_replace(regexp_replace(trim(regexp_replace({raw}, '^\s+|\s+$', '', 'g'), '`"''“”‘’'), '[\s.!?؛。,…]+$', ''), '^\s+|\s+$', '', 'g')"""


def _phrase(value: str) -> str:
    """F04 in SQL."""
    return f"trim(regexp_replace(regexp_replace(lower({value}), '[^a-z0-9äöüß ]+', ' ', 'g'), ' +', ' ', 'g'))"


_ALIASES = ", ".join(f"'{x}'" for x in parsing.DECLINE_ALIASES)
_DECLINE = "|".join(f"(?:{x})" for x in parsing.DECLINE_PHRASES)
#: The parser's steps over the text alone; a letter stands by itself where no letter, mark, digit or underscore is beside it.
ANSWERS = rf"""
seen AS (SELECT id, text, list_last(regexp_extract_all(text, '(?im)^\s*(?:final\s*answer|antwort)\s*[:：\-–—]?\s*([^\n]+?)\s*$', 1)) AS line, regexp_extract(text, '\{{[\s\S]*?\}}') AS block FROM responses),
read AS (SELECT *, CASE WHEN json_valid(text) THEN CASE WHEN json_type(text) = 'OBJECT' THEN text END END AS whole, CASE WHEN block <> '' AND json_valid(block) THEN block END AS part FROM seen),
raw AS (SELECT *, {_clean("line")} AS f, {_clean("json_extract_string(whole, '$.answer')")} AS w, {_clean("json_extract_string(part, '$.answer')")} AS p,
               upper(regexp_extract(text, '(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])([A-Ea-e])(?:$|[^\p{{L}}\p{{M}}\p{{N}}_])', 1)) AS letter FROM read),
tokens AS (SELECT *, {", ".join(f"CASE WHEN upper({c}) IN ('A', 'B', 'C', 'D', 'E') THEN upper({c}) WHEN {_phrase(c)} IN ({_ALIASES}) THEN 'DECLINED' END AS {c}_token" for c in "fwp")} FROM raw),
steps AS (SELECT *, CASE WHEN regexp_full_match(text, '\s*') THEN 0 WHEN f_token IS NOT NULL THEN 1 WHEN w_token IS NOT NULL THEN 2 WHEN p_token IS NOT NULL THEN 3
                        WHEN {_phrase("text")} IN ({_ALIASES}) OR regexp_matches(text, '(?i){_DECLINE}') THEN 4 WHEN letter <> '' THEN 5 ELSE 6 END AS step FROM tokens)"""


@query("F01_F05_parse_answers", f"""WITH {ANSWERS}
SELECT id, CASE step WHEN 1 THEN f_token WHEN 2 THEN w_token WHEN 3 THEN p_token WHEN 4 THEN 'DECLINED' WHEN 5 THEN letter END AS answer,
       CASE step WHEN 2 THEN json_extract_string(whole, '$.reason') WHEN 3 THEN json_extract_string(part, '$.reason') END AS rationale,
       CASE WHEN step = 0 THEN 'empty_response' WHEN step = 4 THEN 'declined_phrase' WHEN step = 5 THEN 'regex_fallback' WHEN step = 6 THEN 'no_parse'
            WHEN (CASE step WHEN 1 THEN f_token WHEN 2 THEN w_token ELSE p_token END) = 'DECLINED' THEN 'declined_explicit' WHEN step = 3 THEN 'json_extracted' END AS warning
FROM steps""")
def parse_answers(spark, sf):
    return parsing.parse_answers(responses(spark, sf)).drop("text")


@query("F06_message_text", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'a' || chr(10) || '{\"answer\": \"A\"}' WHEN 2 THEN 'x' ELSE '' END AS text FROM events")
def message_text(spark, sf):
    contents = F.array(*map(F.lit, ("plain", '[{"type": "text", "text": "a"}, {"type": "json", "json": {"answer": "A"}}]', '{"content": [{"text": "x"}]}', "[]")))
    rows = table(spark, sf, "events").select("event_id", F.get(contents, (F.col("event_id") % 4).cast("int")).alias("c"))
    return rows.select("event_id", parsing.message_text(F.col("c")).alias("text"))


@query("F07_F09_usage", """
SELECT event_id, k AS prompt_tokens, k * 2 AS completion_tokens, k * 3 AS total_tokens, CASE WHEN k % 2 = 0 THEN k END AS reasoning_tokens FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def usage(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    a = F.to_json(F.struct(k.alias("prompt_tokens"), (k * 2).alias("completion_tokens"), F.struct(k.alias("reasoning_tokens")).alias("completion_tokens_details")))
    b = F.to_json(F.struct(k.alias("input_tokens"), (k * 2).alias("output_tokens"), (k * 3).alias("total_tokens")))
    rows = table(spark, sf, "events").select("event_id", F.when(k % 2 == 0, a).otherwise(b).alias("u"))
    got = parsing.usage(F.col("u"))
    return rows.select("event_id", *[got[c].alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens", "reasoning_tokens")])


@query("F08_header_usage", """
SELECT event_id, k AS prompt_tokens, CAST(5 AS BIGINT) AS completion_tokens, k + 5 AS total_tokens, CAST(CASE WHEN k % 2 = 1 THEN 4 END AS BIGINT) AS reasoning_tokens FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def header_usage(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    header = F.when(k % 2 == 0, F.concat(F.lit('{"prompt_tokens": '), k, F.lit(', "completion_tokens": 5}'))).otherwise(F.concat(F.lit("input_tokens="), k, F.lit(", output_tokens=5; completion_tokens_details.reasoning_tokens=4")))
    rows = table(spark, sf, "events").select("event_id", header.alias("h"))
    got = parsing.header_usage(F.col("h"))
    return rows.select("event_id", *[got[c].alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens", "reasoning_tokens")])


@query("F10_F11_F18_F19_casts", """
SELECT t, CASE t WHEN '3.5' THEN 3.5 WHEN ' 4 ' THEN 4 WHEN '2024.0' THEN 2024 ELSE 0 END::DOUBLE AS finite, CASE t WHEN ' 4 ' THEN 4 WHEN '2024.0' THEN 2024 END::BIGINT AS whole, CASE t WHEN 'yes' THEN true WHEN 'F' THEN false END AS flag,
  CASE t WHEN ' 4 ' THEN '4' WHEN '2024.0' THEN '2024' WHEN 'NaN' THEN NULL ELSE t END AS key, count(*) AS n
FROM (SELECT ['3.5', ' 4 ', '2024.0', 'NaN', 'inf', 'yes', 'F', 'x'][1 + event_id % 8] AS t FROM events) GROUP BY ALL""".replace("WHEN 'NaN' THEN NULL ELSE t", "WHEN 'NaN' THEN NULL WHEN 'inf' THEN 'inf' ELSE t"))
def casts(spark, sf):
    t = F.get(F.array(*map(F.lit, ("3.5", " 4 ", "2024.0", "NaN", "inf", "yes", "F", "x"))), (F.col("event_id") % 8).cast("int"))
    rows = table(spark, sf, "events").select(t.alias("t"))
    return rows.groupBy("t", scoring.finite("t").alias("finite"), scoring.whole_number("t").alias("whole"), scoring.boolish("t").alias("flag"), scoring.key_text("t").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("P11_P12_F16_F20_text_forms", """
SELECT t, CASE WHEN t <> 'bad' THEN TIMESTAMP '2024-05-01' END AS day, s, CASE s WHEN 5 THEN '5s' WHEN 184 THEN '3m 04s' ELSE '1h 02m' END AS took, count(*) AS n
FROM (SELECT ['2024-05-01', '2024/05/01', '01.05.2024', 'bad'][1 + event_id % 4] AS t, [5, 184, 3720][1 + event_id % 3] AS s FROM events) GROUP BY ALL""")
def text_forms(spark, sf):
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("event_id") % n).cast("int"))
    rows = table(spark, sf, "events").select(pick(("2024-05-01", "2024/05/01", "01.05.2024", "bad"), 4).alias("t"), pick((5, 184, 3720), 3).alias("s"))
    return rows.groupBy("t", scoring.parsed_date("t").cast("timestamp_ntz").alias("day"), "s", scoring.humanized("s").alias("took")).agg(F.count(F.lit(1)).alias("n"))


@query("F21_replayed_attempts", "SELECT ok AS id, count(*) AS attempts, arg_max(predicted, ln * 100000000 + pk * 1000 + sk) AS predicted, CAST(sum(total_tokens) AS BIGINT) AS tokens, sum(latency_ms) AS latency FROM results GROUP BY ok".replace("arg_max(predicted, ", "arg_max({'p': predicted}, ").replace(") AS predicted", ").p AS predicted"))
def replayed_attempts(spark, sf):
    order = F.col("pos.ln") * 100000000 + F.col("pos.pk") * 1000 + F.col("pos.sk")
    return results(spark, sf).groupBy(F.col("pos.ok").alias("id")).agg(F.count(F.lit(1)).alias("attempts"), F.max_by(F.struct("predicted"), order)["predicted"].alias("predicted"), F.sum("total_tokens").alias("tokens"), F.sum("latency_ms").alias("latency"))
