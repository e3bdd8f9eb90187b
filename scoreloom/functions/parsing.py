"""Answers, usage and message contents from recorded responses.

All is column expressions but two things, which are Arrow-batched pandas UDFs:
the JSON branch of the answer parser (Spark's JSON functions are more lenient
than the format wanted here) and the recursive flattening of message contents.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import BLANKS, DECLINED, LETTERS

#: The line of a final answer, and phrases of a declined one.
FINAL_LINE = r"(?imdUu)^\s*(?:final\s*answer|antwort)\s*[:：\-–—]?\s*([^\n]+?)\s*$"
DECLINE_ALIASES = (
    "declined", "i choose not to answer", "i choose to not answer", "choose not to answer", "i decline to answer", "i decline", "i cannot determine with confidence",
    "cannot determine with confidence", "i cannot determine the answer", "unable to determine", "ich entscheide mich nicht zu antworten", "ich wähle nicht zu antworten",
    "antwort verweigern", "ich verweigere die antwort", "nicht mit ausreichender sicherheit bestimmbar", "kann nicht mit ausreichender sicherheit bestimmen",
    "ich weiß es nicht", "weiß es nicht", "keine ahnung",
)
DECLINE_PHRASES = (
    r"\bi\s+choose\s+not\s+to\s+answer\b", r"\bchoose\s+not\s+to\s+answer\b", r"\bi\s+decline\s+to\s+answer\b", r"\bi\s+decline\b", r"\bcannot\s+determine\s+(?:with\s+)?confidence\b",
    r"\bunable\s+to\s+determine\b", r"\bich\s+entscheide\s+mich,\s+nicht\s+zu\s+antworten\b", r"\bich\s+wähle,\s+nicht\s+zu\s+antworten\b", r"\bantwort\s+verweigern\b",
    r"\bich\s+verweigere\s+die\s+antwort\b", r"\bnicht\s+mit\s+ausreichender\s+sicherheit\s+bestimmbar\b", r"\bkeine\s+ahnung\b", r"\bich\s+weiß\s+es\s+nicht\b",
)
QUOTES = "`\"'“”‘’"


def clean_token(raw: Column) -> Column:
    """without quotes around and marks at the end."""
    token = F.trim(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""), F.lit(QUOTES))
    return F.regexp_replace(F.regexp_replace(token, r"(?U)[\s.!?؛。,…]+$", ""), r"(?U)^\s+|\s+$", "")


def phrase(value: Column) -> Column:
    """F04."""
    text = F.translate(F.lower(value), "’“”", "'\"\"")
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[^a-z0-9äöüß ]+", " "), " +", " "))


def is_decline(value: Column) -> Column:
    """F05, one token."""
    return F.coalesce(phrase(value).isin(*DECLINE_ALIASES), F.lit(False))


def has_decline(text: Column) -> Column:
    """F05, anywhere."""
    return is_decline(text) | text.rlike("(?iuU)" + "|".join(f"(?:{p})" for p in DECLINE_PHRASES))


def token(raw: Column) -> Column:
    """(answer, warning) of a token; both null if it is none."""
    t = clean_token(raw)
    letter = F.upper(t)
    return F.when(letter.isin(*LETTERS), F.struct(letter.alias("answer"), F.lit(None).cast("string").alias("warning"))).when(is_decline(t), F.struct(F.lit(DECLINED).alias("answer"), F.lit("declined_explicit").alias("warning")))


def _json_answers(text: pd.Series) -> pd.DataFrame:
    """answer and reason of a text that is one JSON object."""

    def one(t: str | None) -> tuple:
        try:
            got = json.loads(t)
        except (ValueError, TypeError, RecursionError):
            return None, None
        answer = got.get("answer") if isinstance(got, dict) else None
        if not isinstance(answer, str):
            return None, None
        reason = got.get("reason")
        return answer, reason if isinstance(reason, str) else None

    return pd.DataFrame([one(t) for t in text], columns=["answer", "reason"], dtype=object)


def json_answer(text: Column) -> Column:
    return F.pandas_udf(_json_answers, "struct<answer:string,reason:string>")(text)


def parse_answers(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with answer, rationale and warning. The Python part runs only over rows that hold a brace."""
    t = F.col(text)
    blank = F.coalesce(F.regexp_replace(t, r"(?U)\s+", "") == "", F.lit(True))
    lines = F.regexp_extract_all(t, F.lit(FINAL_LINE), F.lit(1))
    block = F.regexp_extract(t, r"\{[\s\S]*?\}", 0)
    staged = rows.withColumn("final_", token(F.try_element_at(lines, F.lit(-1)))).withColumn("block_", block)
    # texts without a brace can't be JSON objects
    staged = staged.withColumn("whole_", json_answer(F.when(F.contains(t, F.lit("{")), t))).withColumn("part_", json_answer(F.nullif("block_", F.lit(""))))
    staged = staged.withColumn("w_", token(F.col("whole_.answer"))).withColumn("p_", token(F.col("part_.answer")))
    letter = F.upper(F.regexp_extract(t, r"(?U)\b([A-Ea-e])\b", 1))
    none = F.lit(None).cast("string")
    out = lambda answer, rationale, warning: F.struct(answer.alias("answer"), rationale.alias("rationale"), warning.alias("warning"))
    parsed = (
        F.when(blank, out(none, none, F.lit("empty_response")))
        .when(F.col("final_").isNotNull(), out(F.col("final_.answer"), none, F.col("final_.warning")))
        .when(F.col("w_").isNotNull(), out(F.col("w_.answer"), F.col("whole_.reason"), F.col("w_.warning")))
        .when(F.col("p_").isNotNull(), out(F.col("p_.answer"), F.col("part_.reason"), F.coalesce("p_.warning", F.lit("json_extracted"))))
        .when(has_decline(t), out(F.lit(DECLINED), none, F.lit("declined_phrase")))
        .when(letter != "", out(letter, none, F.lit("regex_fallback")))
        .otherwise(out(none, none, F.lit("no_parse")))
    )
    return staged.withColumn("parsed_", parsed).select(*rows.columns, "parsed_.answer", "parsed_.rationale", "parsed_.warning")


def flat_content(value: object) -> str:
    """F06 of one value: strings as they are, lists item by item, of objects json, text, content or tool_calls."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "\n".join(x for x in map(flat_content, value) if x)
    if isinstance(value, dict):
        if value.get("json") is not None:
            got = value["json"]
            return got if isinstance(got, str) else json.dumps(got, ensure_ascii=False)
        for key in ("text", "content"):
            if value.get(key):
                return flat_content(value[key])
        if value.get("tool_calls"):
            return "\n".join(x for x in (flat_content(((c or {}).get("function") or {}).get("arguments")) for c in value["tool_calls"]) if x)
        return ""
    return str(value)


def _message_texts(content: pd.Series) -> pd.Series:
    """JSON of a message content to text; what is no JSON is text."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            return flat_content(json.loads(t)) if re.match(r'\s*[\[{"]', t) else t
        except (ValueError, RecursionError):
            return t

    return content.map(one)


def message_text(content: Column) -> Column:
    return F.pandas_udf(_message_texts, "string")(content)


#: Where each count may stand in a usage object.
USAGE = {
    "prompt_tokens": ("prompt_tokens", "input_tokens"), "completion_tokens": ("completion_tokens", "output_tokens"), "total_tokens": ("total_tokens",),
    "reasoning_tokens": ("completion_tokens_details.reasoning_tokens", "output_tokens_details.reasoning_tokens", "reasoning_tokens"),
    "cached_prompt_tokens": ("prompt_tokens_details.cached_tokens", "input_tokens_details.cached_tokens"), "audio_prompt_tokens": ("prompt_tokens_details.audio_tokens",), "cost_usd": ("cost", "total_cost"),
}


def usage(raw: Column) -> dict[str, Column]:
    """counts of a usage object in JSON."""
    kind = lambda k: "double" if k == "cost_usd" else "bigint"
    out = {k: F.coalesce(*[F.get_json_object(raw, f"$.{p}").try_cast("double").try_cast(kind(k)) for p in places]) for k, places in USAGE.items()}
    return out | {"total_tokens": F.coalesce(out["total_tokens"], out["prompt_tokens"] + out["completion_tokens"])}


def header_usage(header: Column) -> dict[str, Column]:
    """a header in JSON, or key=value pairs between commas or semicolons, with dotted keys."""
    pairs = F.str_to_map(F.regexp_replace(header, r"\s+", ""), F.lit("[,;]"), F.lit("="))
    is_json, found = F.trim(header, F.lit(BLANKS)).startswith("{"), usage(header)
    out = {}
    for k, places in USAGE.items():
        value = F.coalesce(*[F.try_element_at(pairs, F.lit(p)) for p in places]).try_cast("double")
        out[k] = F.when(is_json, found[k]).otherwise(value.try_cast("double" if k == "cost_usd" else "bigint"))
    return out | {"total_tokens": F.when(is_json, found["total_tokens"]).otherwise(F.coalesce(out["total_tokens"], out["prompt_tokens"] + out["completion_tokens"]))}
