"""Queries on prompts, images, recorded attempts, event logs, and the small readers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import images, prompts, scoring
from ..operators import attempts as a
from ..operators import humans as h
from ..sources import readers, sinks
from ..sources.adapters import human_bins, results, table, usage_events
from ..sources.shared import shared_dir
from .registry import query
from .stream_queries import stream

#: A PNG's first 24 bytes but for its width and height, and a JPEG's up to them.
PNG, JPEG = "89504E470D0A1A0A0000000D49484452", "FFD8FFE000040000FFC0000B08"


def pictures(spark, sf):
    """id, image: PNG headers, JPEG headers (as base64 text), no images, and none, from part."""
    size = F.col("p_size").cast("int") * 40
    hexed = lambda n, digits: F.lpad(F.hex(n), digits, "0")
    png = F.concat(F.lit(PNG), hexed(size, 8), hexed(F.col("p_size").cast("int"), 8))
    jpeg = F.concat(F.lit(JPEG), hexed(F.col("p_size").cast("int"), 4), hexed(size, 4))
    kind = F.col("p_partkey") % 4
    data = F.when(kind == 0, F.unhex(png)).when(kind == 1, F.unhex(jpeg)).when(kind == 2, F.encode("p_name", "utf-8"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.base64(data).alias("text"))


@query("F12_F14_images", f"""
WITH p AS (SELECT p_partkey AS id, p_partkey % 4 AS kind, CAST(p_size AS INTEGER) AS height, CAST(p_size AS INTEGER) * 40 AS width, p_name FROM part),
b AS (SELECT *, CASE kind WHEN 0 THEN '{PNG}' || printf('%08X', width) || printf('%08X', height) WHEN 1 THEN '{JPEG}' || printf('%04X', height) || printf('%04X', width) END AS hexed FROM p)
SELECT id, CASE WHEN kind < 2 THEN width END AS width, CASE WHEN kind < 2 THEN height END AS height,
       CASE WHEN kind < 2 AND greatest(width, height) <= 1024 THEN 'data:image/' || CASE kind WHEN 0 THEN 'png' ELSE 'jpeg' END || ';base64,' || to_base64(unhex(hexed)) END AS url,
       CASE WHEN kind = 2 AND length(to_base64(encode(p_name))) > 16 THEN 'image_decode_failed' WHEN kind < 2 AND greatest(width, height) > 1024 THEN 'image_too_large' END AS warning
FROM b""")
def message_images(spark, sf):
    """Headers alone can't be scaled down, with or without an image library."""
    data = pictures(spark, sf).select("id", images.image_bytes("text", "string").alias("data"))
    return data.withColumn("size", images.image_size("data")).withColumn("shown", images.message_image("data")).select("id", "size.width", "size.height", "shown.url", "shown.warning")


def _said(key: str) -> str:
    """A text in the row's language, in SQL."""
    quoted = {k: v[key].replace("'", "''") if isinstance(v[key], str) else json.dumps("\n".join(v[key]), ensure_ascii=False).replace("'", "''") for k, v in prompts.TEXTS.items()}
    return f"CASE WHEN german THEN '{quoted['de']}' ELSE '{quoted['en']}' END"


def _part(text: str) -> str:
    return f"""('{{"type":"text","text":' || to_json({text}) || '}}')"""


def _shown(label: str, url: str) -> str:
    return f"""CASE WHEN {url} <> '' THEN ',' || {_part(label)} || ',{{"type":"image_url","image_url":{{"url":' || to_json({url}) || ',"detail":"auto"}}}}' ELSE '' END"""


_OPTIONS = " || ',' || ".join(f"""{_part(f"'{x}) ' || coalesce(sol_{x}, '')")} || {_shown(f"'Option {x} Bild:'", f"url_{x}")}""" for x in scoring.LETTERS)
_IMAGES = ", ".join(f"CASE WHEN multimodal AND pk % 5 = {i} THEN 'data:{x}' END AS url_{x}" for i, x in enumerate(scoring.LETTERS))
_TEXTS = ", ".join(f"CASE WHEN pk % 11 <> {i} THEN '{i}' END AS sol_{x}" for i, x in enumerate(scoring.LETTERS))


@query("F15_prompts", f"""
WITH q AS (SELECT id, coalesce(language, 'de') = 'de' AS german, 'Q "' || question_id || '"' AS question, CASE WHEN multimodal THEN 'data:q' END AS url, multimodal AND pk % 2 = 0 AS more, {_TEXTS}, {_IMAGES} FROM results)
SELECT id, '[{{"role":"system","content":' || {_said("system")} || '}},{{"role":"user","content":[' || {_part(f"{_said('question')} || ' ' || question")} || {_shown(_said("question_image"), "url")}
       || CASE WHEN more THEN {_shown(f"{_said('more')} || ' 1:'", "'data:a'")} || {_shown(f"{_said('more')} || ' 3:'", "'data:c'")} ELSE '' END
       || ',' || {_part(_said("options"))} || ',' || {_OPTIONS} || ',' || {_part(_said("last"))} || ']}}]' AS messages FROM q""")
def prompt_messages(spark, sf):
    """Questions of all runs, with images on those that are multimodal; of three further images the second is missing."""
    rows = results(spark, sf)
    pk, shown = F.col("pos.pk"), F.col("multimodal")
    more = F.when(shown & (pk % 2 == 0), F.array(F.lit("data:a"), F.lit(None).cast("string"), F.lit("data:c")))
    options = {x: F.when(pk % 11 != i, F.lit(str(i))) for i, x in enumerate(scoring.LETTERS)}
    urls = {x: F.when(shown & (pk % 5 == i), F.lit(f"data:{x}")) for i, x in enumerate(scoring.LETTERS)}
    question = F.concat(F.lit('Q "'), F.col("question_id"), F.lit('"'))
    return rows.select("id", prompts.messages(question, F.col("language"), options, F.when(shown, F.lit("data:q")), more, urls).alias("messages"))


@query("K03_K05_T10_event_log", """
SELECT seq, model, type, CASE WHEN type = 'skipped' THEN 0 ELSE greatest(attempts, 1) END AS attempts, CASE WHEN type = 'success' THEN latency_ms END AS latency_ms FROM usage""")
def event_log(spark, sf):
    """Workers' outcomes as they come, appended as JSON lines, and read back."""
    path = shared_dir(spark, "event-log")
    done = a.outcomes(stream(spark, sf))
    sinks.appended(done, f"{path}/usage.jsonl", f"{path}/state").awaitTermination()
    return readers.jsonl(spark, f"{path}/usage.jsonl", "seq bigint, model string, type string, attempts int, latency_ms double")


def recorded(spark, sf):
    """Attempts of items: the results of one order, in order of their lines, some cut short, some refused."""
    rows = results(spark, sf)
    pk, q = F.col("pos.pk"), F.col("pos.q")
    answer = F.when(q % 3 == 0, F.col("predicted"))
    return rows.select(
        F.col("pos.ok").alias("item"), (F.col("pos.ln") * 100000000 + pk * 1000 + F.col("pos.sk")).alias("place"), F.when(pk % 7 == 0, 429).when(pk % 23 == 0, 400).otherwise(200).alias("status"),
        F.when(pk % 3 == 0, "length").otherwise("stop").alias("finish"), answer.alias("answer"), F.when(answer.isNull(), F.when(q % 2 == 0, "no_parse").otherwise("empty_response")).alias("warning"), F.col("total_tokens").alias("tokens"), "latency_ms",
    )


@query("T12_attempts")
def replayed_attempts(spark, sf):
    return a.replayed(recorded(spark, sf), ["item"], "place")


@query("S10_human_performance", "SELECT question_id, count(*) AS attempts, any_value(p_correct) AS p_correct, any_value(sample_size) AS sample_size FROM results LEFT JOIN (SELECT p_partkey || '-1' AS question_id, p_size / 64.0::DOUBLE AS p_correct, CAST(p_size AS BIGINT) AS sample_size FROM part) h USING (question_id) GROUP BY question_id")
def human_performance(spark, sf):
    """Written as such a file is, and joined to the questions; a file that is missing joins nothing."""
    path = shared_dir(spark, "human-performance")
    part = table(spark, sf, "part")
    part.select(F.concat(F.col("p_partkey"), F.lit("-1")).alias("question_id"), (F.col("p_size") / F.lit(64.0)).alias("p_correct"), F.col("p_size").cast("bigint").alias("sample_size")).write.parquet(f"{path}/human.parquet")
    known = readers.human_performance(spark, f"{path}/human.parquet").unionByName(readers.human_performance(spark, f"{path}/none.parquet"))
    asked = results(spark, sf).groupBy("question_id").agg(F.count(F.lit(1)).alias("attempts"))
    return asked.join(known, "question_id", "left")


@query("S15_config", "SELECT n_name AS model_id, CAST(n_nationkey AS BIGINT) AS seed FROM nation")
def configs(spark, sf):
    """A configuration a nation, written as JSON and read by the config loader."""
    path = shared_dir(spark, "configs")
    sinks.as_json(table(spark, sf, "nation").select(F.col("n_name").alias("model_id"), F.col("n_nationkey").cast("bigint").alias("seed"))).write.text(path)
    rows = [readers.config(r.value) for r in spark.read.text(path).collect()]  # a line a nation
    return spark.createDataFrame([(r["model_id"], r["seed"]) for r in rows], "model_id string, seed bigint")


@query("H21_id_midpoints", """
SELECT year, grade, idx, CASE WHEN idx % 3 = 0 THEN (lo + hi) / 2 WHEN idx % 3 = 1 THEN (lo + CAST(hi AS INTEGER)) / 2 END AS mid FROM human_bins""")
def id_midpoints(spark, sf):
    """Bins with a range; without one but with an id that says it; with neither."""
    ranged = lambda c: F.when(F.col("idx") % 3 == 0, F.col(c))
    name = F.when(F.col("idx") % 3 == 1, F.concat(F.lit("b_"), F.col("lo").cast("int"), F.lit("-"), F.round("hi").cast("int"))).otherwise("top")
    return human_bins(spark, sf).select("year", "grade", "idx", h.id_midpoint(name, ranged("lo"), ranged("hi")).alias("mid"))


@query("O14_bucket_order", """
SELECT "group", CASE "group" WHEN '3-4' THEN 0 WHEN '5-6' THEN 1 WHEN '7-8' THEN 2 WHEN '9-10' THEN 3 WHEN '11-13' THEN 4 ELSE CASE WHEN "group" IS NULL THEN 99 ELSE 98 END END AS place, count(*) AS n FROM results GROUP BY ALL""")
def bucket_order(spark, sf):
    """Labels that are no bucket come after all buckets, and no label after those."""
    return results(spark, sf).groupBy("group").agg(F.count(F.lit(1)).alias("n")).withColumn("place", scoring.bucket_order("group"))


@query("S02_S12_resolved_path", "SELECT 'given' AS how, count(*) AS n FROM part UNION ALL SELECT 'under a root', count(*) FROM part UNION ALL SELECT 'by name', count(*) FROM part")
def resolved_path(spark, sf):
    """A table by its path, by a path under one of the roots, and by its name alone."""
    top, name = sf.rstrip("/").rsplit("/", 1)
    ways = {"given": (f"{sf}/part.parquet", ()), "under a root": (f"{name}/part.parquet", ("/nowhere", top)), "by name": ("elsewhere/part.parquet", ("/nowhere", sf))}
    out = None
    for how, (path, roots) in ways.items():
        one = spark.read.parquet(readers.resolved(spark, path, roots)).agg(F.lit(how).alias("how"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("S20_dotenv", "SELECT n_name AS name, CASE WHEN n_nationkey = 0 THEN 'set before' ELSE 'value ' || n_nationkey END AS value FROM nation")
def environment(spark, sf):
    """A settings file of the driver, a line a nation; what is set already stays."""
    import os
    import tempfile

    names = [(r.n_name, r.n_nationkey) for r in table(spark, sf, "nation").orderBy("n_nationkey").collect()]  # 25 rows
    forms = ("{}=value {}", "export {}='value {}'", '  {} = "value {}"  ')
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, ".env")
        with open(path, "w") as f:
            f.write("# settings\n\n" + "\n".join(forms[k % 3].format(n, k) for n, k in names))
        got = readers.dotenv(path, {names[0][0]: "set before"})
    return spark.createDataFrame(sorted(got.items()), "name string, value string")


@query("H03_range_overrides", "SELECT year, grade, idx, CASE WHEN idx % 4 = 0 THEN lo + 0.25 ELSE lo END::DOUBLE AS lo, CASE WHEN idx % 4 = 0 THEN hi + 0.5 ELSE hi END::DOUBLE AS hi, n FROM human_bins")
def range_overrides(spark, sf):
    """Every fourth bin has a range of the grade's own beside the default."""
    bins = human_bins(spark, sf)
    given = lambda lo, hi: F.struct(lo.alias("min"), hi.alias("max"))
    own = F.when(F.col("idx") % 4 == 0, F.create_map(F.col("grade"), given(F.col("lo") + 0.25, F.col("hi") + 0.5))).otherwise(F.create_map(F.lit("none"), given(F.lit(0.0), F.lit(0.0))))
    ranged = bins.withColumn("ranges_by_grade", own).withColumn("range_default", given(F.col("lo"), F.col("hi")))
    return h.with_range(ranged).select("year", "grade", "idx", "lo", "hi", "n")
