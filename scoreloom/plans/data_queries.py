"""Queries on retries and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import quality as v
from ..operators import retry as m
from ..sources.adapters import results, table
from .registry import query

#: All runs, some predictions spoilt; and retry rows for two thirds of what is missing.
R = "(SELECT id, CASE WHEN ok % 50 = 1 THEN ' f ' WHEN ok % 50 = 2 THEN '  ' ELSE predicted END AS predicted, points_earned, is_correct, pk, ok FROM results)"
MISSING = f"(SELECT id, CASE WHEN nullif(upper(trim(predicted)), '') IS NULL THEN 'missing' ELSE 'invalid' END AS why, nullif(upper(trim(predicted)), '') AS value, pk, ok FROM {R} WHERE coalesce(nullif(upper(trim(predicted)), '') NOT IN ('A', 'B', 'C', 'D', 'E', 'DECLINED'), true))"
RETRY = f"(SELECT id, CASE WHEN pk % 5 = 0 THEN NULL ELSE 'C' END AS predicted, 1.5::DOUBLE AS points_earned, CAST(NULL AS BOOLEAN) AS is_correct FROM {MISSING} WHERE pk % 3 > 0)"


def spoilt(spark, sf):
    rows = results(spark, sf)
    p = F.when(F.col("pos.ok") % 50 == 1, " f ").when(F.col("pos.ok") % 50 == 2, "  ").otherwise(F.col("predicted"))
    return rows.select("id", p.alias("predicted"), "points_earned", "is_correct", F.col("pos.pk").alias("pk"))


def retried(rows):
    lost = rows.join(m.missing(rows).select("id"), "id", "left_semi").where("pk % 3 > 0")
    return m.with_origin(lost.select("id", F.when(F.col("pk") % 5 != 0, "C").alias("predicted"), F.lit(1.5).alias("points_earned"), F.lit(None).cast("boolean").alias("is_correct")), "20240601_090000_m", "retry")


@query("M01_M02_missing", f"SELECT id, why, value FROM {MISSING}")
def missing(spark, sf):
    return m.missing(spoilt(spark, sf))


@query("M02_invalid_counts", f"SELECT value, count(*) AS count FROM {MISSING} WHERE why = 'invalid' GROUP BY value")
def invalid_counts(spark, sf):
    return m.invalid_counts(spoilt(spark, sf))


@query("J08_subset", f"SELECT id, answer FROM results WHERE id IN (SELECT id FROM {MISSING})")
def subset(spark, sf):
    return m.subset(results(spark, sf).select("id", "answer"), m.missing(spoilt(spark, sf)))


@query("J09_M03_M04_id_issues", f"""
SELECT DISTINCT id, 'missing' AS issue FROM {MISSING} WHERE id NOT IN (SELECT id FROM {RETRY})
UNION ALL SELECT DISTINCT 'other-' || pk % 10, 'unexpected' FROM {MISSING} WHERE pk % 3 > 0""")
def id_issues(spark, sf):
    """Files of a retry name their rows question_id; some rows belong to no question that was asked."""
    rows = spoilt(spark, sf)
    lost = m.missing(rows).join(rows.select("id", "pk"), "id")
    got = retried(rows).select("id").unionByName(lost.where("pk % 3 > 0").select(F.concat(F.lit("other-"), F.col("pk") % 10).alias("id")))
    expected, got = (x.withColumnRenamed("id", "question_id") for x in (lost.select("id"), got))
    return m.id_issues(expected, got, m.id_column(got.columns)).withColumnRenamed("question_id", "id")


@query("M05_J10_merged", f"""
SELECT r.id, CASE WHEN x.id IS NOT NULL THEN x.predicted ELSE r.predicted END AS predicted, CASE WHEN x.id IS NOT NULL THEN x.points_earned ELSE r.points_earned END AS points_earned, CASE WHEN x.id IS NOT NULL THEN NULL ELSE r.is_correct END AS is_correct,
  r.predicted AS predicted_original, x.id IS NOT NULL AS filled_by_retry, CASE WHEN x.id IS NOT NULL THEN '20240601' END AS filled_timestamp
FROM {R} r LEFT JOIN (SELECT DISTINCT * FROM {RETRY} WHERE predicted IS NOT NULL) x ON x.id = r.id""")
def merged(spark, sf):
    rows = spoilt(spark, sf)
    return m.merged(rows, retried(rows), order="predicted").select("id", "predicted", "points_earned", "is_correct", "predicted_original", "filled_by_retry", "filled_timestamp")


@query("M06_unresolved", f"SELECT id FROM {MISSING} WHERE id NOT IN (SELECT id FROM {RETRY} WHERE predicted IS NOT NULL)")
def unresolved(spark, sf):
    rows = spoilt(spark, sf)
    return m.unresolved(rows, retried(rows))


#: Questions from part, spoilt by remainders so that each rule has failing rows.
Q = """(SELECT CASE WHEN k % 97 = 0 THEN 'dup' ELSE CAST(k AS VARCHAR) END AS id, CASE WHEN k % 31 = 0 THEN 1990 ELSE 2000 + k % 20 END AS year, ['3-4', '5-6', '7-8'][1 + k % 3] AS "group",
  CASE WHEN k % 37 = 0 THEN 12.0 WHEN k % 41 = 0 THEN 2.0 ELSE 3.0 + k % 3 END::DOUBLE AS points, CAST(CASE WHEN k % 43 = 0 THEN 55 ELSE 1 + k % 30 END AS VARCHAR) AS problem_number, CASE WHEN k % 23 = 0 THEN ' ' ELSE p_name END AS problem_statement,
  CASE WHEN k % 19 = 0 THEN 'F' ELSE substr('abcde', 1 + k % 5, 1) END AS answer, CASE WHEN k % 29 = 0 THEN 'maybe' WHEN k % 7 = 0 THEN 'true' ELSE 'no' END AS multimodal, CASE WHEN k % 47 = 0 THEN 'xx' WHEN k % 3 = 0 THEN NULL ELSE 'de' END AS language,
  CASE WHEN k % 53 = 0 THEN NULL ELSE '1' END AS sol_A, '2' AS sol_B, '3' AS sol_C, CASE WHEN k % 59 = 0 THEN '3' ELSE '4' END AS sol_D, '5' AS sol_E, CASE WHEN k % 14 = 0 OR k % 61 = 0 THEN 'img' END AS img, k
  FROM (SELECT *, p_partkey AS k FROM part))"""


def questions(spark, sf):
    k = F.col("p_partkey")
    mod = lambda n: k % n == 0
    img = F.when(mod(14) | mod(61), F.lit("img"))
    return table(spark, sf, "part").select(
        F.when(mod(97), "dup").otherwise(k.cast("string")).alias("id"), F.when(mod(31), 1990).otherwise(2000 + k % 20).alias("year"), F.get(F.array(*map(F.lit, ("3-4", "5-6", "7-8"))), (k % 3).cast("int")).alias("group"),
        F.when(mod(37), 12.0).when(mod(41), 2.0).otherwise((3 + k % 3).cast("double")).alias("points"), F.when(mod(43), 55).otherwise(1 + k % 30).cast("string").alias("problem_number"), F.when(mod(23), " ").otherwise(F.col("p_name")).alias("problem_statement"),
        F.when(mod(19), "F").otherwise(F.substring(F.lit("abcde"), (1 + k % 5).cast("int"), F.lit(1))).alias("answer"), F.when(mod(29), "maybe").when(mod(7), "true").otherwise("no").alias("multimodal"), F.when(mod(47), "xx").when(~mod(3), "de").alias("language"),
        F.when(~mod(53), "1").alias("sol_A"), F.lit("2").alias("sol_B"), F.lit("3").alias("sol_C"), F.when(mod(59), "3").otherwise("4").alias("sol_D"), F.lit("5").alias("sol_E"), img.alias("img"),
    )


IMAGES = ["img"] * 5
ISSUES = f"""(SELECT id, unnest(list_filter([
  CASE WHEN trim(problem_statement) = '' THEN {{'severity': 'error', 'code': 'empty_problem_statement'}} END, CASE WHEN upper(answer) NOT IN ('A', 'B', 'C', 'D', 'E') THEN {{'severity': 'error', 'code': 'invalid_answer'}} END,
  CASE WHEN sol_A IS NULL AND img IS NULL THEN {{'severity': 'error', 'code': 'options_missing'}} END, CASE WHEN img IS NOT NULL AND sol_A IS NULL THEN {{'severity': 'warning', 'code': 'mixed_options'}} END,
  CASE WHEN sol_A IS NOT NULL AND sol_D = '3' THEN {{'severity': 'warning', 'code': 'duplicate_option_texts'}} END, CASE WHEN multimodal = 'true' AND img IS NULL THEN {{'severity': 'error', 'code': 'multimodal_flag_without_images'}} END,
  CASE WHEN multimodal = 'no' AND img IS NOT NULL THEN {{'severity': 'warning', 'code': 'images_with_multimodal_false'}} END, CASE WHEN multimodal = 'maybe' THEN {{'severity': 'warning', 'code': 'multimodal_nonboolean'}} END,
  CASE WHEN year NOT BETWEEN 1998 AND 2100 THEN {{'severity': 'warning', 'code': 'year_out_of_range'}} END, CASE WHEN CAST(problem_number AS INTEGER) NOT BETWEEN 1 AND 40 THEN {{'severity': 'warning', 'code': 'problem_number_range'}} END,
  CASE WHEN NOT (points > 0 AND points < 10) THEN {{'severity': 'warning', 'code': 'points_range'}} END, CASE WHEN points NOT IN (3, 4, 5) THEN {{'severity': 'warning', 'code': 'points_nonstandard'}} END,
  CASE WHEN language NOT IN ('de', 'en') THEN {{'severity': 'warning', 'code': 'language_unexpected'}} END], lambda x: x IS NOT NULL), recursive := true) FROM {Q})"""


@query("V04_V13_row_issues", f"SELECT severity, code, id FROM {ISSUES}")
def row_issues(spark, sf):
    return v.row_issues(questions(spark, sf), IMAGES)


@query("V17_ranked_issues", f"SELECT severity, code, count(*) AS count, list_sort(list_sort(list(id))[1:5]) AS ids FROM {ISSUES} GROUP BY ALL")
def ranked_issues(spark, sf):
    return v.ranked(v.row_issues(questions(spark, sf), IMAGES))


@query("V02_duplicate_ids", f"SELECT id, count(*) AS count FROM {Q} GROUP BY id HAVING count(*) > 1 ORDER BY count DESC, id LIMIT 10")
def duplicate_ids(spark, sf):
    return v.duplicate_ids(questions(spark, sf))


@query("V03_duplicate_triplets", f'SELECT year, "group", problem_number, count(*) AS count FROM {Q} GROUP BY ALL HAVING count(*) > 1')
def duplicate_triplets(spark, sf):
    return v.duplicate_triplets(questions(spark, sf))


@query("V16_distribution", f'SELECT year, "group", count(*) AS count, count(*) FILTER (WHERE points = 3) AS points_3, count(*) FILTER (WHERE points = 4) AS points_4, count(*) FILTER (WHERE points = 5) AS points_5 FROM {Q} GROUP BY ALL ORDER BY year, "group" LIMIT 20')
def distribution(spark, sf):
    return v.distribution(questions(spark, sf))


@query("V01_column_issues", "SELECT * FROM (VALUES ('error', 'missing_columns', 'language'), ('warning', 'extra_columns', 'img')) t(severity, code, detail)")
def column_issues(spark, sf):
    return spark.createDataFrame(v.column_issues(questions(spark, sf).drop("language").columns), "severity string, code string, detail string")


@query("V14_V15_F14_blobs", """
SELECT k, CASE k % 4 WHEN 0 THEN 'data_url' WHEN 1 THEN 'http_url' WHEN 2 THEN 'base64' ELSE 'path' END AS kind, CASE k % 4 WHEN 2 THEN 'image/png' END AS mime, CASE k % 4 WHEN 2 THEN true END AS decodable FROM (SELECT p_partkey AS k FROM part)""")
def blobs(spark, sf):
    texts = F.array(*map(F.lit, ("data:image/png;base64,AAAA", "https://x.org/a.png", "iVBORw0KGgoAAAANSUhEUgAA", "img/a.png")))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.get(texts, (F.col("p_partkey") % 4).cast("int")).alias("t")).withColumn("kind", v.blob_kind(F.col("t")))
    data = F.when(F.col("kind") == "base64", scoring.bytes_of("t"))
    return rows.withColumn("data", data).select("k", "kind", F.when(F.col("data").isNotNull(), scoring.mime_type("data")).alias("mime"), F.when(F.col("data").isNotNull(), v.decodable(F.col("data"))).alias("decodable"))


def small_images(spark, sf):
    """row, place, data: PNGs of one grey pixel from part, whole, cut off, with a wrong checksum, and none."""
    hexed = lambda n, digits: F.lpad(F.hex(n), digits, "0")
    grey = F.col("p_size").cast("int") % 256

    def chunk(kind, body, flip=0):
        named = F.concat(F.hex(F.lit(kind)), body)
        return F.concat(hexed(F.length(body) / 2, 8), named, hexed(F.crc32(F.unhex(named)).bitwiseXOR(F.lit(flip).cast("bigint")), 8))

    # a stored block of two bytes (filter 0, the pixel) and its checksum
    packed = F.concat(F.lit("7801010200FDFF00"), hexed(grey, 2), hexed((grey + 2) * 65536 + grey + 1, 8))
    whole = lambda flip: F.concat(F.lit("89504E470D0A1A0A"), chunk("IHDR", F.lit("00000001000000010800000000")), chunk("IDAT", packed, flip), chunk("IEND", F.lit("")))
    kind = F.col("p_partkey") % 4
    text = F.when(kind == 0, whole(0)).when(kind == 1, F.expr("substring(w, 1, length(w) - 30)")).when(kind == 2, whole(1))
    return table(spark, sf, "part").withColumn("w", whole(0)).select(F.col("p_partkey").alias("row"), F.lit(0).alias("place"), F.unhex(text).alias("data"))


@query("V14_decode_capped", """
SELECT "row", 0 AS place, 'error' AS severity, 'image_decode_failed' AS code
FROM (SELECT p_partkey AS "row" FROM part WHERE p_partkey % 4 <> 3 ORDER BY p_partkey LIMIT 200) WHERE "row" % 4 IN (1, 2)""")
def decode_capped(spark, sf):
    """The limit is the feature: a validation decodes its first 200 images in row order."""
    return v.decode_issues(small_images(spark, sf), "row", "place")
