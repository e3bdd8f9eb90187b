"""Data-quality rules of question sets (V01 to V18): each rule a boolean column, all in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.images import decodes

BLANKS = scoring.BLANKS
#: Fixed value: images that a validation decodes.
DECODE_LIMIT = 200
OPTIONS = tuple(f"sol_{x}" for x in scoring.LETTERS)
REQUIRED = ("id", "year", "group", "points", "problem_number", "problem_statement", "answer", "multimodal", "language", *OPTIONS)


def column_issues(columns: list[str], required: tuple[str, ...] = REQUIRED) -> list[tuple[str, str, str]]:
    """V01."""
    return [("error", "missing_columns", c) for c in sorted(set(required) - set(columns))] + [("warning", "extra_columns", c) for c in sorted(set(columns) - set(required))]


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c, F.lit(BLANKS)) == "", F.lit(True))


def blob_kind(c: Column) -> Column:
    """V15, for text: data URL, http URL, base64, path."""
    t = F.trim(c, F.lit(BLANKS))
    return (
        F.when(t.isNull() | (t == ""), F.lit(None).cast("string")).when(t.startswith("data:"), "data_url").when(t.rlike("^https?://"), "http_url")
        .when((F.length(t) > 16) & t.rlike(r"^[A-Za-z0-9+/\s]+={0,2}$") & (F.length(t) % 4 == 0) & F.try_to_binary(t, F.lit("base64")).isNotNull(), "base64").otherwise("path")
    )


def decodable(data: Column) -> Column:
    """V14, by the first bytes alone; decode_issues() reads images to their end."""
    return scoring.mime_type(data) != "application/octet-stream"


def decode_issues(images: DataFrame, *order: str, limit: int = DECODE_LIMIT) -> DataFrame:
    """Of the first `limit` images in order those that can't be read to their end; images without bytes don't count.

    The first ones are kept in each partition before they are put together, so no row is numbered; images: data, and
    the columns of the order (row, then place in the row), which come back with severity and code.
    """
    first = images.where(F.length("data") > 0).orderBy(*order).limit(limit)
    return first.where(~decodes("data")).select(*order, F.lit("error").alias("severity"), F.lit("image_decode_failed").alias("code"))


def rules(images: list[str] | None = None) -> list[tuple[str, str, Column]]:
    """(severity, code, condition that a row fails by)."""
    images = images if images is not None else [f"{c}_image" for c in OPTIONS]
    answer = F.upper(F.trim("answer", F.lit(BLANKS)))
    text, pictures = [~_blank(F.col(c)) for c in OPTIONS], [F.col(c).isNotNull() for c in images]
    both = lambda xs, f: f(F.array(*xs), lambda x: x)
    text_ok, image_ok, any_text, any_image = both(text, F.forall), both(pictures, F.forall), both(text, F.exists), both(pictures, F.exists)
    low = F.array(*[F.lower(F.trim(c, F.lit(BLANKS))) for c in OPTIONS])
    year, number, points = scoring.whole_number("year"), scoring.whole_number("problem_number"), F.col("points").try_cast("double")
    return [
        # V04
        ("error", "empty_problem_statement", _blank(F.col("problem_statement"))),
        # V05
        ("error", "invalid_answer", F.coalesce(~answer.isin(*scoring.LETTERS), F.lit(True))),
        # V06
        ("error", "options_missing", ~text_ok & ~image_ok),
        ("warning", "mixed_options", any_text & any_image & ~(text_ok & image_ok)),
        # V08
        ("warning", "duplicate_option_texts", text_ok & (F.size(F.array_distinct(low)) < len(OPTIONS))),
        # V09
        ("error", "multimodal_flag_without_images", F.coalesce(scoring.boolish("multimodal"), F.lit(False)) & ~any_image),
        ("warning", "images_with_multimodal_false", ~F.coalesce(scoring.boolish("multimodal"), F.lit(True)) & any_image),
        ("warning", "multimodal_nonboolean", F.col("multimodal").isNotNull() & scoring.boolish("multimodal").isNull()),
        # V11
        ("warning", "year_out_of_range", ~F.coalesce(year.between(1998, 2100), F.lit(False))),
        ("warning", "problem_number_range", F.coalesce(~number.between(1, 40), F.lit(False))),
        # V12
        ("warning", "points_range", ~F.coalesce((points > 0) & (points < 10), F.lit(False))),
        ("warning", "points_nonstandard", F.coalesce(~points.isin(3.0, 4.0, 5.0), F.lit(True))),
        # V13
        ("warning", "language_unexpected", F.coalesce(~F.lower("language").isin("de", "en"), F.lit(False))),
    ]


def row_issues(rows: DataFrame, images: list[str] | None = None) -> DataFrame:
    """Severity, code, id."""
    failed = F.filter(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(code).alias("code"))) for s, code, c in rules(images)]), lambda x: x.isNotNull())
    return rows.select("id", F.explode(failed).alias("i")).select("i.severity", "i.code", "id")


def duplicate_ids(rows: DataFrame, k: int = 10) -> DataFrame:
    """V02."""
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("count")).where("count > 1").orderBy(F.desc("count"), "id").limit(k)


def duplicate_triplets(rows: DataFrame) -> DataFrame:
    """Counted map-side first, so that one frequent triplet is no trouble."""
    return rows.groupBy("year", "group", "problem_number").agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def distribution(rows: DataFrame, k: int = 20) -> DataFrame:
    """V16."""
    n = lambda p: F.count(F.when(F.col("points") == p, 1)).alias(f"points_{p}")
    return rows.groupBy("year", "group").agg(F.count(F.lit(1)).alias("count"), n(3), n(4), n(5)).orderBy("year", "group").limit(k)


def ranked(issues: DataFrame, samples: int = 5) -> DataFrame:
    """Errors first, then by frequency, with a few ids each."""
    counts = issues.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("count"))
    few = issues.withColumn("place", F.row_number().over(Window.partitionBy("severity", "code").orderBy("id"))).where(F.col("place") <= samples).groupBy("severity", "code").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return counts.join(few, ["severity", "code"]).orderBy(F.col("severity") != "error", F.desc("count"), "code")


def answer_without_option(images: list[str] | None = None) -> Column:
    """The answer's own option has neither text nor image. A row that passes V06 has all five, so this never adds an issue."""
    images = images if images is not None else [f"{c}_image" for c in OPTIONS]
    answer = F.upper(F.trim("answer", F.lit(BLANKS)))
    out = F.lit(False)
    for letter, text, image in zip(scoring.LETTERS, OPTIONS, images):
        out = out | ((answer == letter) & _blank(F.col(text)) & F.col(image).isNull())
    return out


def missing_paths(rows: DataFrame, columns: list[str], known: DataFrame) -> DataFrame:
    """Image paths that are not among the known ones (column path), once a row."""
    paths = F.array_distinct(F.filter(F.array(*columns), lambda c: blob_kind(c) == "path"))
    return rows.select("id", F.explode(paths).alias("path")).join(known.select("path"), "path", "left_anti").select(F.lit("error").alias("severity"), F.lit("image_path_missing").alias("code"), "id", "path")
