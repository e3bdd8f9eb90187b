"""Scoring rules as column expressions; nothing here runs Python on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, the token of a declined answer, the penalty, start capitals by grade.
LETTERS = ("A", "B", "C", "D", "E")
DECLINED = "DECLINED"
PENALTY = 0.25
UPPER_GRADES, UPPER_START = (7, 13), 30.0
LOWER_GRADES, LOWER_START = (3, 6), 24.0
BLANKS = " \t\n\r\v\f"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def finite(x: Column | str) -> Column:
    """a finite double, else 0."""
    n = F.trim(col(x).cast("string"), F.lit(BLANKS)).try_cast("double")
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), 0.0).otherwise(n)


def whole_number(x: Column | str) -> Column:
    """an integer if the value is one, by way of double; else null."""
    n = F.trim(col(x).cast("string"), F.lit(BLANKS)).try_cast("double")
    return F.when(n == F.floor(n), n.try_cast("bigint"))


def grade_numbers(group: Column | str) -> Column:
    """All digit runs of a label, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(col(group).cast("string"), F.lit("")), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))


def start_capital(group: Column | str) -> Column:
    """By the smallest grade of the label."""
    least = F.array_min(grade_numbers(group))
    return F.when(least.between(*UPPER_GRADES), UPPER_START).when(least.between(*LOWER_GRADES), LOWER_START).otherwise(0.0)


def normalized(predicted: Column | str) -> Column:
    """Trimmed, upper case; blank is null."""
    return F.nullif(F.upper(F.trim(col(predicted), F.lit(BLANKS))), F.lit(""))


def declined(predicted: Column | str) -> Column:
    return F.coalesce(F.upper(F.trim(col(predicted), F.lit(BLANKS))) == DECLINED, F.lit(False))


def is_correct(points: Column | str, answer: Column | str, predicted: Column | str) -> Column:
    """E01, second value: null where a row can't be judged."""
    judged = col(answer).isNotNull() & (finite(points) > 0)
    return F.when(judged, F.coalesce(~declined(predicted) & (F.upper(F.trim(col(predicted), F.lit(BLANKS))) == col(answer)), F.lit(False)))


def points_earned(points: Column | str, answer: Column | str, predicted: Column | str, penalize_unanswered: bool = True) -> Column:
    """E01, first value."""
    worth = finite(points)
    missing = -worth * PENALTY if penalize_unanswered else F.lit(0.0)
    return (
        F.when(col(answer).isNull() | (worth <= 0), 0.0)
        .when(col(predicted).isNull(), missing)
        .when(declined(predicted), 0.0)
        .when(F.upper(F.trim(col(predicted), F.lit(BLANKS))) == col(answer), worth)
        .otherwise(-worth * PENALTY)
    )


def grade_band(group: Column | str) -> Column:
    """E08."""
    numbers = grade_numbers(group)
    least = F.array_min(numbers)
    return F.when(col(group).isNull() | (F.size(numbers) == 0), "Unknown").when(least.between(*LOWER_GRADES), "Lower").when(least.between(*UPPER_GRADES), "Upper").otherwise("Other")


#: Grade buckets.
BUCKETS = ((3, 4), (5, 6), (7, 8), (9, 10), (11, 13))


def grade_bucket(group: Column | str) -> Column:
    """The bucket that holds the label's whole range; null if none does."""
    lo, hi = F.array_min(grade_numbers(group)), F.array_max(grade_numbers(group))
    out = F.when(lo.isNull(), F.lit(None).cast("string"))
    for a, b in BUCKETS:
        out = out.when((lo >= a) & (hi <= b), f"{a}-{b}")
    return out


def bucket_order(bucket: Column | str) -> Column:
    """O14."""
    out = F.when(col(bucket).isNull(), 99)
    for i, (a, b) in enumerate(BUCKETS):
        out = out.when(col(bucket) == f"{a}-{b}", i)
    return out.otherwise(98)


def range_key(group: Column | str) -> Column:
    """(start, end, text) of a label; labels without a number come last."""
    numbers = grade_numbers(group)
    return F.struct(F.coalesce(F.get(numbers, F.lit(0)), F.lit(10**6)).alias("lo"), F.coalesce(F.get(numbers, F.size(numbers) - 1), F.lit(10**6)).alias("hi"), col(group).cast("string").alias("text"))


def model_label(run_name: Column | str) -> Column:
    """The third part of a run's name."""
    return F.coalesce(F.get(F.split(col(run_name), "_", 4), F.lit(2)), col(run_name))


def run_time(run_name: Column | str) -> Column:
    """naive time from the first two parts."""
    parts = F.split(col(run_name), "_")
    return F.try_to_timestamp(F.concat_ws("_", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))), F.lit("yyyyMMdd_HHmmss"))


def boolish(x: Column | str) -> Column:
    """F18."""
    t = F.lower(F.trim(col(x).cast("string"), F.lit(BLANKS)))
    return F.when(t.isin("1", "true", "yes", "y", "t"), True).when(t.isin("0", "false", "no", "n", "f"), False)


def key_text(x: Column | str) -> Column:
    """numbers with an integer value (up to 2**63) as integer text, other text trimmed, NaN null."""
    t = F.trim(col(x).cast("string"), F.lit(BLANKS))
    n = t.try_cast("double")
    return F.when(F.isnan(n), F.lit(None).cast("string")).when((n == F.floor(n)) & (F.abs(n) < 2.0**63), n.try_cast("bigint").cast("string")).otherwise(t)


def parsed_date(x: Column | str) -> Column:
    """ISO first, then three day formats; else null."""
    t = F.trim(col(x), F.lit(BLANKS))
    return F.coalesce(t.try_cast("timestamp"), *[F.try_to_timestamp(t, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy")])


def thresholds(text: Column | str) -> Column:
    """Comma-separated shares; 1 and more are percent; negative and other text go."""
    numbers = F.transform(F.split(col(text), ","), lambda x: F.trim(x).try_cast("double"))
    good = F.filter(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0))
    return F.transform(good, lambda x: F.when(x >= 1, x / 100).otherwise(x))


def mime_type(data: Column | str) -> Column:
    """F14, by the first bytes."""
    head = lambda n: F.hex(F.substring(col(data), 1, n))
    return F.when(head(4) == "89504E47", "image/png").when(head(3) == "FFD8FF", "image/jpeg").when(head(4) == "47494638", "image/gif").when((head(4) == "52494646") & (F.hex(F.substring(col(data), 9, 4)) == "57454250"), "image/webp").otherwise("application/octet-stream")


def data_url(data: Column | str) -> Column:
    return F.concat(F.lit("data:"), mime_type(data), F.lit(";base64,"), F.base64(col(data)))


def bytes_of(text: Column | str, least: int = 16) -> Column:
    """base64 text longer than `least` characters as bytes; else null."""
    return F.when(F.length(col(text)) > least, F.try_to_binary(col(text), F.lit("base64")))


def humanized(seconds: Column | str) -> Column:
    """F16: 1h 02m, 3m 04s, 5s."""
    s = F.floor(col(seconds)).cast("bigint")
    return F.when(s.isNull(), "-").when(s >= 3600, F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s % 3600 / 60))).when(s >= 60, F.format_string("%dm %02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))
