"""Scores against binned distributions of human scores.

bins: year, grade, idx (0 = highest), lo, hi, n. A grade has few bins, so
expressions over one score take them as an array, ascending: see with_bins().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import grade_numbers, ratio, start_capital
from .quantiles import quantiles

GRADE = ["year", "grade"]


def midpoint(lo: Column, hi: Column) -> Column:
    """H02."""
    return F.when(hi - lo <= 0, hi).otherwise((lo + hi) / 2)


def with_range(bins: DataFrame, ranges: str = "ranges_by_grade", default: str = "range_default") -> DataFrame:
    """The grade's own range of a bin, else the default."""
    own = F.coalesce(F.try_element_at(F.col(ranges), F.col("grade")), F.col(default))
    return bins.withColumn("lo", own["min"]).withColumn("hi", own["max"])


def grade_stats(bins: DataFrame) -> DataFrame:
    """Students, mean and population deviation by midpoints, best (top of the first bin with students)."""
    mid, n = midpoint(F.col("lo"), F.col("hi")), F.col("n")
    sums = bins.groupBy(*GRADE).agg(F.sum("n").alias("students"), F.sum(n * mid).alias("s1"), F.sum(n * mid * mid).alias("s2"), F.max(F.when(n > 0, F.col("hi"))).alias("best"), F.max("hi").alias("max_points"))
    mean = ratio(F.col("s1"), F.col("students"))
    return sums.select(*GRADE, "students", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), ratio(F.col("s2"), F.col("students")) - mean * mean)).alias("stddev"), "best", "max_points")


def cdf(bins: DataFrame) -> DataFrame:
    """Upper bound and share of students up to it."""
    up = Window.partitionBy(*GRADE).orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    return bins.select(*GRADE, "hi", ratio(F.sum("n").over(up), F.sum("n").over(Window.partitionBy(*GRADE))).alias("share"))


def shares(bins: DataFrame) -> DataFrame:
    """H06."""
    return bins.withColumn("share", F.coalesce(ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*GRADE))), F.lit(0.0)))


def with_bins(bins: DataFrame) -> DataFrame:
    """year, grade, bins: array of (lo, hi, n, idx), ascending."""
    return bins.groupBy(*GRADE).agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "n", "idx"))).alias("bins"))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, b: a + b["n"])


def percentile(score: Column, bins: Column, most: Column) -> Column:
    """H04, first definition (0 to 1): linear inside a bin, empty bins skipped."""
    s, total = F.greatest(F.lit(0.0), F.least(score, most)), _sum(bins)
    hit = F.try_element_at(F.filter(bins, lambda b: (b["n"] > 0) & (b["hi"] >= s)), F.lit(1))
    below = _sum(F.filter(bins, lambda b: b["hi"] < s))
    width = hit["hi"] - hit["lo"]
    inside = F.when(width <= 0, F.when(s >= hit["hi"], 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(s - hit["lo"], width))))
    return F.when(total > 0, (below + F.coalesce(hit["n"] * inside, F.lit(0.0))) / total)


def percentile_at_least(score: Column, bins: Column) -> Column:
    """H19, second definition (0 to 100): 100 less the share in bins whose midpoint is at least the score."""
    above = _sum(F.filter(bins, lambda b: midpoint(b["lo"], b["hi"]) >= score - 1e-9))
    return 100 - 100 * ratio(above, _sum(bins))


def percentile_up_to(score: Column, bins: Column) -> Column:
    """H20, third definition (0 to 100): share in bins whose midpoint is at most the score, the lowest bin at least."""
    below = _sum(F.filter(bins, lambda b: midpoint(b["lo"], b["hi"]) <= score))
    return 100 * ratio(F.greatest(below, F.try_element_at(bins, F.lit(1))["n"]), _sum(bins))


def z_score(score: Column, mean: Column, sd: Column) -> Column:
    """H05."""
    return F.when(sd >= 1e-9, (score - mean) / sd)


def bin_of(score: Column, bins: Column, most: Column, inclusive: str = "both") -> Column:
    """The first bin (highest scores first) that holds the score, else the nearest."""
    s = F.greatest(F.lit(0.0), F.least(score, most))
    holds = {"both": lambda b: (b["lo"] <= s) & (s <= b["hi"]), "left": lambda b: (b["lo"] <= s) & (s < b["hi"]), "right": lambda b: (b["lo"] < s) & (s <= b["hi"])}[inclusive]
    keyed = F.transform(bins, lambda b: F.struct(F.when(holds(b), 0.0).when(s < b["lo"], b["lo"] - s).otherwise(s - b["hi"]).alias("d"), b["idx"].alias("idx")))
    return F.array_min(keyed)["idx"]


def smoothed(score: Column, bins: Column) -> Column:
    """Weights (idx, w) of the two nearest midpoints by inverse distance."""
    near = F.array_sort(F.transform(bins, lambda b: F.struct(F.abs(score - midpoint(b["lo"], b["hi"])).alias("d"), b["idx"].alias("idx"))))
    a, b = F.get(near, F.lit(0)), F.get(near, F.lit(1))
    exact = (a["d"] == 0) | b.isNull()
    pair = lambda x, w: F.struct(x["idx"].alias("idx"), w.cast("double").alias("w"))
    wa = F.try_divide(F.lit(1.0), a["d"])
    wb = F.try_divide(F.lit(1.0), b["d"])
    return F.when(exact, F.array(pair(a, F.lit(1.0)))).otherwise(F.array(pair(a, wa / (wa + wb)), pair(b, wb / (wa + wb))))


def bin_comparison(scored: DataFrame, bins: DataFrame, keys: list[str]) -> DataFrame:
    """Each bin's human share, the score's share (one bin) and its smoothed share. scored: keys, year, grade, score, max_points."""
    both = scored.join(with_bins(bins), GRADE)
    marked = both.withColumn("hit", bin_of(F.col("score"), F.col("bins"), F.col("max_points"))).withColumn("soft", smoothed(F.col("score"), F.col("bins")))
    rows = marked.select(*keys, *[g for g in GRADE if g not in keys], "hit", "soft", F.explode("bins").alias("b"), _sum(F.col("bins")).alias("total"))
    human, raw = F.coalesce(ratio(F.col("b.n"), F.col("total")), F.lit(0.0)), F.when(F.col("b.idx") == F.col("hit"), 1.0).otherwise(0.0)
    soft = F.coalesce(F.try_element_at(F.filter("soft", lambda s: s["idx"] == F.col("b.idx")), F.lit(1))["w"], F.lit(0.0))
    return rows.select(*keys, *[g for g in GRADE if g not in keys], F.col("b.idx").alias("idx"), human.alias("human_share"), raw.alias("llm_share"), soft.alias("smoothed_share"), (raw - human).alias("delta"), (soft - human).alias("smoothed_delta"))


def merged(bins: DataFrame, members: DataFrame) -> DataFrame:
    """Bins of several grades as one. members: year, grade, into."""
    return bins.join(members, GRADE).groupBy("year", "into", "idx").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).withColumnRenamed("into", "grade")


def match_grade(groups: DataFrame, grades: DataFrame) -> DataFrame:
    """Year, group to the grade that the label names: by id, label or members, then with loose separators, then by a single number; the first grade of the first stage wins.

    grades: year, grade, label, members, position; a year has few, so the join by year stays small.
    """
    loose = lambda c: F.regexp_replace(F.lower(c), "[^0-9a-z]+", "-")
    both = groups.join(grades, "year")
    members = F.array_join(F.transform("members", lambda m: m.cast("string")), "-")
    numbers = grade_numbers("group")
    exact = (F.col("group") == F.col("grade")) | (F.col("group") == F.col("label")) | (F.col("group") == F.replace(F.col("label"), F.lit("/"), F.lit("-"))) | (F.col("group") == members)
    stage = F.when(exact, 1).when((loose(F.col("group")) == loose(F.col("label"))) | (loose(F.col("group")) == members), 2).when((F.size(numbers) == 1) & F.array_contains("members", F.get(numbers, F.lit(0))), 3)
    first = Window.partitionBy("year", "group").orderBy("stage", "position")
    return both.withColumn("stage", stage).where("stage is not null").withColumn("place", F.row_number().over(first)).where("place = 1").select("year", "group", "grade", "stage")


def range_members(groups: DataFrame, grades: DataFrame, since: int = 2007) -> DataFrame:
    """Single-member grades inside a label's range, from the year `since` on."""
    numbers = grade_numbers("group")
    ranged = groups.where((F.col("year") >= since) & F.col("group").rlike(r"^\s*\d+\s*-\s*\d+\s*$"))
    inside = F.get(F.col("members"), F.lit(0)).between(F.array_min(numbers), F.array_max(numbers))
    return ranged.join(grades.where(F.size("members") == 1), "year").where(inside).select("year", "group", "grade")


def best_member(members: DataFrame, stats: DataFrame) -> DataFrame:
    """Of each range the grade with the highest mean; the first on ties."""
    best = Window.partitionBy("year", "group").orderBy(F.desc("mean"), "grade")
    return members.join(stats, GRADE).withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def versus(scores: DataFrame, bins: DataFrame) -> DataFrame:
    """Scores (year, grade, earned, available) with capital, share of the maximum, percentile and z-score."""
    stats = grade_stats(bins)
    both = scores.join(stats, GRADE).join(with_bins(bins), GRADE)
    start = start_capital("grade")
    total, observed = F.col("earned") + start, F.col("available") + start
    most = F.when(F.col("max_points") > 0, F.col("max_points")).otherwise(observed)
    return both.select(
        *scores.columns, start.alias("start"), total.alias("llm_total"), most.alias("llm_max"), ratio(total, most).alias("llm_pct"),
        percentile(total, F.col("bins"), F.col("max_points")).alias("percentile"), z_score(total, F.col("mean"), F.col("stddev")).alias("z"), "mean", "stddev", "best",
    )


def cohort(entries: DataFrame) -> DataFrame:
    """Over the runs of a (year, grade): means by maximum (micro) and by run (macro), quantiles, best and worst run."""
    w = F.when(F.col("llm_max") > 0, F.col("llm_max")).otherwise(1.0)
    micro = lambda c: ratio(F.sum(F.col(c) * w), F.sum(F.when(F.col(c).isNotNull(), w)))
    best, worst = F.struct(F.col("percentile"), F.col("order").alias("o")), F.struct(F.col("percentile"), -F.col("order"))
    ordered = entries.withColumn("order", -F.dense_rank().over(Window.partitionBy("year", "grade").orderBy("run_id")))
    out = ordered.groupBy(*GRADE).agg(
        F.count(F.lit(1)).alias("runs"), micro("llm_pct").alias("micro_pct"), F.avg("llm_pct").alias("macro_pct"), micro("percentile").alias("micro_percentile"), F.avg("percentile").alias("macro_percentile"),
        F.count("percentile").alias("known"), F.min("percentile").alias("low"), F.max("percentile").alias("high"),
        F.max_by("run_id", best).alias("best_run"), F.min_by("run_id", worst).alias("worst_run"),
    )
    cuts = quantiles(entries, "percentile", {"median": 0.5, "p25": 0.25, "p75": 0.75}, *GRADE)
    two = [F.when(F.col("known") >= 2, F.col(c)).alias(c) for c in ("median", "p25", "p75")]
    return out.join(cuts, GRADE, "left").select(*(c for c in out.columns if c != "known"), *two)


def weighted(entries: DataFrame, mode: str) -> DataFrame:
    """Entries with weight w: by run, each run's entries alike (macro), or by what could be had."""
    if mode == "macro":
        cells = entries.groupBy("run_id").agg(F.count(F.lit(1)).alias("cells_"))
        return entries.join(cells, "run_id").withColumn("w", F.lit(1.0) / (F.lit(cells.count()) * F.col("cells_"))).drop("cells_")
    return entries.withColumn("w", F.when(F.col("llm_max") > 0, F.col("llm_max")).when(F.col("available") > 0, F.col("available")).otherwise(1.0))


def outcome(gap: Column, tolerance: float = 1e-9) -> Column:
    return F.when(gap > tolerance, "llm").when(gap < -tolerance, "human").when(gap.isNotNull(), "tie")


def summary(entries: DataFrame, comparator: str = "mean", *by: str) -> DataFrame:
    """Wins, losses and ties of each run, and means weighted by maximum."""
    gap = F.col("llm_total") - F.col(comparator)
    w = F.when(F.col("llm_max") > 0, F.col("llm_max")).otherwise(1.0)
    mean = lambda x: ratio(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))
    n = lambda kind: F.count(F.when(outcome(gap) == kind, 1))
    return entries.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cells"), n("llm").alias("llm_wins"), n("human").alias("human_wins"), n("tie").alias("ties"),
        mean(F.col("percentile")).alias("avg_percentile"), mean(gap / F.col("llm_max")).alias("avg_gap_pct"),
    )


def threshold_counts(entries: DataFrame, thresholds: list[float], comparator: str = "mean") -> DataFrame:
    """Cells whose gap is at least each threshold either way."""
    gap = (F.col("llm_total") - F.col(comparator)) / F.col("llm_max")
    each = entries.select(gap.alias("gap"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return each.groupBy("threshold").agg(F.count(F.when(F.col("gap") >= F.col("threshold"), 1)).alias("llm"), F.count(F.when(F.col("gap") <= -F.col("threshold"), 1)).alias("human"))


def baseline_summary(stats: DataFrame, key: str) -> DataFrame:
    """students' mean share of the maximum by year or grade, weighted by students."""
    return stats.groupBy(key).agg(F.sum("students").alias("students"), ratio(F.sum(F.col("mean") * F.col("students") / F.col("max_points")), F.sum("students")).alias("mean_pct"))


def positions(bins: DataFrame) -> DataFrame:
    """The median student's bin, students in the top bin and in the lowest three."""
    up = Window.partitionBy(*GRADE).orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    full = Window.partitionBy(*GRADE)
    ranked = bins.withColumn("cum", F.sum("n").over(up)).withColumn("total", F.sum("n").over(full)).withColumn("last", F.max("idx").over(full))
    return ranked.groupBy(*GRADE).agg(F.max(F.when(F.col("cum") >= F.col("total") / 2, F.col("idx"))).alias("median_bin"), F.sum(F.when(F.col("idx") == 0, F.col("n")).otherwise(0)).alias("top"), F.sum(F.when(F.col("idx") > F.col("last") - 3, F.col("n")).otherwise(0)).alias("bottom3"))


def stars(percentile_: Column) -> Column:
    """C08."""
    return F.when(percentile_ >= 0.99, 4).when(percentile_ >= 0.95, 3).when(percentile_ >= 0.75, 2).when(percentile_ >= 0.5, 1).when(percentile_.isNotNull(), 0)


def cover(groups: DataFrame, grades: DataFrame) -> DataFrame:
    """Grades that together are a label's numbers. year, group, grades, how.

    The grade with that name, else the one with those members; else grades inside
    what is left, in order of position, then grades that overlap it; a label that
    stays uncovered has no row. The folds run over a year's few grades as an array.
    """
    per_year = grades.groupBy("year").agg(F.array_sort(F.collect_list(F.struct("position", "grade", "members"))).alias("all"))
    both = groups.join(per_year, "year").withColumn("want", F.array_distinct(grade_numbers("group"))).where(F.size("want") > 0)
    start = F.struct(F.col("want").alias("left"), F.array().cast("array<string>").alias("taken"))

    def take(state: Column, g: Column, fits: Column) -> Column:
        return F.struct(F.when(fits, F.array_except(state["left"], g["members"])).otherwise(state["left"]).alias("left"), F.when(fits, F.array_append(state["taken"], g["grade"])).otherwise(state["taken"]).alias("taken"))

    inside = F.aggregate("all", start, lambda s, g: take(s, g, (F.size(g["members"]) > 0) & (F.size(F.array_except(g["members"], s["left"])) == 0)))
    staged = both.withColumn("inside", inside)
    over = F.aggregate("all", F.col("inside"), lambda s, g: take(s, g, F.arrays_overlap(g["members"], s["left"]) & ~F.array_contains(s["taken"], g["grade"])))
    named = F.try_element_at(F.filter("all", lambda g: g["grade"] == F.col("group")), F.lit(1))["grade"]
    same = F.try_element_at(F.filter("all", lambda g: F.array_sort(g["members"]) == F.array_sort(F.col("want"))), F.lit(1))["grade"]
    done = staged.withColumn("over", over).withColumn("named", named).withColumn("same", same)
    picked = F.when(F.col("named").isNotNull(), F.array("named")).when(F.col("same").isNotNull(), F.array("same")).when(F.size("over.left") == 0, F.col("over.taken"))
    how = F.when(F.col("named").isNotNull(), "id").when(F.col("same").isNotNull(), "members").otherwise("components")
    return done.withColumn("grades", picked).where("grades is not null").select("year", "group", "grades", how.alias("how"))


def id_midpoint(bin_id: Column, lo: Column, hi: Column) -> Column:
    """From the range, else from the numbers in the bin's id; null without either."""
    numbers = F.transform(F.regexp_extract_all(bin_id, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    by_id = F.when(F.size(numbers) >= 2, (F.get(numbers, F.lit(0)) + F.get(numbers, F.lit(1))) / 2).when(F.size(numbers) == 1, F.get(numbers, F.lit(0)))
    return F.coalesce(midpoint(lo, hi), by_id)


def five_numbers(rows: DataFrame) -> DataFrame:
    """What is missing of minimum, quartiles and maximum is the median."""
    return rows.select(*[F.coalesce(c, "median").alias(c) if c in ("low", "p25", "p75", "high") else F.col(c) for c in rows.columns])


def grade_years(grades: DataFrame) -> DataFrame:
    """Grade numbers with the years that have them."""
    return grades.select("year", F.explode("members").alias("number")).groupBy("number").agg(F.array_sort(F.collect_set("year")).alias("years"))


def quick_stats(entries: DataFrame) -> DataFrame:
    """C04."""
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_distinct("grade").alias("grades"), F.sum("earned").alias("awarded"), F.sum("llm_max").alias("most"))


def client_stats(entries: DataFrame, comparator: str = "mean") -> DataFrame:
    """Wins without tolerance, mean percentile, best year by mean percentile (the first on ties)."""
    wins = entries.agg(F.count(F.when(F.col("llm_total") > F.col(comparator), 1)).alias("llm_wins"), F.count(F.when(F.col("llm_total") < F.col(comparator), 1)).alias("human_wins"), F.avg("percentile").alias("mean_percentile"))
    years = entries.groupBy("year").agg(F.avg("percentile").alias("p")).agg(F.max_by("year", F.struct("p", -F.col("year"))).alias("best_year"))
    return wins.join(F.broadcast(years))
