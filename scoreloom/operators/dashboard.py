"""Aggregates, facets and orders over filtered result rows (A20 to A36, O01 to O13, U, W)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.scoring import ratio
from .quantiles import quantiles, quantiles_of

LETTERS = scoring.LETTERS


def count() -> Column:
    return F.count(F.lit(1))


def subsets() -> Column:
    """Each row counts in all and in its class."""
    kind = F.when(F.col("is_correct"), "correct").when(~F.col("is_correct"), "incorrect").otherwise("unknown")
    return F.array(F.lit("all"), kind)


def exploded_subsets(rows: DataFrame) -> DataFrame:
    return rows.withColumn("subset", F.explode(subsets()))


def breakdown(rows: DataFrame, key: str) -> DataFrame:
    """Over all filtered rows, ordered by range key."""
    good = rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    out = good.groupBy(key).agg(count().alias("count"), F.count(F.when(F.col("is_correct"), 1)).alias("correct"), F.sum("points_earned").alias("earned"), F.sum("points").alias("possible"))
    return out.select(key, "count", ratio(F.col("correct"), F.col("count")).alias("accuracy"), F.coalesce(ratio(F.col("earned"), F.col("possible")), F.lit(0.0)).alias("weighted_accuracy")).orderBy(scoring.range_key(key))


def confusion(rows: DataFrame) -> DataFrame:
    """25 cells, zero-filled."""
    spark = rows.sparkSession
    pairs = rows.select(F.upper("answer").alias("answer"), F.upper("predicted").alias("predicted")).where(F.col("answer").isin(*LETTERS) & F.col("predicted").isin(*LETTERS))
    counts = pairs.groupBy("answer", "predicted").agg(count().alias("count"))
    cells = spark.createDataFrame([(a, b) for a in LETTERS for b in LETTERS], "answer string, predicted string")
    return cells.join(counts, ["answer", "predicted"], "left").select("answer", "predicted", F.coalesce("count", F.lit(0)).alias("count"))


def predicted_counts(rows: DataFrame) -> DataFrame:
    """A23."""
    return rows.where(F.length("predicted") > 0).groupBy(F.upper("predicted").alias("predicted")).agg(count().alias("count"))


def top_warnings(rows: DataFrame, k: int = 10) -> DataFrame:
    """A24; ties by key."""
    return rows.select(F.explode("warnings").alias("warning")).groupBy("warning").agg(count().alias("count")).orderBy(F.desc("count"), "warning").limit(k)


def histogram(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Equal bins, as many as the root of the count between 5 and 20; one where all values are equal."""
    known = rows.where(F.col(value).isNotNull())
    edges = known.groupBy(*by).agg(count().alias("n"), F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    flat = F.abs(F.col("hi") - F.col("lo")) <= 1e-9 * F.greatest(F.abs("hi"), F.abs("lo"))
    edges = edges.withColumn("bins", F.when(flat, 1).otherwise(F.greatest(F.lit(5), F.least(F.lit(20), F.floor(F.sqrt("n")).cast("int")))))
    # one row in all without groups; with them Spark goes by their size
    both = known.join(edges, list(by)) if by else known.join(F.broadcast(edges))
    step = (F.col("hi") - F.col("lo")) / F.col("bins")
    place = F.when(F.col("bins") == 1, 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / step), F.col("bins") - 1)).cast("int")
    counts = both.groupBy(*by, place.alias("bin")).agg(count().alias("count"))
    slots = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    low = F.col("lo") + F.col("bin") * step
    high = F.when(F.col("bin") == F.col("bins") - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * step)
    return slots.join(counts, [*by, "bin"], "left").select(*by, "bin", low.alias("low"), high.alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def _with(out: DataFrame, more: DataFrame, *by: str) -> DataFrame:
    """out with the columns of more, one row a group; without groups both have one row at most."""
    if by:
        return out.join(more, list(by), "left")
    return out.withColumn("one_", F.lit(1)).join(more.withColumn("one_", F.lit(1)), "one_", "left").drop("one_")


def summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """A26."""
    out = rows.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max"), F.round(F.stddev_pop(value), 6).alias("stddev"))
    both = _with(out, quantiles(rows, value, {"p25": 0.25, "median": 0.5, "p75": 0.75}, *by), *by)
    return both.select(*by, "count", "mean", "median", "min", "max", "p25", "p75", "stddev")


def subset_metrics(rows: DataFrame) -> DataFrame:
    """A27 without its distributions. Rows are summed and their values counted by class; the subset of all is made of the classes' sums."""
    total = Window.partitionBy()
    kinds = rows.withColumn("kind", subsets()[1])
    whole = F.explode(F.array(F.lit("all"), "kind")).alias("subset")
    known = lambda c: [F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n")]
    sums = kinds.groupBy("kind").agg(count().alias("count"), F.count(F.when(F.col("is_correct"), 1)).alias("correct"), F.count(F.when(F.col("multimodal"), 1)).alias("vision"), *known("points_earned"), *known("latency_ms"))
    out = sums.select(whole, "*").groupBy("subset").agg(*[F.sum(c).alias(c) for c in sums.columns if c != "kind"])
    values = F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v_")) for c in ("points_earned", "latency_ms")]))
    counts = kinds.select("kind", values).where("v_ is not null").groupBy("kind", "name", "v_").agg(count().alias("n_"))
    counts = counts.select(whole, "name", "v_", "n_").groupBy("subset", "name", "v_").agg(F.sum("n_").alias("n_"))
    middle = quantiles_of(counts, {"median": 0.5}, "subset", "name").groupBy("subset").agg(*[F.max(F.when(F.col("name") == c, F.col("median"))).alias(m) for c, m in (("points_earned", "points_median"), ("latency_ms", "latency_median"))])
    # at most four rows here
    out = out.join(middle, "subset", "left")
    share = F.col("count") / F.max(F.when(F.col("subset") == "all", F.col("count"))).over(total)
    mean = lambda c: ratio(F.col(f"{c}_sum"), F.col(f"{c}_n"))
    return out.select(
        "subset", "count", share.alias("share"), ratio(F.col("correct"), F.col("count")).alias("accuracy"), ratio(F.col("vision"), F.col("count")).alias("multimodal_share"),
        mean("points_earned").alias("points_mean"), "points_median", mean("latency_ms").alias("latency_mean"), "latency_median",
    )


def distribution(rows: DataFrame, key: str, by_range: bool = False, limit: int | None = None) -> DataFrame:
    """Count and share of each value in each subset."""
    label = F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit("Unknown"))
    counts = exploded_subsets(rows).groupBy("subset", label.alias("key")).agg(count().alias("count"))
    per = Window.partitionBy("subset")
    order = [scoring.range_key("key")] if by_range else [F.desc("count"), F.col("key")]
    out = counts.withColumn("share", F.col("count") / F.sum("count").over(per)).withColumn("place", F.row_number().over(per.orderBy(*order)))
    return out.where(F.col("place") <= limit) if limit else out


def facets(rows: DataFrame) -> DataFrame:
    """Sorted distinct values of each attribute; one scan, whose rows are made distinct before they are sent."""
    pair = lambda name, value: F.struct(F.lit(name).alias("attribute"), value.alias("value"))
    single = F.array(*[pair(c, F.col(c).cast("string")) for c in ("year", "group", "language", "reasoning_mode", "predicted")])
    every = F.concat(single, F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: pair("warnings", w)))
    found = rows.select(F.inline(every)).where("value is not null").distinct()
    return found.groupBy("attribute").agg(F.array_sort(F.collect_list("value")).alias("values"))


def overview_facets(runs: DataFrame, active: Column, keys: list[str]) -> DataFrame:
    """Of each value all runs and those that the filter leaves."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("attribute"), F.col(k).cast("string").alias("value")) for k in keys]))
    marked = runs.withColumn("active", active).select("active", pairs.alias("p"))
    return marked.groupBy("p.attribute", "p.value").agg(count().alias("total"), F.count(F.when(F.col("active"), 1)).alias("active"))


def difficulty(rows: DataFrame, key: str = "question_id") -> DataFrame:
    """Mean correctness and disagreement of each question."""
    hit = F.col("is_correct").cast("int")
    return rows.where(F.col("is_correct").isNotNull()).groupBy(key).agg(F.avg(hit).alias("p_correct"), F.stddev_pop(hit).alias("disagreement"), count().alias("n"))


def yearly(difficulty_: DataFrame, questions: DataFrame, human: DataFrame, key: str = "question_id") -> DataFrame:
    """Mean human and model correctness by year, over questions that have a human value."""
    both = difficulty_.join(questions, key, "left").join(human, key, "left").where("human_p is not null and year is not null")
    out = both.groupBy("year").agg(F.avg("human_p").alias("human"), F.avg("p_correct").alias("llm"), count().alias("questions"))
    return out.withColumn("ratio", F.coalesce(ratio(F.col("human"), F.col("llm")), F.lit(0.0)))


def tag_means(difficulty_: DataFrame, tags: DataFrame, key: str = "question_id") -> DataFrame:
    """A35."""
    return difficulty_.join(tags, key).select("p_correct", F.explode("tags").alias("tag")).groupBy("tag").agg(F.avg("p_correct").alias("mean"), count().alias("count"))


def page(rows: DataFrame, by: str, descending: bool, start: int, size: int, neutral: object = 0.0, tie: str = "id") -> DataFrame:
    """Null sorts as the neutral value; ties by id."""
    key = F.coalesce(F.col(by), F.lit(neutral))
    return rows.orderBy(key.desc() if descending else key.asc(), F.col(tie)).offset(start).limit(size)


def last_of(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """Of rows with equal key the last one."""
    place = Window.partitionBy(key).orderBy(*[F.desc(o) if isinstance(o, str) else o.desc() for o in order])
    return rows.withColumn("place_", F.row_number().over(place)).where("place_ = 1").drop("place_")


def run_pair(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Common keys with both sides and their differences."""
    side = lambda df, p: df.select(key, *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return side(a, "a").join(side(b, "b"), key)


def pair_breakdown(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """All keys of either run; delta only where both have one."""
    side = lambda df, p: df.select(key, F.col("accuracy").alias(f"{p}_accuracy"), F.col("count").alias(f"{p}_count"))
    return side(a, "a").join(side(b, "b"), key, "full_outer").withColumn("delta", F.col("b_accuracy") - F.col("a_accuracy"))


def top_by(rows: DataFrame, group: list[str], *order: Column) -> DataFrame:
    """First row of each group."""
    return rows.withColumn("place_", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("place_ = 1").drop("place_")


def winners(scores: DataFrame, group: list[str], value: str, who: str) -> DataFrame:
    """Winner, runner-up and margin of each group."""
    order = Window.partitionBy(*group).orderBy(F.desc(value), F.col(who))
    ranked = scores.withColumn("place_", F.row_number().over(order)).withColumn("runner_up", F.lead(who).over(order)).withColumn("second", F.lead(value).over(order))
    return ranked.where("place_ = 1").select(*group, F.col(who).alias("winner"), F.col(value).alias("best"), "runner_up", (F.col(value) - F.col("second")).alias("margin"))


def leave_one_out(scores: DataFrame, group: list[str], value: str) -> DataFrame:
    """Equal-weight mean of a group, and without the row's own value (null where it is alone)."""
    per = Window.partitionBy(*group)
    total, n = F.sum(value).over(per), F.count(value).over(per)
    own = F.coalesce(F.col(value), F.lit(0.0))
    return scores.withColumn("ensemble", ratio(total, n)).withColumn("others", ratio(total - own, n - F.when(F.col(value).isNotNull(), 1).otherwise(0)))


def z_scores(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Population; 0 where a group has no spread."""
    per = Window.partitionBy(*group)
    mean, sd = F.avg(value).over(per), F.stddev_pop(value).over(per)
    return rows.withColumn("z", F.when(sd > 0, (F.col(value) - mean) / sd).otherwise(F.col(value) * 0))


def quantile_bins(rows: DataFrame, value: str, q: int) -> DataFrame:
    """Bins by exact quantiles, equal edges dropped; the lowest value is in the first bin. q + 1 edges come to the driver."""
    edges = quantiles(rows, value, {f"q{i}": i / q for i in range(q + 1)}).first()
    cuts = sorted({x for x in edges or () if x is not None})
    below = sum((F.when(F.col(value) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    return rows.withColumn("bin", F.greatest(F.lit(1), below) - 1)


def ema(rows: DataFrame, group: list[str], order: list[str], value: str, alpha: float = 0.2) -> DataFrame:
    """Exponential mean of a group's values in order, as the sum of their weights; nothing is gathered."""
    back = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in order])
    known = rows.where(F.col(value).isNotNull()).withColumn("age_", F.row_number().over(back) - 1).withColumn("first_", F.lead(F.lit(1)).over(back).isNull())
    weight = F.pow(F.lit(1 - alpha), F.col("age_")) * F.when(F.col("first_"), 1.0).otherwise(alpha)
    return known.groupBy(*group).agg(F.sum(F.col(value) * weight).alias("ema"), F.count(F.lit(1)).cast("int").alias("n"))
