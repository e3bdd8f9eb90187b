"""Exact quantiles of any number of values, by selection of the wanted ranks.

A double's sign, exponent and mantissa make a 64-bit number in the order of the
values. Values are counted by its first 16 bits (sums made map-side); the counts,
at most 65,536 a group, say in which of these ranges a wanted rank lies. Values in
such ranges are counted by 16 bits more, and only those whose first 32 bits agree
with the one that is looked for (to one in a million) are sorted. So no group is
sorted or gathered as a whole, however many values it has or how often one repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the number that are left out of the ranges.
STEPS = (48, 32)


def _power(n: Column) -> Column:
    """Two to the n, as a product of two: near the least number the library's power is off by a bit."""
    half = F.shiftright(n, 1)
    return F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), n - half)


def with_bits(rows: DataFrame, value: str) -> DataFrame:
    """Adds bits_, a bigint in the order of the values; NaN is above all, and the zeros are one.

    Each step is a column of its own, so that it is worked out once.
    """
    v = F.col(value)
    guess = F.greatest(F.floor(F.log2(F.abs(v))).cast("int"), F.lit(-1022))
    steps = rows.withColumn("guess_", F.when((v != 0) & ~F.isnan(v) & (F.abs(v) < float("inf")), guess)).withColumn("unit_", _power(F.col("guess_")))
    # the logarithm may be off by one beside a power of two; below the least normal number the mantissa has no leading one, and the same sum holds
    off = F.when(F.abs(v) < F.col("unit_"), -1).when(F.abs(v) >= F.col("unit_") * 2, 1).otherwise(0)
    steps = steps.withColumn("power_", F.when(F.col("guess_").isNotNull(), F.greatest(F.col("guess_") + off, F.lit(-1022)))).withColumn("unit_", _power(F.col("power_")))
    whole = (F.col("power_").cast("bigint") + 1023) * F.lit(1 << 52) + ((F.abs(v) / F.col("unit_") - 1) * float(1 << 52)).cast("bigint")
    steps = steps.withColumn("size_", F.when(F.isnan(v), F.lit((1 << 63) - 1)).when(v == 0, F.lit(0)).otherwise(F.coalesce(whole, F.lit(2047 << 52))))
    return steps.withColumn("bits_", F.when(v < 0, -F.col("size_")).otherwise(F.col("size_"))).drop("guess_", "unit_", "power_", "size_")


def counted(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Groups, v_ and how often the group has it (n_)."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v_")).agg(F.count(F.lit(1)).alias("n_"))


def quantiles_of(counts: DataFrame, shares: dict[str, float], *by: str) -> DataFrame:
    """Exact quantiles by name, between two values by their distance, by group; counts: groups, v_, n_, a row for each value."""
    # a group may be null, so groups are told by struct in joins; without groups all is one
    keyed = with_bits(counts.select(F.struct(*[F.col(c) for c in by] or [F.lit(1).alias("one")]).alias("by_"), "v_", "n_"), "v_")
    keyed = keyed.withColumns({"range0_": F.shiftright("bits_", STEPS[0]), "range1_": F.shiftright("bits_", STEPS[1])})
    ranges = keyed.groupBy("by_", "range0_").agg(F.sum("n_").alias("n_"))
    per = Window.partitionBy("by_")  # over counts of ranges, 65,536 at most
    placed = ranges.withColumns({"upto_": F.sum("n_").over(per.orderBy("range0_")), "all_": F.sum("n_").over(per)})
    at = {name: share * (F.col("all_") - 1) for name, share in shares.items()}
    ranks = F.array(*[F.struct(F.lit(i).alias("i_"), f(p).cast("bigint").alias("rank_"), (p - F.floor(p)).alias("part_")) for i, (p, f) in enumerate((p, f) for p in at.values() for f in (F.floor, F.ceil))])
    wanted = placed.select("by_", "range0_", (F.col("upto_") - F.col("n_")).alias("below_"), "upto_", F.inline(ranks)).where("rank_ >= below_ and rank_ < upto_").drop("upto_")
    one = Window.partitionBy("by_", "i_")  # over ranges or values within the range that holds one rank
    finer = keyed.join(wanted, ["by_", "range0_"]).groupBy("by_", "i_", "rank_", "part_", "below_", "range1_").agg(F.sum("n_").alias("n_"))
    finer = finer.withColumn("upto_", F.col("below_") + F.sum("n_").over(one.orderBy("range1_"))).where("rank_ >= upto_ - n_ and rank_ < upto_")
    finer = finer.select("by_", "i_", "rank_", "part_", (F.col("upto_") - F.col("n_")).alias("below_"), "range1_")
    values = keyed.join(finer, ["by_", "range1_"]).withColumn("upto_", F.col("below_") + F.sum("n_").over(one.orderBy("bits_"))).where("rank_ >= upto_ - n_ and rank_ < upto_")
    one_of = lambda c, i: F.max(F.when(F.col("i_") == i, F.col(c)))
    cut = [(one_of("v_", 2 * i) + one_of("part_", 2 * i) * (one_of("v_", 2 * i + 1) - one_of("v_", 2 * i))).alias(name) for i, name in enumerate(at)]
    return values.groupBy("by_").agg(*cut).select(*[F.col("by_")[c].alias(c) for c in by], *at)


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """Exact quantiles by name, between two values by their distance, by group. No values, no row."""
    return quantiles_of(counted(rows, value, *by), shares, *by)
