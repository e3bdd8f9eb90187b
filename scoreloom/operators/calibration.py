"""How far a model's difficulty stands for the human one (N05, N11 to N16, N22), and p-values.

Difficulty is minus the z-score of an exam's share of points within its group.
Fits of one variable, and of one beside the year, are moments, so they are plain
aggregates; bootstraps and fits of more variables are sums as well (resampling).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import resampling, stats
from .dashboard import leave_one_out

#: Limits of the decision rules.
MIN_CORRELATION, MIN_SAME_SIDE, MIN_RECALL, MAX_ALPHA, BETA, MAX_DELTA_ALPHA, MAX_DELTA_BETA, MIN_OUT_OF_SAMPLE = 0.3, 0.5, 0.4, 0.3, (0.5, 1.5), 0.5, 0.5, 0.0
#: Rows that an era needs, and spread under which a variable counts as constant.
ERA_ROWS, NO_SPREAD = 3, 1e-12
KEY = ["group", "series"]


def series_of(exams: DataFrame, human: Column, anchor: str) -> DataFrame:
    """Year, group, series, human, value: shares of points of the human runs, of the anchor run, of all model runs alike, and of all but one.

    exams: run_id, year, group, pct. human: which rows are human.
    """
    model = exams.where(~human)
    people = exams.where(human).groupBy("year", "group").agg(F.avg("pct").alias("human"))
    whole = model.groupBy("year", "group").agg(F.avg("pct").alias("ensemble_equal"), F.max(F.when(F.col("run_id") == anchor, F.col("pct"))).alias("anchor"))
    two = whole.select("year", "group", F.explode(F.array(*[F.struct(F.lit(s).alias("series"), F.col(s).alias("value")) for s in ("anchor", "ensemble_equal")])).alias("x")).select("year", "group", "x.*")
    less = leave_one_out(model, ["year", "group"], "pct").select("year", "group", F.concat(F.lit("without_"), "run_id").alias("series"), F.col("others").alias("value"))
    return two.unionByName(less).join(people, ["year", "group"])


def difficulties(series: DataFrame) -> DataFrame:
    """Human and value turned into difficulties within group (and series)."""
    per = Window.partitionBy(*KEY)

    def minus_z(c: str) -> Column:
        spread = F.stddev_pop(c).over(per)
        return F.when(spread > NO_SPREAD, -(F.col(c) - F.avg(c).over(per)) / spread).otherwise(F.when(F.col(c).isNotNull(), 0.0))

    return series.withColumns({"human": minus_z("human"), "value": minus_z("value")}).withColumnRenamed("value", "llm")


def composition_residuals(exams: DataFrame, terms: list[str], key: list[str]) -> DataFrame:
    """What a linear fit on an exam's make-up leaves of its value, within group; as difficulty. exams: group, value, key, terms."""
    rest = resampling.residuals(exams, "value", terms, "group", key)
    per = Window.partitionBy("group")
    spread = F.stddev_pop("residual").over(per)
    return rest.withColumn("difficulty", F.when(spread > NO_SPREAD, -(F.col("residual") - F.avg("residual").over(per)) / spread).otherwise(0.0))


def _eras(pairs: DataFrame) -> DataFrame:
    """pairs with early: years before the median year of the group and series."""
    middle = pairs.groupBy(*KEY).agg(F.median("year").alias("middle"))
    return pairs.join(middle, KEY).withColumn("early", F.col("year") < F.col("middle"))


def _quotient(a: Column, b: Column, least: float = NO_SPREAD) -> Column:
    return F.when(F.abs(b) > least, a / b)


def calibration(pairs: DataFrame) -> DataFrame:
    """By group and series, human on llm: correlation, agreement, fit, trend beside the year, both eras, and each era's fit tried on the other.

    A fit is null where its variable has no spread or rows are too few.
    """
    rows = _eras(pairs.where(F.col("human").isNotNull() & F.col("llm").isNotNull()))
    x, y, t = F.col("llm"), F.col("human"), F.col("year").cast("double")
    n = lambda c: F.count(F.when(c, 1))
    same, px, py = (y > 0) == (x > 0), F.abs(y) >= 1, F.abs(x) >= 1
    sums = [F.count(F.lit(1)).alias("n"), F.avg(same.cast("int")).alias("same_side"), n(px & py & same).alias("met"), n(px).alias("peaks"), n(py).alias("seen")]
    for name, when in (("", F.lit(True)), ("_early", F.col("early")), ("_late", ~F.col("early"))):
        of = lambda c: F.when(when, c)  # noqa: B023, E731
        sums += [n(when).alias(f"n{name}"), F.avg(of(x)).alias(f"x{name}"), F.avg(of(y)).alias(f"y{name}"), F.var_pop(of(x)).alias(f"xx{name}"), F.var_pop(of(y)).alias(f"yy{name}"), F.covar_pop(of(x), of(y)).alias(f"xy{name}")]
    sums = [*sums[1:], F.covar_pop(x, t).alias("xt"), F.covar_pop(y, t).alias("yt"), F.var_pop(t).alias("tt")]
    m = rows.groupBy(*KEY).agg(*sums)
    c = F.col
    both = (c("n_early") >= ERA_ROWS) & (c("n_late") >= ERA_ROWS)
    m = m.withColumn("beta", F.when(c("n") >= 2, _quotient(c("xy"), c("xx"))))
    for e in ("_early", "_late"):
        m = m.withColumn(f"beta{e}", F.when(both, _quotient(c(f"xy{e}"), c(f"xx{e}")))).withColumn(f"alpha{e}", c(f"y{e}") - c(f"beta{e}") * c(f"x{e}"))

    def tried(fit: str, test: str) -> Column:
        a, b = c(f"alpha{fit}"), c(f"beta{fit}")
        off = c(f"y{test}") - a - b * c(f"x{test}")
        left = c(f"yy{test}") - 2 * b * c(f"xy{test}") + b * b * c(f"xx{test}") + off * off
        return F.when(b.isNotNull(), F.when(c(f"yy{test}") > NO_SPREAD, 1 - left / c(f"yy{test}")).otherwise(0.0))

    r = _quotient(c("xy"), F.sqrt(c("xx") * c("yy")))
    return m.select(
        *KEY, "n", F.when(c("n") >= 3, r).alias("correlation"), "same_side", F.when(c("peaks") > 0, c("met") / c("peaks")).alias("peak_recall"), F.when((c("peaks") > 0) & (c("seen") > 0), c("met") / c("seen")).alias("peak_precision"),
        (c("y") - c("beta") * c("x")).alias("alpha"), "beta", F.when(c("beta").isNotNull(), F.when(c("yy") > NO_SPREAD, r * r).otherwise(0.0)).alias("r2"),
        F.when(c("n") >= 3, _quotient(c("yt") * c("xx") - c("xt") * c("xy"), c("xx") * c("tt") - c("xt") * c("xt"))).alias("gamma"),
        "alpha_early", "beta_early", "alpha_late", "beta_late", (c("alpha_late") - c("alpha_early")).alias("delta_alpha"), (c("beta_late") - c("beta_early")).alias("delta_beta"),
        tried("_early", "_late").alias("early_to_late"), tried("_late", "_early").alias("late_to_early"),
    )


def _holds(c: Column) -> Column:
    """1 where the check holds; null and NaN fail."""
    return F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)


def _limits() -> dict[str, Column]:
    c = stats.real
    return {
        "corr_ok": c(F.col("correlation")) >= MIN_CORRELATION, "same_side_ok": c(F.col("same_side")) >= MIN_SAME_SIDE, "peak_recall_ok": c(F.col("peak_recall")) >= MIN_RECALL,
        "beta_ok": c(F.col("beta")).between(*BETA), "alpha_ok": F.abs(c(F.col("alpha"))) <= MAX_ALPHA, "delta_alpha_ok": F.abs(c(F.col("delta_alpha"))) <= MAX_DELTA_ALPHA,
        "delta_beta_ok": F.abs(c(F.col("delta_beta"))) <= MAX_DELTA_BETA, "oos_r2_ok": c(F.col("early_to_late")) >= MIN_OUT_OF_SAMPLE,
    }


def _verdict(passed: Column, of: int, usable: float) -> Column:
    return F.when(passed >= of * usable, "usable").when(passed >= of * 0.5, "uncertain").otherwise("not_usable")


def trend_intervals(pairs: DataFrame, times: int = resampling.TIMES) -> DataFrame:
    """The 95 % percentile intervals of the year's coefficient beside llm (gamma), and of intercept and slope of human on llm alone, by group and series."""
    years = pairs.groupBy(*KEY).agg(F.avg("year").alias("middle"))
    rows = pairs.join(years, KEY).withColumn("since", F.col("year") - F.col("middle"))
    order = ["year", "llm", "human"]
    trend = resampling.of_terms(rows, "human", ["llm", "since"], KEY, times, order).select(*KEY, F.col("c2.low").alias("gamma_low"), F.col("c2.high").alias("gamma_high"))
    fit = resampling.of_terms(rows, "human", ["llm"], KEY, times, order)
    ends = [F.col(f"c{i}")[e].alias(f"{n}_{e}") for i, n in enumerate(("alpha", "beta")) for e in ("low", "high")]
    return years.select(*KEY).join(trend, KEY, "left").join(fit.select(*KEY, *ends), KEY, "left")


def decisions(fits: DataFrame, trends: DataFrame) -> DataFrame:
    """Nine checks; 80 % of them held is usable, half uncertain. fits: calibration(); trends: trend_intervals()."""
    checks = _limits() | {"gamma_ok": (stats.real(F.col("gamma_low")) <= 0) & (stats.real(F.col("gamma_high")) >= 0)}
    both = fits.join(trends, KEY).withColumns({name: _holds(c) for name, c in checks.items()})
    passed = sum((F.col(name) for name in checks), F.lit(0))
    return both.select(*KEY, *checks, passed.alias("passed"), _verdict(passed, len(checks), 0.8).alias("verdict"))


def robustness(fits: DataFrame) -> DataFrame:
    """Four checks of the fits that leave one model out; 75 % of them held is usable, half uncertain."""
    checks = {k: v for k, v in _limits().items() if k in ("corr_ok", "same_side_ok", "peak_recall_ok", "beta_ok")}
    passed = sum((_holds(c) for c in checks.values()), F.lit(0))
    return fits.select(*KEY, passed.alias("passed"), _verdict(passed, len(checks), 0.75).alias("verdict"))


def interpretation(verdicts: DataFrame) -> DataFrame:
    """Verdicts counted by series, and what they come to: all usable, 60 % and more, 30 % and more, fewer."""
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    out = verdicts.groupBy("series").agg(F.count(F.lit(1)).alias("groups"), n("usable").alias("usable"), n("uncertain").alias("uncertain"), n("not_usable").alias("not_usable"))
    share = [(1.0, "reliable"), (0.6, "depends on the group"), (0.3, "limited")]
    said = F.when(F.col("usable") >= F.col("groups"), share[0][1])
    for least, text in share[1:]:
        said = said.when(F.col("usable") >= F.col("groups") * least, text)
    return out.withColumn("reading", said.otherwise("not suitable"))


def alignment(pairs: DataFrame) -> DataFrame:
    """By group and series the correlation with the human difficulty, the slope over years of either, and the largest difference from the whole ensemble."""
    whole = pairs.where("series = 'ensemble_equal'").select("group", "year", F.col("llm").alias("whole"))
    both = pairs.join(whole, ["group", "year"], "left")
    good = F.col("human").isNotNull() & F.col("llm").isNotNull()
    fit = lambda y: F.when(F.var_pop("year") > NO_SPREAD, F.regr_slope(y, "year"))
    r = _quotient(F.covar_pop("human", "llm"), F.stddev_pop(F.when(good, F.col("human"))) * F.stddev_pop(F.when(good, F.col("llm"))))
    return both.groupBy(*KEY).agg(F.when(F.count(F.when(good, 1)) >= 3, r).alias("corr"), fit("llm").alias("slope"), fit("human").alias("human_slope"), F.max(F.abs(F.col("llm") - F.col("whole"))).alias("max_abs_delta"))


def alignment_intervals(pairs: DataFrame, times: int = 2000) -> DataFrame:
    """Bootstrap intervals of the correlations (r) and of the slopes over years (slope)."""
    keyed = pairs.withColumn("key", F.concat_ws("|", *KEY))
    r = stats.bootstrap(keyed, "r", "human", "llm", "key", times).withColumn("kind", F.lit("r"))
    slope = stats.bootstrap(keyed, "slope", "year", "llm", "key", times).withColumn("kind", F.lit("slope"))
    return r.unionByName(slope).select(F.split_part("key", F.lit("|"), F.lit(1)).alias("group"), F.split_part("key", F.lit("|"), F.lit(2)).alias("series"), "kind", "value", "low", "high", "n")


def composition_effects(pairs: DataFrame, terms: list[str], times: int = resampling.TIMES) -> DataFrame:
    """Human on llm alone and beside the terms of an exam's make-up: coefficients, intervals of beta, and what the terms change."""
    order = ["year", "llm", "human"]
    out = pairs.select(*KEY).distinct()
    for name, columns in (("base", ["llm"]), ("comp", ["llm", *terms])):
        fit = resampling.of_terms(pairs, "human", columns, KEY, times, order)
        more = [F.col(f"c{i + 2}.value").alias(f"coef_{t}") for i, t in enumerate(terms)] if name == "comp" else []
        beta = [F.col("c1")[v].alias(f"beta_{name}{e}") for v, e in (("value", ""), ("low", "_low"), ("high", "_high"))]
        out = out.join(fit.select(*KEY, *beta, F.col("r2").alias(f"r2_{name}"), *more), KEY, "left")
    return out.withColumns({"delta_beta": F.col("beta_comp") - F.col("beta_base"), "delta_r2": F.col("r2_comp") - F.col("r2_base")})


def two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-values of Student's t: the regularised incomplete beta function at df / (df + t * t), by its continued fraction."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    x, a, b = df / (df + t * t), df / 2, 0.5
    # the fraction converges fast below the mean; beyond it the other tail is worked out
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    d = 1 - (p + q) * z / (p + 1)
    tiny = 1e-300
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    c, h = np.ones_like(d), d.copy()
    for m in range(1, 200):
        for term in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
    log_beta = np.vectorize(lambda u, v: math.lgamma(u) + math.lgamma(v) - math.lgamma(u + v), otypes=[float])(p, q)
    with np.errstate(divide="ignore"):
        part = np.exp(p * np.log(z) + q * np.log1p(-z) - log_beta) * h / p
    return np.clip(np.where(flip, 1 - part, part), 0.0, 1.0)


def with_p(lines: DataFrame) -> DataFrame:
    """lines() with the two-sided p-value of r; 0 where r is 1 or -1, null under three rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            r, df = rows["r"].to_numpy(float), rows["n"].to_numpy(float) - 2
            good = ~np.isnan(r) & (df > 0)
            p = np.full(len(rows), np.nan)
            with np.errstate(divide="ignore", invalid="ignore"):
                t = r * np.sqrt(df / np.maximum(1 - r * r, 0))
            sure = good & np.isinf(t)
            p[sure] = 0.0
            good &= ~sure
            p[good] = two_sided(t[good], df[good])
            yield rows.assign(p=p)

    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields), "p double"])
    return lines.mapInPandas(run, shape).withColumn("p", stats.real(F.col("p")))
