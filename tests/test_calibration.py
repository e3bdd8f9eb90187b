"""Calibration, decisions and p-values against plain numpy."""

import numpy as np
import pandas as pd
import pytest

from scoreloom.operators import calibration as c


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for group in ("3-4", "5-6", "short", "flat"):
        for year in range(2000, 2003 if group == "short" else 2009):
            human = float(rng.normal())
            for series in ("anchor", "ensemble_equal", "without_AF"):
                llm = 1.0 if group == "flat" else human * 0.8 + float(rng.normal()) * 0.5
                rows.append((group, series, year, human, None if year == 2004 else llm, float(rng.random()), float(rng.random())))
    return spark.createDataFrame(rows, "group string, series string, year int, human double, llm double, multimodal_share double, share_5 double").repartition(3)


def brute(rows):
    rows = rows.dropna(subset=["human", "llm"]).sort_values("year")
    x, y, t = rows.llm.to_numpy(), rows.human.to_numpy(), rows.year.to_numpy(float)
    out = dict.fromkeys(("correlation", "alpha", "beta", "r2", "gamma", "alpha_early", "beta_late", "early_to_late", "late_to_early"))
    if x.std() == 0:
        return out
    fit = lambda a, b: np.linalg.lstsq(np.column_stack([np.ones(len(a)), a]), b, rcond=None)[0]
    out["alpha"], out["beta"] = fit(x, y)
    out["correlation"] = np.corrcoef(x, y)[0, 1]
    out["r2"] = out["correlation"] ** 2
    early = t < np.median(t)
    if len(x) > 3:
        out["gamma"] = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x, t - t.mean()]), y, rcond=None)[0][2]
    if early.sum() >= 3 and (~early).sum() >= 3:
        first, last = fit(x[early], y[early]), fit(x[~early], y[~early])
        out["alpha_early"], out["beta_late"] = first[0], last[1]
        r2 = lambda f, m: 1 - ((y[m] - f[0] - f[1] * x[m]) ** 2).sum() / ((y[m] - y[m].mean()) ** 2).sum()
        out["early_to_late"], out["late_to_early"] = r2(first, ~early), r2(last, early)
    return out


def test_calibration(pairs):
    frame = pairs.toPandas()
    got = {(r["group"], r.series): r for r in c.calibration(pairs).collect()}
    for key, rows in frame.groupby(["group", "series"]):
        want = brute(rows)
        for name, value in want.items():
            if key[0] == "short" and name == "gamma":
                continue  # three rows, three coefficients
            assert got[key][name] == (None if value is None else pytest.approx(value, abs=1e-8)), (key, name)


def test_decisions(spark):
    names = ("correlation", "same_side", "peak_recall", "alpha", "beta", "delta_alpha", "delta_beta", "early_to_late", "gamma_low", "gamma_high")
    good = (0.3, 0.5, 0.4, -0.3, 1.5, 0.5, -0.5, 0.0, -1.0, 0.0)
    nan = float("nan")
    rows = [("a", good), ("b", (0.2, 0.4, *good[2:])), ("c", (nan, nan, nan, None, *good[4:])), ("d", (nan,) * 10), ("e", (0.2, *good[1:]))]
    frame = spark.createDataFrame([(g, "ensemble_equal", *v) for g, v in rows], "group string, series string, " + ", ".join(f"{n} double" for n in names))
    trends = frame.select("group", "series", "gamma_low", "gamma_high")
    got = {r["group"]: (r.passed, r.verdict) for r in c.decisions(frame.drop("gamma_low", "gamma_high"), trends).collect()}
    assert got == {"a": (9, "usable"), "b": (7, "uncertain"), "c": (5, "uncertain"), "d": (0, "not_usable"), "e": (8, "usable")}
    loo = {r["group"]: (r.passed, r.verdict) for r in c.robustness(frame).collect()}
    assert loo == {"a": (4, "usable"), "b": (2, "uncertain"), "c": (1, "not_usable"), "d": (0, "not_usable"), "e": (3, "usable")}


def test_reading(spark):
    rows = [("all", "usable")] * 3 + [("most", v) for v in ("usable", "usable", "usable", "uncertain", "not_usable")] + [("some", v) for v in ("usable", "uncertain", "uncertain")] + [("none", "uncertain")] * 4
    got = {r.series: r.reading for r in c.interpretation(spark.createDataFrame(rows, "series string, verdict string")).collect()}
    assert got == {"all": "reliable", "most": "depends on the group", "some": "limited", "none": "not suitable"}


def test_intervals(pairs):
    """Seeds go by key, so repeated runs and other partitionings agree; intervals hold the value."""
    a, b = (sorted(map(tuple, c.trend_intervals(p, 300).collect())) for p in (pairs, pairs.repartition(1)))
    assert [r[:2] for r in a] == [r[:2] for r in b] and np.allclose([r[2:] for r in a], [r[2:] for r in b], equal_nan=True)
    fits = {(r["group"], r.series): r for r in c.calibration(pairs).collect()}
    for group, series, low, high, *ends in a:
        if group in ("3-4", "5-6"):
            assert low <= fits[group, series].gamma <= high
            assert ends[0] <= fits[group, series].alpha <= ends[1] and ends[2] <= fits[group, series].beta <= ends[3]
    for r in c.alignment_intervals(pairs.where("group in ('3-4', '5-6')"), 300).collect():
        assert r.low <= r.value <= r.high and r.kind in ("r", "slope")


def test_composition(pairs):
    frame, terms = pairs.toPandas(), ["multimodal_share", "share_5"]
    for r in c.composition_effects(pairs, terms, 200).collect():
        rows = frame[(frame["group"] == r["group"]) & (frame.series == r.series)].dropna()
        y = rows.human.to_numpy()
        fit = {}
        for name, columns in (("base", ["llm"]), ("comp", ["llm", *terms])):
            x = np.column_stack([np.ones(len(y)), rows[columns].to_numpy()])
            if len(y) < len(columns) + 1:
                assert pd.isna(r[f"beta_{name}"])
                continue
            coef = np.linalg.lstsq(x, y, rcond=None)[0]
            fit[name] = coef, 1 - ((y - x @ coef) ** 2).sum() / ((y - y.mean()) ** 2).sum()
            assert r[f"beta_{name}"] == pytest.approx(coef[1], abs=1e-8) and r[f"r2_{name}"] == pytest.approx(fit[name][1], abs=1e-8)
        if len(fit) == 2:
            assert r.delta_beta == pytest.approx(fit["comp"][0][1] - fit["base"][0][1], abs=1e-8) and r.delta_r2 == pytest.approx(fit["comp"][1] - fit["base"][1], abs=1e-8)


def test_p_values(spark):
    """Against tables of Student's t."""
    t, df = np.array([12.706205, 4.302653, 2.228139, 1.959964, 0.0, 3.169273, 0.7]), np.array([1, 2, 10, 1e7, 5, 10, 30.0])
    assert np.allclose(c.two_sided(t, df)[:6], [0.05, 0.05, 0.05, 0.05, 1.0, 0.01], atol=2e-6)
    # with one degree of freedom the tail is an arc tangent, with two it is algebraic
    x = np.linspace(0.01, 50, 200)
    assert np.allclose(c.two_sided(x, np.ones(200)), 1 - 2 * np.arctan(x) / np.pi, atol=1e-10)
    assert np.allclose(c.two_sided(x, np.full(200, 2.0)), 1 - x / np.sqrt(2 + x * x), atol=1e-10)
    rows = spark.createDataFrame([("a", 10, 0.5), ("b", 5, 1.0), ("c", 2, 0.3), ("d", 9, None)], "k string, n long, r double")
    got = {r.k: r.p for r in c.with_p(rows).collect()}
    assert got["a"] == pytest.approx(0.1411, abs=1e-4) and got["b"] == 0.0 and got["c"] is None and got["d"] is None
