"""Bootstraps and regressions from sums against numpy over whole groups."""

from zlib import crc32

import numpy as np
import pandas as pd
import pytest

from scoreloom.operators import resampling as r


def design(x):
    return np.column_stack([np.ones(len(x)), x])


@pytest.mark.parametrize("kind", ["plain", "same", "flat", "sum", "few"])
def test_solved_is_least_squares(kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3 if kind == "few" else 40, 3)) * [1, 50, 0.01] + [2000, -7, 0.5]
    if kind == "same":
        x[:, 2] = x[:, 1]
    if kind == "flat":
        x[:, 1] = 4.0
    if kind == "sum":
        x[:, 2] = x[:, 0] - 2 * x[:, 1]
    y = 3 + x @ [0.5, -0.2, 4] + rng.normal(size=len(x))
    want = np.linalg.lstsq(design(x), y, rcond=None)[0]
    whole = np.column_stack([y, x])
    centre = whole.mean(axis=0)
    v = design(whole - centre)
    coef, r2 = r.solved((v.T @ v)[None], centre[None])
    assert np.allclose(design(x) @ coef[0], design(x) @ want, atol=1e-6)
    assert np.allclose(coef[0], want, rtol=1e-4, atol=1e-6)
    rest = ((y - design(x) @ want) ** 2).sum()
    assert r2[0] == pytest.approx(1 - rest / ((y - y.mean()) ** 2).sum(), abs=1e-8)


def groups():
    rng = np.random.default_rng(5)
    parts = []
    for g, n in (("small", 9), ("two", 2), ("flat", 12), ("large", 3000), (None, 30), ("copies", 4000)):
        x = rng.normal(size=n)
        y = 0.6 * x + rng.normal(size=n)
        if g == "flat":
            x[:] = 2.0
        if g == "copies":
            x, y = np.round(x), np.round(y * 0.5)  # few distinct rows, each many times
        parts.append(pd.DataFrame({"g": [g] * n, "x": x, "y": y}))
    parts.append(pd.DataFrame({"g": ["small", "nulls"], "x": [None, 1.0], "y": [1.0, None]}))
    return pd.concat(parts)


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(None if pd.isna(v.g) else v.g, None if pd.isna(v.x) else float(v.x), None if pd.isna(v.y) else float(v.y)) for v in groups().itertuples()]
    return spark.createDataFrame(rows, "g string, x double, y double").repartition(6)


def drawn(x, y, key, statistic, times=2000):
    rows = np.random.default_rng([2025, crc32(key.encode())]).integers(0, len(x), (times, len(x)))
    got = np.array([statistic(x[i], y[i]) for i in rows if x[i].std() > 0 and y[i].std() > 0])
    return np.percentile(got, [2.5, 97.5])


def test_intervals(frame):
    """Small groups are drawn from as a plain bootstrap does; large ones in chunks agree with it."""
    given = groups()
    for kind, statistic in (("r", lambda a, b: np.corrcoef(a, b)[0, 1]), ("slope", lambda a, b: np.polyfit(a, b, 1)[0])):
        got = {v.g: v for v in r.of_two(frame, kind, "x", "y", ["g"]).collect()}
        assert set(got) == {"small", "two", "flat", "large", None, "copies", "nulls"}
        for g in ("small", None, "large", "copies"):
            rows = given[given.g.isna() if g is None else given.g == g].dropna(subset=["x", "y"]).sort_values(["x", "y"])
            x, y = rows.x.to_numpy(), rows.y.to_numpy()
            low, high = drawn(x, y, g or "", statistic)
            assert got[g].value == pytest.approx(statistic(x, y), abs=1e-9) and got[g].n == len(rows) + (g == "small")
            close = 1e-9 if g in ("small", None) else 0.012
            assert got[g].low == pytest.approx(low, abs=close) and got[g].high == pytest.approx(high, abs=close), (kind, g)
        assert np.isnan([got[g].value for g in ("flat", "nulls")]).all() and np.isnan(got["flat"].low)


def test_same_draws_however_dealt(frame):
    a, b = (sorted((str(v.g), v.low, v.high) for v in r.of_two(f, "r", "x", "y", ["g"], 300).collect()) for f in (frame, frame.repartition(1)))
    assert [v[0] for v in a] == [v[0] for v in b] and np.allclose([v[1:] for v in a], [v[1:] for v in b], equal_nan=True, atol=1e-9)


def test_coefficients(frame):
    given = groups()
    got = {v.g: v for v in r.of_terms(frame, "y", ["x"], ["g"], 500).collect()}
    rows = given[given.g == "large"]
    want = np.linalg.lstsq(design(rows.x.to_numpy()[:, None]), rows.y.to_numpy(), rcond=None)[0]
    assert got["large"].c0.value == pytest.approx(want[0]) and got["large"].c1.value == pytest.approx(want[1])
    # the standard error of a slope, twice
    half = (got["large"].c1.high - got["large"].c1.low) / 2
    assert half == pytest.approx(1.96 / np.sqrt(3000), rel=0.15) and got["large"].c1.low < want[1] < got["large"].c1.high
    flat = got["flat"].c1.value  # of least norm, beside a constant of two
    rows = given[given.g == "flat"]
    assert flat == pytest.approx(np.linalg.lstsq(design(rows.x.to_numpy()[:, None]), rows.y.to_numpy(), rcond=None)[0][1])


def test_residuals(spark):
    rng = np.random.default_rng(9)
    rows = [(g, i, float(rng.normal()), float(i % 5), float(i % 5) * 2 + 1 if g == "same" else float(rng.normal())) for g, n in (("a", 50), ("same", 20), ("few", 2), (None, 8)) for i in range(n)]
    rows += [("a", 99, None, 1.0, 1.0), ("a", 98, 1.0, None, 1.0)]
    frame = spark.createDataFrame(rows, "g string, i int, y double, u double, v double").repartition(4)
    got = {(x.g, x.i): x.residual for x in r.residuals(frame, "y", ["u", "v"], "g", ["i"]).collect()}
    assert len(got) == len(rows) - 2
    for g in ("a", "same", "few", None):
        part = [x for x in rows if x[0] == g and None not in x[2:]]
        y, x = np.array([p[2] for p in part]), np.array([p[3:] for p in part])
        want = y - y.mean() if len(y) <= 2 else y - design(x) @ np.linalg.lstsq(design(x), y, rcond=None)[0]
        assert np.allclose([got[g, p[1]] for p in part], want, atol=1e-9)
