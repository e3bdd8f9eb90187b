"""Quantiles by selection against numpy, and the order of the bits of doubles."""

import math
import random
import struct

import numpy as np
import pytest

from scoreloom.operators import quantiles as q

SHARES = {"least": 0.0, "p10": 0.1, "p25": 0.25, "median": 0.5, "p99": 0.99, "most": 1.0}


def test_bits_keep_the_order(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 1.7976931348623157e308, float("inf"), float("-inf"), 4.4501477170144023e-308]
    for k in range(-1074, 1024, 3):
        values += [2.0**k, math.nextafter(2.0**k, 0), -math.nextafter(2.0**k, math.inf)]
    values += [v for v in (struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(3000)) if v == v]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for row in q.with_bits(frame, "v").collect():
        size = struct.unpack("q", struct.pack("d", abs(row.v)))[0]
        assert row.bits_ == (size if row.v > 0 else -size)


def rows():
    rng = random.Random(2)
    out = []
    for group, n in (("a", 3000), ("b", 200), (None, 60), ("c", 3), ("one", 1), ("same", 50)):
        for i in range(n):
            tight = 1 + i * 2.0**-50  # the same first bits
            out.append((group, 7.5 if group == "same" else rng.choice([rng.gauss(0, 1), rng.randrange(5) * 0.25, rng.gauss(0, 1) * 10.0 ** rng.randrange(-30, 30), tight, None])))
    return out + [("none", None)]


def test_quantiles(spark):
    given = rows()
    frame = spark.createDataFrame(given, "g string, v double").repartition(5)
    got = {r.g: r for r in q.quantiles(frame, "v", SHARES, "g").collect()}
    for group in {g for g, _ in given}:
        values = [v for g, v in given if g == group and v is not None]
        assert (group in got) == bool(values)
        for name, share in SHARES.items() if values else ():
            assert got[group][name] == pytest.approx(np.quantile(values, share), rel=1e-12, abs=0), (group, name)
    one = q.quantiles(frame, "v", SHARES).collect()
    assert len(one) == 1 and one[0]["p10"] == pytest.approx(np.quantile([v for _, v in given if v is not None], 0.1), rel=1e-12)
    assert q.quantiles(frame.limit(0), "v", SHARES, "g").collect() == [] and q.quantiles(frame.limit(0), "v", SHARES).collect() == []


def test_no_window_over_the_values_of_a_group(spark):
    """Windows go over counts of ranges (and their total), or over what lies in the one range that holds a rank."""
    frame = spark.createDataFrame(rows(), "g string, v double")
    plan = q.quantiles(frame, "v", SHARES, "g")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert windows and all("range0_#" in w or "i_#" in w or "AS all_#" in w for w in windows)
