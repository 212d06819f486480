"""Sinuosity along lines and weights of all observations, against brute force."""

import math
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.operators import interp, network


def brute(xy, sampling, picked=None):
    """{station: (x, y, value)} of a line, for the stations of the given places in order."""
    xy = np.array(xy, float)
    a, b = xy[:-1], xy[1:]
    far = np.hypot(*(b - a).T)
    a, b, far = a[far > 0], b[far > 0], far[far > 0]
    start = np.concatenate([[0], np.cumsum(far)])
    marks = sorted({k * sampling for k in range(int(start[-1] // sampling) + 1)} | {start[-1]})
    out = {}
    for m in marks if picked is None else [marks[i] for i in picked]:
        i = max(0, int(np.searchsorted(start, m)) - 1)
        p = a[i] + (b[i] - a[i]) * (m - start[i]) / far[i]
        u = (b - a) / far[:, None]
        s, d = ((p - a) * u).sum(axis=1), (p - a)[:, 0] * u[:, 1] - (p - a)[:, 1] * u[:, 0]
        h = np.sqrt(np.maximum((sampling / 2) ** 2 - d * d, 0))
        out[m] = (*p, np.maximum(np.minimum(s + h, far) - np.maximum(s - h, 0), 0).sum() / sampling)
    return out


@pytest.mark.parametrize("points, legs", [(32_768, 131_072), (5, 7)])
def test_sinuosity(spark, monkeypatch, points, legs):
    monkeypatch.setattr(network, "POINTS", points)
    monkeypatch.setattr(network, "LEGS", legs)
    rng = np.random.default_rng(3)
    lines = {
        1: rng.uniform(-40, 40, (60, 2)), 2: [(0, 0), (30, 0), (30, 0), (30, -40), (0, -40), (0, 0)], 3: [(0, 0), (10, 0)] * 6,
        4: rng.integers(-3, 4, (40, 2)) * 10.0, 5: [(5e5, 4e6), (5e5 + 300, 4e6 + 400)], 6: [(1, 1)], 7: [(2, 2), (2, 2)],
    }
    rows = [(f, i, float(x), float(y)) for f, xy in lines.items() for i, (x, y) in enumerate(xy)] + [(None, 0, 0.0, 0.0), (None, 1, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "fid int, seq int, x double, y double").repartition(3)
    got = {}
    for r in network.sinuosity(df, 10.0).collect():
        got.setdefault(r["fid"], []).append((r["station"], r["x"], r["y"], r["value"]))
    assert sorted(got) == [1, 2, 3, 4, 5]
    for f, found in got.items():
        want = [(m, *v) for m, v in brute(lines[f], 10.0).items()]
        assert len(found) == len(want) and np.allclose(sorted(found), want, rtol=1e-9, atol=1e-5), f
    assert network.sinuosity(df.limit(0), 10.0).count() == 0


def test_sinuosity_of_a_long_line(spark):
    """A tangle of 40,000 legs: the work is the circles' legs, and no row is made for a point and a leg."""
    k = F.col("id")
    df = spark.range(40_001).select(F.lit(1).alias("fid"), k.alias("seq"), (k * 7919 % 101 * 3).cast("double").alias("x"), (k * 104729 % 103 * 3).cast("double").alias("y"))
    begun = time.monotonic()
    got = {r["station"]: r["value"] for r in network.sinuosity(df, 100.0).collect()}
    assert time.monotonic() - begun < 40
    i = np.arange(40_001)
    want = brute(np.stack([i * 7919 % 101 * 3, i * 104729 % 103 * 3], axis=1), 100.0, range(0, 50_000, 5_000))
    assert len(want) == 10 and all(min((abs(s - m), v) for s, v in got.items())[1] == pytest.approx(v[2], rel=1e-7) for m, v in want.items())
    assert math.isclose(max(got), sum(math.hypot((b * 7919 % 101 - a * 7919 % 101) * 3, (b * 104729 % 103 - a * 104729 % 103) * 3) for a, b in zip(i[:-1].tolist(), i[1:].tolist(), strict=True)), rel_tol=1e-9)


def test_full_idw_meets_each_place_once(spark):
    """Repeated places cost nothing, and NULLs count as in SQL's sum(z / d2) / sum(1 / d2)."""
    rng = np.random.default_rng(5)
    xy, z = rng.uniform(0, 9, (30, 2)), rng.uniform(-5, 5, 30)
    rows = [(i, float(x), float(y), float(v)) for i, ((x, y), v) in enumerate(zip(xy, z, strict=True))]
    rows += [(30, *rows[3][1:3], 7.0), (31, *rows[4][1:3], None), (32, None, 1.0, 4.0), (33, 2.5, 2.5, -1.0), (34, 2.5, 2.5, 8.0)]
    obs = spark.createDataFrame(rows, "oid int, ox double, oy double, z double").repartition(3)
    spots = [(1.0, 2.0), (2.5, 2.5), (20.0, 3.0)]
    k = F.col("id")
    pred = spark.range(60_000).select(k.alias("pid"), *[F.element_at(F.array(*[F.lit(s[i]) for s in spots]), (k % 3 + 1).cast("int")).alias(c) for i, c in enumerate(("px", "py"))])
    pred = pred.unionByName(spark.createDataFrame([(60_000, None, 1.0)], "pid long, px double, py double"))
    want = []
    for x, y in spots:
        near = [(v, 1 / ((x - a) ** 2 + (y - b) ** 2)) for _, a, b, v in rows if a is not None and (a, b) != (x, y)]
        want.append(sum(v * w for v, w in near if v is not None) / sum(w for _, w in near))
    want[1] = -1.0  # of the smaller oid at the very point
    out = interp.full_idw(pred, obs)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert {int(n) for n in re.findall(r"pmod\(xxhash64\(px[^)]*\), (?:cast\()?(\d+)", plan)} == {1}  # one block for three places, not eight for 60,000 points
    got = {r["pid"]: r["value"] for r in out.collect()}
    assert len(got) == 60_001 and got.pop(60_000) is None
    assert all(math.isclose(v, want[i % 3], rel_tol=1e-9) for i, v in got.items())
    assert interp.full_idw(pred.limit(3), obs.limit(0)).where("value is not null").isEmpty()
