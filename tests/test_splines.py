"""Quadratic splines by blocks against a dense solve of all conditions."""

import random

import numpy as np
import pytest

from almanac.operators import splines


def dense(x, y):
    """Slopes and curvatures of the pieces at inner points, from value and slope conditions midway and the two outer points."""
    n = len(x) - 2
    a, b = np.zeros((2 * n, 2 * n)), np.zeros(2 * n)  # unknowns: slopes, then curvatures
    row = 0
    for i in range(n - 1):
        h = x[i + 2] - x[i + 1]
        a[row, [i, i + 1, n + i, n + i + 1]] = h / 2, h / 2, h * h / 4, -h * h / 4
        b[row] = y[i + 2] - y[i + 1]
        a[row + 1, [i, i + 1, n + i, n + i + 1]] = 1, -1, h, h
        row += 2
    h = x[1] - x[0]
    a[row, [0, n]] = -h, h * h
    b[row] = y[0] - y[1]
    h = x[-1] - x[-2]
    a[row + 1, [n - 1, 2 * n - 1]] = h, h * h
    b[row + 1] = y[-1] - y[-2]
    u = np.linalg.solve(a, b)
    return u[:n], u[n:]


def plain(v):
    x = [i for i, a in enumerate(v) if a is not None]
    y = [v[i] for i in x]
    out = list(v)
    if not x:
        return out
    if len(x) >= 3:
        slope, c = dense(x, y)
    for i in range(len(v)):
        if v[i] is None:
            if i < x[0] or i > x[-1]:
                out[i] = y[0] if i < x[0] else y[-1]
                continue
            k = max(j for j, at in enumerate(x) if at < i)
            if len(x) == 2:
                out[i] = y[0] + (y[1] - y[0]) * (i - x[0]) / (x[1] - x[0])
                continue
            p = k if 2 * i < x[k] + x[k + 1] else k + 1
            p = min(max(p, 1), len(x) - 2)
            d = i - x[p]
            out[i] = y[p] + slope[p - 1] * d + c[p - 1] * d * d
    return out


@pytest.fixture(scope="module")
def series():
    rnd = random.Random(7)
    gappy = [None if rnd.random() < 0.4 or 200 < i < 230 else rnd.gauss(0, 5) + i / 9 for i in range(420)]
    return {1: gappy, 2: [None, 1.0, None, 4.0, None, 9.0, None], 3: [2.0, None, None, 5.0], 4: [None, 3.0, None], 5: [None] * 4,
            6: [float(i * i) if i % 4 else None for i in range(40)], 7: [1.0, 2.0, 4.0], 8: [1.0, None, 5.0, None, 2.0, 3.0]}


@pytest.mark.parametrize("size", [4096, 20, 3, 2])
def test_fill_is_the_spline(make, series, size):
    """Also parabolas, which come back exactly, and series of no, one, two and three points."""
    got = {}
    for r in splines.impute_spline(make({(k, "s"): v for k, v in series.items()}), size=size).orderBy("pos").collect():
        got.setdefault(r.station_code, []).append(r.value)
    for k, v in series.items():
        want = plain(v)
        assert len(got[k]) == len(v)
        assert all((a is None) == (b is None) for a, b in zip(got[k], want))
        assert np.allclose([a for a in got[k] if a is not None], [a for a in want if a is not None], atol=1e-8), (k, size)
    assert np.allclose(got[6][1:39], [i * i for i in range(1, 39)])


def test_slopes_are_continuous(make, series):
    """Neighbouring pieces agree midway in value and slope."""
    import pyspark.sql.functions as F
    from almanac.plans import blocks
    df = make({(1, "s"): series[1]})
    known = blocks.number_rows(df.where("value is not null").select("station_code", "station", "date", "value", F.col("pos").alias("own")), splines.KEYS)
    points = known.select("station_code", "station", "value", F.col("pos").alias("idx"), "n", F.col("own").alias("pos"))
    rows = splines.quadratic_pieces(points, size=16).orderBy("at").collect()
    assert len(rows) == sum(v is not None for v in series[1]) - 2
    for a, b in zip(rows, rows[1:]):
        h = (b["at"] - a["at"]) / 2
        assert a.y + a.slope * h + a.c * h * h == pytest.approx(b.y - b.slope * h + b.c * h * h, abs=1e-7)
        assert a.slope + 2 * a.c * h == pytest.approx(b.slope - 2 * b.c * h, abs=1e-7)
