"""Two-sided p-value of Student's t, vectorised over rows (one row per station)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


SLICE = 256


def student_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Tail probability by Simpson's rule on the density, after x = tan-like substitution.

    With t = sqrt(df) * tan(a) the density becomes c * cos(a) ** (df - 1), smooth on a finite
    interval, so a fixed grid is accurate to far below reporting precision.
    """
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & (df > 0)
    if not ok.any():
        return out
    angle = np.arctan2(np.abs(t[ok]), np.sqrt(df[ok]))
    d = df[ok]
    scale = np.array([math.exp(math.lgamma((x + 1) / 2) - math.lgamma(x / 2)) / math.sqrt(math.pi) for x in d])
    steps = 2000
    grid = np.linspace(0.0, 1.0, steps + 1)
    weights = np.ones(steps + 1)
    weights[1:-1:2], weights[2:-1:2] = 4.0, 2.0
    # integrate the tail itself, over a width the density has not died out on
    width = np.minimum(math.pi / 2 - angle, 40.0 / np.sqrt(d))
    x = angle[:, None] + grid[None, :] * width[:, None]
    density = np.cos(x) ** (d[:, None] - 1)
    out[ok] = 2.0 * scale * (density @ weights) * width / steps / 3.0
    return np.minimum(out, 1.0)


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    a, b = t.to_numpy(dtype=float), df.to_numpy(dtype=float)
    # the grid is rows x 2001, so a slice at a time
    parts = [student_p(a[i:i + SLICE], b[i:i + SLICE]) for i in range(0, len(a), SLICE)]
    return pd.Series(np.concatenate(parts) if parts else np.zeros(0))
