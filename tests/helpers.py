"""Independent reference computations (numpy / pandas) and fixture builders."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd

from panelcast.plans.panel import Panel, with_step

MONDAY = dt.date(2000, 1, 3)


def weekly_frame(spark, data: dict[str, list], shuffle_seed: int = 7, seg_steps: int = 1 << 16, start=MONDAY):
    """Panel from {series: [values...]} (None = gap), one row per week, rows shuffled."""
    rows = []
    for k, vals in data.items():
        for i, v in enumerate(vals):
            rows.append((k, start + dt.timedelta(days=7 * i), None if v is None else float(v)))
    rng = np.random.default_rng(shuffle_seed)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, wk date, v double")
    p = Panel(keys=("key",), ts="wk", freq="week", seg_steps=seg_steps)
    return with_step(df, p), p


def to_series(df, key="key", ts="wk", col="v") -> dict[str, np.ndarray]:
    pdf = df.select(key, ts, col).toPandas().sort_values([key, ts])
    return {k: g[col].to_numpy(dtype=float) for k, g in pdf.groupby(key)}


def ewm_ref(x: np.ndarray, span: float) -> np.ndarray:
    """pandas-style adjusted EWM with ignore_na=False, written out."""
    r = 1 - 2 / (span + 1)
    out = np.full(len(x), np.nan)
    for t in range(len(x)):
        num = den = 0.0
        for i in range(t + 1):
            if not np.isnan(x[i]):
                w = r ** (t - i)
                num += w * x[i]
                den += w
        out[t] = num / den if den > 0 else np.nan
    return out


def ffill_ref(x):
    return pd.Series(x).ffill().to_numpy()


def bfill_ref(x):
    return pd.Series(x).bfill().to_numpy()


def close(a, b, tol=1e-9):
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    return a.shape == b.shape and np.allclose(a, b, rtol=tol, atol=tol, equal_nan=True)


def simulate_var2(n=400, seed=3):
    rng = np.random.default_rng(seed)
    A1 = np.array([[0.5, 0.1], [0.2, 0.3]])
    A2 = np.array([[-0.2, 0.05], [0.1, -0.1]])
    c = np.array([0.3, -0.1])
    x = np.zeros((n, 2))
    for t in range(2, n):
        x[t] = c + A1 @ x[t - 1] + A2 @ x[t - 2] + rng.normal(size=2) * 0.5
    return x
