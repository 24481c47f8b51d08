"""M10 difference regression and M11 seasonal autoregression order search.

M10 (order (0,1,0) with regressors): ``dy_t = dx_t . beta`` (no constant) by
least squares; the forecast is ``y_T + (x_{T+h} - x_T) . beta``.

M11 (re-aimed seasonal search): seasonal difference ``w_t = y_t - y_{t-m}`` (and
of the regressors), AR(p) with a constant and the differenced regressors for
p = 0..max_p, compared by AIC on the common sample, refitted on its own sample;
forecasts rebuild levels from the seasonal history.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.models import linear
from panelcast.operators.clean import last_rows
from panelcast.operators.features import diff
from panelcast.operators.stats import _ols, _stack, cross_products, lag_matrix
from panelcast.plans.panel import Panel, attach_series


def diffreg_fit(df: DataFrame, panel: Panel, xcols: Sequence[str], y: str) -> DataFrame:
    """M10 fit: per-series coefficients of first differences, no intercept."""
    d = diff(df.select(*panel.keys, panel.ts, panel.t, panel.seg, y, *xcols), panel, [y, *xcols], 1)
    return linear.fit(d, panel, list(xcols), y, method="ols", intercept=False)


def diffreg_forecast(train: DataFrame, test: DataFrame, panel: Panel, xcols: Sequence[str], y: str, coefs: DataFrame, out: str = "y_pred") -> DataFrame:
    """M10 forecast: ``y_T + (x - x_T) . beta`` for every test row."""
    last = last_rows(train.select(*panel.keys, panel.t, panel.seg, y, *xcols), panel, 1)
    anchor = last.select(*panel.keys, F.col(y).alias("_yT"), *[F.col(x).alias(f"_xT_{x}") for x in xcols])
    c = coefs.select(*panel.keys, F.col("coef").alias("_w"))
    st = anchor.join(c, list(panel.keys))
    d = attach_series(test, panel, st)
    e = F.col("_yT")
    for i, x in enumerate(xcols):
        e = e + (F.col(x) - F.col(f"_xT_{x}")) * F.col("_w")[i]
    return d.withColumn(out, e).drop("_yT", "_w", *[f"_xT_{x}" for x in xcols])


def seasonal_ar_search(train: DataFrame, test: DataFrame, panel: Panel, y: str, xcols: Sequence[str] = (), m: int = 52, max_p: int = 10, out: str = "y_pred") -> DataFrame:
    """Choose p by AIC and forecast the test rows.

    Returns one row per test row: (keys, ts, p, y_pred, reason).  A series without enough training rows for one season, the
    chosen lags and the coefficients gets NULL forecasts (reason ``short history``); a row whose regressors are missing,
    and those that build on it, too (``missing values``)."""
    keys = list(panel.keys)
    xcols = list(xcols)
    base = train.select(*panel.keys, panel.ts, panel.t, panel.seg, y, *xcols)
    sd = diff(base, panel, [y, *xcols], m).filter(F.col(y).isNotNull())
    lm = lag_matrix(sd, panel, [y], max_p)
    xs = sd.select(*panel.keys, panel.t, *xcols)
    lm = lm.join(xs, [*panel.keys, panel.t])
    z = ["_one", *[f"{y}__{j}" for j in range(1, max_p + 1)], *xcols, f"{y}__0"]
    lm = lm.withColumn("_one", F.lit(1.0)).withColumn("_b", F.least(F.col("_pos"), F.lit(max_p)))
    cp = cross_products(lm, [*keys, "_b"], z)
    D = len(z)
    tail = last_rows(base, panel, m + max_p).select(*keys, panel.ts, panel.t, y, *xcols).withColumn("_role", F.lit(0))
    fut = test.select(*keys, panel.ts, panel.t, *xcols).withColumn(y, F.lit(None).cast("double")).withColumn("_role", F.lit(1))
    rows = tail.unionByName(fut)
    schema = T.StructType([*[test.schema[k] for k in keys], test.schema[panel.ts], T.StructField("p", T.IntegerType()), T.StructField(out, T.DoubleType()), T.StructField("reason", T.StringType())])

    def rows_of(data, p, values, short):
        res = data[data["_role"] == 1][[*keys, panel.ts]].copy()
        res["p"] = pd.array([p] * len(res), dtype="Int32")
        res[out] = values
        res["reason"] = np.where(np.isnan(res[out].to_numpy(dtype=float)), "short history" if short else "missing values", None)
        return res

    def fn(gram: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        data = data.sort_values(panel.t)
        if gram.empty:
            return rows_of(data, None, np.nan, True)
        Gs, Ns = _stack(gram, D, max_p)
        yi = D - 1
        xi_ex = list(range(1 + max_p, 1 + max_p + len(xcols)))
        best, best_aic = 0, None
        G, n = Gs[max_p], Ns[max_p]
        for p in range(0, max_p + 1):
            xi = [0, *range(1, p + 1), *xi_ex]
            _, ssr, _ = _ols(G, xi, yi)
            if n <= len(xi) or ssr <= 0:
                continue
            aic = n * math.log(ssr / n) + 2 * len(xi)
            if best_aic is None or aic < best_aic:
                best, best_aic = p, aic
        xi = [0, *range(1, best + 1), *xi_ex]
        lv = list(data[data["_role"] == 0][y].astype(float))
        xh = data[data["_role"] == 0][xcols].to_numpy(dtype=float) if xcols else None
        xlist = [r for r in xh] if xcols else []
        w = [lv[i] - lv[i - m] for i in range(m, len(lv))]
        if Ns[best] < len(xi) or len(w) < max(best, 1):
            return rows_of(data, None, np.nan, True)
        b, _, _ = _ols(Gs[best], xi, yi)
        pred = []
        for xr in data[data["_role"] == 1][xcols].to_numpy(dtype=float):
            dx = xr - xlist[-m] if xcols else xr
            wh = float(np.concatenate([[1.0], [w[-j] for j in range(1, best + 1)], dx]) @ b)
            w.append(wh)
            lv.append(wh + lv[-m])
            pred.append(lv[-1])
            if xcols:
                xlist.append(xr)
        return rows_of(data, best, pred, False)

    return cp.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(fn, schema)
