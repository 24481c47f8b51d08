"""Per-series linear models solved from distributed cross-products (M1a-M1e).

One pass aggregates ``Z'Z`` for ``Z = [1, x..., y]`` per series
(:func:`panelcast.operators.stats.cross_products`); a pandas step then solves a
``(p+1) x (p+1)`` problem per series.  Objectives (``n`` rows, centred data,
intercept never penalised):

* ``ols``   -- least squares;
* ``ridge`` -- ``||y - Xw||^2 + alpha ||w||^2``;
* ``lasso`` -- ``||y - Xw||^2 / (2n) + alpha ||w||_1`` (also the LassoLars target);
* ``enet``  -- ``||y - Xw||^2 / (2n) + alpha l1 ||w||_1 + alpha (1 - l1) ||w||^2 / 2``.

The L1 problems run coordinate descent on the centred Gram matrix, so their cost
does not depend on the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.stats import cross_products, gram
from panelcast.plans.panel import Panel, attach_series

METHODS = ("ols", "ridge", "lasso", "enet")


def solve_gram(G: np.ndarray, n: float, method: str = "ols", alpha: float = 1.0, l1_ratio: float = 0.5, intercept: bool = True, max_iter: int = 10000, tol: float = 1e-10) -> tuple[float, np.ndarray]:
    """Solve from ``G = Z'Z`` with ``Z = [1, x_1..x_p, y]``; returns (intercept, w)."""
    p = G.shape[0] - 2
    xs = list(range(1, p + 1))
    yi = p + 1
    if intercept:
        mx = G[0, xs] / n
        my = G[0, yi] / n
        C = G[np.ix_(xs, xs)] - n * np.outer(mx, mx)
        c = G[xs, yi] - n * mx * my
    else:
        mx, my = np.zeros(p), 0.0
        C = G[np.ix_(xs, xs)]
        c = G[xs, yi]
    # a constant regressor has zero centred variance; from sums it is only
    # cancellation noise, so drop it exactly (its coefficient becomes 0)
    dead = np.diag(C) <= 1e-12 * np.maximum(np.diag(G)[xs], 1e-300)
    if dead.any():
        C = C.copy()
        c = c.copy()
        C[dead, :] = 0.0
        C[:, dead] = 0.0
        c[dead] = 0.0
    if method == "ols":
        w = np.linalg.lstsq(C, c, rcond=None)[0]
    elif method == "ridge":
        w = np.linalg.solve(C + alpha * np.eye(p), c) if alpha > 0 else np.linalg.lstsq(C, c, rcond=None)[0]
    elif method in ("lasso", "enet"):
        l1 = 1.0 if method == "lasso" else l1_ratio
        w = _cd(C, c, n, alpha * l1, alpha * (1.0 - l1), max_iter, tol)
    else:
        raise ValueError(f"method must be one of {METHODS}")
    b = my - float(mx @ w) if intercept else 0.0
    return b, w


def _cd(C: np.ndarray, c: np.ndarray, n: float, a1: float, a2: float, max_iter: int, tol: float) -> np.ndarray:
    """Coordinate descent for ``||y-Xw||^2/(2n) + a1 |w|_1 + a2 |w|^2 / 2`` on the Gram."""
    p = len(c)
    w = np.zeros(p)
    for _ in range(max_iter):
        wmax = dmax = 0.0
        for j in range(p):
            if C[j, j] <= 0:
                continue
            rho = c[j] - C[j] @ w + C[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - n * a1, 0.0) / (C[j, j] + n * a2)
            dmax = max(dmax, abs(new - w[j]))
            wmax = max(wmax, abs(new))
            w[j] = new
        if wmax == 0.0 or dmax / wmax < tol:
            break
    return w


def fit(
    df: DataFrame,
    panel: Panel,
    xcols: Sequence[str],
    y: str,
    method: str = "ols",
    alpha: float = 1.0,
    l1_ratio: float = 0.5,
    intercept: bool = True,
    by: Sequence[str] = (),
    running: bool = False,
) -> DataFrame:
    """Fit one linear model per series (and ``by`` group): (keys..., intercept, coef, n).

    ``running``: a group's model is that of its rows and of all rows in groups before it (in order of the one ``by`` column), read off
    the running sum of the groups' cross products; no row is copied into later groups."""
    keys = [*panel.keys, *by]
    z = ["_one", *xcols, y]
    d = df.withColumn("_one", F.lit(1.0))
    cp = cross_products(d, keys, z)
    if running:
        cp = _running(cp, list(panel.keys), by[0])
    D = len(z)
    schema = T.StructType(
        [*[df.schema[k] for k in keys], T.StructField("intercept", T.DoubleType()), T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())]
    )

    def fn(it):
        for pdf in it:
            rows = []
            for _, r in pdf.iterrows():
                G = gram(r["g"], D)
                b, w = solve_gram(G, float(r["n"]), method, alpha, l1_ratio, intercept)
                rows.append((*[r[k] for k in keys], float(b), [float(v) for v in w], int(r["n"])))
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return cp.mapInPandas(fn, schema)


def _running(cp: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Cross products per (series, group) as sums over the groups up to each."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by)
        g = np.cumsum(np.stack(pdf["g"].to_numpy()), axis=0)
        return pdf.assign(n=pdf["n"].cumsum(), g=[row.tolist() for row in g])

    return cp.groupBy(*keys).applyInPandas(fn, cp.schema)


def predict(df: DataFrame, panel: Panel, coefs: DataFrame, xcols: Sequence[str], out: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """Attach each series' coefficients and evaluate ``intercept + x . coef`` JVM-side."""
    c = coefs.select(*panel.keys, *by, F.col("intercept").alias("_b0"), F.col("coef").alias("_w"))
    if by:
        d = df.join(c, [*panel.keys, *by], "left")
    else:
        d = attach_series(df, panel, c)
    e = F.col("_b0")
    for i, x in enumerate(xcols):
        e = e + F.col("_w")[i] * F.col(x)
    return d.withColumn(out, e).drop("_b0", "_w")
