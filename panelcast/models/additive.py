"""M12 additive trend / season / regressor model and M13 recombination (re-aimed).

Per series, on the training rows:
``y/scale = a + b*s + sum_k d_k * max(s - c_k, 0) + Fourier(yearly) + X beta``
with ``s`` the time scaled to [0, 1] over the training range, changepoints
``c_k`` evenly spaced over the first 80 % of it, yearly Fourier terms of the
date, and extra regressors.  Coefficients are a ridge solve from one
cross-product pass: hinge coefficients are shrunk with ``sigma^2/prior_scale^2``
(changepoint prior 0.01), seasonality and regressors with ``sigma^2/10^2``, where
``sigma^2`` is the residual variance of a first, nearly unshrunk solve.
Component columns are partial dot products: ``trend``, ``yearly``,
``extra_regressors``, ``yhat``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.stats import cross_products, gram
from panelcast.plans.panel import Panel, attach_series

YEAR_DAYS = 365.25


def _design(d: DataFrame, panel: Panel, n_cp: int, cp_range: float, order: int, regressors: Sequence[str]) -> tuple[DataFrame, list[str], list[str], list[str]]:
    s = (F.col(panel.t) - F.col("_t0")) / F.greatest(F.col("_t1") - F.col("_t0"), F.lit(1))
    d = d.withColumn("_s", s)
    hinge = []
    for k in range(1, n_cp + 1):
        c = cp_range * k / (n_cp + 1)
        d = d.withColumn(f"_h{k}", F.greatest(F.col("_s") - F.lit(c), F.lit(0.0)))
        hinge.append(f"_h{k}")
    day = F.datediff(F.col(panel.ts).cast("date"), F.lit("1970-01-01").cast("date")).cast("double")
    four = []
    for j in range(1, order + 1):
        ang = day * F.lit(2 * math.pi * j / YEAR_DAYS)
        d = d.withColumn(f"_sin{j}", F.sin(ang)).withColumn(f"_cos{j}", F.cos(ang))
        four += [f"_sin{j}", f"_cos{j}"]
    return d, ["_one", "_s", *hinge], four, list(regressors)


def fit_predict(
    train: DataFrame,
    test: DataFrame,
    panel: Panel,
    y: str,
    regressors: Sequence[str] = (),
    n_changepoints: int = 25,
    changepoint_range: float = 0.8,
    changepoint_prior: float = 0.01,
    season_prior: float = 10.0,
    yearly_order: int = 10,
) -> DataFrame:
    """Fit on ``train`` and return ``test`` rows with trend/yearly/extra_regressors/yhat."""
    keys = list(panel.keys)
    st = train.groupBy(*keys).agg(
        F.min(panel.t).alias("_t0"), F.max(panel.t).alias("_t1"), F.max(F.abs(F.col(y))).alias("_ys")
    )
    st = st.withColumn("_ys", F.when(F.col("_ys") > 0, F.col("_ys")).otherwise(F.lit(1.0)))
    tr = attach_series(train, panel, st).withColumn("_one", F.lit(1.0)).withColumn("_y", F.col(y) / F.col("_ys"))
    tr, trend_c, four_c, reg_c = _design(tr, panel, n_changepoints, changepoint_range, yearly_order, regressors)
    z = [*trend_c, *four_c, *reg_c, "_y"]
    cp = cross_products(tr, keys, z)
    D = len(z)
    pen = np.zeros(D - 1)
    pen[2 : 2 + n_changepoints] = 1.0 / changepoint_prior**2
    pen[len(trend_c) :] = 1.0 / season_prior**2
    schema = T.StructType([*[train.schema[k] for k in keys], T.StructField("_beta", T.ArrayType(T.DoubleType()))])

    def fn(it):
        for pdf in it:
            rows = []
            for _, r in pdf.iterrows():
                G = gram(r["g"], D)
                X, xy = G[:-1, :-1], G[:-1, -1]
                b = np.linalg.lstsq(X + 1e-8 * np.diag(pen), xy, rcond=None)[0]
                free = max(1.0, float(r["n"]) - len(b))
                sigma2 = max(1e-8, float(G[-1, -1] - 2 * b @ xy + b @ X @ b) / free)
                b = np.linalg.lstsq(X + sigma2 * np.diag(pen), xy, rcond=None)[0]
                rows.append((*[r[k] for k in keys], [float(v) for v in b]))
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    coefs = cp.mapInPandas(fn, schema).join(st, keys)
    te = attach_series(test, panel, coefs).withColumn("_one", F.lit(1.0))
    te, trend_c, four_c, reg_c = _design(te, panel, n_changepoints, changepoint_range, yearly_order, regressors)

    def dot(names: list[str], offset: int) -> Column:
        e = F.lit(0.0)
        for i, n in enumerate(names):
            e = e + F.col("_beta")[offset + i] * F.col(n)
        return e * F.col("_ys")

    trend = dot(trend_c, 0)
    yearly = dot(four_c, len(trend_c))
    extra = dot(reg_c, len(trend_c) + len(four_c))
    out = te.select(*test.columns, trend.alias("trend"), yearly.alias("yearly"), extra.alias("extra_regressors"))
    out = out.withColumn("additive", F.col("yearly") + F.col("extra_regressors"))
    return out.withColumn("yhat", F.col("trend") + F.col("additive"))


def recombine(df: DataFrame, additive: str = "additive") -> Column:
    """``yhat/trend + yearly + extra_regressors + additive``, the last being the sum of the additive components."""
    return F.try_divide(F.col("yhat"), F.col("trend")) + F.col("yearly") + F.col("extra_regressors") + F.col(additive)
