import datetime as dt
import math
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from helpers import ewm_ref, weekly_frame
from panelcast.models import additive, search, seasonal
from panelcast.plans.panel import Panel, step_of, time_of


def _frame(spark, n, seed, seg=32, noise=0.3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    y = 2.0 + 1.5 * x + rng.normal(size=n) * noise
    df, p = weekly_frame(spark, {"a": list(range(n))}, seg_steps=seg)
    aux = spark.createDataFrame([(float(i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "v double, x double, y double")
    return df.join(aux, "v"), p, x, y


def test_grid_linear_matches_numpy_cv(spark):
    df, p, x, y = _frame(spark, 31, 1)
    alphas = [0.1, 1.0, 10.0]
    got = search.grid_linear(df, p, ["x"], "y", "ridge", alphas, k=3).toPandas().sort_values("alpha")
    n = len(y)
    sizes = [n // 3 + (1 if i < n % 3 else 0) for i in range(3)]
    bounds = np.cumsum([0, *sizes])
    ref = []
    for a in alphas:
        scores = []
        for f in range(3):
            te = np.arange(bounds[f], bounds[f + 1])
            tr = np.setdiff1d(np.arange(n), te)
            xm, ym = x[tr].mean(), y[tr].mean()
            w = ((x[tr] - xm) * (y[tr] - ym)).sum() / (((x[tr] - xm) ** 2).sum() + a)
            pred = ym + w * (x[te] - xm)
            scores.append(1 - ((y[te] - pred) ** 2).sum() / ((y[te] - y[te].mean()) ** 2).sum())
        ref.append(np.mean(scores))
    assert np.allclose(got.mean_r2, ref, atol=1e-9)
    assert got.best.sum() == 1 and got[got.best].alpha.iloc[0] == alphas[int(np.argmax(ref))]


def test_walk_forward_matches_numpy_loop(spark):
    from panelcast.operators import predict

    n = 53
    df, p, x, y = _frame(spark, n, 2, seg=16)
    sc, mean = predict.walk_forward(df, p, ["x"], "y", frame_frac=0.2, test_frac=0.3, span=5)
    size = int(n * 0.2)
    maes = []
    for f in range(round(n / size)):
        idx = np.arange(f * size, min((f + 1) * size, n))
        k = len(idx)
        ntest = math.ceil(0.3 * k)
        tr, te = idx[: k - ntest], idx[k - ntest :]
        w, b = np.polyfit(x[tr], y[tr], 1)
        pred = ewm_ref(b + w * x[te], 5)
        maes.append(np.abs(y[te] - pred).mean())
    got = sc.toPandas().sort_values("frame")
    assert np.allclose(got.mae, maes, atol=1e-9)
    assert abs(mean.collect()[0].mean_mae - np.mean(maes)) < 1e-9


def test_seasonal_ar_search_matches_numpy(spark):
    rng = np.random.default_rng(6)
    n, m = 160, 12
    season = np.sin(np.arange(n) * 2 * np.pi / m) * 5
    e = np.zeros(n)
    for t in range(1, n):
        e[t] = 0.6 * e[t - 1] + rng.normal()
    yv = 10 + season + e
    df, p = weekly_frame(spark, {"a": list(yv)}, seg_steps=64)
    tmin = df.agg(F.min("t")).collect()[0][0]
    tr, te = df.filter(F.col("t") < tmin + 140), df.filter(F.col("t") >= tmin + 140)
    got = seasonal.seasonal_ar_search(tr, te, p, "v", [], m=m, max_p=3).toPandas().sort_values("wk")
    # numpy: seasonal difference, AIC on the common sample (p = 0..3), refit, recursive forecast
    ytr = yv[:140]
    w = ytr[m:] - ytr[:-m]
    def design(p_, start):
        Y = w[start:]
        X = np.column_stack([np.ones(len(Y))] + [w[start - j : len(w) - j] for j in range(1, p_ + 1)])
        return X, Y
    best, best_aic = 0, None
    for p_ in range(4):
        X, Y = design(p_, 3)
        b = np.linalg.lstsq(X, Y, rcond=None)[0]
        ssr = ((Y - X @ b) ** 2).sum()
        aic = len(Y) * np.log(ssr / len(Y)) + 2 * X.shape[1]
        if best_aic is None or aic < best_aic:
            best, best_aic = p_, aic
    X, Y = design(best, best)
    b = np.linalg.lstsq(X, Y, rcond=None)[0]
    lv, ww, preds = list(ytr), list(w), []
    for _ in range(20):
        feats = [1.0, *[ww[-j] for j in range(1, best + 1)]]
        wh = float(np.asarray(feats) @ b)
        yh = wh + lv[-m]
        ww.append(wh)
        lv.append(yh)
        preds.append(yh)
    assert int(got.p.iloc[0]) == best
    assert np.allclose(got.y_pred, preds, atol=1e-8)


def test_additive_recovers_trend_and_season(spark):
    n = 260
    t = np.arange(n)
    start = dt.date(2000, 1, 3)
    days = np.array([(start + dt.timedelta(days=7 * int(i)) - dt.date(1970, 1, 1)).days for i in t])
    yv = 50 + 0.1 * t + 8 * np.sin(2 * np.pi * days / 365.25)
    df, p = weekly_frame(spark, {"a": list(yv)}, seg_steps=64)
    tmin = df.agg(F.min("t")).collect()[0][0]
    tr, te = df.filter(F.col("t") < tmin + 220), df.filter(F.col("t") >= tmin + 220)
    fc = additive.fit_predict(tr, te, p, "v").toPandas().sort_values("wk")
    assert np.abs(fc.yhat.to_numpy() - yv[220:]).max() < 1.5
    assert np.allclose(fc.yhat, fc.trend + fc.yearly + fc.extra_regressors)


def test_versions_and_params_roundtrip(spark):
    from pyspark.ml.regression import DecisionTreeRegressor

    from panelcast.models import ml
    from panelcast.operators import predict

    df, p, x, y = _frame(spark, 60, 3)
    models = [ml.Pooled(DecisionTreeRegressor(maxDepth=d, seed=1), ["x"], "y", series_col="key").fit(df) for d in (2, 3, 4)]
    root = tempfile.mkdtemp(prefix="versions-", dir=os.environ.get("TMPDIR", "/tmp"))
    paths = predict.save_versions(models, root)
    avg = predict.average_versions(paths, df, ["x"], "y", ["key", "wk"], series_col="key").toPandas().sort_values("wk")
    direct = [m.transform(df).toPandas().sort_values("wk").y_pred.to_numpy() for m in models]
    assert np.allclose(avg.y_pred, np.mean(direct, axis=0)) and (avg.versions == 3).all()
    best = search.grid_linear(df, p, ["x"], "y", "ridge", [0.1, 1.0]).filter("best")
    search.write_params(best, f"{root}/params")
    back = spark.read.json(f"{root}/params").collect()
    assert len(back) == 1 and back[0].alpha in (0.1, 1.0)


def test_hour_steps_round_trip(spark):
    rows = [(dt.datetime(2024, 1, 1, 0, 5), ), (dt.datetime(2024, 1, 31, 23, 59),), (dt.datetime(1999, 12, 31, 13, 0),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    out = df.select(time_of(step_of("ts", "hour"), "hour").alias("h")).collect()
    assert [r.h for r in out] == [dt.datetime(2024, 1, 1, 0), dt.datetime(2024, 1, 31, 23), dt.datetime(1999, 12, 31, 13)]
    d2 = spark.createDataFrame([(dt.date(2024, 1, 3),), (dt.date(1969, 12, 29),)], "d date")
    w = d2.select(time_of(step_of("d", "week"), "week").alias("w")).collect()
    assert [r.w for r in w] == [dt.date(2024, 1, 1), dt.date(1969, 12, 29)]
    _ = Panel
