import numpy as np
from pyspark.sql import functions as F

from helpers import simulate_var2, weekly_frame
from panelcast.models import linear, negbin, seasonal, var
from panelcast.models.linear import solve_gram


def _xy_frame(spark, n=120, seed=1, seg=32):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = 1.5 + 2.0 * x1 - 0.7 * x2 + rng.normal(size=n) * 0.3
    df, p = weekly_frame(spark, {"a": list(y)}, seg_steps=seg)
    aux = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(y, x1, x2)], "v double, x1 double, x2 double")
    return df.join(aux, "v"), p, (x1, x2, y)


def test_ols_ridge_lasso_enet(spark):
    df, p, (x1, x2, y) = _xy_frame(spark)
    X = np.column_stack([x1, x2])
    n = len(y)
    Xc, yc = X - X.mean(0), y - y.mean()
    for method, kw in (("ols", {}), ("ridge", {"alpha": 1.0}), ("lasso", {"alpha": 0.1}), ("enet", {"alpha": 0.1, "l1_ratio": 0.5})):
        row = linear.fit(df, p, ["x1", "x2"], "v", method=method, **kw).collect()[0]
        if method == "ols":
            w = np.linalg.lstsq(Xc, yc, rcond=None)[0]
        elif method == "ridge":
            w = np.linalg.solve(Xc.T @ Xc + np.eye(2), Xc.T @ yc)
        else:
            l1 = 1.0 if method == "lasso" else 0.5
            a = kw["alpha"]
            w = np.array(row.coef)
            # optimality (KKT) of (1/2n)|y - Xw|^2 + a l1 |w|_1 + a (1-l1)/2 |w|^2
            grad = -Xc.T @ (yc - Xc @ w) / n + a * (1 - l1) * w
            for j in range(2):
                if w[j] != 0:
                    assert abs(grad[j] + a * l1 * np.sign(w[j])) < 1e-8
                else:
                    assert abs(grad[j]) <= a * l1 + 1e-8
        assert np.allclose(row.coef, w, atol=1e-8), method
        assert abs(row.intercept - (y.mean() - X.mean(0) @ np.array(row.coef))) < 1e-8
    pr = linear.predict(df, p, linear.fit(df, p, ["x1", "x2"], "v"), ["x1", "x2"]).toPandas()
    assert np.isfinite(pr.y_pred).all() and len(pr) == len(y)


def test_solve_gram_no_intercept():
    rng = np.random.default_rng(0)
    X = rng.normal(size=(50, 2))
    y = X @ np.array([1.0, -2.0])
    Z = np.column_stack([np.ones(50), X, y])
    b0, w = solve_gram(Z.T @ Z, 50, "ols", intercept=False)
    assert b0 == 0.0 and np.allclose(w, [1.0, -2.0])


def _var_frame(spark, seg=64):
    x = simulate_var2()
    df, p = weekly_frame(spark, {"s": list(x[:, 0])}, seg_steps=seg)
    aux = spark.createDataFrame([(float(a), float(b)) for a, b in x], "v double, w double").dropDuplicates(["v"])
    return df.join(aux, "v"), p, x


def _var_ref(x, lag):
    Y = x[lag:]
    X = np.column_stack([np.ones(len(Y))] + [x[lag - j : len(x) - j] for j in range(1, lag + 1)])
    A = np.linalg.lstsq(X, Y, rcond=None)[0]
    return A, Y - X @ A


def test_var_fit_and_order_table(spark):
    df, p, x = _var_frame(spark)
    A, resid = _var_ref(x, 2)
    rows = {r.equation: r for r in var.fit(df, p, ["v", "w"], 2).collect()}
    for e, name in enumerate(["v", "w"]):
        assert abs(rows[name].intercept - A[0, e]) < 1e-9
        assert np.allclose(rows[name].coef, A[1:, e], atol=1e-9)
    ot = var.order_table(df, p, ["v", "w"], 4).toPandas().sort_values("lag")
    for lag in (1, 2, 3):
        _, r = _var_ref(x, lag)
        nobs = len(r)
        ld = np.linalg.slogdet(r.T @ r / nobs)[1]
        free, k = lag * 4, 1 + 2 * lag
        assert abs(ot.aic.iloc[lag] - (ld + 2.0 / nobs * free)) < 1e-8
        assert abs(ot.bic.iloc[lag] - (ld + np.log(nobs) / nobs * free)) < 1e-8
        assert abs(ot.hqic.iloc[lag] - (ld + 2.0 * np.log(np.log(nobs)) / nobs * free)) < 1e-8
        assert abs(ot.fpe.iloc[lag] / (((nobs + k) / (nobs - k)) ** 2 * np.exp(ld)) - 1) < 1e-8


def test_var_forecast_and_step_by_step(spark):
    df, p, x = _var_frame(spark)
    tr = df.filter(F.col("t") < F.lit(df.agg(F.min("t")).collect()[0][0] + 380))
    te = df.filter(F.col("t") >= F.lit(df.agg(F.min("t")).collect()[0][0] + 380))
    xtr, xte = x[:380], x[380:]
    A, _ = _var_ref(xtr, 2)
    hist = [r for r in xtr[-2:]]
    fc_ref = []
    for _ in range(len(xte)):
        z = np.concatenate([[1.0], hist[-1], hist[-2]])
        yhat = z @ A
        fc_ref.append(yhat)
        hist.append(yhat)
    fc = var.forecast(tr, te, p, ["v", "w"], 2).toPandas().sort_values("wk")
    assert np.allclose(fc.v_fc, np.array(fc_ref)[:, 0], atol=1e-9)
    # step by step: refit every step on history + appended (features known, target predicted)
    sbs = var.step_by_step(tr, te, p, ["w", "v"], "v", 2).toPandas().sort_values("wk")
    data = x[:380, ::-1].copy()  # order (w, v)
    preds = []
    for i in range(len(xte)):
        A2, _ = _var_ref(data, 2)
        z = np.concatenate([[1.0], data[-1], data[-2]])
        yhat = z @ A2
        preds.append(yhat[1])
        new = np.array([xte[i, 1], yhat[1]])
        data = np.vstack([data, new])
    assert np.allclose(sbs.y_pred, preds, atol=1e-8)
    assert np.allclose(sbs.y, xte[:, 0])


def test_negbin_irls_matches_numpy(spark):
    rng = np.random.default_rng(4)
    n = 200
    xv = rng.normal(size=n)
    mu = np.exp(1.0 + 0.5 * xv)
    yv = rng.poisson(mu).astype(float)
    df, p = weekly_frame(spark, {"a": list(range(n))}, seg_steps=64)
    aux = spark.createDataFrame([(float(i), float(a), float(b)) for i, (a, b) in enumerate(zip(xv, yv))], "v double, x double, y double")
    df = df.join(aux, "v")
    alpha = 1e-4
    got = negbin.fit(df, p, ["x"], "y", [alpha], max_iter=50, tol=1e-12).collect()[0]
    X = np.column_stack([np.ones(n), xv])
    m = (yv + yv.mean()) / 2
    eta = np.log(m)
    for _ in range(100):
        w = m / (1 + alpha * m)
        z = eta + (yv - m) / m
        b = np.linalg.solve(X.T @ (w[:, None] * X), X.T @ (w * z))
        eta = X @ b
        m = np.exp(eta)
    assert np.allclose(got.coef, b, atol=1e-8)


def test_diffreg(spark):
    df, p, (x1, x2, y) = _xy_frame(spark, n=60)
    c = seasonal.diffreg_fit(df, p, ["x1"], "v").collect()[0]
    dy, dx = np.diff(y), np.diff(x1)
    assert abs(c.coef[0] - (dx * dy).sum() / (dx * dx).sum()) < 1e-10 and c.intercept == 0.0


def test_knn_exact_against_brute_force(spark):
    from panelcast.models import knn

    rng = np.random.default_rng(8)
    rows_tr, rows_q = [], []
    for s, n in (("a", 300), ("b", 40), ("c", 7)):
        pts = rng.normal(size=(n, 3)) * [1.0, 3.0, 0.5]
        pts[: n // 5] = pts[0]  # a block of exact duplicates
        for i, p_ in enumerate(pts):
            rows_tr.append((s, i, *map(float, p_), float(rng.integers(0, 50))))
        for i, q_ in enumerate(rng.normal(size=(25, 3)) * [1.5, 3.0, 0.5] + [4.0 if s == "a" else 0.0, 0, 0]):
            rows_q.append((s, 1000 + i, *map(float, q_)))
    tr = spark.createDataFrame(rows_tr, "k string, t int, f1 double, f2 double, f3 double, y double")
    q = spark.createDataFrame(rows_q, "k string, t int, f1 double, f2 double, f3 double")
    for grid_dims in (2, 3):
        got = {(r.k, r.t): r.y_pred for r in knn.knn_regress(tr, q, ["k"], "t", ["f1", "f2", "f3"], "y", k=20, grid_dims=grid_dims).collect()}
        assert len(got) == len(rows_q)
        for s in ("a", "b", "c"):
            T = np.array([r[2:5] for r in rows_tr if r[0] == s])
            Y = np.array([r[5] for r in rows_tr if r[0] == s])
            tt = np.array([r[1] for r in rows_tr if r[0] == s])
            for r in rows_q:
                if r[0] != s:
                    continue
                d2 = ((T - np.array(r[2:5])) ** 2).sum(1)
                order = np.lexsort((tt, d2))[:20]
                assert abs(got[(s, r[1])] - Y[order].mean()) < 1e-9


def test_constant_regressor_gets_zero_coefficient():
    rng = np.random.default_rng(1)
    x1 = np.full(40, 123.456)
    x2 = rng.normal(size=40)
    y = 3.0 + 2.0 * x2 + rng.normal(size=40) * 0.1
    Z = np.column_stack([np.ones(40), x1, x2, y])
    b0, w = solve_gram(Z.T @ Z, 40, "ols")
    ref = np.linalg.lstsq(np.column_stack([x1 - x1.mean(), x2 - x2.mean()]), y - y.mean(), rcond=None)[0]
    assert w[0] == 0.0 and abs(w[1] - ref[1]) < 1e-9 and abs(b0 - (y.mean() - x2.mean() * w[1])) < 1e-9


def test_var_blocks_equal_one_walk(spark):
    """Any block size gives the multi-step and the step-by-step forecast of one long walk, missing values included."""
    import pandas as pd

    from panelcast.models import var
    from panelcast.plans.panel import Panel, regularize

    rng = np.random.default_rng(4)
    rows = []
    for key in ("a", "b"):
        v = np.zeros((150, 2))
        for i in range(2, 150):
            v[i] = 0.5 * v[i - 1] + [[0.1, -0.2], [0.3, 0.1]] @ v[i - 2] + rng.normal(size=2)
        rows += [(key, pd.Timestamp("2020-01-06") + pd.Timedelta(weeks=i), *map(float, v[i]), float(rng.normal())) for i in range(150)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["key", "wk", "v", "w", "x"]))
    df = regularize(df.withColumn("wk", F.to_date("wk")), Panel(keys=("key",), ts="wk", freq="week"))
    p = Panel(keys=("key",), ts="wk", freq="week")
    tr, te = df.filter("wk < '2022-01-03'"), df.filter("wk >= '2022-01-03'")
    te = te.withColumn("x", F.when(~((F.col("key") == "b") & (F.col("wk") == F.lit("2022-03-07").cast("date"))), F.col("x")))
    te = te.withColumn("w", F.when(F.col("wk") != F.lit("2022-02-07").cast("date"), F.col("w")))

    def multi(n):
        return var.forecast(tr, te, p, ["v", "w"], 2, exog=["x"], block_steps=n).toPandas().sort_values(["key", "wk"])

    def steps(n):
        return var.step_by_step(tr, te, p, ["w", "v"], "v", 2, block_steps=n).toPandas().sort_values(["key", "wk"])

    for run, col in ((multi, "v_fc"), (steps, "y_pred")):
        whole = run(1000)
        for n in (1, 7):
            got = run(n)
            assert np.allclose(got[col].to_numpy(float), whole[col].to_numpy(float), atol=1e-9, equal_nan=True)
            assert list(got["reason"].fillna("")) == list(whole["reason"].fillna(""))
    assert multi(7)["v_fc"].isna().sum() > 3  # after the missing exogenous value


def test_refit_walk_equals_new_solutions():
    from panelcast.models.var import _refit_walk, _solve

    rng = np.random.default_rng(2)
    m, k = 2, 5
    z = np.concatenate([np.ones((60, 1)), rng.normal(size=(60, 6))], 1)
    G, hist, truth = z.T @ z, rng.normal(size=4), rng.normal(size=(600, 2))
    pred, after, _ = _refit_walk(G, hist, truth, m, k, 1)
    g, h = G.copy(), hist.copy()
    for i, row in enumerate(truth):
        x = np.concatenate([[1.0], h])
        yhat = x @ _solve(g, m, k)[0]
        assert abs(pred[i] - yhat[1]) < 1e-9
        new = row.copy()
        new[1] = yhat[1]
        z1 = np.concatenate([x, new])
        g += np.outer(z1, z1)
        h = np.concatenate([new, h[:2]])
    assert np.allclose(after, g)
