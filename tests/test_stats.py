import numpy as np

from helpers import close, simulate_var2, weekly_frame
from panelcast.functions.distributions import chi2_sf, durbin_levinson
from panelcast.operators import stats


def acf_ref(x, L):
    x = x - x.mean()
    d = (x * x).sum()
    return np.array([(x[k:] * x[: len(x) - k]).sum() / d for k in range(L + 1)])


def test_acf_pacf(spark):
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.normal(size=300)) * 0.1 + rng.normal(size=300)
    df, p = weekly_frame(spark, {"a": list(x)}, seg_steps=64)
    a = stats.acf(df, p, ["v"], 30).toPandas().sort_values("lag")
    assert close(a.acf, acf_ref(x, 30), 1e-9)
    pa = stats.pacf(stats.acf(df, p, ["v"], 10), p).toPandas().sort_values("lag")
    # partial autocorrelation at lag k = last coefficient of the Yule-Walker AR(k) fit
    r = acf_ref(x, 10)
    for k in range(1, 11):
        R = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        phi = np.linalg.solve(R, r[1 : k + 1])
        assert abs(pa.pacf.iloc[k] - phi[-1]) < 1e-9
    assert close(durbin_levinson(np.array([1.0, 0.5, 0.25])), [1.0, 0.5, 0.0])


def test_histogram(spark):
    vals = [0.0, 1.0, 2.0, 2.5, 10.0, None]
    df, p = weekly_frame(spark, {"a": vals, "c": [4.0, 4.0]})
    h = stats.histogram(df, p, "v", 25).toPandas()
    ha = h[h.key == "a"].sort_values("bin")
    counts, _ = np.histogram([0.0, 1.0, 2.0, 2.5, 10.0], bins=25)
    assert list(ha["count"]) == list(counts)
    hc = h[h.key == "c"]
    assert hc["count"].sum() == 2 and int(hc[hc["count"] == 2].bin.iloc[0]) == 12


def test_durbin_watson(spark):
    e = np.random.default_rng(2).normal(size=50)
    df, p = weekly_frame(spark, {"a": list(e)}, seg_steps=8)
    dw = stats.durbin_watson(df, p, "v").collect()[0].dw
    assert abs(dw - (np.diff(e) ** 2).sum() / (e**2).sum()) < 1e-12


def test_chi2_sf_known_points():
    # 5 % critical values
    for k, x in ((1, 3.841458820694124), (2, 5.991464547107979), (3, 7.814727903251179), (12, 21.02606981748307)):
        assert abs(chi2_sf(x, k) - 0.05) < 1e-9


def _ols_ssr(X, y):
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    return ((y - X @ b) ** 2).sum()


def test_granger_matches_numpy(spark):
    x = simulate_var2()
    df, p = weekly_frame(spark, {"a": list(x[:, 0])}, seg_steps=64)
    from pyspark.sql import functions as F

    df = df.join(spark.createDataFrame([(float(a), float(b)) for a, b in x], "v double, w double").dropDuplicates(["v"]), "v")
    g = stats.granger(df, p, ["v", "w"], 4).toPandas()
    for L in (1, 2, 4):
        y = x[L:, 0]
        own = np.column_stack([np.ones(len(y))] + [x[L - j : len(x) - j, 0] for j in range(1, L + 1)])
        joint = np.column_stack([own] + [x[L - j : len(x) - j, 1] for j in range(1, L + 1)])
        sr, su = _ols_ssr(own, y), _ols_ssr(joint, y)
        stat = len(y) * (sr - su) / su
        row = g[(g.response == "v") & (g.predictor == "w") & (g.lag == L)].iloc[0]
        assert abs(row.chi2 - stat) < 1e-6 * max(1, stat)
        assert abs(row.p_value - chi2_sf(stat, L)) < 1e-9
    assert g[(g.response == "v") & (g.predictor == "v")].chi2.isna().all()
    m = stats.granger_matrix(stats.granger_min_p(stats.granger(df, p, ["v", "w"], 3), p), p, ["v", "w"]).collect()
    assert len(m) == 2
    _ = F


def test_adf_and_johansen_shapes(spark):
    rng = np.random.default_rng(9)
    walk = np.cumsum(rng.normal(size=300))
    noise = rng.normal(size=300)
    df, p = weekly_frame(spark, {"walk": list(walk), "noise": list(noise)}, seg_steps=64)
    a = {r.key: r for r in stats.adf(df, p, ["v"]).collect()}
    assert a["noise"].p_value < 0.01 and a["noise"].stationary
    assert a["walk"].p_value > 0.05 and not a["walk"].stationary
    # ADF statistic equals numpy OLS t-value for the chosen lag
    lag = a["walk"].used_lag
    dx = np.diff(walk)
    y = dx[lag:]
    X = np.column_stack([walk[lag:-1]] + [dx[lag - j : len(dx) - j] for j in range(1, lag + 1)] + [np.ones(len(y))])
    b, res, *_ = np.linalg.lstsq(X, y, rcond=None)
    s2 = ((y - X @ b) ** 2).sum() / (len(y) - X.shape[1])
    se = np.sqrt(s2 * np.linalg.inv(X.T @ X)[0, 0])
    assert abs(a["walk"].statistic - b[0] / se) < 1e-6
    x = simulate_var2()
    df2, p2 = weekly_frame(spark, {"s": list(x[:, 0])}, seg_steps=64)
    df2 = df2.join(spark.createDataFrame([(float(a_), float(b_)) for a_, b_ in x], "v double, w double").dropDuplicates(["v"]), "v")
    j = stats.johansen(df2, p2, ["v", "w"], 2).toPandas().sort_values("rank")
    assert list(j["rank"]) == [0, 1] and (j.trace.diff().dropna() < 0).all()
