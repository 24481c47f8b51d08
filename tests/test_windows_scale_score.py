import math

import numpy as np
from pyspark.sql import functions as F

from helpers import close, to_series, weekly_frame
from panelcast.operators import scale, score, windows


def test_sequences_count_and_content(spark):
    data = {"a": [float(i) for i in range(10)], "b": [float(10 * i) for i in range(3)]}
    df, p = weekly_frame(spark, data, seg_steps=4)
    df = df.withColumn("w", F.col("v") * 2)
    s = windows.sequences(df, p, ["v", "w"], "v", 4).toPandas().sort_values(["key", "wk"])
    assert len(s[s.key == "a"]) == 10 - 4 + 1 and len(s[s.key == "b"]) == 0
    first = s[s.key == "a"].iloc[0]
    assert [list(r) for r in first.x] == [[0.0, 0.0], [1.0, 2.0], [2.0, 4.0], [3.0, 6.0]]
    assert first.y == 3.0
    h = windows.split_halves(windows.sequences(df, p, ["v"], "v", 4), "x", 4).toPandas()
    assert [[list(r) for r in half] for half in h.sort_values("wk").iloc[0].x] == [[[0.0], [1.0]], [[2.0], [3.0]]]


def test_chrono_split_sizes(spark):
    df, p = weekly_frame(spark, {"a": [1.0] * 135}, seg_steps=16)
    c = windows.chrono_split(df, p, 0.22).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in c} == {"train": 105, "test": 30}
    tv = windows.tail_validation(df, p, 0.9).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in tv} == {"train": 121, "validation": 14}


def test_frames_odd_sizes(spark):
    for n in (10, 11, 13):
        for frac in (0.2, 0.3):
            df, p = weekly_frame(spark, {"a": [1.0] * n}, seg_steps=4)
            fr = windows.frames(df, p, frac, 0.3).toPandas().sort_values("wk")
            size = int(math.floor(n * frac))
            nfr = round(n / size)
            exp_frames = [i // size if i // size < nfr else None for i in range(n)]
            got = [None if (f is None or (isinstance(f, float) and math.isnan(f))) else int(f) for f in fr.frame]
            assert got == exp_frames, (n, frac)
            for f in range(nfr):
                rows = fr[fr.frame == f]
                k = len(rows)
                assert (rows.part == "test").sum() == math.ceil(0.3 * k)
            assert (fr.part == "remainder").sum() == max(0, n - nfr * size)


def test_scaler_population_std_and_inverse(spark):
    data = {"a": [1.0, 2.0, None, 4.0, 8.0], "c": [3.0, 3.0, 3.0]}
    df, p = weekly_frame(spark, data, seg_steps=2)
    z, st = scale.fit_transform(df, p, ["v"])
    got = to_series(z)
    x = np.array([1.0, 2.0, np.nan, 4.0, 8.0])
    m, s = np.nanmean(x), np.nanstd(x)
    assert close(got["a"], (x - m) / s)
    assert close(got["c"], [0.0, 0.0, 0.0])  # zero std scales by 1
    back = to_series(scale.inverse(z, p, st, ["v"]))
    assert close(back["a"], x) and close(back["c"], [3.0, 3.0, 3.0])
    row = st.filter("key = 'a'").collect()[0]
    assert row.column == "v" and abs(row["std"] - s) < 1e-12


def test_score_metrics(spark):
    y = np.array([3.0, 5.0, 2.0, 8.0, 7.0])
    yp = np.array([2.5, 5.5, 2.0, 6.0, 9.0])
    rows = [("m", float(a), float(b)) for a, b in zip(y, yp)] + [("const", 4.0, 4.0), ("const", 4.0, 4.0)]
    df = spark.createDataFrame(rows, "model string, y double, y_pred double")
    out = {r.model: r for r in score.score(df, digits=None).collect()}
    e = y - yp
    sst = ((y - y.mean()) ** 2).sum()
    assert abs(out["m"].mae - np.abs(e).mean()) < 1e-12
    assert abs(out["m"].mse - (e**2).mean()) < 1e-12
    assert abs(out["m"].r2 - (1 - (e**2).sum() / sst)) < 1e-12
    assert abs(out["m"].r2_hand - out["m"].r2) < 1e-12
    assert out["const"].r2 == 1.0 and out["const"].r2_hand is None
    b = score.best_candidate(spark.createDataFrame([("s", 1e-8, 2.0), ("s", 1e-6, 1.0), ("s", 1e-5, 1.0)], "k string, alpha double, mae double"), ["k"], "alpha")
    assert b.collect()[0].best_alpha == 1e-6
    t = score.transpose(score.score(df)).collect()
    assert {r.metric for r in t} == set(score.METRICS)
