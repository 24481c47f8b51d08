import numpy as np
from pyspark.sql import functions as F

from helpers import bfill_ref, close, ffill_ref, to_series, weekly_frame
from panelcast.operators import clean, features
from panelcast.plans.panel import Panel, regularize, row_index

GAPS = {
    "a": [None, None, 1.0, 2.0, None, None, 5.0, None, 7.0, 8.0, None, None],
    "b": [3.0, None, None, None, 4.0, 4.5, None, 1.0, None, None, 2.0, None],
}


def test_ffill_bfill_match_pandas_across_segments(spark):
    for seg in (3, 4, 1 << 16):
        df, p = weekly_frame(spark, GAPS, seg_steps=seg)
        got_f = to_series(clean.ffill(df, p, ["v"]))
        got_b = to_series(clean.bfill(df, p, ["v"]))
        for k, x in GAPS.items():
            x = np.array([np.nan if v is None else v for v in x])
            assert close(got_f[k], ffill_ref(x)), (seg, k)
            assert close(got_b[k], bfill_ref(x)), (seg, k)


def test_regularize_spines_each_series(spark):
    import datetime as dt

    rows = [("x", dt.date(2001, 1, 1), 1.0), ("x", dt.date(2001, 1, 29), 2.0), ("y", dt.date(2001, 1, 8), 3.0)]
    df = spark.createDataFrame(rows, "key string, wk date, v double")
    p = Panel(keys=("key",), ts="wk", seg_steps=2)
    out = regularize(df, p).orderBy("key", "wk").collect()
    assert [(r.key, str(r.wk), r.v) for r in out] == [
        ("x", "2001-01-01", 1.0),
        ("x", "2001-01-08", None),
        ("x", "2001-01-15", None),
        ("x", "2001-01-22", None),
        ("x", "2001-01-29", 2.0),
        ("y", "2001-01-08", 3.0),
    ]


def test_row_index_is_independent_of_segments(spark):
    for seg in (2, 5, 1 << 16):
        df, p = weekly_frame(spark, GAPS, seg_steps=seg)
        got = row_index(df, p, "rn").select("key", "wk", "rn").toPandas().sort_values(["key", "wk"])
        for k, g in got.groupby("key"):
            assert list(g["rn"]) == list(range(len(GAPS[k])))


def test_lags_diff_cumsum_across_segments(spark):
    data = {"a": [float(i * i) for i in range(15)], "b": [float(-i) for i in range(9)]}
    for seg in (4, 1 << 16):
        df, p = weekly_frame(spark, data, seg_steps=seg)
        lg = features.lags(df, p, ["v"], 3, fmt="{col}_l{j}")
        pdf = lg.toPandas().sort_values(["key", "wk"])
        for k, g in pdf.groupby("key"):
            s = np.array(data[k])
            for j in (1, 2, 3):
                ref = np.concatenate([[np.nan] * j, s[:-j]])
                assert close(g[f"v_l{j}"], ref)
        dd = to_series(features.diff(df, p, ["v"], 2))
        cs = to_series(features.cumsum(df, p, ["v"]))
        for k, s in data.items():
            s = np.array(s)
            assert close(dd[k], np.concatenate([[np.nan] * 2, s[2:] - s[:-2]]))
            assert close(cs[k], np.cumsum(s))


def test_undiff_inverts_diff_for_any_k(spark):
    data = {"a": [float((i * 7) % 11) for i in range(20)]}
    df, p = weekly_frame(spark, data, seg_steps=4)
    from panelcast.operators import windows

    for k in (1, 3):
        sp = windows.chrono_split(df, p, 0.3)
        dd = features.diff(sp, p, ["v"], k)
        hist = sp.filter(F.col("split") == "train").drop("split")
        test = dd.filter(F.col("split") == "test").drop("split")
        got = to_series(features.undiff(test, p, hist, "v", k=k))
        assert close(got["a"], np.array(data["a"])[-6:])


def test_drop_leading_and_last_rows(spark):
    df, p = weekly_frame(spark, GAPS, seg_steps=5)
    d = clean.drop_leading(df, p, {"a": 3}).groupBy("key").count().collect()
    assert {r.key: r["count"] for r in d} == {"a": 9, "b": 12}
    lr = clean.last_rows(df, p, 4).toPandas()
    assert lr.groupby("key").size().to_dict() == {"a": 4, "b": 4}
    assert lr[lr.key == "a"].wk.min() > df.filter("key = 'a'").toPandas().wk.sort_values().iloc[7]


def test_replace_clamp_truncate(spark):
    df = spark.createDataFrame([(0.076225,), (0.04585,), (0.0762251,), (-1.7,), (1.7,), (20000.0,)], "x double")
    out = df.select(
        clean.replace_values(df, {"x": {0.076225: -0.1, 0.04585: -0.1}}).columns[0],
    )
    r = clean.replace_values(df, {"x": {0.076225: -0.1, 0.04585: -0.1}}).collect()
    assert [v.x for v in r][:3] == [-0.1, -0.1, 0.0762251]
    t = df.select(clean.to_int("x").alias("i"), clean.zero_above("x", 10000).alias("z")).collect()
    assert [v.i for v in t][3:] == [-1, 1, 20000]
    assert [v.z for v in t][5] == 0
    assert out is not None


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (2.5,)], "x double")
    r = df.select(clean.round_even("x", 2).alias("a"), clean.round_even("x", 0).alias("b")).collect()
    assert [v.a for v in r] == [0.12, 0.38, 2.5]
    assert r[2].b == 2.0


def test_row_order_does_not_matter_and_acf0_is_one(spark):
    from panelcast.operators import smooth, stats

    data = {"a": [None, 1.0, 4.0, None, 2.0, 8.0, 5.0, None, 3.0, 1.0], "b": [2.0, None, 2.5, 7.0]}
    outs = []
    for seed in (1, 2, 3):
        df, p = weekly_frame(spark, data, shuffle_seed=seed, seg_steps=3)
        outs.append(to_series(smooth.ewm(clean.ffill(df, p, ["v"]), p, ["v"], 4)))
    for k in data:
        assert close(outs[0][k], outs[1][k]) and close(outs[0][k], outs[2][k])
    df, p = weekly_frame(spark, data, seg_steps=3)
    a = stats.acf(clean.ffill(df, p, ["v"]), p, ["v"], 2).filter("lag = 0").collect()
    assert all(abs(r.acf - 1.0) < 1e-12 for r in a)


def test_positional_steps_number_rows_in_date_order(spark):
    import datetime as dt

    from panelcast.plans.panel import positional_steps

    days = [dt.date(1993, 12, 24), dt.date(1993, 12, 31), dt.date(1994, 1, 1), dt.date(1994, 1, 8), dt.date(1994, 1, 15)]
    rows = [("x", d, float(i)) for i, d in enumerate(days)] + [("y", dt.date(2000, 1, 3), 9.0)]
    df = spark.createDataFrame(rows[::-1], "key string, wk date, v double")
    p = Panel(keys=("key",), ts="wk", seg_steps=2)
    out = positional_steps(df, p).orderBy("key", "wk").collect()
    assert [(r.key, r.t, r.seg) for r in out] == [("x", 0, 0), ("x", 1, 0), ("x", 2, 1), ("x", 3, 1), ("x", 4, 2), ("y", 0, 0)]
