import numpy as np

from helpers import close, ewm_ref, to_series, weekly_frame
from panelcast.operators import smooth

rng = np.random.default_rng(11)
LONG = [None if rng.random() < 0.15 else float(rng.normal(10, 3)) for _ in range(140)]
LONG[40:75] = [None] * 35  # a long gap
DATA = {"a": LONG, "b": [None, 2.0, 2.0, None, 3.0] * 6, "c": [5.0] * 30}


def test_ewm_matches_reference_with_gaps_and_carries(spark):
    for seg, block in ((1 << 16, None), (32, 8), (16, 4)):
        df, p = weekly_frame(spark, DATA, seg_steps=seg)
        for span in (4, 5, 8):
            got = to_series(smooth.ewm(df, p, ["v"], span, block=block))
            for k, x in DATA.items():
                x = np.array([np.nan if v is None else v for v in x])
                assert close(got[k], ewm_ref(x, span), tol=1e-9), (seg, block, span, k)


def test_ewm_constant_is_constant(spark):
    df, p = weekly_frame(spark, {"c": [7.25] * 50}, seg_steps=8)
    got = to_series(smooth.ewm(df, p, ["v"], 4, block=4))["c"]
    assert np.allclose(got, 7.25, rtol=0, atol=1e-12)


def test_threshold_flag(spark):
    df, p = weekly_frame(spark, {"a": [None, 0.1, 0.3, -0.2, None, 0.5]})
    got = smooth.threshold_flag(df, p, ["v"], 4, 0.195).toPandas().sort_values("wk")
    ref = ewm_ref(np.array([np.nan, 0.1, 0.3, -0.2, np.nan, 0.5]), 4)
    exp = [0 if np.isnan(v) else int(v < 0.195) for v in ref]
    assert list(got["v_flag"]) == exp


def test_ewm_several_spans_in_one_pass(spark):
    df, p = weekly_frame(spark, {"a": LONG}, seg_steps=32)
    from pyspark.sql import functions as F

    d = df.withColumn("w", F.col("v"))
    got = smooth.ewm(d, p, {"v": "e4", "w": "e8"}, {"v": 4, "w": 8}, block=8).toPandas().sort_values("wk")
    x = np.array([np.nan if v is None else v for v in LONG])
    assert close(got.e4, ewm_ref(x, 4)) and close(got.e8, ewm_ref(x, 8))
