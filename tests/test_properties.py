"""Randomised checks: results do not depend on segment / block sizes or row order."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import bfill_ref, close, ewm_ref, ffill_ref, to_series, weekly_frame
from panelcast.operators import clean, features, smooth

series = st.lists(st.one_of(st.none(), st.floats(-50, 50, allow_nan=False).map(lambda v: round(v, 3))), min_size=1, max_size=40)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=series, b=series, seg=st.sampled_from([2, 4, 8, 1 << 16]), block=st.sampled_from([1, 2, 4, None]), span=st.sampled_from([2.0, 4.0, 5.0, 8.0]), seed=st.integers(0, 99))
def test_fill_ewm_lag_against_references(spark, a, b, seg, block, span, seed):
    data = {"a": a, "b": b}
    df, p = weekly_frame(spark, data, shuffle_seed=seed, seg_steps=seg)
    f = to_series(clean.ffill(df, p, ["v"]))
    bf = to_series(clean.bfill(df, p, ["v"]))
    e = to_series(smooth.ewm(df, p, ["v"], span, block=block))
    lg = features.lags(df, p, ["v"], 2, fmt="{col}_l{j}").toPandas().sort_values(["key", "wk"])
    for k, vals in data.items():
        x = np.array([np.nan if v is None else v for v in vals])
        assert close(f[k], ffill_ref(x))
        assert close(bf[k], bfill_ref(x))
        assert close(e[k], ewm_ref(x, span), tol=1e-8)
        g = lg[lg.key == k]
        assert close(g["v_l1"], np.concatenate([[np.nan], x[:-1]]))
        assert close(g["v_l2"], np.concatenate([[np.nan, np.nan], x[:-2]])[: len(x)])
