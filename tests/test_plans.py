"""Plan shape: ordered operators on a materialized panel do not shuffle the panel."""

import re

import pytest

from helpers import weekly_frame
from panelcast.operators import clean, features, smooth, windows
from panelcast.plans.panel import materialize


def _tree_lines(df):
    plan = df._jdf.queryExecution().executedPlan()
    # AQE wraps the plan; its initial plan has the static shape
    text = plan.toString()
    return [ln for ln in text.split("\n") if ln.strip()]


def _exchange_between_scan_and_window(df) -> bool:
    lines = _tree_lines(df)
    found = False
    for i, ln in enumerate(lines):
        if "FileScan" in ln and "panelcast_work.panel_" in ln:
            found = True
            depth = len(ln) - len(ln.lstrip(" :+-"))
            for up in range(i - 1, -1, -1):
                u = lines[up]
                d = len(u) - len(u.lstrip(" :+-"))
                if d >= depth:
                    continue
                depth = d
                if "Window" in u or "Aggregate" in u:
                    break  # a window on the panel rows, or a summary of them
                if re.search(r"\bExchange\b", u) and "BroadcastExchange" not in u:
                    return True
    assert found, "no scan of the materialized panel in the plan"
    return False


@pytest.fixture(scope="module")
def panel(spark):
    data = {k: [float(i % 7) if i % 5 else None for i in range(40)] for k in ("a", "b", "c")}
    df, p = weekly_frame(spark, data, seg_steps=8)
    return materialize(df, p), p


def test_fill_ewm_lags_sequences_do_not_shuffle_the_panel(panel):
    df, p = panel
    cases = {
        "ffill": clean.ffill(df, p, ["v"]),
        "ewm": smooth.ewm(df, p, ["v"], 5),
        "lags": features.lags(df, p, ["v"], 3),
        "sequences": windows.sequences(df, p, ["v"], "v", 3),
    }
    for name, out in cases.items():
        assert not _exchange_between_scan_and_window(out), name


def test_detector_sees_a_series_only_window_shuffle(panel):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df, p = panel
    bad = df.select("*", F.row_number().over(Window.partitionBy("key").orderBy("t")).alias("rn"))
    assert _exchange_between_scan_and_window(bad)


def test_release_drops_tables_and_files(spark):
    import os

    from panelcast.plans.panel import WORK_DB, release_materialized

    data = {"a": [1.0, 2.0, 3.0]}
    df, p = weekly_frame(spark, data, seg_steps=8)
    m = materialize(df, p)
    assert m.count() == 3
    loc = spark.sql(f"DESCRIBE DATABASE {WORK_DB}").filter("info_name = 'Location'").collect()[0].info_value
    before = len(os.listdir(loc.replace("file:", "")))
    n = release_materialized(spark)
    after = len(os.listdir(loc.replace("file:", "")))
    assert n >= 1 and after < before and spark.catalog.listTables(WORK_DB) == []
