"""End-to-end jobs on a small weekly climate-style fixture written as CSV."""

import datetime as dt
import os
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelcast.operators.features import RAW_FEATURES
from panelcast.plans import jobs
from panelcast.sources import csvfiles


def _write_fixture(d, n=60):
    rng = np.random.default_rng(0)
    feats, labs = [], []
    for city, start in (("sj", dt.date(1990, 4, 30)), ("iq", dt.date(2000, 7, 3))):
        for i in range(n):
            day = start + dt.timedelta(days=7 * i)
            iso = day.isocalendar()
            row = {"city": city, "year": iso[0], "weekofyear": iso[1], "week_start_date": day.isoformat()}
            for c in RAW_FEATURES:
                row[c] = None if rng.random() < 0.1 else float(rng.normal(20, 5))
            feats.append(row)
            labs.append({"city": city, "year": iso[0], "weekofyear": iso[1], "total_cases": int(rng.poisson(10 + 5 * np.sin(i / 8)))})
    # columns shuffled on disk; labels in another order
    fdf = pd.DataFrame(feats)
    fdf = fdf[["week_start_date", "city", "weekofyear", "year", *RAW_FEATURES[::-1]]]
    fdf.to_csv(f"{d}/features.csv", index=False)
    pd.DataFrame(labs).sample(frac=1, random_state=1).to_csv(f"{d}/labels.csv", index=False)


def test_feature_job_train_score_forecast(spark):
    d = tempfile.mkdtemp(prefix="climate-", dir=os.environ.get("TMPDIR", "/tmp"))
    _write_fixture(d)
    f = csvfiles.read_features(spark, f"{d}/features.csv")
    lab = csvfiles.read_labels(spark, f"{d}/labels.csv")
    assert dict(f.dtypes)["week_start_date"] == "date"
    panel_df = jobs.climate_panel(f, lab)
    cfg = jobs.FeatureJob(drop_first={"iq": 5}, lags=3, month=True, weeks=True, test_frac=0.25)
    rows, stats, feats = jobs.feature_job(panel_df, jobs.CLIMATE_PANEL, cfg)
    assert {"vegetazione", "temperature", "umidita", "precipitazioni"} <= set(feats)
    assert "vegetazione_2_week_back" in feats and "weeks" in feats
    counts = {(r.city, r.split): r["count"] for r in rows.groupBy("city", "split").count().collect()}
    assert counts[("sj", "test")] == 15 and counts[("iq", "train")] + counts[("iq", "test")] == 55
    pm, sc = jobs.train_and_score(rows, jobs.CLIMATE_PANEL, feats, "total_cases", ["LinearRegression", "ridge"], stats)
    models = {r.model for r in sc.collect()}
    assert models == {"LinearRegression", "ridge", "Ensamble"}
    # un-scaled predictions are on the count scale
    assert pm.agg(F.avg("y")).collect()[0][0] > 3
    tr = rows.filter("split = 'train'")
    te = rows.filter("split = 'test'").withColumn("year", F.year("week_start_date")).withColumn("weekofyear", F.weekofyear("week_start_date"))
    tmpl = te.select("city", "year", "weekofyear", F.lit(0).alias("total_cases"))
    from pyspark.ml.regression import DecisionTreeRegressor

    out = jobs.forecast_runs(tr, te, jobs.CLIMATE_PANEL, feats, "total_cases", tmpl, ["city", "year", "weekofyear"], stats, runs=2, estimator_for_run=lambda k: DecisionTreeRegressor(maxDepth=3, seed=k))
    o = out.collect()
    assert len(o) == tmpl.count() and all(r.runs == 2 for r in o)
    seq = jobs.sequence_dataset(rows, jobs.CLIMATE_PANEL, feats[:3], "total_cases", 4, mode="convLSTM")
    first = seq.first()
    assert len(first.x) == 2 and len(first.x[0]) == 1 and len(first.x[0][0]) == 2
