"""Many series, missing features, gaps inside a segment, unknown master: nothing is lost or invented."""

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import functions as F

from helpers import weekly_frame
from panelcast.models import additive, knn, ml, negbin, seasonal, var
from panelcast.operators import stats
from panelcast.plans import jobs
from panelcast.plans.panel import default_buckets


def rows(spark, n_series):
    data = [(f"s{k:04d}", t, float(k + t), None if (k + t) % 7 == 0 else float(t % 5), float(k % 3)) for k in range(n_series) for t in range(6)]
    return spark.createDataFrame(data, "key string, t long, y double, a double, b double")


def test_pooled_tree_fits_a_thousand_series_and_keeps_every_row(spark):
    df = rows(spark, 1000)
    m = ml.Pooled(DecisionTreeRegressor(maxDepth=4), ["a", "b"], "y", series_col="key").fit(df)
    got = m.transform(df)
    assert got.count() == df.count()
    assert got.where("a IS NULL AND y_pred IS NOT NULL").count() == 0 and got.where("a IS NOT NULL AND y_pred IS NULL").count() == 0
    assert "y_pred" in m.transform(df.limit(0)).columns


def test_linear_pooled_model_does_not_take_the_series_number(spark):
    df = rows(spark, 40)
    m = ml.Pooled(LinearRegression(), ["a", "b"], "y", series_col="key").fit(df)
    assert m.model.stages[-1].numFeatures == 2
    assert m.transform(df).count() == df.count()


def test_recombination_adds_the_additive_components(spark):
    df = spark.createDataFrame([(6.0, 2.0, 1.0, 0.5, 1.5), (6.0, 0.0, 1.0, 0.5, 1.5)], "yhat double, trend double, yearly double, extra_regressors double, additive double")
    assert [r[0] for r in df.select(additive.recombine(df)).collect()] == [6.0, None]


def test_buckets_follow_the_data_not_an_unknown_size(spark):
    assert 1 <= default_buckets(rows(spark, 3)) <= 8 and isinstance(default_buckets(spark.range(3).toDF("x")), int)


def two_series(spark, long=60, short=1, seg=16):
    """A long series and one whose first ``short`` weeks are training rows; the last five weeks are the test rows."""
    rng = np.random.default_rng(3)
    df, p = weekly_frame(spark, {"long": list(rng.normal(size=long + 5)), "short": list(rng.normal(size=short + 5))}, seg_steps=seg)
    df = df.withColumn("w", F.sin(F.col("t") * 1.3) + F.col("v") / 3)
    ends = df.groupBy("key").agg(F.max("t").alias("end"))
    df = df.join(ends, "key").withColumn("test", F.col("t") > F.col("end") - 5).drop("end")
    return df.filter("NOT test").drop("test"), df.filter("test").drop("test"), p


def test_short_series_keep_their_rows_with_a_reason(spark):
    tr, te, p = two_series(spark)
    for got, col in ((var.forecast(tr, te, p, ["v", "w"], 2), "v_fc"), (var.step_by_step(tr, te, p, ["w", "v"], "v", 2), "y_pred")):
        got = got.collect()
        assert len(got) == 10
        for r in got:
            assert (r[col] is None, r["reason"]) == ((True, "short history") if r["key"] == "short" else (False, None))
    tr, te, p = two_series(spark, 160, 25, 64)
    got = seasonal.seasonal_ar_search(tr, te, p, "v", ["w"], m=52, max_p=3).collect()
    assert len(got) == 10
    for r in got:
        assert (r["y_pred"] is None, r["p"] is None, r["reason"]) == ((True, True, "short history") if r["key"] == "short" else (False, False, None))


def test_series_without_training_rows_keep_their_rows(spark):
    tr, te, p = two_series(spark)
    tr = tr.filter("key = 'long'")
    assert var.forecast(tr, te, p, ["v", "w"], 1).filter("key = 'short' AND v_fc IS NULL AND reason = 'short history'").count() == 5
    assert var.step_by_step(tr, te, p, ["w", "v"], "v", 1).filter("key = 'short' AND y_pred IS NULL").count() == 5
    assert seasonal.seasonal_ar_search(tr, te, p, "v", m=4, max_p=2).filter("key = 'short' AND y_pred IS NULL").count() == 5


def test_missing_horizon_values_are_not_invented(spark):
    tr, te, p = two_series(spark)
    tr, te = tr.filter("key = 'long'"), te.filter("key = 'long'")
    first = te.agg(F.min("t")).first()[0]
    gap = te.withColumn("w", F.when(F.col("t") != first + 2, F.col("w")))
    got = var.forecast(tr, gap, p, ["v"], 1, exog=["w"]).orderBy("wk").collect()
    assert [r.v_fc is None for r in got] == [False, False, True, True, True] and got[2].reason == "missing values"
    sbs = var.step_by_step(tr, gap.withColumn("v", F.when(F.col("t") != first, F.col("v"))), p, ["w", "v"], "v", 1).orderBy("wk").collect()
    assert all(r.y_pred is not None for r in sbs) and sbs[0].y is None and sbs[1].y is not None


def test_job_keeps_the_step_index_of_positional_panels(spark):
    tr, te, p = two_series(spark)
    moved = lambda d: d.withColumn("t", F.col("t") + 7).withColumn("seg", F.floor((F.col("t")) / 16).cast(d.schema["seg"].dataType))
    a = jobs.var_forecast_job(tr, te, p, ["w", "v"], "v", 1, None).filter("key = 'long'").orderBy("wk").collect()
    b = jobs.var_forecast_job(moved(tr), moved(te), p, ["w", "v"], "v", 1, None).filter("key = 'long'").orderBy("wk").collect()
    assert [y.t - x.t for x, y in zip(a, b)] == [7] * 5
    assert np.allclose([r.y_pred for r in a], [r.y_pred for r in b])


def test_negative_binomial_says_which_fits_converged(spark):
    tr, _, p = two_series(spark)
    df = tr.filter("key = 'long'").withColumn("y", F.round(F.exp(1 + F.col("w") / 2)).cast("long"))
    done = negbin.fit(df, p, ["w"], "y", [1e-6, 1e-4]).collect()
    assert all(r.converged and r.iterations < 30 for r in done) and len(done) == 2
    cut = negbin.fit(df, p, ["w"], "y", [1e-6], max_iter=2).collect()
    assert [(r.converged, r.iterations) for r in cut] == [(False, 2)]


def test_knn_answers_every_query_however_far(spark):
    tr = spark.createDataFrame([("a", i, float(i % 50) / 50, float(i)) for i in range(400)] + [("a", 400, 1e15, 1.0)], "k string, t long, f double, y double")
    q = spark.createDataFrame([("a", 1000 + i, x) for i, x in enumerate((0.5, 1e15, -1e15, 3e14))], "k string, t long, f double")
    assert knn.knn_regress(tr, q, ["k"], "t", ["f"], "y", k=20).count() == 4


def test_johansen_level_and_missing_critical_values(spark):
    tr, _, p = two_series(spark)
    tr = tr.filter("key = 'long'")
    a, b = (stats.johansen(tr, p, ["v", "w"], 1, signif=s).orderBy("rank").collect() for s in (0.1, 0.01))
    assert a[0].crit_90 < b[0].crit_99 and a[0].trace == b[0].trace
    with pytest.raises(ValueError):
        stats.johansen(tr, p, list("abcdef"), 1)


def test_additive_job_scores_both_forms(spark):
    tr, te, p = two_series(spark, 80, 40)
    pred, scores = jobs.additive_job(tr.withColumn("v", F.col("v") + 20), te.withColumn("v", F.col("v") + 20), p, "v", ["w"], n_changepoints=3, yearly_order=2)
    assert pred.count() == 20 and {r.model for r in scores.collect()} == {"additive", "additive_recombined"}


def test_buckets_do_not_follow_the_estimate_of_a_checkpointed_join(spark):
    a = spark.range(1000).selectExpr("id % 7 AS k", "id AS v")
    joined = a.join(a.withColumnRenamed("v", "w"), "k").join(a.withColumnRenamed("v", "x"), "k").limit(100).checkpoint(eager=True)
    assert default_buckets(joined.join(joined.select("k").distinct(), "k")) <= 8
