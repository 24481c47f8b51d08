"""M5 negative binomial GLM (log link) by IRLS and M4 dispersion search.

Variance ``mu + alpha mu^2``.  Each IRLS step is one distributed weighted
cross-product pass (rows scaled by ``sqrt(w)``, ``w = mu / (1 + alpha mu)``,
working response ``eta + (y - mu)/mu``) and a small solve per series (and per
``alpha`` when several are fitted together).  The coefficient table is
checkpointed every step, so the lineage stays one join deep and a lost
executor recomputes one step, not the whole loop.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.stats import cross_products, gram
from panelcast.plans.panel import Panel, attach_series
from panelcast.session import ensure_checkpoint_dir

# The dispersion grid 1e-8 .. 1e-4.
ALPHA_GRID = [10.0**e for e in range(-8, -3)]


def _eta(xcols: Sequence[str]):
    e = F.col("_b")[0]
    for i, x in enumerate(xcols):
        e = e + F.col("_b")[i + 1] * F.col(x)
    return e


def fit(df: DataFrame, panel: Panel, xcols: Sequence[str], y: str, alphas: Sequence[float] = (1e-8,), max_iter: int = 30, tol: float = 1e-9) -> DataFrame:
    """Fit per (series, alpha): (keys, alpha, coef[intercept, x...], iterations, converged).

    A fit takes part in the rounds until its largest coefficient change is below ``tol``; one that diverges has
    NULL coefficients, and one still moving after ``max_iter`` rounds has ``converged`` false.
    Rejects negative targets (Q14): counts only.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = list(panel.keys)
    xcols = list(xcols)
    if df.filter(F.col(y) < 0).limit(1).count():
        raise ValueError("negative binomial needs counts; the target has negative values")
    base = df.select(*panel.keys, panel.t, panel.seg, *xcols, F.col(y).cast("double").alias("_y")).dropna()
    # every row once per candidate dispersion (a fixed, short parameter list)
    base = base.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    grp = [*keys, "alpha"]
    # start: mu = (y + mean(y)) / 2
    my = base.groupBy(*grp).agg(F.avg("_y").alias("_my"))
    cur = base.join(my, grp).withColumn("_mu", (F.col("_y") + F.col("_my")) / 2).drop("_my")
    D = len(xcols) + 2
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("alpha", T.DoubleType()), T.StructField("_b", T.ArrayType(T.DoubleType()))])

    def solve(it):
        for pdf in it:
            rows = []
            for _, r in pdf.iterrows():
                G = gram(r["g"], D)
                b = np.linalg.lstsq(G[:-1, :-1], G[:-1, -1], rcond=None)[0] if np.isfinite(G).all() else None
                rows.append((*[r[k] for k in keys], float(r["alpha"]), None if b is None else [float(v) for v in b]))
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    state = open_ = None
    change = F.aggregate(F.zip_with("_b", "_old", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, v: F.greatest(acc, v))
    for it in range(1, max_iter + 1):
        if open_ is not None:
            cur = base.join(open_.select(*grp, "_b"), grp).withColumn("_mu", F.exp(_eta(xcols))).drop("_b")
        mu = F.col("_mu")
        w = mu / (1 + F.col("alpha") * mu)
        zw = F.log(mu) + F.try_divide(F.col("_y") - mu, mu)
        sw = F.sqrt(w)
        wz = cur.select(*grp, (sw).alias("_c0"), *[(sw * F.col(x)).alias(f"_c{i + 1}") for i, x in enumerate(xcols)], (sw * zw).alias("_cz"))
        cp = cross_products(wz, grp, ["_c0", *[f"_c{i + 1}" for i in range(len(xcols))], "_cz"])
        new = cp.mapInPandas(solve, schema)
        if state is None:
            state = new.select(*grp, "_b", F.lit(False).alias("converged"), F.lit(it).alias("iterations"))
        else:
            step = open_.select(*grp, F.col("_b").alias("_old")).join(new, grp, "left")
            step = step.select(*grp, "_b", F.coalesce(change < tol, F.lit(False)).alias("converged"), F.lit(it).alias("iterations"))
            state = state.filter("converged OR _b IS NULL").unionByName(step)
        state = state.checkpoint(eager=True)
        open_ = state.filter("NOT converged AND _b IS NOT NULL")
        if open_.isEmpty():
            break
    return state.select(*grp, F.col("_b").alias("coef"), "iterations", "converged")


def predict(df: DataFrame, panel: Panel, coefs: DataFrame, xcols: Sequence[str], out: str = "y_pred") -> DataFrame:
    """``exp(intercept + x . coef)``; one row per input row and fitted alpha."""
    c = coefs.filter("coef IS NOT NULL").select(*panel.keys, "alpha", F.col("coef").alias("_b"))
    per = c.groupBy(*panel.keys).agg(F.collect_list(F.struct("alpha", "_b")).alias("_fits"))
    d = attach_series(df, panel, per).select("*", F.explode("_fits").alias("_f")).drop("_fits")
    d = d.select("*", F.col("_f.alpha").alias("alpha"), F.col("_f._b").alias("_b")).drop("_f")
    return d.withColumn(out, F.exp(_eta(list(xcols)))).drop("_b")


def search(train: DataFrame, test: DataFrame, panel: Panel, xcols: Sequence[str], y: str, alphas: Sequence[float] = ALPHA_GRID) -> DataFrame:
    """M4: fit every alpha, score int-truncated test predictions by MAE, keep the
    best alpha per series (ties: the smallest alpha).  Returns (keys, best_alpha, best_mae)."""
    from panelcast.operators.score import best_candidate

    coefs = fit(train, panel, xcols, y, alphas)
    pr = predict(test, panel, coefs, xcols)
    sc = pr.groupBy(*panel.keys, "alpha").agg(F.avg(F.abs(F.col("y_pred").try_cast("bigint") - F.col(y))).alias("mae"))
    return best_candidate(sc, panel.keys, "alpha", "mae")
