"""M15 grid search with contiguous folds, IO5 best-parameter output.

Folds are contiguous blocks in time order per series (sizes as an unshuffled
k-fold split: the first ``n % k`` folds hold one extra row).  For the
per-series linear models the whole search is one cross-product pass: each
(series, fold) gets its own ``Z'Z``; the training matrix of a fold is the total
minus that fold, and the validation R^2 comes from the fold's matrix, so no
candidate ever rescans the data.  Pooled ``pyspark.ml`` models use
``CrossValidator`` with the same fold column.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.models.linear import solve_gram
from panelcast.operators.stats import cross_products, gram
from panelcast.plans.panel import Panel, with_position


def fold_of(pos: Column, n: Column, k: int) -> Column:
    """Contiguous fold index of 0-based position ``pos`` in a series of ``n`` rows."""
    q = F.floor(n / k)
    r = n - q * k
    big = (q + 1) * r
    return F.when(pos < big, F.floor(pos / (q + 1))).otherwise(r + F.floor((pos - big) / q)).cast("int")


def with_folds(df: DataFrame, panel: Panel, k: int = 3, col: str = "fold") -> DataFrame:
    d = with_position(df, panel)
    return d.withColumn(col, fold_of(F.col("_pos"), F.col("_n"), k)).drop("_pos", "_n")


def grid_linear(df: DataFrame, panel: Panel, xcols: Sequence[str], y: str, method: str, alphas: Sequence[float], k: int = 3, l1_ratio: float = 0.5) -> DataFrame:
    """Mean validation R^2 per (series, alpha) and the best alpha per series.

    Returns (keys, alpha, mean_r2, best) -- ``best`` marks the first alpha in
    grid order with the highest mean score.
    """
    keys = list(panel.keys)
    d = with_folds(df, panel, k).withColumn("_one", F.lit(1.0))
    z = ["_one", *xcols, y]
    cp = cross_products(d, [*keys, "fold"], z)
    D = len(z)
    schema = T.StructType([*[df.schema[c] for c in keys], T.StructField("alpha", T.DoubleType()), T.StructField("mean_r2", T.DoubleType()), T.StructField("best", T.BooleanType())])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        Gf = {int(f): gram(g, D) for f, g in zip(pdf["fold"], pdf["g"])}
        Nf = {int(f): float(n) for f, n in zip(pdf["fold"], pdf["n"])}
        Gt, Nt = sum(Gf.values()), sum(Nf.values())
        kv = [pdf[c].iloc[0] for c in keys]
        scores = []
        for a in alphas:
            vals = []
            for f, Gv in Gf.items():
                b0, w = solve_gram(Gt - Gv, Nt - Nf[f], method, a, l1_ratio)
                beta = np.concatenate([[b0], w])
                xx, xy, yy = Gv[:-1, :-1], Gv[:-1, -1], Gv[-1, -1]
                sse = yy - 2 * beta @ xy + beta @ xx @ beta
                sst = yy - Gv[0, -1] ** 2 / Nf[f]
                # a constant fold has sst = 0 up to cancellation noise: no variance to explain
                vals.append(1 - sse / sst if sst > 1e-9 * yy else 0.0)
            scores.append(float(np.mean(vals)))
        bi = int(np.argmax(scores))
        rows = [(*kv, float(a), s, i == bi) for i, (a, s) in enumerate(zip(alphas, scores))]
        return pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return cp.groupBy(*keys).applyInPandas(fn, schema)


def grid_pooled(df: DataFrame, panel: Panel, pooled, grid: dict, k: int = 3, metric: str = "r2"):
    """CrossValidator over a pooled pipeline; params given as ``{param_name: [values]}``."""
    d = with_folds(df, panel, k).filter(F.col(pooled.label).isNotNull())
    stages = pooled._stages()
    est = stages[-1]
    from pyspark.ml import Pipeline

    pipe = Pipeline(stages=stages)
    pg = ParamGridBuilder()
    for name, values in grid.items():
        pg = pg.addGrid(est.getParam(name), values)
    ev = RegressionEvaluator(labelCol=pooled.label, predictionCol=pooled.out, metricName=metric)
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=pg.build(), evaluator=ev, numFolds=k, foldCol="fold", parallelism=2)
    return cv.fit(d)


def write_params(best: DataFrame, path: str) -> None:
    """IO5: best parameters as JSON rows."""
    best.write.mode("overwrite").json(path)
