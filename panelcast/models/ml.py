"""Pooled ``pyspark.ml`` regressors (M1f, M1g, M2f) with the reference's presets; :func:`model` also gives the tree models of :mod:`panelcast.models.trees`.

These estimators fit one model per DataFrame, so they are fitted once over all
series: the series key enters as an indexed feature (trees can split on it).
Features are assembled JVM-side with ``VectorAssembler``; nothing is collected.

Re-aimed presets (no exact Spark counterpart):
* SGD -> least squares with a small L2 term by L-BFGS;
* AdaBoost.R2 -> a driver loop of weighted depth-3 trees (below).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.models import trees

SEED = 42


def preset(name: str):
    """Estimator for a registry name with the reference's hyper-parameters."""
    if name == "HuberRegressor":
        return LinearRegression(loss="huber", epsilon=1.35, regParam=1e-4, elasticNetParam=0.0, maxIter=2000)
    if name == "SGDRegressor":
        return LinearRegression(solver="l-bfgs", regParam=1e-4, elasticNetParam=0.0, maxIter=2000, tol=1e-3)
    raise KeyError(name)


def model(name: str, features: Sequence[str], label: str, series_col: str | None = None, key_cols: Sequence[str] = (), seed: int | None = None, estimator=None):
    """An unfitted pooled model for a registry name.  ``key_cols`` name a row (draws of tree models hash them); ``estimator``: other settings,
    a ``Spec`` or a ``pyspark.ml`` estimator."""
    if name in trees.PRESETS and (estimator is None or isinstance(estimator, trees.Spec)):
        spec = estimator or trees.PRESETS[name]
        return trees.TreeModel(spec if seed is None else replace(spec, seed=seed), features, label, series_col, key_cols)
    return Pooled(estimator or preset(name), features, label, series_col=series_col)


@dataclass
class Pooled:
    """A pooled model: ``fit`` once, ``transform`` any panel rows."""

    estimator: object
    features: Sequence[str]
    label: str
    series_col: str | None = None
    out: str = "y_pred"
    model: PipelineModel | None = None

    def _stages(self):
        cols = list(self.features)
        st = []
        # a linear model must not take the series number as a quantity
        if self.series_col and not isinstance(self.estimator, LinearRegression):
            st.append(StringIndexer(inputCol=self.series_col, outputCol="_series_idx", handleInvalid="keep"))
            cols = [*cols, "_series_idx"]
        st.append(VectorAssembler(inputCols=cols, outputCol="_features", handleInvalid="keep"))
        est = self.estimator.copy()
        est.setFeaturesCol("_features").setLabelCol(self.label).setPredictionCol(self.out)
        st.append(est)
        return st

    def _complete(self) -> Column:
        """Rows that have every feature."""
        ok = F.lit(True)
        for c in self.features:
            ok = ok & F.col(c).isNotNull()
        return ok

    def fit(self, df: DataFrame) -> "Pooled":
        d = df.filter(F.col(self.label).isNotNull() & self._complete())
        if self.series_col and self.estimator.hasParam("maxBins"):
            # a categorical feature needs a bin per value (and one for values unseen in training)
            n = d.agg(F.countDistinct(self.series_col)).first()[0]
            self.estimator = self.estimator.copy({self.estimator.maxBins: max(self.estimator.getMaxBins(), n + 1)})
        self.model = Pipeline(stages=self._stages()).fit(d)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Every row of ``df``; a row with a missing feature gets a NULL prediction."""
        out = self.model.transform(df)
        return out.withColumn(self.out, F.when(self._complete(), F.col(self.out))).drop("_features", "_series_idx")

    def save(self, path: str) -> None:
        """IO6: one saved version."""
        self.model.write().overwrite().save(path)

    @staticmethod
    def load(path: str, features, label, series_col=None, out="y_pred") -> "Pooled":
        p = Pooled(None, features, label, series_col, out)
        p.model = PipelineModel.load(path)
        return p


def _weighted_median(preds: Column, weights: list[float]) -> Column:
    """Weighted median of an array of per-estimator predictions (AdaBoost.R2 combine)."""
    pairs = F.arrays_zip(preds.alias("p"), F.array(*[F.lit(w) for w in weights]).alias("w"))
    srt = F.array_sort(pairs, lambda a, b: F.when(a["p"] < b["p"], -1).when(a["p"] > b["p"], 1).otherwise(0))
    half = 0.5 * sum(weights)
    cum = F.aggregate(
        srt,
        F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("m")),
        lambda acc, x: F.struct(
            (acc["c"] + x["w"]).alias("c"),
            F.when(acc["m"].isNull() & (acc["c"] + x["w"] >= F.lit(half)), x["p"]).otherwise(acc["m"]).alias("m"),
        ),
    )
    return cum["m"]


class AdaBoostR2:
    """M2f: AdaBoost.R2 with exponential loss on a pooled panel.

    Each round fits a depth-3 tree with the row weights as ``weightCol``, scores
    every row, and updates the weights with one aggregate (max error, weighted
    loss) and one column expression.  The weighted data is checkpointed every
    round to the session's checkpoint folder, so lineage stays short and an
    executor loss costs one round.
    """

    def __init__(self, features: Sequence[str], label: str, n_estimators: int = 7, learning_rate: float = 0.01, max_depth: int = 3, series_col: str | None = None, seed: int = SEED):
        self.features, self.label = list(features), label
        self.n, self.lr, self.depth, self.series_col, self.seed = n_estimators, learning_rate, max_depth, series_col, seed
        self.models: list[Pooled] = []
        self.weights: list[float] = []

    def fit(self, df: DataFrame) -> "AdaBoostR2":
        from panelcast.session import ensure_checkpoint_dir

        ensure_checkpoint_dir(df.sparkSession)
        d = df.filter(F.col(self.label).isNotNull())
        total = d.count()
        d = d.withColumn("_w", F.lit(1.0 / total)).checkpoint(eager=True)
        for i in range(self.n):
            est = DecisionTreeRegressor(maxDepth=self.depth, seed=self.seed + i, weightCol="_w")
            m = Pooled(est, self.features, self.label, self.series_col, out="_p").fit(d)
            scored = m.transform(d).withColumn("_err", F.abs(F.col("_p") - F.col(self.label)))
            emax = scored.agg(F.max("_err")).collect()[0][0] or 0.0
            if emax <= 0:
                self.models.append(m)
                self.weights.append(1.0)
                break
            loss = 1 - F.exp(-F.col("_err") / F.lit(emax))
            scored = scored.withColumn("_loss", loss)
            werr = scored.agg(F.sum(F.col("_w") * F.col("_loss")) / F.sum("_w")).collect()[0][0]
            if werr >= 0.5:
                if not self.models:
                    self.models.append(m)
                    self.weights.append(1.0)
                break
            beta = werr / (1 - werr)
            self.models.append(m)
            self.weights.append(self.lr * math.log(1 / beta))
            d = scored.select(*df.columns, (F.col("_w") * F.pow(F.lit(beta), (1 - F.col("_loss")) * self.lr)).alias("_w"))
            d = d.withColumn("_w", F.col("_w")).checkpoint(eager=True)
        return self

    def transform(self, df: DataFrame, out: str = "y_pred") -> DataFrame:
        d = df
        names = []
        for i, m in enumerate(self.models):
            d = m.transform(d).withColumnRenamed("_p", f"_p{i}")
            names.append(f"_p{i}")
        med = _weighted_median(F.array(*[F.col(n) for n in names]), self.weights)
        return d.withColumn(out, med).drop(*names)
