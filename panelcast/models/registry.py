"""M14 model registry and fitting, M16 prediction matrix.

Names follow the reference's registry.  Linear names are fitted per series from
cross-products; tree/boosting names are pooled ``pyspark.ml`` models with the
series key as an indexed feature.  ``fit_models`` returns objects with a
``transform(df) -> df + y_pred`` method, so the prediction matrix is a union.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.models import knn, linear, ml, negbin, seasonal
from panelcast.plans.panel import Panel

# Registry names of the per-series linear models and their settings.
LINEAR = {
    "LinearRegression": ("ols", {}),
    "ridge": ("ridge", {"alpha": 1.0}),
    "lasso": ("lasso", {"alpha": 1.0}),
    "ElasticNet": ("enet", {"alpha": 1.0, "l1_ratio": 0.5}),
    "LassoLars": ("lasso", {"alpha": 0.5}),
}
# Registry names of the pooled tree / boosting / robust models.
POOLED = [
    "DecisionTreeRegressor",
    "RandomForestRegressor",
    "ExtraTreesRegressor",
    "ExtraTreeRegressor",
    "BaggingRegressor",
    "GradientBoostingRegressor",
    "XGBRegressor",
    "LGBMRegressor",
    "HuberRegressor",
    "SGDRegressor",
]
ADABOOST = "AdaBoostRegressor"
# Registry names of the models that predict whole stretches of a series, and their settings.
STEPWISE = {
    "KNeighborsRegressor": {"k": 20},
    "NegativeBinomial": {"alpha": 1e-8},
    "SARIMAX": {},
    "SARIMAX_auto": {"m": 52, "max_p": 10},
}
NAMES = [*LINEAR, *POOLED, ADABOOST, *STEPWISE]


@dataclass
class LinearFitted:
    panel: Panel
    coefs: DataFrame
    features: Sequence[str]

    def transform(self, df: DataFrame, out: str = "y_pred") -> DataFrame:
        return linear.predict(df, self.panel, self.coefs, self.features, out)


@dataclass
class Stepwise:
    """A model that answers all rows asked for at once; rows it has no answer for get NULL."""

    panel: Panel
    run: Callable[[DataFrame], DataFrame]

    def transform(self, df: DataFrame, out: str = "y_pred") -> DataFrame:
        on = [*self.panel.keys, self.panel.ts]
        return df.drop(out).join(self.run(df).select(*on, F.col("y_pred").alias(out)), on, "left")


def _stepwise(name: str, train: DataFrame, panel: Panel, features: Sequence[str], label: str, options: dict) -> Stepwise:
    xs, keys = list(features), list(panel.keys)
    if name == "KNeighborsRegressor":
        return Stepwise(panel, lambda df: knn.knn_regress(train, df, keys, panel.ts, xs, label, **options))
    if name == "NegativeBinomial":
        coefs = negbin.fit(train, panel, xs, label, [options["alpha"]])
        return Stepwise(panel, lambda df: negbin.predict(df, panel, coefs, xs))
    if name == "SARIMAX":
        coefs = seasonal.diffreg_fit(train, panel, xs, label)
        return Stepwise(panel, lambda df: seasonal.diffreg_forecast(train, df, panel, xs, label, coefs))
    return Stepwise(panel, lambda df: seasonal.seasonal_ar_search(train, df, panel, label, xs, **options))


def fit_models(train: DataFrame, panel: Panel, names: Sequence[str], features: Sequence[str], label: str, overrides: dict | None = None, seed: int | None = None) -> dict:
    """Fit every chosen model.  ``overrides`` maps a name to a ready estimator or a
    ``trees.Spec`` for pooled models, to a dict of settings for those of ``STEPWISE``; ``seed`` is that of tree models."""
    overrides = overrides or {}
    out = {}
    for name in names:
        if name in LINEAR:
            method, kw = LINEAR[name]
            out[name] = LinearFitted(panel, linear.fit(train, panel, features, label, method=method, **kw), features)
        elif name in POOLED:
            out[name] = ml.model(name, features, label, panel.keys[0], [*panel.keys, panel.ts], seed, overrides.get(name)).fit(train)
        elif name in STEPWISE:
            out[name] = _stepwise(name, train, panel, features, label, {**STEPWISE[name], **overrides.get(name, {})})
        elif name == ADABOOST:
            out[name] = ml.AdaBoostR2(features, label, series_col=panel.keys[0]).fit(train)
        else:
            raise KeyError(f"unknown model {name}; known: {NAMES}")
    return out


def prediction_matrix(fitted: dict, test: DataFrame, keep: Sequence[str], ensemble: bool = True) -> DataFrame:
    """M16 + AG10: long (keep..., model, y_pred) with the ensemble mean appended."""
    from panelcast.operators.predict import ensemble as add_ensemble

    parts = [f.transform(test).select(*keep, F.lit(name).alias("model"), F.col("y_pred").cast("double").alias("y_pred")) for name, f in fitted.items()]
    pr = parts[0]
    for p in parts[1:]:
        pr = pr.unionByName(p)
    return add_ensemble(pr, by=keep) if ensemble else pr
