"""End-to-end jobs (E1-E8) composed from the operators.

Every job works on all series at once; the reference's per-city and per-run
loops become partition keys and a ``run_id`` column.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators import clean, features, scale, score, smooth, windows
from panelcast.operators.predict import ENSEMBLE
from panelcast.plans.panel import Panel, materialize, positional_steps, regularize
from panelcast.session import ensure_checkpoint_dir
from panelcast.sources import csvfiles

SEED = 42
CLIMATE_PANEL = Panel(keys=("city",), ts="week_start_date", freq="week")


@dataclass
class FeatureJob:
    """Options of the feature job (E1); defaults follow the reference."""

    target: str = "total_cases"
    drop_first: Mapping[str, int] = field(default_factory=dict)  # PR2 per series
    composites: Sequence = features.CLIMATE_COMPOSITES  # E2
    replacements: Mapping = field(default_factory=lambda: dict(features.CLIMATE_REPLACEMENTS))  # PR5
    drop_raw: bool = True  # PR4
    diff_k: int = 0  # W5 (+ W2 + EWM 5) when > 0
    normalize: bool = True  # SC1/SC2
    fit_on_train: bool = False  # Q5 option: fit the scaler on the training part only
    lags: int = 0  # W4: lags 1..lags-1 (the reference's num_weeks), then W2
    year: bool = False
    month: bool = False
    weeks: bool = False  # PR10/PR11
    test_frac: float = 0.295  # W9


def climate_panel(feat: DataFrame, labels: DataFrame | None, panel: Panel = CLIMATE_PANEL, positional: bool = True) -> DataFrame:
    """J1 + step index: features joined to labels, one row per week per city.

    ``positional`` (default, as the reference: each row is one period) numbers
    the rows of each city in date order; otherwise the dates are mapped to
    calendar weeks and missing weeks become NULL rows (spine).
    """
    d = csvfiles.join_labels(feat, labels) if labels is not None else feat.withColumn("total_cases", F.lit(None).cast("int"))
    d = d.drop("year", "weekofyear")  # PR3
    d = positional_steps(d, panel) if positional else regularize(d, panel)
    return materialize(d, panel)


def feature_job(df: DataFrame, panel: Panel, cfg: FeatureJob, stats: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """Trim, fill, composites, difference, drop groups, scale, lag, calendar, split.

    Returns (rows with ``split`` column, scaler statistics, feature names).
    ``stats`` given = transform with stored statistics (SC2, the test file).
    """
    d = clean.drop_leading(df, panel, dict(cfg.drop_first)) if cfg.drop_first else df
    d = clean.ffill(d, panel)  # W1
    d = clean.replace_values(d, cfg.replacements)  # PR5
    d = features.composites(d, panel, cfg.composites)  # E2
    d = d.drop(*features.features_to_drop(cfg.drop_raw, target="__none__"))
    d = materialize(d, panel)  # stage boundary: cut lineage, keep the (keys, seg) layout
    meas = [c for c in panel.measures(d)]
    if cfg.diff_k > 0:  # W5 + W2 + EWM(5)
        d = features.diff(d, panel, meas, cfg.diff_k)
        d = clean.bfill(d, panel, meas)
        d = smooth.ewm(d, panel, meas, 5)
        d = materialize(d, panel)
    feats = [c for c in meas if c != cfg.target]
    d = windows.chrono_split(d, panel, cfg.test_frac)
    if cfg.normalize:
        if stats is None:
            fit_rows = d.filter(F.col("split") == "train") if cfg.fit_on_train else d
            stats = scale.fit_scaler(fit_rows, panel, [*feats, cfg.target])
        d = scale.transform(d, panel, stats, [*feats, cfg.target])
    if cfg.lags > 1:  # W4 + W2
        d = features.lags(d, panel, feats, cfg.lags - 1)
        new = [f"{c}_{j}_week_back" for j in range(1, cfg.lags) for c in feats]
        d = clean.bfill(d, panel, new)
        feats = [*feats, *new]
    d = features.calendar(d, panel, cfg.year, cfg.month, False)
    if cfg.weeks:
        d = features.calendar(d, panel, False, False, True)
    feats = [*feats, *[c for c, on in (("year", cfg.year), ("month", cfg.month), ("weeks", cfg.weeks)) if on]]
    return materialize(d, panel), stats, feats


def train_and_score(d: DataFrame, panel: Panel, feats: Sequence[str], target: str, models: Sequence[str], stats: DataFrame | None, span: float = 5) -> tuple[DataFrame, DataFrame]:
    """Fit on train rows, predict test rows, EWM(span) per model, un-scale, score.

    Returns (long predictions (keys, ts, model, y, y_pred, reason), scores per model); a test row without a prediction stays, with the
    reason, and does not count in the scores."""
    from dataclasses import replace

    from panelcast.models import registry

    tr = d.filter(F.col("split") == "train").na.drop(subset=[*feats, target])
    te = d.filter(F.col("split") == "test")
    fitted = registry.fit_models(tr, panel, models, feats, target)
    pm = registry.prediction_matrix(fitted, te, keep=[*panel.keys, panel.ts, panel.t, panel.seg, target])
    mp = replace(panel, keys=(*panel.keys, "model"))
    pm = materialize(pm.withColumn("reason", _reason("y_pred")), mp)
    pm = smooth.ewm(pm, mp, ["y_pred"], span)  # W3(5) per model
    pm = pm.withColumn("y_pred", F.when(F.col("reason").isNull(), F.col("y_pred")))
    if stats is not None:  # SC3/SC4
        pm = scale.inverse(pm, panel, stats, {"y_pred": target, target: target})
    pm = pm.withColumnRenamed(target, "y")
    return pm, score.score(pm.filter("y IS NOT NULL AND y_pred IS NOT NULL"), by=("model",))


def _reason(y_pred: str) -> Column:
    """Why a row has no prediction."""
    return F.when(F.col(y_pred).isNull() | F.isnan(y_pred), F.lit("a feature or the series' model is missing"))


def run_folder(spark) -> str:
    """A new folder for forecast files below the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/panelcast-runs-{uuid.uuid4().hex}"


def forecast_runs(
    train: DataFrame,
    test: DataFrame,
    panel: Panel,
    feats: Sequence[str],
    target: str,
    template: DataFrame,
    template_keys: Sequence[str],
    stats: DataFrame | None,
    models: Sequence[str] = ("GradientBoostingRegressor",),
    runs: int = 1,
    path: str | None = None,
    overrides: dict | None = None,
    span: float = 5,
    estimator_for_run: Callable[[int], object] | None = None,
) -> DataFrame:
    """Each run fits all ``models`` (seeds differ), predicts the test rows, smooths and un-scales every model and their mean
    ``Ensamble``, attaches the mean to the template and truncates it.  With ``path`` each run is written as files of its own (IO4,
    ``path/runs/run_id=k``), all are read again (IO3) and their average (AG7) is written to ``path/average``.  ``estimator_for_run``
    gives each run's estimator (or ``trees.Spec``) for the pooled models among ``models``.

    Returns (template keys..., total_cases, runs).  A template row without a prediction stays NULL."""
    from dataclasses import replace

    from panelcast.models import registry
    from panelcast.operators import forecast

    spark = train.sparkSession
    tr = train.na.drop(subset=[*feats, target])
    keep = [*dict.fromkeys([*panel.keys, panel.ts, panel.t, panel.seg, *template_keys])]
    mp = replace(panel, keys=(*panel.keys, "model"))
    folder = path or run_folder(spark)
    for run in range(runs):
        settings = dict(overrides or {})
        if estimator_for_run:
            settings |= {name: estimator_for_run(run) for name in models if name in registry.POOLED}
        fitted = registry.fit_models(tr, panel, models, feats, target, settings, seed=SEED + run)
        pm = registry.prediction_matrix(fitted, test, keep=keep)
        pm = materialize(pm.withColumn("_why", _reason("y_pred")), mp)
        pm = smooth.ewm(pm, mp, ["y_pred"], span)
        pm = pm.withColumn("y_pred", F.when(F.col("_why").isNull(), F.col("y_pred"))).drop("_why")
        if stats is not None:
            pm = scale.inverse(pm, panel, stats, {"y_pred": target})
        one = forecast.attach(template, pm.filter(F.col("model") == ENSEMBLE), list(template_keys))
        forecast.write_runs(one.withColumn("run_id", F.lit(run)), f"{folder}/runs", mode="append")
    kinds = ", ".join(f"`{c}` {template.schema[c].dataType.simpleString()}" for c in [*template_keys])
    back = forecast.read_runs(spark, f"{folder}/runs", f"{kinds}, total_cases long, run_id int")
    mean = forecast.average_runs(back, list(template_keys))
    if path:
        forecast.write_single(mean, f"{path}/average", list(template_keys))
    return mean


def sequence_dataset(d: DataFrame, panel: Panel, feats: Sequence[str], target: str, n_steps: int, mode: str = "vanilla", path: str | None = None) -> DataFrame:
    """Sliding windows (W7), two-level for ``CNN``/``convLSTM`` (W8), optionally written as parquet."""
    src = d
    if mode == "convLSTM":
        src = clean.drop_leading(d, panel, 1)  # the reference drops the first row
    s = windows.sequences(src, panel, feats, target, n_steps)
    if mode in ("CNN", "convLSTM"):
        s = windows.split_halves(s, "x", n_steps, unit_axis=(mode == "convLSTM"))
    if path:
        s.write.mode("overwrite").parquet(path)
    return s


def var_forecast_job(train: DataFrame, test: DataFrame, panel: Panel, cols: Sequence[str], target: str, lag: int, stats: DataFrame | None, template: DataFrame | None = None, template_keys: Sequence[str] = (), span: float = 5) -> DataFrame:
    """E5: step-by-step VAR (M9), EWM(span) smoothing, un-scaling, shift to a zero
    minimum (PR14), attached to a template and truncated (J2, PR12) when given."""
    from panelcast.models import var
    from panelcast.operators import forecast

    pr = var.step_by_step(train, test, panel, cols, target, lag)
    pr = materialize(pr, panel)  # the recursion runs once; later steps read its output
    pr = smooth.ewm(pr, panel, ["y_pred"], span)
    if stats is not None:
        pr = scale.inverse(pr, panel, stats, {"y_pred": target, "y": target})
    pr = clean.shift_to_zero_min(pr, panel, ["y_pred"])
    if template is None:
        return pr
    return forecast.attach(template, pr, list(template_keys))


def additive_job(train: DataFrame, test: DataFrame, panel: Panel, target: str, regressors: Sequence[str] = (), stats: DataFrame | None = None, span: float | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Additive model (M12) per series on the train rows, test rows predicted and recombined (M13), smoothed when
    ``span`` is given, un-scaled when ``stats`` are, and scored per model (``yhat`` and ``recombined``).

    Returns (long predictions (keys, ts, model, y, y_pred), scores per model)."""
    from dataclasses import replace

    from panelcast.models import additive

    fc = additive.fit_predict(train.na.drop(subset=[target, *regressors]), test, panel, target, regressors, **options)
    both = F.explode(F.create_map(F.lit("additive"), F.col("yhat"), F.lit("additive_recombined"), additive.recombine(fc))).alias("model", "y_pred")
    pm = fc.select(*panel.keys, panel.ts, panel.t, panel.seg, target, both)
    if span is not None:
        mp = replace(panel, keys=(*panel.keys, "model"))
        pm = smooth.ewm(materialize(pm, mp), mp, ["y_pred"], span)
    if stats is not None:
        pm = scale.inverse(pm, panel, stats, {"y_pred": target, target: target})
    pm = pm.withColumnRenamed(target, "y")
    return pm, score.score(pm.filter("y IS NOT NULL AND y_pred IS NOT NULL"), by=("model",))
