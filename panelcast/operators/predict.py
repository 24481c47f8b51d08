"""Prediction tables: AG10 ensemble mean, M16 prediction matrix, M17 version average.

Predictions are kept long -- ``(keys..., ts, model, y_pred)`` -- so any number
of models is one column, the ensemble is one ``groupBy`` and the wide matrix a
``pivot``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENSEMBLE = "Ensamble"


def ensemble(pred: DataFrame, by: Sequence[str], model: str = "model", y_pred: str = "y_pred", name: str = ENSEMBLE, keep: Sequence[str] = ()) -> DataFrame:
    """AG10: mean over models per row key (missing predictions skipped), appended as model ``name``."""
    ens = pred.groupBy(*by).agg(*[F.first(k).alias(k) for k in keep], F.avg(y_pred).alias(y_pred)).withColumn(model, F.lit(name))
    return pred.unionByName(ens.select(*pred.columns))


def wide(pred: DataFrame, by: Sequence[str], models: Sequence[str], model: str = "model", y_pred: str = "y_pred") -> DataFrame:
    """M16 wide form: one column per model (model names given, so no extra job)."""
    return pred.groupBy(*by).pivot(model, list(models)).agg(F.first(y_pred))


def matrix(fitted: dict, df: DataFrame, by: Sequence[str], y_pred: str = "y_pred") -> DataFrame:
    """Apply every fitted model (``name -> callable(df) -> df with y_pred``) and
    stack the outputs long, tagged by model name."""
    parts = [f(df).select(*by, F.lit(name).alias("model"), F.col(y_pred)) for name, f in fitted.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def version_average(pred: DataFrame, by: Sequence[str], version: str = "version", y_pred: str = "y_pred") -> DataFrame:
    """Average the predictions of several saved versions of a model."""
    return pred.groupBy(*by).agg(F.avg(y_pred).alias(y_pred), F.count(version).alias("versions"))


def walk_forward(
    df,
    panel,
    xcols,
    y,
    method: str = "ols",
    frame_frac: float = 0.2,
    test_frac: float = 0.3,
    expanding: bool = False,
    span: float = 5,
    stats=None,
    alpha: float = 1.0,
):
    """Walk-forward training with per-frame fits (W11), predictions smoothed
    with EWM(span) inside each frame's validation rows, optionally un-scaled with
    scaler statistics, scored per frame (AG2) and averaged (AG3).

    ``expanding`` trains frame f on the training rows of frames <= f, else on frame f alone; the
    model of a frame is read off the running sum of the frames' cross products.  Returns (scores, mean).
    """
    from dataclasses import replace

    from pyspark.sql import functions as F

    from panelcast.models import linear
    from panelcast.operators import scale as scl
    from panelcast.operators import score as scr
    from panelcast.operators.smooth import ewm
    from panelcast.operators.windows import frames

    fr = frames(df, panel, frame_frac, test_frac).filter(F.col("frame").isNotNull())
    train = fr.filter(F.col("part") == "train")
    coefs = linear.fit(train, panel, xcols, y, method=method, alpha=alpha, by=["frame"], running=expanding)
    test = fr.filter(F.col("part") == "test")
    pr = linear.predict(test, panel, coefs, xcols, by=["frame"])
    fpanel = replace(panel, keys=(*panel.keys, "frame"))
    pr = ewm(pr.select(*fpanel.keys, panel.ts, panel.t, panel.seg, y, "y_pred"), fpanel, ["y_pred"], span)
    if stats is not None:
        pr = scl.inverse(pr, panel, stats, {"y_pred": y, y: y})
    sc = scr.score(pr.withColumnRenamed(y, "y"), by=[*panel.keys, "frame"], digits=None)
    return sc, scr.mean_score(sc, by=list(panel.keys))


def walk_forward_models(
    df,
    panel,
    names: Sequence[str],
    xcols: Sequence[str],
    y: str,
    frame_frac: float = 0.2,
    test_frac: float = 0.3,
    expanding: bool = False,
    carry: bool = False,
    span: float = 5,
    stats=None,
    overrides: dict | None = None,
):
    """M18 for any model of the registry: frame by frame, every model is fitted on the frame's training rows (``expanding``: on those of all frames
    so far) and predicts its test rows; predictions are smoothed inside a frame, optionally un-scaled, and scored per frame and model.

    ``carry``: boosted models go on from frame to frame - the next frame's trees are fitted to what the trees so far leave of its
    labels, and all of them predict.  Other models hold no state to go on from and are fitted anew.
    Returns (scores, mean per model)."""
    from dataclasses import replace

    from panelcast.models import registry
    from panelcast.models.ml import model as pooled
    from panelcast.models.trees import PRESETS, Chain, Spec
    from panelcast.operators import scale as scl
    from panelcast.operators import score as scr
    from panelcast.operators.smooth import ewm
    from panelcast.operators.windows import frames
    from panelcast.plans.panel import materialize

    fr = materialize(frames(df, panel, frame_frac, test_frac).filter(F.col("frame").isNotNull()), panel)
    last = fr.agg(F.max("frame")).first()[0]
    keep = [*panel.keys, panel.ts, panel.t, panel.seg, y, "frame"]
    chains = {}
    if carry:
        for name in names:
            spec = (overrides or {}).get(name) or PRESETS.get(name)
            if isinstance(spec, Spec) and spec.boost:
                chains[name] = Chain(lambda name=name, spec=spec: pooled(name, xcols, y, panel.keys[0], [*panel.keys, panel.ts], estimator=spec))
    parts = []
    for k in range((last if last is not None else -1) + 1):
        seen = (F.col("frame") <= k) if expanding else (F.col("frame") == k)
        train = fr.filter((F.col("part") == "train") & seen)
        test = fr.filter((F.col("part") == "test") & (F.col("frame") == k))
        fitted = registry.fit_models(train, panel, [n for n in names if n not in chains], xcols, y, overrides)
        fitted.update({n: c.fit(fr.filter((F.col("part") == "train") & (F.col("frame") == k))) for n, c in chains.items()})
        parts.append(registry.prediction_matrix({n: fitted[n] for n in names}, test, keep=keep))
    pr = parts[0]
    for p in parts[1:]:
        pr = pr.unionByName(p)
    fpanel = replace(panel, keys=(*panel.keys, "frame", "model"))
    pr = materialize(pr, fpanel)
    gone = F.col("y_pred").isNull() | F.isnan("y_pred")
    pr = ewm(pr.filter(~gone), fpanel, ["y_pred"], span)
    if stats is not None:
        pr = scl.inverse(pr, panel, stats, {"y_pred": y, y: y})
    sc = scr.score(pr.withColumnRenamed(y, "y").filter("y IS NOT NULL"), by=["model", "frame"], digits=None)
    return sc, scr.mean_score(sc, by=["model"])


def save_versions(models: list, root: str) -> list[str]:
    """IO6: save fitted pooled models as ``{root}/version={k}``."""
    paths = []
    for k, m in enumerate(models):
        p = f"{root.rstrip('/')}/version={k}"
        m.save(p)
        paths.append(p)
    return paths


def average_versions(paths: list[str], df, features, label: str, by, series_col: str | None = None, unfitted=None):
    """Load every saved version, predict ``df`` with each, average per row key.
    ``unfitted`` makes a model to load a version into (tree models); by default ``pyspark.ml`` pipelines are loaded."""
    from pyspark.sql import functions as F

    from panelcast.models.ml import Pooled

    parts = []
    for k, p in enumerate(paths):
        m = unfitted().load(df.sparkSession, p) if unfitted else Pooled.load(p, features, label, series_col)
        parts.append(m.transform(df).select(*by, F.lit(k).alias("version"), F.col("y_pred")))
    allv = parts[0]
    for x in parts[1:]:
        allv = allv.unionByName(x)
    return version_average(allv, by)
