"""AG2 error metrics, AG3 mean fold score, AG8 best candidate, PR17 rounding, PR18 transpose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ["mae", "mse", "r2", "r2_hand", "residual"]


def score(
    pred: DataFrame,
    by: Sequence[str] = ("model",),
    y: str = "y",
    y_pred: str = "y_pred",
    digits: int | None = 3,
) -> DataFrame:
    """Metrics per group of a long prediction table ``(..., model, y, y_pred)``.

    ``mae``, ``mse``, ``r2`` (zero total variance gives 1 for a perfect fit,
    else 0), ``r2_hand`` (``1 - SS_res/SS_tot``, NULL when SS_tot is 0) and
    ``residual`` (``SS_res``).  Rows missing either value are skipped.  One
    aggregation with partial aggregation; ``SS_tot = var_pop(y) * n``.
    """
    d = pred.filter(F.col(y).isNotNull() & F.col(y_pred).isNotNull())
    e = F.col(y) - F.col(y_pred)
    g = d.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.sum(e * e).alias("residual"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"),
    )
    sst, ssr = F.col("_sst"), F.col("residual")
    r2 = F.when(sst > 0, 1 - ssr / sst).otherwise(F.when(ssr == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    hand = F.when(sst != 0, 1 - ssr / sst)
    out = g.select(*by, "mae", "mse", r2.alias("r2"), hand.alias("r2_hand"), "residual")
    if digits is not None:
        out = out.select(*by, *[F.bround(c, digits).alias(c) for c in METRICS])
    return out


def mean_score(scores: DataFrame, by: Sequence[str] = ("model",), metric: str = "mae") -> DataFrame:
    """AG3: average of a metric over folds / frames."""
    return scores.groupBy(*by).agg(F.avg(metric).alias(f"mean_{metric}"))


def best_candidate(scores: DataFrame, by: Sequence[str], candidate: str, metric: str = "mae") -> DataFrame:
    """AG8: the candidate with the least metric; ties go to the smallest candidate."""
    return scores.groupBy(*by).agg(
        F.min_by(F.col(candidate), F.struct(F.col(metric), F.col(candidate))).alias(f"best_{candidate}"),
        F.min(metric).alias(f"best_{metric}"),
    )


def transpose(scores: DataFrame, name: str = "model", metrics: Sequence[str] = METRICS) -> DataFrame:
    """PR18: metrics as rows, one column per model (long form first, then pivot)."""
    long = scores.unpivot(name, list(metrics), "metric", "value")
    return long.groupBy("metric").pivot(name).agg(F.first("value"))
