"""AG1 scaling statistics and SC1-SC4 transform / inverse transform.

Mean and **population** standard deviation per series and column, NULLs
ignored, a zero deviation scales by 1 (the behaviour of a standard scaler).
``pyspark.ml.feature.StandardScaler`` uses the sample deviation, so it is not
used.  The fitted state is a small long table ``(keys..., column, mean, std)``
that can be stored and reused on new rows (SC2).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.plans.panel import Panel, attach_series


def fit_scaler(df: DataFrame, panel: Panel, cols: Sequence[str]) -> DataFrame:
    """AG1: one row per (series, column) with ``mean`` and ``std`` (population)."""
    wide = df.groupBy(*panel.keys).agg(
        *[x for c in cols for x in (F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std"))]
    )
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std")) for c in cols]
    )
    return wide.select(*panel.keys, F.inline(entries))


def _wide_stats(stats: DataFrame, panel: Panel, cols: Sequence[str]) -> DataFrame:
    return stats.groupBy(*panel.keys).agg(
        *[
            x
            for c in cols
            for x in (
                F.max(F.when(F.col("column") == c, F.col("mean"))).alias(f"_m_{c}"),
                F.max(F.when(F.col("column") == c, F.col("std"))).alias(f"_s_{c}"),
            )
        ]
    )


def _scale(c: str):
    s = F.col(f"_s_{c}")
    return F.when(s.isNull() | (s == 0), F.lit(1.0)).otherwise(s)


def transform(df: DataFrame, panel: Panel, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """SC1/SC2: ``(c - mean) / std`` with stored statistics."""
    d = attach_series(df, panel, _wide_stats(stats, panel, cols))
    return d.select(*[((F.col(c) - F.col(f"_m_{c}")) / _scale(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def inverse(df: DataFrame, panel: Panel, stats: DataFrame, cols: Sequence[str] | dict[str, str]) -> DataFrame:
    """SC3/SC4: ``z * std + mean``.

    ``cols`` may map a column of ``df`` to the statistics entry to use, e.g.
    ``{"y_pred": "cnt"}`` to un-scale a long prediction table with the target's
    statistics.
    """
    mapping = dict(cols) if isinstance(cols, dict) else {c: c for c in cols}
    d = attach_series(df, panel, _wide_stats(stats, panel, sorted(set(mapping.values()))))
    return d.select(
        *[(F.col(c) * _scale(mapping[c]) + F.col(f"_m_{mapping[c]}")).alias(c) if c in mapping else F.col(c) for c in df.columns]
    )


def fit_transform(df: DataFrame, panel: Panel, cols: Sequence[str], fit_on: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """SC1: fit on ``fit_on`` (default: all rows, as the reference) and transform ``df``."""
    stats = fit_scaler(fit_on if fit_on is not None else df, panel, cols)
    return transform(df, panel, stats, cols), stats
