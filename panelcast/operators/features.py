"""Feature operators.

E2 composites, PR4 feature groups, PR7 row mean, PR8 offset alignment, PR10
calendar, PR11 row index, W4 lags, W5 differences, W6 inverse difference.

Lags and differences look back a bounded number of steps: inside a (series,
segment) window a ``lag``, across the border a lookup in the previous segment's
tail; running sums and row positions use a per-segment carry (see
:mod:`panelcast.plans.panel`).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.smooth import ewm
from panelcast.plans.panel import Panel, attach_series, row_index, seg_carry_sum, with_lag_cols, with_position

# Column names of the weekly climate feature table by feature group.
FEATURE_GROUPS = {
    "temperature": [
        "station_min_temp_c",
        "reanalysis_min_air_temp_k",
        "reanalysis_max_air_temp_k",
        "station_max_temp_c",
        "station_avg_temp_c",
        "reanalysis_avg_temp_k",
        "reanalysis_air_temp_k",
        "station_diur_temp_rng_c",
        "reanalysis_tdtr_k",
    ],
    "vegetation": ["ndvi_ne", "ndvi_nw", "ndvi_sw", "ndvi_se"],
    "precipitation": [
        "station_precip_mm",
        "precipitation_amt_mm",
        "reanalysis_sat_precip_amt_mm",
        "reanalysis_precip_amt_kg_per_m2",
    ],
    "humidity": [
        "reanalysis_dew_point_temp_k",
        "reanalysis_specific_humidity_g_per_kg",
        "reanalysis_relative_humidity_percent",
    ],
}
RAW_FEATURES = [c for g in FEATURE_GROUPS.values() for c in g]


def features_to_drop(drop_raw: bool, target: str = "total_cases") -> list[str]:
    """PR4: ``drop_raw`` drops all 20 raw climate columns plus the target, else only the target."""
    return [*RAW_FEATURES, target] if drop_raw else [target]


def row_mean(*cols: str | Column) -> Column:
    """PR7: mean across columns; a NULL in any input gives NULL."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    total = cs[0]
    for c in cs[1:]:
        total = total + c
    return total / F.lit(float(len(cs)))


def series_offset(df: DataFrame, panel: Panel, col: str, ref: str, name: str = "_delta") -> DataFrame:
    """PR8: add ``mean(col) - mean(ref)`` over each series as column ``name``."""
    st = df.groupBy(*panel.keys).agg((F.avg(col) - F.avg(ref)).alias(name))
    return attach_series(df, panel, st)


@dataclass(frozen=True)
class Composite:
    """One composite feature: EWM(span) of the row mean of ``cols``.

    Columns listed in ``shifted`` first have ``mean(align_from) - mean(align_to)``
    (per series) subtracted, aligning two sensors that measure the same thing
    on different scales.
    """

    name: str
    cols: tuple[str, ...]
    span: float
    shifted: tuple[str, ...] = ()
    align_from: str | None = None
    align_to: str | None = None


# The four composites of the climate feature table.
CLIMATE_COMPOSITES = (
    Composite("vegetazione", ("ndvi_ne", "ndvi_nw", "ndvi_sw", "ndvi_se"), 4),
    Composite(
        "temperature",
        ("station_avg_temp_c", "reanalysis_air_temp_k", "reanalysis_avg_temp_k"),
        4,
        shifted=("reanalysis_air_temp_k", "reanalysis_avg_temp_k"),
        align_from="reanalysis_air_temp_k",
        align_to="station_avg_temp_c",
    ),
    Composite("umidita", ("reanalysis_specific_humidity_g_per_kg",), 8),
    Composite(
        "precipitazioni",
        ("station_precip_mm", "precipitation_amt_mm", "reanalysis_sat_precip_amt_mm", "reanalysis_precip_amt_kg_per_m2"),
        4,
    ),
)
# Exact readings replaced before the composites are built.
CLIMATE_REPLACEMENTS = {"ndvi_nw": {0.076225: -0.1}, "ndvi_ne": {0.04585: -0.1}}


def composites(df: DataFrame, panel: Panel, spec: Sequence[Composite]) -> DataFrame:
    """Add every composite of ``spec``.  Offsets are one aggregate; all
    composites are smoothed in one pass, each with its own span."""
    d = df
    deltas = {}
    aligned = [c for c in spec if c.shifted]
    if aligned:
        st = df.groupBy(*panel.keys).agg(
            *[(F.avg(c.align_from) - F.avg(c.align_to)).alias(f"_delta_{c.name}") for c in aligned]
        )
        d = attach_series(d, panel, st)
        deltas = {c.name: F.col(f"_delta_{c.name}") for c in aligned}
    for c in spec:
        parts = [F.col(x) - deltas[c.name] if x in c.shifted else F.col(x) for x in c.cols]
        d = d.withColumn(c.name, row_mean(*parts))
    d = d.drop(*[f"_delta_{c.name}" for c in aligned])
    # every composite in one smoothing pass, each with its own span
    return ewm(d, panel, [c.name for c in spec], {c.name: c.span for c in spec})


def lags(df: DataFrame, panel: Panel, cols: Sequence[str], max_lag: int, fmt: str = "{col}_{j}_week_back") -> DataFrame:
    """``lag(c, j)`` for j in 1..max_lag as new columns (one window pass, no shuffle)."""
    if max_lag < 1:
        return df
    return with_lag_cols(df, panel, cols, range(1, max_lag + 1), fmt)


def diff(df: DataFrame, panel: Panel, cols: Sequence[str], k: int = 1) -> DataFrame:
    """``c - lag(c, k)`` in place."""
    d = with_lag_cols(df, panel, cols, [k], fmt="_lag_{col}")
    return d.select(*[(F.col(c) - F.col(f"_lag_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])


def cumsum(df: DataFrame, panel: Panel, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Running sum within each series (NULLs count as 0), with a segment carry."""
    w = panel.running()
    local = df.select("*", *[F.sum(F.coalesce(F.col(c), F.lit(0))).over(w).alias(f"_cs_{c}") for c in cols])
    carry = seg_carry_sum(df, panel, {c: F.coalesce(F.col(c), F.lit(0)) for c in cols})
    out = local.join(carry, panel.part, "left")
    res = {f"{c}{suffix}": F.col(f"_cs_{c}") + F.col(f"_carry_{c}") for c in cols}
    keep = [F.col(c) for c in df.columns if c not in res]
    return out.select(*keep, *[e.alias(n) for n, e in res.items()])


def undiff(diffs: DataFrame, panel: Panel, history: DataFrame, col: str, k: int = 1, out: str | None = None) -> DataFrame:
    """Rebuild levels from k-step differences that follow ``history``.

    Row q (0-based) of ``diffs`` belongs to residue class ``q mod k``; its level
    is the history value ending that class (row ``n_hist - k + class``) plus the
    running sum of the class's differences (Q17: right for any k, not only 1).
    """
    out = out or col
    d = row_index(diffs, panel, "_q")
    d = d.withColumn("_cls", F.pmod(F.col("_q"), F.lit(k)))
    h = with_position(history.select(*panel.keys, panel.t, panel.seg, col), panel, "_hp", "_hn")
    base = h.filter(F.col("_hp") >= F.col("_hn") - k).select(
        *panel.keys, (F.col("_hp") - (F.col("_hn") - k)).alias("_cls"), F.col(col).alias("_base")
    )
    cls_panel = replace(panel, keys=(*panel.keys, "_cls"))
    summed = cumsum(d, cls_panel, [col], suffix="_run")
    res = summed.join(base, [*panel.keys, "_cls"], "left")
    cols = [c for c in diffs.columns if c != col]
    return res.select(*cols, (F.col("_base") + F.col(f"{col}_run")).alias(out))


def calendar(df: DataFrame, panel: Panel, year: bool = True, month: bool = True, weeks: bool = True) -> DataFrame:
    """PR10/PR11: ``year``, ``month`` of the time column and ``weeks`` = 0..n-1 per series."""
    d = df
    if year:
        d = d.withColumn("year", F.year(panel.ts))
    if month:
        d = d.withColumn("month", F.month(panel.ts))
    if weeks:
        d = row_index(d, panel, "weeks")
    return d
