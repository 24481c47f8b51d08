"""Sliding-window datasets and time-ordered splits.

W7 sequences, W8 two-level reshape, W9 chronological split, W10 tail
validation, W11 contiguous frames, W12 remainder frame.

Sequences look back ``n - 1`` steps: inside a segment a window, across the
border the previous segment's tail (no shuffle of the panel); splits and frames
need each row's position and its series length, both computed with per-segment
carries and per-series counts (never a whole series in one task).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.plans.panel import Panel, with_position, with_tail


def sequences(
    df: DataFrame,
    panel: Panel,
    feature_cols: Sequence[str],
    target: str,
    n_steps: int,
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """One row per window of ``n_steps`` consecutive rows.

    ``x`` = ARRAY<ARRAY<DOUBLE>> of the window's feature rows (oldest first),
    ``y`` = target of the window's last row, time = the last row's time (Q2 fix).
    A series of N rows gives N - n_steps + 1 windows.
    """
    if n_steps < 1:
        raise ValueError("n_steps must be >= 1")
    h = n_steps - 1
    row = F.array(*[F.col(c).cast("double") for c in feature_cols])
    w = panel.window().rowsBetween(-h, Window.currentRow)
    inside = F.collect_list(row).over(w)
    if h:
        # steps before the segment start come from the previous segment's tail
        d = with_tail(df, panel, row, h)
        t, start = F.col(panel.t), F.col(panel.seg) * F.lit(panel.seg_steps)
        steps = F.when(t - h < start, F.sequence(t - h, start - 1)).otherwise(F.array().cast("array<bigint>"))
        prefix = F.filter(F.transform(steps, lambda k: F.try_element_at(F.col("_tail"), k)), lambda e: e.isNotNull())
        win = F.concat(prefix, inside)
    else:
        d, win = df, inside
    d = d.select(*panel.keys, panel.ts, panel.t, panel.seg, win.alias(x), F.col(target).cast("double").alias(y))
    return d.filter(F.size(x) == n_steps)


def split_halves(df: DataFrame, x: str, n_steps: int, unit_axis: bool = False, out: str | None = None) -> DataFrame:
    """``[n, f]`` windows -> ``[2, n/2, f]`` (or ``[2, 1, n/2, f]`` with ``unit_axis``)."""
    if n_steps % 2:
        raise ValueError("two-level windows need an even number of steps (Q6)")
    h = n_steps // 2
    first, second = F.slice(x, 1, h), F.slice(x, h + 1, h)
    if unit_axis:
        first, second = F.array(first), F.array(second)
    return df.withColumn(out or x, F.array(first, second))


def chrono_split(df: DataFrame, panel: Panel, test_frac: float, col: str = "split") -> DataFrame:
    """The last ``ceil(test_frac * n)`` rows of each series are ``test``, the rest ``train``."""
    d = with_position(df, panel)
    n_test = F.ceil(F.col("_n") * F.lit(test_frac))
    lab = F.when(F.col("_pos") >= F.col("_n") - n_test, F.lit("test")).otherwise(F.lit("train"))
    return d.withColumn(col, lab).drop("_pos", "_n")


def tail_validation(df: DataFrame, panel: Panel, keep_frac: float, col: str = "split") -> DataFrame:
    """The first ``floor(n * keep_frac)`` rows are ``train``, the rest ``validation``."""
    d = with_position(df, panel)
    cut = F.floor(F.col("_n") * F.lit(keep_frac))
    lab = F.when(F.col("_pos") < cut, F.lit("train")).otherwise(F.lit("validation"))
    return d.withColumn(col, lab).drop("_pos", "_n")


def frames(df: DataFrame, panel: Panel, frame_frac: float, test_frac: float = 0.3) -> DataFrame:
    """Walk-forward frames.

    ``frame_size = floor(n * frame_frac)``, ``round(n / frame_size)`` frames
    (half to even, as Python), each split train/test in time order with the last
    ``ceil(test_frac * size)`` rows as test.  Rows past the last full frame get
    ``frame = NULL`` and ``part = 'remainder'`` (Q7: only the true remainder).
    A frame that runs past the series end keeps the rows that exist.
    """
    d = with_position(df, panel)
    size = F.floor(F.col("_n") * F.lit(frame_frac))
    nfr = F.bround(F.try_divide(F.col("_n"), size), 0)
    fr = F.floor(F.try_divide(F.col("_pos"), size))
    d = d.withColumn("frame", F.when(fr < nfr, fr.cast("long")))
    start = F.col("frame") * size
    flen = F.least(size, F.col("_n") - start)
    n_test = F.ceil(flen * F.lit(test_frac))
    part = (
        F.when(F.col("frame").isNull(), F.lit("remainder"))
        .when(F.col("_pos") - start >= flen - n_test, F.lit("test"))
        .otherwise(F.lit("train"))
    )
    return d.withColumn("part", part).drop("_pos", "_n")
