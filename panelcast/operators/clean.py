"""Gap filling, value replacement and the small scalar clean-ups.

W1 forward fill, W2 back fill, PR2 drop leading rows, W13 last rows, PR3/PR4 drop
columns or a feature group, PR5 replace exact values, PR9 rename, PR12 integer
truncation, PR13 outlier zeroing, PR14 shift to zero minimum, PR15 mean debias,
PR16 constant placeholder target.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.plans.panel import Panel, attach_series, seg_carry_last, with_position


def _cols(df: DataFrame, panel: Panel, cols: Sequence[str] | None) -> list[str]:
    return list(cols) if cols else panel.measures(df)


def ffill(df: DataFrame, panel: Panel, cols: Sequence[str] | None = None) -> DataFrame:
    """Forward fill inside each series; leading gaps stay NULL (as pandas ``ffill``)."""
    cols = _cols(df, panel, cols)
    w = panel.running()
    local = df.select(*[F.last(c, ignorenulls=True).over(w).alias(c) if c in cols else F.col(c) for c in df.columns])
    carry = seg_carry_last(df, panel, cols)
    out = local.join(carry, panel.part, "left")
    return out.select(*[F.coalesce(F.col(c), F.col(f"_carry_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])


def bfill(df: DataFrame, panel: Panel, cols: Sequence[str] | None = None) -> DataFrame:
    """Back fill inside each series; trailing gaps stay NULL (as pandas ``bfill``)."""
    cols = _cols(df, panel, cols)
    w = panel.window().rowsBetween(Window.currentRow, Window.unboundedFollowing)
    local = df.select(*[F.first(c, ignorenulls=True).over(w).alias(c) if c in cols else F.col(c) for c in df.columns])
    carry = seg_carry_last(df, panel, cols, reverse=True)
    out = local.join(carry, panel.part, "left")
    return out.select(*[F.coalesce(F.col(c), F.col(f"_carry_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])


def drop_leading(df: DataFrame, panel: Panel, n: int | Mapping[str, int], key: str | None = None) -> DataFrame:
    """Drop the first ``n`` rows of every series (PR2).

    ``n`` may be a mapping from a series key value to its own count (missing
    keys drop nothing), replacing the reference's hard-coded row labels.
    """
    d = with_position(df, panel)
    if isinstance(n, Mapping):
        k = F.col(key or panel.keys[0])
        expr = F.lit(0)
        for kv, cnt in n.items():
            expr = F.when(k == F.lit(kv), F.lit(int(cnt))).otherwise(expr)
        cond = F.col("_pos") >= expr
    else:
        cond = F.col("_pos") >= F.lit(int(n))
    return d.filter(cond).drop("_pos", "_n")


def last_rows(df: DataFrame, panel: Panel, k: int) -> DataFrame:
    """Keep the last ``k`` rows of every series (W13, top-k by time)."""
    d = with_position(df, panel)
    return d.filter(F.col("_pos") >= F.col("_n") - k).drop("_pos", "_n")


def replace_values(df: DataFrame, mapping: Mapping[str, Mapping[float, float]]) -> DataFrame:
    """Replace exact values per column (PR5): ``{"col": {old: new}}``."""
    out = df
    for c, m in mapping.items():
        e = F.col(c)
        for old, new in m.items():
            e = F.when(F.col(c) == F.lit(old), F.lit(new)).otherwise(e)
        out = out.withColumn(c, e)
    return out


def zero_above(c: Column | str, limit: float = 10000) -> Column:
    """PR13: values above ``limit`` become 0."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col > F.lit(limit), F.lit(0)).otherwise(col)


def to_int(c: Column | str) -> Column:
    """PR12: truncate toward zero (-1.7 -> -1) to 64 bits, as ``astype(int)``; NULL beyond them."""
    col = F.col(c) if isinstance(c, str) else c
    return col.try_cast("bigint")


def round_even(c: Column | str, digits: int) -> Column:
    """PR17: round half to even, as Python's ``round``."""
    col = F.col(c) if isinstance(c, str) else c
    return F.bround(col, digits)


def drop_columns(df: DataFrame, *cols: str) -> DataFrame:
    """PR3."""
    return df.drop(*cols)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """PR9: ``{"total_cases": "y"}``."""
    return df.withColumnsRenamed(dict(mapping))


def placeholder_target(df: DataFrame, name: str = "total_cases", value: float = 0) -> DataFrame:
    """PR16."""
    return df.withColumn(name, F.lit(value))


def shift_to_zero_min(df: DataFrame, panel: Panel, cols: Sequence[str]) -> DataFrame:
    """PR14: subtract each series' minimum so the smallest value becomes 0."""
    stats = df.groupBy(*panel.keys).agg(*[F.min(c).alias(f"_min_{c}") for c in cols])
    out = attach_series(df, panel, stats)
    return out.select(*[(F.col(c) - F.col(f"_min_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])


def debias(df: DataFrame, panel: Panel, pred: str, reference: DataFrame, ref_col: str) -> DataFrame:
    """PR15: ``pred + (mean(reference) - mean(pred))`` per series, then PR14.

    ``reference`` is the training history (keyed like ``df``); both means are
    per-series aggregates joined back.
    """
    mp = df.groupBy(*panel.keys).agg(F.avg(pred).alias("_mp"))
    mr = reference.groupBy(*panel.keys).agg(F.avg(ref_col).alias("_mr"))
    stats = mp.join(mr, list(panel.keys), "left")
    out = attach_series(df, panel, stats)
    out = out.withColumn(pred, F.col(pred) + (F.col("_mr") - F.col("_mp"))).drop("_mr", "_mp")
    return shift_to_zero_min(out, panel, [pred])
