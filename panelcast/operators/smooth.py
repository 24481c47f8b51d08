"""W3 exponentially weighted mean and PR6 threshold flags.

Semantics (pandas ``ewm(span=s).mean()`` with the default ``adjust=True``,
``ignore_na=False``): ``alpha = 2/(s+1)``, ``r = 1 - alpha``; at step ``t``

    ewm(t) = sum_{i<=t, v_i not null} r^(t-i) v_i  /  sum_{i<=t, v_i not null} r^(t-i)

so weights decay with the step distance, also through gaps, and the result is
NULL until the first observation.

Plan
----
Rows are cut into blocks of ``B`` steps (``B`` a power of two dividing the
segment size, small enough that ``r^-B`` cannot overflow).  Inside a block the
two sums are running window sums of ``r^-(t-b0) v`` -- constant work per row,
no arrays.  Each block also leaves a one-row summary; the state entering a block
is the summary of the latest earlier block that saw data, combined with the
``m`` blocks before it (older blocks weigh less than 1e-30 relative and are
dropped).  That state is kept as (mean, log weight), so very long gaps decay
without underflow.  The summaries are 1/B of the rows; the latest earlier
state is found inside the segment first and otherwise carried over one row per
segment, so no step sees a whole series.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.clean import ffill
from panelcast.plans.panel import Panel

_MAX_BLOCK = 512
_REL_EPS_LOG10 = 30


def _block_size(lnr: float, seg_steps: int, block: int | None) -> int:
    if block:
        b = block
    else:
        b = _MAX_BLOCK
        while b > 1 and b * (-lnr) > 600:
            b //= 2
    b = math.gcd(b, seg_steps)
    return max(b, 1)


def ewm(
    df: DataFrame,
    panel: Panel,
    cols: Sequence[str] | Mapping[str, str],
    span: float | Mapping[str, float],
    block: int | None = None,
) -> DataFrame:
    """Exponentially weighted mean of ``cols`` within each series.

    ``cols`` is a list (replace in place) or a mapping ``{source: output}``;
    ``span`` is one number or a mapping ``{source: span}`` -- columns with
    different spans share one pass (same windows, one block summary).
    """
    mapping = dict(cols) if isinstance(cols, Mapping) else {c: c for c in cols}
    spans = {s: float(span[s]) if isinstance(span, Mapping) else float(span) for s in mapping}
    if any(v < 1 for v in spans.values()):
        raise ValueError("span must be >= 1")
    flat = {s: o for s, o in mapping.items() if spans[s] <= 1.0}
    if flat:  # alpha = 1: the value itself, held through gaps
        d = df.select("*", *[F.col(s).alias(f"_e_{o}") for s, o in flat.items()])
        d = ffill(d, panel, [f"_e_{o}" for o in flat.values()])
        d = _finish(d, df, flat)
        rest = {s: o for s, o in mapping.items() if s not in flat}
        return ewm(d, panel, rest, {s: spans[s] for s in rest}, block) if rest else d
    srcs = list(mapping)
    rs = [1.0 - 2.0 / (spans[s] + 1.0) for s in srcs]
    lnrs = [math.log(r) for r in rs]
    B = min(_block_size(lnr, panel.seg_steps, block) for lnr in lnrs)
    m = max(int(math.ceil(_REL_EPS_LOG10 * math.log(10) / (-lnr * B))) + 1 for lnr in lnrs)
    t = F.col(panel.t)
    blk = F.floor(t / F.lit(B)).cast("long")
    d = df.withColumn("_blk", blk).withColumn("_a", t - F.col("_blk") * B)
    n_src = range(len(srcs))

    # 1. running sums inside each block (one window spec, one sort).  Powers are
    #    taken relative to the block's first observation, so that one has weight
    #    exactly 1 and a lone observation comes back unchanged.
    wp = Window.partitionBy(*panel.part, "_blk")
    w = wp.orderBy(t).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = [F.min(F.when(F.col(s).isNotNull(), F.col("_a"))).over(wp).alias(f"_a0{i}") for i, s in enumerate(srcs)]
    d0 = d.select("*", *first)
    local_cols = []
    for i, s in enumerate(srcs):
        v = F.col(s)
        up = F.pow(F.lit(rs[i]), F.col(f"_a0{i}") - F.col("_a"))
        local_cols.append(F.sum(F.when(v.isNotNull(), up * v)).over(w).alias(f"_sv{i}"))
        local_cols.append(F.sum(F.when(v.isNotNull(), up)).over(w).alias(f"_sw{i}"))
    local = d0.select("*", *local_cols)

    # 2. one summary row per block: sums decayed to the block's last step
    summ = d.groupBy(*panel.keys, panel.seg, "_blk").agg(
        *[
            x
            for i, s in enumerate(srcs)
            for x in (
                F.sum(F.when(F.col(s).isNotNull(), F.pow(F.lit(rs[i]), F.lit(B - 1) - F.col("_a")) * F.col(s))).alias(f"_S{i}"),
                F.sum(F.when(F.col(s).isNotNull(), F.pow(F.lit(rs[i]), F.lit(B - 1) - F.col("_a")))).alias(f"_W{i}"),
            )
        ]
    )

    # 3. full state at the end of every block: its own sums plus the m blocks
    #    before it, decayed (explode + group, no window, no collect)
    fan = summ.select(
        *panel.keys,
        "_blk",
        *[F.col(f"_S{i}") for i in n_src],
        *[F.col(f"_W{i}") for i in n_src],
        F.explode(F.sequence(F.lit(0), F.lit(m))).alias("_j"),
    )
    full = (
        fan.withColumn("_tgt", F.col("_blk") + F.col("_j"))
        .groupBy(*panel.keys, "_tgt")
        .agg(
            *[
                x
                for i in n_src
                for x in (
                    F.sum(F.pow(F.lit(rs[i]), F.col("_j") * B) * F.col(f"_S{i}")).alias(f"_FS{i}"),
                    F.sum(F.pow(F.lit(rs[i]), F.col("_j") * B) * F.col(f"_W{i}")).alias(f"_FW{i}"),
                )
            ]
        )
        .withColumnRenamed("_tgt", "_blk")
    )
    # keep the state only where the block itself saw data for that column
    st = summ.join(full, [*panel.keys, "_blk"], "inner")
    state_cols = []
    for i in n_src:
        ok = F.col(f"_W{i}") > 0
        state_cols.append(
            F.when(ok, F.struct((F.col(f"_FS{i}") / F.col(f"_FW{i}")).alias("e"), F.log(F.col(f"_FW{i}")).alias("lw"), F.col("_blk").alias("b"))).alias(f"_st{i}")
        )
    st = st.select(*panel.keys, panel.seg, "_blk", *state_cols)
    # 4. state entering each block = latest earlier block with data: first among the
    #    earlier blocks of the same segment (at most seg_steps/B of them), else the
    #    last one of the earlier segments (a carry over one row per segment), so no
    #    window ever spans a whole series.
    w_in = Window.partitionBy(*panel.keys, panel.seg).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    loc = st.select(*panel.keys, panel.seg, "_blk", *[F.last(f"_st{i}", ignorenulls=True).over(w_in).alias(f"_loc{i}") for i in n_src])
    seg_last = st.groupBy(*panel.keys, panel.seg).agg(
        *[F.max_by(F.col(f"_st{i}"), F.when(F.col(f"_st{i}").isNotNull(), F.col("_blk"))).alias(f"_sl{i}") for i in n_src]
    )
    w_seg = panel.seg_window().rowsBetween(Window.unboundedPreceding, -1)
    car = seg_last.select(*panel.keys, panel.seg, *[F.last(f"_sl{i}", ignorenulls=True).over(w_seg).alias(f"_car{i}") for i in n_src])
    inc = loc.join(car, panel.part, "left").select(
        *panel.keys, panel.seg, "_blk", *[F.coalesce(F.col(f"_loc{i}"), F.col(f"_car{i}")).alias(f"_in{i}") for i in n_src]
    )
    # one row per (series, segment) holding its blocks' states, so the join runs
    # on exactly the panel's bucket columns and the panel side is not shuffled
    inc_m = inc.groupBy(*panel.keys, panel.seg).agg(
        F.map_from_entries(F.collect_list(F.struct("_blk", F.struct(*[F.col(f"_in{i}") for i in n_src])))).alias("_incm")
    )
    out = local.join(inc_m, panel.part, "left").withColumn("_inb", F.try_element_at(F.col("_incm"), F.col("_blk"))).drop("_incm")
    res = {}
    for i, (s, o) in enumerate(mapping.items()):
        ra = F.pow(F.lit(rs[i]), F.col("_a") - F.coalesce(F.col(f"_a0{i}"), F.col("_a")))
        st_in = F.col("_inb")[f"_in{i}"]
        gap = t - (st_in["b"] * B + (B - 1))
        dec = F.coalesce(F.exp(gap * F.lit(lnrs[i]) + st_in["lw"]), F.lit(0.0))
        sv, sw = F.coalesce(F.col(f"_sv{i}"), F.lit(0.0)), F.coalesce(F.col(f"_sw{i}"), F.lit(0.0))
        num = ra * sv + dec * F.coalesce(st_in["e"], F.lit(0.0))
        den = ra * sw + dec
        res[o] = F.when(sw > 0, num / den).otherwise(st_in["e"])
    out = out.select("*", *[e.alias(f"_e_{o}") for o, e in res.items()])
    return _finish(out, df, mapping)


def _finish(d: DataFrame, df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    base = [F.col(f"_e_{c}").alias(c) if c in mapping.values() else F.col(c) for c in df.columns]
    new = [F.col(f"_e_{o}").alias(o) for o in mapping.values() if o not in df.columns]
    return d.select(*base, *new)


def threshold_flag(df: DataFrame, panel: Panel, cols: Sequence[str], span: float, threshold, key: str | None = None, suffix: str = "_flag") -> DataFrame:
    """PR6: ``(ewm(c) < threshold)`` as 0/1; a NULL mean gives 0 (NaN compares false).

    ``threshold`` is a number or a mapping from series key value to number.
    """
    tmp = {c: f"_ewm_{c}" for c in cols}
    d = ewm(df, panel, tmp, span)
    if isinstance(threshold, Mapping):
        k = F.col(key or panel.keys[0])
        thr = F.lit(None).cast("double")
        for kv, v in threshold.items():
            thr = F.when(k == F.lit(kv), F.lit(float(v))).otherwise(thr)
    else:
        thr = F.lit(float(threshold))
    for c in cols:
        d = d.withColumn(f"{c}{suffix}", F.coalesce((F.col(tmp[c]) < thr).cast("int"), F.lit(0)))
    return d.drop(*tmp.values())
