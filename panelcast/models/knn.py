"""M3 k-nearest-neighbour regression (mean of the k nearest training targets).

Exact, without pairing every query with every training row of its series:

* each series gets a grid over (up to) its first three features, with about
  ``k`` training points per cell (``m = floor((n/k)^(1/g))`` cells per axis);
* round ``r`` pairs each open query with the training points in the
  ``(2r+1)^g`` cells around its own cell (an equi-join on series + cell);
* a point outside that block is at least ``r * h_min`` away (``h_min`` the
  smallest cell side), so a query whose k-th candidate distance is within that
  bound -- or whose block already covers the whole grid -- is final; the others
  go to the next round with ``r`` doubled.

Distances use all features; ties are broken by the training row's time.  The
open queries of a round are checkpointed, so rounds do not stack lineage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import ensure_checkpoint_dir


def knn_regress(
    train: DataFrame,
    query: DataFrame,
    keys: Sequence[str],
    time_col: str,
    features: Sequence[str],
    y: str,
    k: int = 20,
    grid_dims: int = 3,
    out: str = "y_pred",
) -> DataFrame:
    """Returns (keys, time_col, y_pred) for every query row with all features present."""
    keys, feats = list(keys), list(features)
    gd = feats[: max(1, min(grid_dims, len(feats)))]
    G = len(gd)
    ensure_checkpoint_dir(train.sparkSession)
    tr = train.select(*keys, F.col(time_col).alias("_tt"), *[F.col(f).cast("double").alias(f) for f in feats], F.col(y).cast("double").alias("_y")).na.drop()
    qr = query.select(*keys, time_col, *[F.col(f).cast("double").alias(f) for f in feats]).na.drop()

    st = tr.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[x for j, f in enumerate(gd) for x in (F.min(f).alias(f"_lo{j}"), F.max(f).alias(f"_hi{j}"))])
    m = F.greatest(F.lit(1), F.floor(F.pow(F.col("_n") / F.lit(float(k)), F.lit(1.0 / G)))).cast("long")
    st = st.withColumn("_m", m)
    for j in range(G):
        span = F.col(f"_hi{j}") - F.col(f"_lo{j}")
        st = st.withColumn(f"_h{j}", F.when(span > 0, span / F.col("_m")).otherwise(F.lit(1.0)))
    st = st.withColumn("_hmin", F.least(*[F.col(f"_h{j}") for j in range(G)]) if G > 1 else F.col("_h0"))
    st = st.withColumn("_keff", F.least(F.col("_n"), F.lit(k)))

    def cells(df):
        for j, f in enumerate(gd):
            c = F.floor((F.col(f) - F.col(f"_lo{j}")) / F.col(f"_h{j}"))
            df = df.withColumn(f"_c{j}", F.least(F.col("_m") - 1, F.greatest(F.lit(0), c)).cast("long"))
        return df

    cell_cols = [f"_c{j}" for j in range(G)]
    trc = cells(tr.join(st.select(*keys, "_m", *[f"_lo{j}" for j in range(G)], *[f"_h{j}" for j in range(G)]), keys)).select(*keys, *cell_cols, "_tt", *feats, "_y")
    open_q = cells(qr.join(st, keys)).select(*keys, time_col, *feats, *cell_cols, "_m", "_hmin", "_keff")
    done = []
    r = 1
    while True:  # ends: r doubles until the block covers the grid
        # candidate cells of the block around each query's cell
        qx = open_q
        for j in range(G):
            lo = F.greatest(F.lit(0), F.col(f"_c{j}") - r)
            hi = F.least(F.col("_m") - 1, F.col(f"_c{j}") + r)
            qx = qx.withColumn(f"_x{j}", F.explode(F.sequence(lo, hi)))
        qx = qx.select(*keys, time_col, *[F.col(f).alias(f"_q_{f}") for f in feats], *[F.col(f"_x{j}").alias(f"_c{j}") for j in range(G)], "_m", "_hmin", "_keff")
        cand = qx.join(trc, [*keys, *cell_cols])
        d2 = None
        for f in feats:
            term = (F.col(f"_q_{f}") - F.col(f)) * (F.col(f"_q_{f}") - F.col(f))
            d2 = term if d2 is None else d2 + term
        cand = cand.withColumn("_d2", d2)
        w = Window.partitionBy(*keys, time_col).orderBy("_d2", "_tt")
        top = cand.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k)
        agg = top.groupBy(*keys, time_col).agg(
            F.avg("_y").alias(out), F.max("_d2").alias("_d2k"), F.count(F.lit(1)).alias("_cnt"), F.first("_m").alias("_m"), F.first("_hmin").alias("_hmin"), F.first("_keff").alias("_keff")
        )
        covers = F.lit(r) >= F.col("_m") - 1
        ok = (F.col("_cnt") >= F.col("_keff")) & ((F.col("_d2k") <= (F.lit(float(r)) * F.col("_hmin")) ** 2) | covers)
        res = agg.withColumn("_ok", ok).checkpoint(eager=True)
        done.append(res.filter("_ok").select(*keys, time_col, out))
        # queries with no candidate at all in the block are open too
        open_q = open_q.join(res.select(*keys, time_col, "_ok"), [*keys, time_col], "left").filter(~F.coalesce(F.col("_ok"), F.lit(False))).drop("_ok")
        open_q = open_q.checkpoint(eager=True)
        if open_q.limit(1).count() == 0:
            break
        r *= 2
    out_df = done[0]
    for x in done[1:]:
        out_df = out_df.unionByName(x)
    return out_df
