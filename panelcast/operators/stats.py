"""Series diagnostics and time-series tests, run over all series at once.

AG4 histogram, W14 autocorrelation, W15 partial autocorrelation, AG9
Durbin-Watson, T1 Granger causality (with AG5 minimum p and AG6 matrix), T2
augmented Dickey-Fuller, T3 Johansen trace test, T5 series profile.

Regression-based tests share one distributed step, :func:`cross_products`:
every Arrow batch adds ``Z'Z`` of its rows per (series, bucket) with numpy, the
partial matrices are summed by a map-side-combined ``groupBy``, and only the
summed ``D x D`` matrices (one per series and bucket) reach the small dense
solves.  Buckets are the row position capped at the largest lag, so the
sample of every lag order (rows with position >= L) is a sum of buckets and
each test uses exactly its own sample.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.distributions import adf_critical, adf_pvalue, chi2_sf, durbin_levinson, johansen_crit
from panelcast.plans.panel import Panel, attach_series, with_lag_cols, with_position


_PARTIAL_BYTES = 64 << 20


def _key_fields(df: DataFrame, cols: Sequence[str]) -> list[T.StructField]:
    return [df.schema[c] for c in cols]


# --------------------------------------------------------------------------- simple diagnostics


def histogram(df: DataFrame, panel: Panel, col: str, bins: int = 25) -> DataFrame:
    """AG4: equal-width histogram per series: (keys, bin, lo, hi, count), all bins.

    Bin ``b = least(bins-1, floor((v - min)/(max - min) * bins))``; the last bin
    is closed.  A constant series uses the range ``[v - 0.5, v + 0.5]``.
    """
    st = df.groupBy(*panel.keys).agg(F.min(col).alias("_lo0"), F.max(col).alias("_hi0"))
    st = st.select(
        *panel.keys,
        F.when(F.col("_hi0") > F.col("_lo0"), F.col("_lo0")).otherwise(F.col("_lo0") - 0.5).alias("_lo"),
        F.when(F.col("_hi0") > F.col("_lo0"), F.col("_hi0")).otherwise(F.col("_hi0") + 0.5).alias("_hi"),
    )
    d = attach_series(df.filter(F.col(col).isNotNull()), panel, st)
    b = F.least(F.lit(bins - 1), F.floor((F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)).cast("int")
    counts = d.groupBy(*panel.keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = st.select(*panel.keys, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return grid.join(counts, [*panel.keys, "bin"], "left").select(
        *panel.keys,
        "bin",
        (F.col("_lo") + width * F.col("bin")).alias("lo"),
        (F.col("_lo") + width * (F.col("bin") + 1)).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).alias("count"),
    )


def acf(df: DataFrame, panel: Panel, cols: Sequence[str], nlags: int = 30) -> DataFrame:
    """Autocorrelation 0..nlags per series and column: (keys, column, lag, acf).

    ``acf_k = sum (x_t - m)(x_{t-k} - m) / sum (x_t - m)^2`` over non-null
    values (the biased estimator); pairs with a NULL are skipped.
    """
    st = df.groupBy(*panel.keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    d = attach_series(df, panel, st)
    d = d.select(*panel.keys, panel.t, panel.seg, *[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in cols])
    d = with_lag_cols(d, panel, cols, range(1, nlags + 1), fmt="_l_{col}_{j}")
    prods = [
        (F.col(c) * (F.col(f"_l_{c}_{k}") if k else F.col(c))).alias(f"_p_{i}_{k}")
        for i, c in enumerate(cols)
        for k in range(nlags + 1)
    ]
    d = d.select(*panel.keys, *prods)
    sums = d.groupBy(*panel.keys).agg(*[F.sum(f"_p_{i}_{k}").alias(f"_s_{i}_{k}") for i in range(len(cols)) for k in range(nlags + 1)])
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.lit(k).alias("lag"), F.try_divide(F.col(f"_s_{i}_{k}"), F.col(f"_s_{i}_0")).alias("acf"))
            for i, c in enumerate(cols)
            for k in range(nlags + 1)
        ]
    )
    return sums.select(*panel.keys, F.inline(entries))


def pacf(acf_df: DataFrame, panel: Panel) -> DataFrame:
    """Partial autocorrelations by Durbin-Levinson over each (series, column)'s
    ACF -- a pandas step on nlags+1 numbers per group."""
    keys = list(panel.keys)
    schema = T.StructType([*_key_fields(acf_df, keys), T.StructField("column", T.StringType()), T.StructField("lag", T.IntegerType()), T.StructField("pacf", T.DoubleType())])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        p = durbin_levinson(pdf["acf"].to_numpy(dtype=float))
        out = pdf[[*keys, "column", "lag"]].copy()
        out["lag"] = out["lag"].astype("int32")
        out["pacf"] = p
        return out

    return acf_df.groupBy(*keys, "column").applyInPandas(fn, schema)


def durbin_watson(df: DataFrame, panel: Panel, resid: str, by: Sequence[str] = ()) -> DataFrame:
    """AG9: ``sum((e_t - e_{t-1})^2) / sum(e_t^2)`` per series (and ``by`` group)."""
    sub = Panel(keys=(*panel.keys, *by), ts=panel.ts, freq=panel.freq, t=panel.t, seg=panel.seg, seg_steps=panel.seg_steps)
    d = with_lag_cols(df.select(*sub.keys, panel.t, panel.seg, resid), sub, [resid], [1], fmt="_prev")
    g = d.groupBy(*sub.keys).agg(
        F.sum((F.col(resid) - F.col("_prev")) * (F.col(resid) - F.col("_prev"))).alias("_num"),
        F.sum(F.col(resid) * F.col(resid)).alias("_den"),
    )
    return g.select(*sub.keys, F.try_divide(F.col("_num"), F.col("_den")).alias("dw"))


# --------------------------------------------------------------------------- cross-product core


def lag_matrix(df: DataFrame, panel: Panel, cols: Sequence[str], maxlag: int, diff: bool = False) -> DataFrame:
    """Columns ``{c}__{j}`` = value ``j`` steps back (j = 0..maxlag) and ``_pos``.

    With ``diff`` the base series is first differenced (``{c}__d{j}``) and the
    level ``{c}__lv{j}`` is kept too.  Lags reaching before the series start
    are 0 (they are never used by a model whose sample starts later).
    """
    d = with_position(df, panel)
    need = maxlag + (1 if diff else 0)
    d = with_lag_cols(d, panel, cols, range(1, need + 1), fmt="_raw_{col}_{j}")
    sel = []
    for c in cols:
        for j in range(need + 1):
            v = F.col(f"_raw_{c}_{j}") if j else F.col(c)
            sel.append(F.when(F.col("_pos") >= j, v.cast("double")).otherwise(F.lit(0.0)).alias(f"_lv_{c}_{j}"))
    base = [*panel.keys, *([panel.ts] if panel.ts in df.columns else []), panel.t, panel.seg, "_pos"]
    d = d.select(*base, *sel)
    if not diff:
        return d.select(*base, *[F.col(f"_lv_{c}_{j}").alias(f"{c}__{j}") for c in cols for j in range(maxlag + 1)])
    out = base
    exprs = []
    for c in cols:
        for j in range(maxlag + 1):
            exprs.append(
                F.when(F.col("_pos") >= j + 1, F.col(f"_lv_{c}_{j}") - F.col(f"_lv_{c}_{j + 1}")).otherwise(F.lit(0.0)).alias(f"{c}__d{j}")
            )
            exprs.append(F.col(f"_lv_{c}_{j}").alias(f"{c}__lv{j}"))
        exprs.append(F.col(f"_lv_{c}_{maxlag + 1}").alias(f"{c}__lv{maxlag + 1}"))
    return d.select(*out, *exprs)


def cross_products(df: DataFrame, group_cols: Sequence[str], zcols: Sequence[str]) -> DataFrame:
    """Per group: ``n`` and ``g`` = packed upper triangle of ``Z'Z`` over the
    ``zcols`` (rows with a NULL skipped); unpack with :func:`gram`.

    Each task accumulates its rows per group with numpy (one partial matrix per
    group and task), the partial triangles are exploded and summed by a
    ``groupBy`` with map-side combine, and only the summed triangle per group is
    gathered -- a group spread over many tasks (a hot series) never lands whole
    in one place.
    """
    group_cols = list(group_cols)
    D = len(zcols)
    iu = np.triu_indices(D)
    zc = [f"_z{i}" for i in range(D)]
    sel = df.select(*group_cols, *[F.col(c).cast("double").alias(z) for c, z in zip(zcols, zc)])
    schema = T.StructType([*_key_fields(sel, group_cols), T.StructField("n", T.LongType()), T.StructField("g", T.ArrayType(T.DoubleType()))])

    # partial matrices kept per task before they are emitted (memory bound)
    max_groups = max(1, _PARTIAL_BYTES // (8 * D * D))

    def part(it):
        acc: dict = {}

        def flush():
            rows = [(*k, n, G[iu].tolist()) for k, (n, G) in acc.items()]
            acc.clear()
            return pd.DataFrame(rows, columns=[*group_cols, "n", "g"])

        for pdf in it:
            pdf = pdf.dropna(subset=zc)
            if pdf.empty:
                continue
            Z = pdf[zc].to_numpy(dtype=float)
            for key, idx in pdf.groupby(group_cols, sort=False, dropna=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                zz = Z[idx]
                cur = acc.get(key)
                if cur is None:
                    acc[key] = [len(idx), zz.T @ zz]
                else:
                    cur[0] += len(idx)
                    cur[1] += zz.T @ zz
            if len(acc) >= max_groups:
                yield flush()
        if acc:
            yield flush()

    partial = sel.mapInPandas(part, schema)
    ex = partial.select(*group_cols, "n", F.posexplode("g").alias("i", "v"))
    summed = ex.groupBy(*group_cols, "i").agg(F.sum("v").alias("v"), F.sum(F.when(F.col("i") == 0, F.col("n"))).alias("n"))
    return summed.groupBy(*group_cols).agg(
        F.sum("n").alias("n"),
        F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("g"),
    )


def gram(g, D: int) -> np.ndarray:
    """Full symmetric ``D x D`` matrix from the packed upper triangle of :func:`cross_products`."""
    G = np.zeros((D, D))
    iu = np.triu_indices(D)
    G[iu] = np.asarray(g, dtype=float)
    return G + np.triu(G, 1).T


def _stack(pdf: pd.DataFrame, D: int, maxb: int) -> np.ndarray:
    """Per-bucket matrices -> array [maxb+1, D, D] of sums over buckets >= b."""
    G = np.zeros((maxb + 2, D, D))
    N = np.zeros(maxb + 2)
    for b, g, n in zip(pdf["_b"], pdf["g"], pdf["n"]):
        G[int(b)] += gram(g, D)
        N[int(b)] += n
    return np.cumsum(G[::-1], axis=0)[::-1], np.cumsum(N[::-1])[::-1]


def _ols(G: np.ndarray, xi: list[int], yi: int):
    """Coefficients, SSR and (X'X)^-1 from a cross-product matrix."""
    XtX = G[np.ix_(xi, xi)]
    Xty = G[xi, yi]
    inv = np.linalg.pinv(XtX)
    b = inv @ Xty
    ssr = float(G[yi, yi] - b @ Xty)
    return b, max(ssr, 0.0), inv


# --------------------------------------------------------------------------- T1 Granger


def granger(df: DataFrame, panel: Panel, cols: Sequence[str], maxlag: int = 12) -> DataFrame:
    """For every ordered pair (response, predictor) and lag L = 1..maxlag,
    the chi-square form of the Granger test ``n (ssr_r - ssr_u) / ssr_u`` with
    ``L`` degrees of freedom, on rows with position >= L (own sample per L).

    Returns (keys, response, predictor, lag, chi2, p_value).  The diagonal is
    NULL (Q13).  Input should be gap free (fill first).
    """
    keys = list(panel.keys)
    lm = lag_matrix(df, panel, cols, maxlag)
    zcols = ["_one", *[f"{c}__{j}" for c in cols for j in range(maxlag + 1)]]
    lm = lm.withColumn("_one", F.lit(1.0)).withColumn("_b", F.least(F.col("_pos"), F.lit(maxlag)))
    cp = cross_products(lm, [*keys, "_b"], zcols)
    D, P = len(zcols), len(cols)

    def idx(v, j):
        return 1 + v * (maxlag + 1) + j

    schema = T.StructType(
        [*_key_fields(df, keys), T.StructField("response", T.StringType()), T.StructField("predictor", T.StringType()), T.StructField("lag", T.IntegerType()), T.StructField("chi2", T.DoubleType()), T.StructField("p_value", T.DoubleType())]
    )

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        Gs, Ns = _stack(pdf, D, maxlag)
        kv = [pdf[k].iloc[0] for k in keys]
        rows = []
        for r in range(P):
            for c in range(P):
                for L in range(1, maxlag + 1):
                    if r == c:
                        rows.append((*kv, cols[r], cols[c], L, None, None))
                        continue
                    G, n = Gs[L], Ns[L]
                    own = [0, *[idx(r, j) for j in range(1, L + 1)]]
                    joint = own + [idx(c, j) for j in range(1, L + 1)]
                    _, ssr_r, _ = _ols(G, own, idx(r, 0))
                    _, ssr_u, _ = _ols(G, joint, idx(r, 0))
                    if ssr_u <= 0 or n <= len(joint):
                        rows.append((*kv, cols[r], cols[c], L, None, None))
                        continue
                    stat = n * (ssr_r - ssr_u) / ssr_u
                    rows.append((*kv, cols[r], cols[c], L, float(stat), chi2_sf(stat, L)))
        return pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return cp.groupBy(*keys).applyInPandas(fn, schema)


def granger_min_p(tests: DataFrame, panel: Panel, digits: int = 4) -> DataFrame:
    """AG5: per (response, predictor) the least p-value over lags, each rounded first."""
    return tests.groupBy(*panel.keys, "response", "predictor").agg(F.min(F.bround("p_value", digits)).alias("min_p"))


def granger_matrix(min_p: DataFrame, panel: Panel, cols: Sequence[str]) -> DataFrame:
    """AG6: responses as rows (``{c}_y``), predictors as columns (``{c}_x``)."""
    m = min_p.withColumn("response", F.concat("response", F.lit("_y"))).withColumn("predictor", F.concat("predictor", F.lit("_x")))
    return m.groupBy(*panel.keys, "response").pivot("predictor", [f"{c}_x" for c in cols]).agg(F.first("min_p"))


# --------------------------------------------------------------------------- T2 ADF


def default_adf_maxlag(n: int) -> int:
    return max(0, min(n // 2 - 2, int(math.ceil(12.0 * (n / 100.0) ** 0.25))))


def adf(df: DataFrame, panel: Panel, cols: Sequence[str], maxlag: int | None = None, signif: float = 0.05) -> DataFrame:
    """Augmented Dickey-Fuller with a constant, lag order by AIC.

    Lag candidates 0..maxlag are compared on the common sample (position >=
    maxlag + 1), the chosen order is refitted on its own sample.  ``maxlag``
    defaults to ``min(n//2 - 2, ceil(12 (n/100)^(1/4)))`` per series, bounded
    by the longest series (one scalar aggregate).
    """
    keys = list(panel.keys)
    if maxlag is None:
        nmax = df.groupBy(*keys).count().agg(F.max("count")).collect()[0][0] or 0
        cap = default_adf_maxlag(int(nmax))
    else:
        cap = maxlag
    lm = lag_matrix(df, panel, cols, cap, diff=True)
    zcols = ["_one", *[f"{c}__lv1" for c in cols], *[f"{c}__d{j}" for c in cols for j in range(cap + 1)]]
    lm = lm.withColumn("_one", F.lit(1.0)).withColumn("_b", F.least(F.col("_pos"), F.lit(cap + 1)))
    lm = lm.filter(F.col("_pos") >= 1)
    cp = cross_products(lm, [*keys, "_b"], zcols)
    D, P = len(zcols), len(cols)
    schema = T.StructType(
        [
            *_key_fields(df, keys),
            T.StructField("column", T.StringType()),
            T.StructField("statistic", T.DoubleType()),
            T.StructField("p_value", T.DoubleType()),
            T.StructField("used_lag", T.IntegerType()),
            T.StructField("nobs", T.LongType()),
            T.StructField("crit_1", T.DoubleType()),
            T.StructField("crit_5", T.DoubleType()),
            T.StructField("crit_10", T.DoubleType()),
            T.StructField("stationary", T.BooleanType()),
        ]
    )

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        Gs, Ns = _stack(pdf, D, cap + 1)
        kv = [pdf[k].iloc[0] for k in keys]
        n_series = int(Ns[0]) + 1  # rows with position >= 1, plus the first row
        ml = min(cap, default_adf_maxlag(n_series)) if maxlag is None else cap
        rows = []
        for v in range(P):
            lv = 1 + v
            d0 = 1 + P + v * (cap + 1)
            G, nobs = Gs[ml + 1], Ns[ml + 1]
            best, best_aic = 0, None
            for lag in range(0, ml + 1):
                xi = [lv, *[d0 + j for j in range(1, lag + 1)], 0]
                _, ssr, _ = _ols(G, xi, d0)
                if nobs <= 0 or ssr <= 0:
                    continue
                llf = -nobs / 2.0 * (math.log(2 * math.pi) + math.log(ssr / nobs) + 1)
                aic = -2 * llf + 2 * len(xi)
                if best_aic is None or aic < best_aic:
                    best, best_aic = lag, aic
            G, nobs = Gs[best + 1], Ns[best + 1]
            xi = [lv, *[d0 + j for j in range(1, best + 1)], 0]
            b, ssr, inv = _ols(G, xi, d0)
            dof = nobs - len(xi)
            if dof <= 0 or inv[0, 0] <= 0:
                rows.append((*kv, cols[v], None, None, best, int(nobs), None, None, None, None))
                continue
            se = math.sqrt(ssr / dof * inv[0, 0])
            stat = float(b[0] / se) if se > 0 else None
            p = adf_pvalue(stat) if stat is not None else None
            cv = adf_critical(int(nobs))
            rows.append((*kv, cols[v], stat, p, best, int(nobs), cv["1%"], cv["5%"], cv["10%"], bool(p is not None and p <= signif)))
        return pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return cp.groupBy(*keys).applyInPandas(fn, schema)


# --------------------------------------------------------------------------- T3 Johansen


def johansen(df: DataFrame, panel: Panel, cols: Sequence[str], k_ar_diff: int = 5, crit_table: dict | None = None, signif: float = 0.05) -> DataFrame:
    """Johansen trace test without deterministic terms.

    Differences ``dx_t`` and the level ``x_{t-k}`` are each regressed on
    ``dx_{t-1..t-k}``; the residual moment matrices give the eigenvalues of
    ``Skk^-1 Sk0 S00^-1 S0k`` and the trace statistics
    ``-T sum_{j>=r} ln(1 - lambda_j)``.  Rows are labelled by hypothesis
    ``rank <= r`` (Q12).  ``signif`` (0.1, 0.05 or 0.01) picks the critical value, whose column is named after it
    (``crit_95``); more columns than the table has critical values for are refused, pass ``crit_table``.
    """
    keys = list(panel.keys)
    k = k_ar_diff
    P = len(cols)
    levels = [0.1, 0.05, 0.01]
    if signif not in levels:
        raise ValueError(f"signif must be one of {levels}")
    crit = [johansen_crit(i, crit_table)[levels.index(signif)] for i in range(1, P + 1)]
    lm = lag_matrix(df, panel, cols, k, diff=True)
    zcols = [*[f"{c}__d0" for c in cols], *[f"{c}__lv{k}" for c in cols], *[f"{c}__d{j}" for j in range(1, k + 1) for c in cols]]
    lm = lm.filter(F.col("_pos") >= k + 1).withColumn("_b", F.lit(0))
    cp = cross_products(lm, [*keys, "_b"], zcols)
    D = len(zcols)
    schema = T.StructType(
        [
            *_key_fields(df, keys),
            T.StructField("rank", T.IntegerType()),
            T.StructField("eigenvalue", T.DoubleType()),
            T.StructField("trace", T.DoubleType()),
            T.StructField(f"crit_{round(100 * (1 - signif))}", T.DoubleType()),
            T.StructField("reject", T.BooleanType()),
        ]
    )

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        Gs, Ns = _stack(pdf, D, 0)
        G, n = Gs[0], Ns[0]
        kv = [pdf[kk].iloc[0] for kk in keys]
        d_i, l_i, z_i = list(range(P)), list(range(P, 2 * P)), list(range(2 * P, D))

        def resid_moment(a, b):
            Gzz = G[np.ix_(z_i, z_i)]
            pinv = np.linalg.pinv(Gzz)
            return (G[np.ix_(a, b)] - G[np.ix_(a, z_i)] @ pinv @ G[np.ix_(z_i, b)]) / n

        s00, skk, sk0 = resid_moment(d_i, d_i), resid_moment(l_i, l_i), resid_moment(l_i, d_i)
        m = np.linalg.pinv(skk) @ sk0 @ np.linalg.pinv(s00) @ sk0.T
        ev = np.sort(np.real(np.linalg.eigvals(m)))[::-1]
        rows = []
        for r in range(P):
            tr = float(-n * np.sum(np.log(1 - ev[r:])))
            cv = crit[P - r - 1]
            rows.append((*kv, r, float(ev[r]), tr, cv, bool(tr > cv)))
        return pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return cp.groupBy(*keys).applyInPandas(fn, schema)


# --------------------------------------------------------------------------- T5 profile


def profile(df: DataFrame, panel: Panel, cols: Sequence[str], nlags: int = 30, bins: int = 25) -> DataFrame:
    """T5: histogram, ACF and PACF of each column as one long table
    (keys, column, kind, idx, value[, lo, hi])."""
    a = acf(df, panel, cols, nlags)
    p = pacf(a, panel)
    parts = [
        a.select(*panel.keys, "column", F.lit("acf").alias("kind"), F.col("lag").alias("idx"), F.col("acf").alias("value"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")),
        p.select(*panel.keys, "column", F.lit("pacf").alias("kind"), F.col("lag").alias("idx"), F.col("pacf").alias("value"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")),
    ]
    for c in cols:
        h = histogram(df, panel, c, bins)
        parts.append(h.select(*panel.keys, F.lit(c).alias("column"), F.lit("hist").alias("kind"), F.col("bin").alias("idx"), F.col("count").cast("double").alias("value"), "lo", "hi"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
