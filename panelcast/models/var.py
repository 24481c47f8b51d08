"""Vector autoregression per series (M6 fit + forecast, M7 order table, M8 VARX,
M9 step-by-step forecast with refit).

The data pass is :func:`panelcast.operators.stats.cross_products` over the lag
matrix, bucketed by row position so every lag order uses its own sample (rows
with position >= p), as a per-order least-squares fit does.  Everything after
that -- solves, information criteria -- runs per series on ``D x D`` matrices.
Forecasts walk blocks of the horizon: multi-step ones all at once, from starting
states composed out of the blocks' affine maps; step-by-step ones (M9, a refit
after every step) in rounds of blocks, with an updated inverse in place of a
new solution.  No group holds a series' history or its whole horizon.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.clean import last_rows
from panelcast.operators.stats import _stack, cross_products, lag_matrix
from panelcast.plans.panel import Panel, attach_series, with_position
from panelcast.session import ensure_checkpoint_dir


def _zcols(cols, exog, p):
    lagged = [f"{c}__{j}" for j in range(1, p + 1) for c in cols]
    return ["_one", *lagged, *[f"{e}__0" for e in exog], *[f"{c}__0" for c in cols]]


def _gram(df: DataFrame, panel: Panel, cols, exog, p: int, bucket_cap: int | None = None) -> DataFrame:
    lm = lag_matrix(df, panel, [*cols, *exog], p)
    lm = lm.withColumn("_one", F.lit(1.0))
    cap = p if bucket_cap is None else bucket_cap
    lm = lm.withColumn("_b", F.least(F.col("_pos"), F.lit(cap)))
    return cross_products(lm, [*panel.keys, "_b"], _zcols(cols, exog, p))


def _solve(G: np.ndarray, m: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients A (k x m) and residual SSR matrix (m x m) from G over [x(k), y(m)]."""
    XtX = G[:k, :k]
    XtY = G[:k, k : k + m]
    A = np.linalg.lstsq(XtX, XtY, rcond=None)[0]
    S = G[k : k + m, k : k + m] - A.T @ XtY - XtY.T @ A + A.T @ XtX @ A
    return A, S


def _sub(G: np.ndarray, idx: list[int]) -> np.ndarray:
    return G[np.ix_(idx, idx)]


def fit(df: DataFrame, panel: Panel, cols: Sequence[str], lag: int, exog: Sequence[str] = ()) -> DataFrame:
    """M6/M8: VAR(lag) with a constant (and unlagged exogenous columns) per series.

    Returns (keys, equation, intercept, coef, sigma2, nobs); ``coef`` is ordered
    lag 1 (all columns), lag 2, ..., then exogenous columns.
    """
    cols, exog = list(cols), list(exog)
    keys = list(panel.keys)
    cp = _gram(df, panel, cols, exog, lag)
    m, k = len(cols), 1 + len(cols) * lag + len(exog)
    D = k + m
    schema = T.StructType(
        [*[df.schema[c] for c in keys], T.StructField("equation", T.StringType()), T.StructField("intercept", T.DoubleType()), T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("sigma2", T.DoubleType()), T.StructField("nobs", T.LongType())]
    )

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        Gs, Ns = _stack(pdf, D, lag)
        G, n = Gs[lag], Ns[lag]
        A, S = _solve(G, m, k)
        kv = [pdf[c].iloc[0] for c in keys]
        rows = [(*kv, cols[e], float(A[0, e]), [float(x) for x in A[1:, e]], float(S[e, e] / n) if n else None, int(n)) for e in range(m)]
        return pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return cp.groupBy(*keys).applyInPandas(fn, schema)


def order_table(df: DataFrame, panel: Panel, cols: Sequence[str], maxlag: int) -> DataFrame:
    """M7: AIC, BIC, FPE, HQIC of VAR(p) for p = 0..maxlag-1, each on its own sample."""
    cols = list(cols)
    keys = list(panel.keys)
    top = max(maxlag - 1, 0)
    cp = _gram(df, panel, cols, [], top, bucket_cap=top)
    m = len(cols)
    D = 1 + m * top + m
    schema = T.StructType(
        [*[df.schema[c] for c in keys], T.StructField("lag", T.IntegerType()), T.StructField("aic", T.DoubleType()), T.StructField("bic", T.DoubleType()), T.StructField("fpe", T.DoubleType()), T.StructField("hqic", T.DoubleType())]
    )

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        Gs, Ns = _stack(pdf, D, top)
        kv = [pdf[c].iloc[0] for c in keys]
        rows = []
        for p in range(0, maxlag):
            G, n = Gs[p], Ns[p]
            idx = [0, *range(1, 1 + m * p), *range(1 + m * top, 1 + m * top + m)]
            k = 1 + m * p
            A, S = _solve(_sub(G, idx), m, k)
            sign, ld = np.linalg.slogdet(S / n)
            if sign <= 0 or n <= k:
                rows.append((*kv, p, None, None, None, None))
                continue
            free = p * m * m
            aic = ld + 2.0 / n * free
            bic = ld + math.log(n) / n * free
            hqic = ld + 2.0 * math.log(math.log(n)) / n * free
            fpe = ((n + k) / (n - k)) ** m * math.exp(ld)
            rows.append((*kv, p, float(aic), float(bic), float(fpe), float(hqic)))
        return pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return cp.groupBy(*keys).applyInPandas(fn, schema)


def _starts(cp: DataFrame, train: DataFrame, panel: Panel, cols, lag: int, D: int, k: int, schema) -> DataFrame:
    """One row a series: the cross products of its sample and its last ``lag`` rows (latest first), both NULL when the sample has fewer rows
    than the ``k`` coefficients or fewer than ``lag`` rows of history."""
    keys = list(panel.keys)
    tail = last_rows(train.select(*keys, panel.ts, panel.t, panel.seg, *cols), panel, lag).select(*keys, panel.t, *cols)

    def fn(gram: pd.DataFrame, last: pd.DataFrame) -> pd.DataFrame:
        g = hist = None
        if not gram.empty and len(last) >= lag:
            Gs, Ns = _stack(gram, D, lag)
            if Ns[lag] >= k:
                g = [float(x) for x in Gs[lag].ravel()]
                hist = [float(x) for x in last.sort_values(panel.t, ascending=False)[cols].to_numpy(dtype=float).ravel()]
        some = gram if not gram.empty else last
        return pd.DataFrame([(*[some[c].iloc[0] for c in keys], g, hist)], columns=[*keys, "_g", "_h"])

    out = T.StructType([*[schema[c] for c in keys], T.StructField("_g", T.ArrayType(T.DoubleType())), T.StructField("_h", T.ArrayType(T.DoubleType()))])
    return cp.groupBy(*keys).cogroup(tail.groupBy(*keys)).applyInPandas(fn, out)


def _blocks(test: DataFrame, panel: Panel, cols, block_steps: int) -> DataFrame:
    """The test rows with their number in the horizon cut into blocks of ``block_steps``, checkpointed."""
    ensure_checkpoint_dir(test.sparkSession)
    rows = with_position(test.select(*dict.fromkeys([*panel.keys, panel.ts, panel.t, panel.seg, *cols])), panel)
    return rows.withColumn("_blk", F.expr(f"_pos div {block_steps}")).drop("_pos", "_n").checkpoint()


def _filled(values) -> bool:
    """Whether an array cell holds an array."""
    return isinstance(values, (list, np.ndarray))


def _forecast_rows(fut: pd.DataFrame, keep: Sequence[str], values: dict, short: bool) -> pd.DataFrame:
    """The horizon's rows with their forecasts and the reason why one is missing."""
    res = fut[list(keep)].assign(**values)
    gone = np.isnan(np.asarray(list(values.values())[-1], dtype=float))
    res["reason"] = np.where(gone, "short history" if short else "missing values", None)
    return res


def _walk(A: np.ndarray, ex: np.ndarray, state: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The recursion over the rows of ``ex`` from ``state`` (last values, latest first): all forecasts and the state after them."""
    n, kx = len(ex), len(state)
    drive = A[0] + ex @ A[1 + kx :]
    step = A[1 : 1 + kx]
    out = np.empty((n, m))
    for i in range(n):
        out[i] = drive[i] + state @ step
        state = np.concatenate([out[i], state[: kx - m]])
    return out, state


def forecast(train: DataFrame, test: DataFrame, panel: Panel, cols: Sequence[str], lag: int, exog: Sequence[str] = (), suffix: str = "_fc", block_steps: int = 4096) -> DataFrame:
    """M6/M8: multi-step forecast over the rows of ``test`` (one step per test row,
    in time order) from the last ``lag`` training rows; exogenous values come from
    the test rows.

    The recursion is an affine map of the state (the last ``lag`` rows).  Each block of ``block_steps`` rows is walked once from a zero state,
    which gives its map (a matrix power and an offset); the maps of a series, one row a block, are composed in order to each block's
    starting state, and the blocks are walked again from there, all at once.

    Returns one row per test row: keys, time, ``{c}{suffix}`` columns and ``reason``.  A series with fewer training
    rows than the model has coefficients gets NULL forecasts (reason ``short history``), and a row whose exogenous
    values are missing, with those after it that build on it, too (``missing values``)."""
    cols, exog = list(cols), list(exog)
    keys = list(panel.keys)
    cp = _gram(train, panel, cols, exog, lag)
    m, k = len(cols), 1 + len(cols) * lag + len(exog)
    D = k + m
    kf = [test.schema[c] for c in keys]
    arr = T.ArrayType(T.DoubleType())
    rows = _blocks(test, panel, exog, block_steps)
    model = _starts(cp, train, panel, cols, lag, D, k, test.schema).checkpoint()
    block = [*keys, "_blk"]
    own = rows.select(*[F.col(c).alias(f"_{c}") for c in block]).distinct()
    with_model = own.select(*[F.col(f"_{c}").alias(c) for c in block]).join(model, keys, "left")

    def offset(fut: pd.DataFrame, one: pd.DataFrame) -> pd.DataFrame:
        w, g = None, one["_g"].iloc[0]
        if _filled(g):
            A, _ = _solve(np.reshape(g, (D, D)), m, k)
            ex = fut.sort_values(panel.t)[exog].to_numpy(dtype=float)
            w = [float(x) for x in _walk(A, ex, np.zeros(m * lag), m)[1]]
        return pd.DataFrame([(*[one[c].iloc[0] for c in block], len(fut), w)], columns=[*block, "_n", "_w"])

    maps = rows.groupBy(*block).cogroup(with_model.groupBy(*block)).applyInPandas(offset, T.StructType([*kf, T.StructField("_blk", T.LongType()), T.StructField("_n", T.LongType()), T.StructField("_w", arr)]))

    def compose(blocks: pd.DataFrame, one: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("_blk")
        g = one["_g"].iloc[0] if len(one) else None
        starts: list = [None] * len(blocks)
        if _filled(g):
            A, _ = _solve(np.reshape(g, (D, D)), m, k)
            M = np.zeros((m * lag, m * lag))
            M[:, :m] = A[1 : 1 + m * lag]
            M[: m * (lag - 1), m:] = np.eye(m * (lag - 1))
            state = np.asarray(one["_h"].iloc[0], dtype=float)
            for i, (n, w) in enumerate(zip(blocks["_n"], blocks["_w"])):
                starts[i] = [float(x) for x in state]
                state = state @ np.linalg.matrix_power(M, int(n)) + np.asarray(w, dtype=float)
        return blocks[block].assign(_g=[g if _filled(g) else None] * len(blocks), _s=starts)

    begun = maps.groupBy(*keys).cogroup(model.groupBy(*keys)).applyInPandas(compose, T.StructType([*kf, T.StructField("_blk", T.LongType()), T.StructField("_g", arr), T.StructField("_s", arr)]))
    schema = T.StructType([*kf, test.schema[panel.ts], *[T.StructField(f"{c}{suffix}", T.DoubleType()) for c in cols], T.StructField("reason", T.StringType())])

    def walk(fut: pd.DataFrame, one: pd.DataFrame) -> pd.DataFrame:
        fut, g = fut.sort_values(panel.t), one["_g"].iloc[0]
        pred = np.full((len(fut), m), np.nan)
        if _filled(g):
            A, _ = _solve(np.reshape(g, (D, D)), m, k)
            pred, _ = _walk(A, fut[exog].to_numpy(dtype=float), np.asarray(one["_s"].iloc[0], dtype=float), m)
        return _forecast_rows(fut, [*keys, panel.ts], {f"{c}{suffix}": pred[:, i] for i, c in enumerate(cols)}, not _filled(g))

    return rows.groupBy(*block).cogroup(begun.groupBy(*block)).applyInPandas(walk, schema)


REFRESH = 256


def _refit_walk(G: np.ndarray, hist: np.ndarray, truth: np.ndarray, m: int, k: int, ti: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Predict a row, append it with the predicted target, refit: the forecasts and the cross products and history after them.

    The refit updates the inverse of the cross products and the coefficients by the new row (computed afresh every ``REFRESH``
    rows); a singular matrix is solved anew at each row."""
    pred = np.full(len(truth), np.nan)
    G, whole = G.copy(), False
    for i, row in enumerate(truth):
        if i % REFRESH == 0 or not whole:
            A, _ = _solve(G, m, k)
            whole = np.linalg.matrix_rank(G[:k, :k]) == k
            P = np.linalg.inv(G[:k, :k]) if whole else None
        x = np.concatenate([[1.0], hist])
        yhat = x @ A
        new = np.where(np.isnan(row), yhat, row)
        new[ti] = pred[i] = yhat[ti]
        if whole:
            px = P @ x
            gain = px / (1.0 + x @ px)
            A = A + np.outer(gain, new - yhat)
            P = P - np.outer(gain, px)
        z = np.concatenate([x, new])
        G += np.outer(z, z)
        hist = np.concatenate([new, hist[: len(hist) - m]])
    return pred, G, hist


def step_by_step(train: DataFrame, test: DataFrame, panel: Panel, cols: Sequence[str], target: str, lag: int, out: str = "y_pred", block_steps: int = 1 << 16) -> DataFrame:
    """M9: for each test row in time order -- refit VAR(lag) on the history, predict
    one step, keep the target forecast, append the row with its known features and
    the *predicted* target.  Refits are rank-one updates of the inverse cross products.

    Each step needs the one before, so a horizon is walked in rounds of ``block_steps`` rows, all series at once; between rounds a series
    is its cross products and its last ``lag`` rows.

    ``target`` must be one of ``cols``.  Returns one row per test row: (keys, ts, t, seg, y, y_pred, reason).  A known feature that is
    missing at a step is taken from the model's own forecast; a series with fewer training rows than the model has
    coefficients gets NULL forecasts (reason ``short history``).
    """
    cols = list(cols)
    keys = list(panel.keys)
    ti = cols.index(target)
    cp = _gram(train, panel, cols, [], lag)
    m, k = len(cols), 1 + len(cols) * lag
    D = k + m
    rows = _blocks(test, panel, cols, block_steps)
    state = _starts(cp, train, panel, cols, lag, D, k, test.schema).checkpoint()
    kept = [*keys, panel.ts, panel.t, panel.seg]
    arr = T.ArrayType(T.DoubleType())
    found = [T.StructField("y", T.DoubleType()), T.StructField(out, T.DoubleType()), T.StructField("reason", T.StringType())]
    carried = [T.StructField("_g", arr), T.StructField("_h", arr), T.StructField("_carry", T.BooleanType())]
    schema = T.StructType([*[test.schema[c] for c in kept], *found, *carried])
    names = [f.name for f in schema.fields]

    def fn(fut: pd.DataFrame, one: pd.DataFrame) -> pd.DataFrame:
        fut = fut.sort_values(panel.t)
        truth = fut[cols].to_numpy(dtype=float)
        g = one["_g"].iloc[0] if len(one) else None
        pred, parts = np.full(len(fut), np.nan), []
        if _filled(g):
            pred, G, hist = _refit_walk(np.reshape(g, (D, D)).astype(float), np.asarray(one["_h"].iloc[0], dtype=float), truth, m, k, ti)
            if len(fut):
                carry = fut.iloc[:1][kept].assign(y=np.nan, **{out: np.nan}, reason=None, _g=[[float(x) for x in G.ravel()]], _h=[[float(x) for x in hist]], _carry=True)
                parts = [carry[names]]
        res = _forecast_rows(fut, kept, {"y": truth[:, ti], out: pred}, not _filled(g))
        res = res.assign(_g=None, _h=None, _carry=False)[names]
        return pd.concat([p for p in (res, *parts) if len(p)] or [res])

    last = rows.agg(F.max("_blk")).first()[0] or 0
    done = []
    for b in range(last + 1):
        got = rows.filter(F.col("_blk") == b).groupBy(*keys).cogroup(state.groupBy(*keys)).applyInPandas(fn, schema)
        if last:
            got = got.checkpoint()
            state = got.filter("_carry").select(*keys, "_g", "_h")
        done.append(got.filter("NOT _carry").select(*kept, *[f.name for f in found]))
    for d in done[1:]:
        done[0] = done[0].unionByName(d)
    return done[0]


def residuals(df: DataFrame, panel: Panel, coefs: DataFrame, cols: Sequence[str], lag: int, exog: Sequence[str] = ()) -> DataFrame:
    """In-sample residuals per equation (long: keys, ts, t, seg, equation, resid) for AG9."""
    cols, exog = list(cols), list(exog)
    lm = lag_matrix(df, panel, [*cols, *exog], lag).filter(F.col("_pos") >= lag)
    regs = [f"{c}__{j}" for j in range(1, lag + 1) for c in cols] + [f"{e}__0" for e in exog]
    # one row per series holding every equation, fanned out to the panel's segments
    per_series = coefs.groupBy(*panel.keys).agg(
        F.map_from_entries(F.collect_list(F.struct("equation", F.struct("intercept", "coef")))).alias("_eqs")
    )
    j = attach_series(lm, panel, per_series)
    long = j.select("*", F.explode(F.array(*[F.struct(F.lit(x).alias("equation"), F.col(f"{x}__0").alias("_y")) for x in cols])).alias("_eq"))
    long = long.select("*", F.col("_eq.equation").alias("equation"), F.col("_eq._y").alias("_y")).drop("_eq")
    e = F.element_at(F.col("_eqs"), F.col("equation"))
    fitted = e["intercept"]
    for i, x in enumerate(regs):
        fitted = fitted + e["coef"][i] * F.col(x)
    return long.select(*panel.keys, panel.ts, panel.t, panel.seg, "equation", (F.col("_y") - fitted).alias("resid"))
