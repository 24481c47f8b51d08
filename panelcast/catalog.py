"""Registered queries over the driver tables and their DuckDB oracle SQL.

Each query takes ``(spark, data_dir)`` and returns a DataFrame; each oracle is
plain SQL over the same tables.  Floating outputs are rounded to 4 places on
both sides so the value hashes agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators import clean, features, scale, score, smooth
from panelcast.plans.panel import Panel, with_position
from panelcast.session import configure
from panelcast.sources.panels import PRIORITIES, PRIORITY_COLS, events_panel, orders_panel, orders_weekly

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

MEASURES = ["cnt", "avg_price", *PRIORITY_COLS]


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def r4(c: str):
    """Round to 4 places as ``round(x * 1e4) / 1e4`` -- the same double arithmetic
    the oracle engine uses, so identical doubles round identically."""
    return round4(F.col(c)).alias(c)


def round4(col):
    # half away from zero on the scaled value, keeping the sign of zero (-0.0)
    return F.signum(col) * F.floor(F.abs(col * F.lit(10000.0)) + F.lit(0.5)) / F.lit(10000.0)


def out(df: DataFrame, panel: Panel, cols, ints=()) -> DataFrame:
    return df.select(*panel.keys, panel.ts, *[F.col(c) if c in ints else r4(c) for c in cols])


def opanel(spark: SparkSession, d: str, seg_steps: int | None = None):
    configure(spark)
    return orders_panel(spark, d, seg_steps)


# --------------------------------------------------------------------------- oracle building blocks

_PRIO_SQL = ",\n    ".join(
    f"CAST(sum(CASE WHEN o.o_orderpriority = '{p}' THEN CAST(o.o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE)"
    f" / nullif(count(CASE WHEN o.o_orderpriority = '{p}' THEN 1 END), 0) AS {c}"
    for p, c in zip(PRIORITIES, PRIORITY_COLS)
)
OW_CTE = f"""ow AS (
  SELECT n.n_name, CAST(date_trunc('week', o.o_orderdate) AS DATE) AS wk,
    count(*) AS cnt, CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_price,
    {_PRIO_SQL}
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY 1, 2)"""
_MCOLS = ", ".join(f"ow.{c}" for c in MEASURES)
PANEL_CTE = f"""{OW_CTE},
owt AS (SELECT *, date_diff('day', DATE '1970-01-05', wk) // 7 AS t FROM ow),
bnd AS (SELECT n_name, min(t) AS lo, max(t) AS hi FROM owt GROUP BY 1),
sp AS (SELECT n_name, unnest(generate_series(lo, hi)) AS t FROM bnd),
panel AS (
  SELECT sp.n_name, CAST(DATE '1970-01-05' + CAST(sp.t * 7 AS INTEGER) AS DATE) AS wk, sp.t, {_MCOLS}
  FROM sp LEFT JOIN owt ow ON sp.n_name = ow.n_name AND sp.t = ow.t)"""

EV_CTE = """evh AS (
  SELECT event_type, date_trunc('hour', ts) AS hr, count(*) AS cnt, avg(value) AS avg_value
  FROM events GROUP BY 1, 2),
evt AS (SELECT *, date_diff('day', DATE '1970-01-01', CAST(hr AS DATE)) * 24 + hour(hr) AS t FROM evh),
evb AS (SELECT event_type, min(t) AS lo, max(t) AS hi FROM evt GROUP BY 1),
evs AS (SELECT event_type, unnest(generate_series(lo, hi)) AS t FROM evb),
epanel AS (
  SELECT evs.event_type, TIMESTAMP '1970-01-01 00:00:00' + to_hours(evs.t) AS hr, evs.t, evt.cnt, evt.avg_value
  FROM evs LEFT JOIN evt ON evs.event_type = evt.event_type AND evs.t = evt.t)"""


def _sel(cols, src="", ints=()):
    p = f"{src}." if src else ""
    return ", ".join(f"{p}{c} AS {c}" if c in ints else f"round({p}{c}, 4) AS {c}" for c in cols)


def _ffill_sql(cols, src="panel", key="n_name"):
    w = f"OVER (PARTITION BY {key} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return ", ".join(f"last_value({c} IGNORE NULLS) {w} AS {c}" for c in cols)


def _bfill_sql(cols, key="n_name"):
    w = f"OVER (PARTITION BY {key} ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return ", ".join(f"first_value({c} IGNORE NULLS) {w} AS {c}" for c in cols)


def _ewm_sql(src: str, cols: dict[str, str], span: float, key: str, ts: str) -> str:
    """Full-history EWM by self-join: sum(r^(t-i) v) / sum(r^(t-i)) over earlier non-null v."""
    r = repr(1.0 - 2.0 / (span + 1.0))
    parts = []
    for out_name, c in cols.items():
        parts.append(
            f"sum(CASE WHEN b.{c} IS NOT NULL THEN pow({r}, a.t - b.t) * b.{c} END)"
            f" / sum(CASE WHEN b.{c} IS NOT NULL THEN pow({r}, a.t - b.t) END) AS {out_name}"
        )
    return (
        f"SELECT a.{key}, a.{ts}, a.t, {', '.join(parts)} FROM {src} a "
        f"LEFT JOIN {src} b ON a.{key} = b.{key} AND b.t <= a.t GROUP BY a.{key}, a.{ts}, a.t"
    )


# --------------------------------------------------------------------------- step 0: panel, fills, smoothing, scaling, score


@register(
    "q_join_panel",
    f"""WITH {OW_CTE},
feat AS (SELECT n_name, isoyear(wk) AS year, weekofyear(wk) AS weekofyear, wk, avg_price, p1 FROM ow),
lab AS (SELECT n_name, isoyear(wk) AS year, weekofyear(wk) AS weekofyear, cnt FROM ow WHERE cnt > 1)
SELECT f.n_name, f.year, f.weekofyear, f.wk AS week_start_date, l.cnt, round(f.avg_price, 4) AS avg_price, round(f.p1, 4) AS p1
FROM feat f JOIN lab l ON f.n_name = l.n_name AND f.year = l.year AND f.weekofyear = l.weekofyear""",
)
def q_join_panel(spark, d):
    """IO7 J1 PR3: weekly features joined to weekly labels on (series, year, week of year)."""
    configure(spark)
    # both sides come from one weekly aggregate: write it once (reliable checkpoint
    # in spark.checkpoint.dir) instead of scanning and joining the orders twice
    w = orders_weekly(spark, d).checkpoint(eager=True)
    keyed = w.select(
        "*",
        F.extract(F.lit("YEAROFWEEK"), F.col("wk")).cast("bigint").alias("year"),
        F.weekofyear("wk").cast("bigint").alias("weekofyear"),
    )
    feat = keyed.select("n_name", "year", "weekofyear", F.col("wk").alias("week_start_date"), "avg_price", "p1")
    lab = keyed.filter(F.col("cnt") > 1).select("n_name", "year", "weekofyear", "cnt")
    j = feat.join(lab, ["n_name", "year", "weekofyear"], "inner")
    return j.select("n_name", "year", "weekofyear", "week_start_date", "cnt", r4("avg_price"), r4("p1"))


@register("q_spine", f"WITH {PANEL_CTE} SELECT n_name, wk, cnt, {_sel(MEASURES[1:])} FROM panel")
def q_spine(spark, d):
    """Regular weekly panel per nation; gap weeks are NULL rows."""
    df, p = opanel(spark, d)
    return out(df, p, MEASURES, ints=("cnt",))


@register(
    "q_events_panel",
    f"WITH {EV_CTE} SELECT event_type, hr, cnt, round(avg_value, 4) AS avg_value FROM epanel",
)
def q_events_panel(spark, d):
    """Regular hourly panel per event type."""
    configure(spark)
    df, p = events_panel(spark, d)
    return out(df, p, ["cnt", "avg_value"], ints=("cnt",))


@register(
    "q_ffill",
    f"WITH {PANEL_CTE}, f AS (SELECT n_name, wk, {_ffill_sql(MEASURES)} FROM panel) "
    f"SELECT n_name, wk, cnt, {_sel(MEASURES[1:])} FROM f",
)
def q_ffill(spark, d):
    """W1."""
    df, p = opanel(spark, d)
    return out(clean.ffill(df, p, MEASURES), p, MEASURES, ints=("cnt",))


@register(
    "q_bfill",
    f"WITH {PANEL_CTE}, f AS (SELECT n_name, wk, {_bfill_sql(MEASURES)} FROM panel) "
    f"SELECT n_name, wk, cnt, {_sel(MEASURES[1:])} FROM f",
)
def q_bfill(spark, d):
    """W2."""
    df, p = opanel(spark, d)
    return out(clean.bfill(df, p, MEASURES), p, MEASURES, ints=("cnt",))


_EWM4_COLS = ["cnt", "avg_price"]


@register(
    "q_ewm5",
    f"WITH {PANEL_CTE}, e AS ({_ewm_sql('panel', {c: c for c in _EWM4_COLS}, 5, 'n_name', 'wk')}) "
    f"SELECT n_name, wk, {_sel(_EWM4_COLS)} FROM e",
)
def q_ewm5(spark, d):
    """W3, span 5 (the prediction-smoothing span), straight over the gaps."""
    df, p = opanel(spark, d)
    return out(smooth.ewm(df, p, _EWM4_COLS, 5), p, _EWM4_COLS)


@register(
    "q_ewm8",
    f"WITH {EV_CTE}, e AS ({_ewm_sql('epanel', {'cnt': 'cnt', 'avg_value': 'avg_value'}, 8, 'event_type', 'hr')}) "
    f"SELECT event_type, hr, {_sel(['cnt', 'avg_value'])} FROM e",
)
def q_ewm8(spark, d):
    """W3, span 8, on the hourly events panel."""
    configure(spark)
    df, p = events_panel(spark, d)
    return out(smooth.ewm(df, p, ["cnt", "avg_value"], 8), p, ["cnt", "avg_value"])


_Z_COLS = ["cnt", "avg_price", "p1"]


def _zscore_sql(cols):
    st = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
    z = ", ".join(
        f"round((p.{c} - s.m_{c}) / CASE WHEN s.s_{c} IS NULL OR s.s_{c} = 0 THEN 1 ELSE s.s_{c} END, 4) AS {c}" for c in cols
    )
    return st, z


_ST, _Z = _zscore_sql(_Z_COLS)
_STATS_COLS = ["cnt", "avg_price", "p2"]
_ST2, _ = _zscore_sql(_STATS_COLS)


@register(
    "q_zscore",
    f"WITH {PANEL_CTE}, s AS (SELECT n_name, {_ST} FROM panel GROUP BY 1) "
    f"SELECT p.n_name, p.wk, {_Z} FROM panel p JOIN s ON p.n_name = s.n_name",
)
def q_zscore(spark, d):
    """AG1 SC1: per-series z-score with the population deviation."""
    df, p = opanel(spark, d)
    z, _ = scale.fit_transform(df, p, _Z_COLS)
    return out(z, p, _Z_COLS)


@register(
    "q_scaler_stats",
    f"WITH {PANEL_CTE}, s AS (SELECT n_name, {_ST2} FROM panel GROUP BY 1) "
    + "SELECT n_name, col AS \"column\", round(mean, 4) AS mean, round(std, 4) AS std FROM ("
    + " UNION ALL ".join(f"SELECT n_name, '{c}' AS col, m_{c} AS mean, s_{c} AS std FROM s" for c in _STATS_COLS)
    + ")",
)
def q_scaler_stats(spark, d):
    """AG1: the stored scaler table (series, column, mean, std)."""
    df, p = opanel(spark, d)
    st = scale.fit_scaler(df, p, _STATS_COLS)
    return st.select("n_name", "column", r4("mean"), r4("std"))


@register(
    "q_unscale",
    f"WITH {PANEL_CTE}, tr AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY t) "
    f"<= count(*) OVER (PARTITION BY n_name) - ceil(0.3 * count(*) OVER (PARTITION BY n_name))), "
    f"s AS (SELECT n_name, {_ST} FROM tr GROUP BY 1) "
    f"SELECT p.n_name, p.wk, {', '.join(f'round(CAST(p.{c} AS DOUBLE), 4) AS {c}' for c in _Z_COLS)}, "
    f"round((p.avg_price - s.m_avg_price) / CASE WHEN s.s_avg_price IS NULL OR s.s_avg_price = 0 THEN 1 ELSE s.s_avg_price END, 4) AS z_price "
    f"FROM panel p JOIN s ON p.n_name = s.n_name",
)
def q_unscale(spark, d):
    """SC2-SC4: fit on the first 70% of each series, transform all rows, invert back.

    ``cnt``/``avg_price``/``p1`` come back through inverse(transform(x)); ``z_price`` is the scaled value."""
    df, p = opanel(spark, d)
    pos = with_position(df, p)
    train = pos.filter(F.col("_pos") < F.col("_n") - F.ceil(F.col("_n") * 0.3)).drop("_pos", "_n")
    st = scale.fit_scaler(train, p, _Z_COLS)
    z = scale.transform(df, p, st, _Z_COLS).withColumn("z_price", F.col("avg_price"))
    back = scale.inverse(z, p, st, _Z_COLS)
    return out(back, p, [*_Z_COLS, "z_price"])


def naive_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Long prediction table of three simple predictors of ``cnt`` on the filled panel:
    last week (``naive``), mean of the last 4 weeks (``mean4``) and EWM span 4 of the
    previous weeks (``ewm4``).  Columns: n_name, wk, model, y, y_pred."""
    df, p = opanel(spark, d)
    f = clean.ffill(df, p, ["cnt"])
    f = smooth.ewm(f, p, {"cnt": "_sm"}, 4)
    f = features.lags(f, p, ["cnt", "_sm"], 4, fmt="{col}_l{j}")
    f = f.withColumn("_mean4", features.row_mean("cnt_l1", "cnt_l2", "cnt_l3", "cnt_l4"))
    long = f.select(
        "n_name",
        "wk",
        F.col("cnt").cast("double").alias("y"),
        F.inline(
            F.array(
                F.struct(F.lit("naive").alias("model"), F.col("cnt_l1").cast("double").alias("y_pred")),
                F.struct(F.lit("mean4").alias("model"), F.col("_mean4").alias("y_pred")),
                F.struct(F.lit("ewm4").alias("model"), F.col("_sm_l1").alias("y_pred")),
            )
        ),
    )
    return long


_NAIVE_SQL = f"""{PANEL_CTE},
fl AS (SELECT n_name, wk, t, {_ffill_sql(['cnt'])} FROM panel),
sm AS ({_ewm_sql('fl', {'sm': 'cnt'}, 4, 'n_name', 'wk')}),
lg AS (
  SELECT fl.n_name, fl.wk, CAST(fl.cnt AS DOUBLE) AS y,
    CAST(lag(fl.cnt, 1) OVER w AS DOUBLE) AS l1,
    (lag(fl.cnt, 1) OVER w + lag(fl.cnt, 2) OVER w + lag(fl.cnt, 3) OVER w + lag(fl.cnt, 4) OVER w) / 4.0 AS m4,
    lag(sm.sm, 1) OVER w AS s1
  FROM fl JOIN sm ON fl.n_name = sm.n_name AND fl.t = sm.t
  WINDOW w AS (PARTITION BY fl.n_name ORDER BY fl.t)),
pred AS (
  SELECT n_name, wk, y, 'naive' AS model, l1 AS y_pred FROM lg
  UNION ALL SELECT n_name, wk, y, 'mean4', m4 FROM lg
  UNION ALL SELECT n_name, wk, y, 'ewm4', s1 FROM lg)"""


@register(
    "q_score",
    f"""WITH {_NAIVE_SQL},
g AS (
  SELECT n_name, model, avg(abs(y - y_pred)) AS mae, avg((y - y_pred) * (y - y_pred)) AS mse,
    sum((y - y_pred) * (y - y_pred)) AS residual, var_pop(y) * count(*) AS sst
  FROM pred WHERE y IS NOT NULL AND y_pred IS NOT NULL GROUP BY 1, 2)
SELECT n_name, model, round_even(mae, 3) AS mae, round_even(mse, 3) AS mse,
  round_even(CASE WHEN sst > 0 THEN 1 - residual / sst WHEN residual = 0 THEN 1.0 ELSE 0.0 END, 3) AS r2,
  round_even(CASE WHEN sst <> 0 THEN 1 - residual / sst END, 3) AS r2_hand,
  round_even(residual, 3) AS residual
FROM g""",
)
def q_score(spark, d):
    """AG2 PR17: MAE, MSE, R2, hand R2 and residual per nation and model."""
    return score.score(naive_predictions(spark, d), by=("n_name", "model"))


# --------------------------------------------------------------------------- step 1: expressions, lags, calendar

_FILLED = f"""{PANEL_CTE},
fp AS (SELECT n_name, wk, t, {_ffill_sql(MEASURES)} FROM panel)"""


def filled_panel(spark, d, seg_steps=None):
    df, p = opanel(spark, d, seg_steps)
    return clean.ffill(df, p, MEASURES), p


@register(
    "q_flag",
    f"""WITH {PANEL_CTE}, e AS ({_ewm_sql('panel', {'e1': 'p1', 'e2': 'p2', 'e3': 'p3'}, 4, 'n_name', 'wk')})
SELECT n_name, wk, coalesce(CAST(e1 < 250000 AS INTEGER), 0) AS p1_flag,
  coalesce(CAST(e2 < 250000 AS INTEGER), 0) AS p2_flag, coalesce(CAST(e3 < 250000 AS INTEGER), 0) AS p3_flag FROM e""",
)
def q_flag(spark, d):
    """PR6: EWM(4) below a threshold as a 0/1 flag (NULL mean -> 0)."""
    df, p = opanel(spark, d)
    f = smooth.threshold_flag(df.select(*p.keys, p.ts, p.t, p.seg, "p1", "p2", "p3"), p, ["p1", "p2", "p3"], 4, 250000.0)
    return f.select(*p.keys, p.ts, "p1_flag", "p2_flag", "p3_flag")


@register(
    "q_replace_clamp",
    f"""WITH {PANEL_CTE}
SELECT n_name, wk, CASE WHEN cnt = 1 THEN 0 ELSE cnt END AS cnt_r,
  round(CASE WHEN avg_price > 400000 THEN 0 ELSE avg_price END, 4) AS price_z,
  CAST(trunc((avg_price - 250000) / 1000) AS BIGINT) AS price_k FROM panel""",
)
def q_replace_clamp(spark, d):
    """PR5 exact replacement, PR13 zero above a limit, PR12 truncation toward zero."""
    df, p = opanel(spark, d)
    r = clean.replace_values(df, {"cnt": {1: 0}})
    return r.select(
        *p.keys,
        p.ts,
        F.col("cnt").alias("cnt_r"),
        round4(clean.zero_above("avg_price", 400000)).alias("price_z"),
        clean.to_int((F.col("avg_price") - 250000) / 1000).alias("price_k"),
    )


_COMP_SPEC = (
    features.Composite("price_level", ("p1", "p2", "p3"), 5),
    features.Composite("price_aligned", ("avg_price", "p1", "p2"), 5, shifted=("p1", "p2"), align_from="p1", align_to="avg_price"),
    features.Composite("volume", ("cnt",), 8),
    features.Composite("price_low", ("p3", "p4", "p5"), 5),
)


@register(
    "q_composite",
    f"""WITH {_FILLED},
dl AS (SELECT n_name, avg(p1) - avg(avg_price) AS delta FROM fp GROUP BY 1),
rm AS (SELECT fp.n_name, fp.wk, fp.t, (p1 + p2 + p3) / 3.0 AS price_level,
  (avg_price + (p1 - dl.delta) + (p2 - dl.delta)) / 3.0 AS price_aligned, cnt AS volume,
  (p3 + p4 + p5) / 3.0 AS price_low FROM fp JOIN dl ON fp.n_name = dl.n_name),
e4 AS ({_ewm_sql('rm', {'price_level': 'price_level', 'price_aligned': 'price_aligned', 'price_low': 'price_low'}, 5, 'n_name', 'wk')}),
e8 AS ({_ewm_sql('rm', {'volume': 'volume'}, 8, 'n_name', 'wk')})
SELECT e4.n_name, e4.wk, round(price_level, 4) AS price_level, round(price_aligned, 4) AS price_aligned,
  round(volume, 4) AS volume, round(price_low, 4) AS price_low
FROM e4 JOIN e8 ON e4.n_name = e8.n_name AND e4.t = e8.t""",
)
def q_composite(spark, d):
    """E2 PR7 PR8 W3: row means of sensor groups, offset alignment, EWM 5 / 8."""
    df, p = filled_panel(spark, d)
    c = features.composites(df, p, _COMP_SPEC)
    return out(c, p, [x.name for x in _COMP_SPEC])


_LAG_COLS = ["cnt", "avg_price"]
_LAG_NAMES = [f"{c}_{j}_week_back" for j in range(1, 4) for c in _LAG_COLS]


@register(
    "q_lags",
    f"""WITH {_FILLED},
lg AS (SELECT n_name, wk, t, cnt, avg_price, {', '.join(f'lag({c}, {j}) OVER (PARTITION BY n_name ORDER BY t) AS {c}_{j}_week_back' for j in range(1, 4) for c in _LAG_COLS)} FROM fp),
bf AS (SELECT n_name, wk, cnt, avg_price, {_bfill_sql(_LAG_NAMES)} FROM lg)
SELECT n_name, wk, cnt, round(avg_price, 4) AS avg_price, {_sel(_LAG_NAMES)} FROM bf""",
)
def q_lags(spark, d):
    """W4 + W2: lags 1..3 of the filled target and price, back-filled."""
    df, p = filled_panel(spark, d)
    df = df.select(*p.keys, p.ts, p.t, p.seg, "cnt", "avg_price")
    lg = features.lags(df, p, _LAG_COLS, 3)
    lg = clean.bfill(lg, p, _LAG_NAMES)
    return out(lg, p, ["cnt", "avg_price", *_LAG_NAMES], ints=("cnt", *[c for c in _LAG_NAMES if c.startswith("cnt_")]))


@register(
    "q_diff",
    f"""WITH {_FILLED},
df AS (SELECT n_name, wk, t, cnt - lag(cnt, 2) OVER w AS cnt, avg_price - lag(avg_price, 2) OVER w AS avg_price
  FROM fp WINDOW w AS (PARTITION BY n_name ORDER BY t)),
bf AS (SELECT n_name, wk, {_bfill_sql(['cnt', 'avg_price'])} FROM df)
SELECT n_name, wk, cnt, round(avg_price, 4) AS avg_price FROM bf""",
)
def q_diff(spark, d):
    """W5 + W2: 2-step differences, back-filled."""
    df, p = filled_panel(spark, d)
    df = df.select(*p.keys, p.ts, p.t, p.seg, "cnt", "avg_price")
    dd = clean.bfill(features.diff(df, p, ["cnt", "avg_price"], 2), p, ["cnt", "avg_price"])
    return out(dd, p, ["cnt", "avg_price"], ints=("cnt",))


@register(
    "q_undiff",
    f"""WITH {_FILLED},
v AS (SELECT n_name, wk, t, CAST(coalesce(cnt, 0) AS DOUBLE) AS v,
  row_number() OVER (PARTITION BY n_name ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY n_name) AS n FROM fp),
s AS (SELECT *, n - ceil(0.2 * n) AS ntr FROM v),
dd AS (SELECT *, v - lag(v, 3) OVER (PARTITION BY n_name ORDER BY t) AS d FROM s),
te AS (SELECT *, (pos - ntr) % 3 AS cls FROM dd WHERE pos >= ntr),
base AS (SELECT n_name, pos - (ntr - 3) AS cls, v AS b FROM s WHERE pos >= ntr - 3 AND pos < ntr)
SELECT te.n_name, te.wk, round(base.b + sum(te.d) OVER (PARTITION BY te.n_name, te.cls ORDER BY te.t), 4) AS v
FROM te JOIN base ON te.n_name = base.n_name AND te.cls = base.cls""",
)
def q_undiff(spark, d):
    """W5 + W6: 3-step differences of the last 20% rebuilt into levels from the history."""
    df, p = filled_panel(spark, d)
    v = df.select(*p.keys, p.ts, p.t, p.seg, F.coalesce(F.col("cnt"), F.lit(0)).cast("double").alias("v"))
    from panelcast.operators import windows

    sp = windows.chrono_split(v, p, 0.2)
    dd = features.diff(sp, p, ["v"], 3)
    hist = sp.filter(F.col("split") == "train").drop("split")
    test = dd.filter(F.col("split") == "test").drop("split")
    rebuilt = features.undiff(test, p, hist, "v", k=3)
    return out(rebuilt, p, ["v"])


@register(
    "q_calendar",
    f"""WITH {PANEL_CTE}
SELECT n_name, wk, year(wk) AS year, month(wk) AS month,
  row_number() OVER (PARTITION BY n_name ORDER BY t) - 1 AS weeks FROM panel""",
)
def q_calendar(spark, d):
    """PR10 PR11: year, month and the 0-based row index of each series."""
    df, p = opanel(spark, d)
    c = features.calendar(df.select(*p.keys, p.ts, p.t, p.seg), p)
    return c.select(*p.keys, p.ts, F.col("year").cast("bigint").alias("year"), F.col("month").cast("bigint").alias("month"), "weeks")


@register(
    "q_trim_leading",
    f"""WITH {PANEL_CTE}
SELECT n_name, wk, cnt FROM panel
QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY t) > CASE WHEN n_name = 'NATION_1' THEN 77 ELSE 4 END""",
)
def q_trim_leading(spark, d):
    """PR2: drop the first rows of each series (77 for one named series, 4 for the rest)."""
    df, p = opanel(spark, d)
    from collections import defaultdict

    n = defaultdict(lambda: 4)
    n["NATION_1"] = 77
    keep = clean.drop_leading(df, p, {k: n[k] for k in [f"NATION_{i}" for i in range(25)]})
    return keep.select(*p.keys, p.ts, "cnt")


@register(
    "q_last_rows",
    f"""WITH {PANEL_CTE}
SELECT n_name, wk, cnt, round(avg_price, 4) AS avg_price FROM panel
QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY t DESC) <= 8""",
)
def q_last_rows(spark, d):
    """The last 8 weeks of every series."""
    df, p = opanel(spark, d)
    return out(clean.last_rows(df, p, 8), p, ["cnt", "avg_price"], ints=("cnt",))


# --------------------------------------------------------------------------- step 2: windows, splits, diagnostics

_SEQ_N = 4


def _seq_text_spark(col):
    return F.concat_ws(
        ";", F.transform(col, lambda r: F.concat_ws(",", F.transform(r, lambda v: F.coalesce(F.format_string("%.4f", round4(v)), F.lit("null")))))
    )


_SEQ_SQL = f"""{_FILLED},
lst AS (SELECT n_name, wk, t, CAST(cnt AS DOUBLE) AS y,
  list([CAST(cnt AS DOUBLE), avg_price, p1]) OVER (PARTITION BY n_name ORDER BY t ROWS BETWEEN {_SEQ_N - 1} PRECEDING AND CURRENT ROW) AS x
  FROM fp),
txt AS (SELECT n_name, wk, y, x, list_transform(x, lambda r: array_to_string(list_transform(r, lambda v: coalesce(printf('%.4f', round(v, 4)), 'null')), ',')) AS rows_txt FROM lst WHERE len(x) = {_SEQ_N})"""


@register("q_sequences", f"WITH {_SEQ_SQL} SELECT n_name, wk, y, array_to_string(rows_txt, ';') AS x FROM txt")
def q_sequences(spark, d):
    """4-step windows of (cnt, avg_price, p1), label = cnt of the last row; arrays hashed as text."""
    from panelcast.operators import windows

    df, p = filled_panel(spark, d)
    s = windows.sequences(df, p, ["cnt", "avg_price", "p1"], "cnt", _SEQ_N)
    return s.select(*p.keys, p.ts, "y", _seq_text_spark(F.col("x")).alias("x"))


@register(
    "q_sequences2",
    f"WITH {_SEQ_SQL} SELECT n_name, wk, y, array_to_string(rows_txt[1:{_SEQ_N // 2}], ';') || '|' || array_to_string(rows_txt[{_SEQ_N // 2 + 1}:{_SEQ_N}], ';') AS x FROM txt",
)
def q_sequences2(spark, d):
    """The same windows reshaped to two halves; halves joined by '|'."""
    from panelcast.operators import windows

    df, p = filled_panel(spark, d)
    s = windows.split_halves(windows.sequences(df, p, ["cnt", "avg_price", "p1"], "cnt", _SEQ_N), "x", _SEQ_N)
    return s.select(*p.keys, p.ts, "y", F.concat_ws("|", F.transform("x", _seq_text_spark)).alias("x"))


_POS_SQL = f"""{PANEL_CTE},
ps AS (SELECT n_name, wk, t, cnt, row_number() OVER (PARTITION BY n_name ORDER BY t) - 1 AS pos,
  count(*) OVER (PARTITION BY n_name) AS n FROM panel)"""


@register(
    "q_split",
    f"WITH {_POS_SQL} SELECT n_name, wk, CASE WHEN pos >= n - ceil(0.22 * n) THEN 'test' ELSE 'train' END AS split FROM ps",
)
def q_split(spark, d):
    """Chronological split, the last ceil(0.22 n) rows are test."""
    from panelcast.operators import windows

    df, p = opanel(spark, d)
    return windows.chrono_split(df, p, 0.22).select(*p.keys, p.ts, "split")


@register(
    "q_tail_split",
    f"WITH {_POS_SQL} SELECT n_name, wk, CASE WHEN pos < floor(n * 0.9) THEN 'train' ELSE 'validation' END AS split FROM ps",
)
def q_tail_split(spark, d):
    """First floor(0.9 n) rows train, the rest validation."""
    from panelcast.operators import windows

    df, p = opanel(spark, d)
    return windows.tail_validation(df, p, 0.9).select(*p.keys, p.ts, "split")


@register(
    "q_frames",
    f"""WITH {_POS_SQL},
fs AS (SELECT *, floor(n * 0.2) AS size FROM ps),
fr AS (SELECT *, round_even(n / nullif(size, 0), 0) AS nfr, floor(pos / nullif(size, 0)) AS f FROM fs),
fa AS (SELECT *, CASE WHEN f < nfr THEN CAST(f AS BIGINT) END AS frame FROM fr),
fb AS (SELECT *, least(size, n - frame * size) AS flen FROM fa)
SELECT n_name, wk, frame,
  CASE WHEN frame IS NULL THEN 'remainder' WHEN pos - frame * size >= flen - ceil(flen * 0.3) THEN 'test' ELSE 'train' END AS part
FROM fb""",
)
def q_frames(spark, d):
    """Walk-forward frames of floor(0.2 n) rows, 70/30 inside each, true remainder flagged."""
    from panelcast.operators import windows

    df, p = opanel(spark, d)
    return windows.frames(df, p, 0.2, 0.3).select(*p.keys, p.ts, "frame", "part")


_ACF_L = 30


@register(
    "q_acf",
    f"""WITH {_FILLED},
m AS (SELECT n_name, avg(avg_price) AS mu FROM fp GROUP BY 1),
c AS (SELECT fp.n_name, fp.t, fp.avg_price - m.mu AS x FROM fp JOIN m ON fp.n_name = m.n_name),
pr AS (SELECT a.n_name, a.t - b.t AS lag, sum(a.x * b.x) AS s FROM c a JOIN c b ON a.n_name = b.n_name AND a.t - b.t BETWEEN 0 AND {_ACF_L}
  WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2),
z AS (SELECT n_name, s AS s0 FROM pr WHERE lag = 0)
SELECT pr.n_name, 'avg_price' AS "column", CAST(pr.lag AS INTEGER) AS lag, round(pr.s / nullif(z.s0, 0), 4) AS acf FROM pr JOIN z ON pr.n_name = z.n_name""",
)
def q_acf(spark, d):
    """Autocorrelation of the filled price, lags 0..30."""
    from panelcast.operators import stats

    df, p = filled_panel(spark, d)
    a = stats.acf(df, p, ["avg_price"], _ACF_L)
    return a.select(*p.keys, "column", "lag", r4("acf"))


def _acf_sql(col: str) -> str:
    return f"""SELECT n_name, '{col}' AS col, lag, s FROM (
  SELECT a.n_name, a.t - b.t AS lag, sum(a.x * b.x) AS s
  FROM (SELECT fp.n_name, fp.t, fp.{col} - m.mu AS x FROM fp JOIN (SELECT n_name, avg({col}) AS mu FROM fp GROUP BY 1) m ON fp.n_name = m.n_name) a
  JOIN (SELECT fp.n_name, fp.t, fp.{col} - m.mu AS x FROM fp JOIN (SELECT n_name, avg({col}) AS mu FROM fp GROUP BY 1) m ON fp.n_name = m.n_name) b
    ON a.n_name = b.n_name AND a.t - b.t BETWEEN 0 AND {_ACF_L}
  WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2)"""


def _pacf_ctes(cols) -> str:
    acs = " UNION ALL ".join(_acf_sql(c) for c in cols)
    return f"""ac AS ({acs}),
rl AS (SELECT a.n_name, a.col, list(a.s / nullif(z.s, 0) ORDER BY a.lag) AS r
  FROM ac a JOIN ac z ON a.n_name = z.n_name AND a.col = z.col AND z.lag = 0 GROUP BY 1, 2),
dl(n_name, col, k, phi, v, r) AS (
  SELECT n_name, col, 1, [r[2]], 1 - r[2] * r[2], r FROM rl
  UNION ALL
  SELECT n_name, col, k + 1,
    list_append(list_transform(phi, lambda p, j: p - ((r[k + 2] - list_sum(list_transform(phi, lambda q, i: q * r[k + 2 - i]))) / v) * phi[k + 1 - j]),
      (r[k + 2] - list_sum(list_transform(phi, lambda q, i: q * r[k + 2 - i]))) / v),
    v * (1 - power((r[k + 2] - list_sum(list_transform(phi, lambda q, i: q * r[k + 2 - i]))) / v, 2)),
    r
  FROM dl WHERE k < {_ACF_L}),
pacf AS (SELECT n_name, col, CAST(k AS INTEGER) AS lag, phi[k] AS pacf FROM dl
  UNION ALL SELECT n_name, col, 0, 1.0 FROM rl),
acf AS (SELECT a.n_name, a.col, CAST(a.lag AS INTEGER) AS lag, a.s / nullif(z.s, 0) AS acf
  FROM ac a JOIN ac z ON a.n_name = z.n_name AND a.col = z.col AND z.lag = 0)"""


def _hist_sql(col: str, src: str = "fp", bins: int = 25) -> str:
    return f"""SELECT g.n_name, '{col}' AS col, g.bin, g.lo + (g.hi - g.lo) / {bins} * g.bin AS lo,
  g.lo + (g.hi - g.lo) / {bins} * (g.bin + 1) AS hi, coalesce(b.cnt, 0) AS count
FROM (SELECT n_name, lo, hi, CAST(unnest(generate_series(0, {bins - 1})) AS INTEGER) AS bin FROM (
  SELECT n_name, CASE WHEN max({col}) > min({col}) THEN min({col}) ELSE min({col}) - 0.5 END AS lo,
    CASE WHEN max({col}) > min({col}) THEN max({col}) ELSE max({col}) + 0.5 END AS hi FROM {src} GROUP BY 1)) g
LEFT JOIN (SELECT s.n_name, CAST(least({bins - 1}, floor((s.{col} - mm.lo) / (mm.hi - mm.lo) * {bins})) AS INTEGER) AS bin, count(*) AS cnt
  FROM {src} s JOIN (SELECT n_name, CASE WHEN max({col}) > min({col}) THEN min({col}) ELSE min({col}) - 0.5 END AS lo,
    CASE WHEN max({col}) > min({col}) THEN max({col}) ELSE max({col}) + 0.5 END AS hi FROM {src} GROUP BY 1) mm
  ON s.n_name = mm.n_name WHERE s.{col} IS NOT NULL GROUP BY 1, 2) b ON g.n_name = b.n_name AND g.bin = b.bin"""


@register(
    "q_pacf",
    f"""WITH RECURSIVE {_FILLED},
{_pacf_ctes(['avg_price', 'cnt'])}
SELECT n_name, col AS "column", lag, round(pacf, 4) AS pacf FROM pacf""",
)
def q_pacf(spark, d):
    """Partial autocorrelation by Durbin-Levinson over the ACF (oracle: a recursive CTE; numpy in tests)."""
    from panelcast.operators import stats

    df, p = filled_panel(spark, d)
    a = stats.pacf(stats.acf(df, p, ["avg_price", "cnt"], _ACF_L), p)
    return a.select(*p.keys, "column", "lag", r4("pacf"))


@register(
    "q_hist",
    f"""WITH {PANEL_CTE},
mm AS (SELECT n_name, CASE WHEN max(avg_price) > min(avg_price) THEN min(avg_price) ELSE min(avg_price) - 0.5 END AS lo,
  CASE WHEN max(avg_price) > min(avg_price) THEN max(avg_price) ELSE max(avg_price) + 0.5 END AS hi FROM panel GROUP BY 1),
b AS (SELECT p.n_name, CAST(least(24, floor((p.avg_price - mm.lo) / (mm.hi - mm.lo) * 25)) AS INTEGER) AS bin, count(*) AS cnt
  FROM panel p JOIN mm ON p.n_name = mm.n_name WHERE p.avg_price IS NOT NULL GROUP BY 1, 2),
g AS (SELECT n_name, lo, hi, CAST(unnest(generate_series(0, 24)) AS INTEGER) AS bin FROM mm)
SELECT g.n_name, g.bin, round(g.lo + (g.hi - g.lo) / 25 * g.bin, 4) AS lo, round(g.lo + (g.hi - g.lo) / 25 * (g.bin + 1), 4) AS hi,
  coalesce(b.cnt, 0) AS count FROM g LEFT JOIN b ON g.n_name = b.n_name AND g.bin = b.bin""",
)
def q_hist(spark, d):
    """AG4: 25-bin histogram of the weekly average price per nation."""
    from panelcast.operators import stats

    df, p = opanel(spark, d)
    h = stats.histogram(df, p, "avg_price", 25)
    return h.select(*p.keys, "bin", r4("lo"), r4("hi"), "count")


@register(
    "q_dw",
    f"""WITH {_NAIVE_SQL},
r AS (SELECT p.n_name, p.model, t, y - y_pred AS e FROM pred p JOIN panel ON p.n_name = panel.n_name AND p.wk = panel.wk),
l AS (SELECT *, lag(e, 1) OVER (PARTITION BY n_name, model ORDER BY t) AS pe FROM r)
SELECT n_name, model, round(sum((e - pe) * (e - pe)) / nullif(sum(e * e), 0), 4) AS dw FROM l GROUP BY 1, 2""",
)
def q_dw(spark, d):
    """AG9 T4: Durbin-Watson of each simple predictor's residuals per nation."""
    from panelcast.operators import stats
    from panelcast.plans.panel import step_of, seg_of

    pr = naive_predictions(spark, d)
    p = Panel(keys=("n_name",), ts="wk")
    pr = pr.withColumn(p.t, step_of("wk", "week")).withColumn(p.seg, seg_of(p.t, p.seg_steps))
    pr = pr.withColumn("e", F.col("y") - F.col("y_pred"))
    return stats.durbin_watson(pr, p, "e", by=["model"]).select("n_name", "model", r4("dw"))


# --------------------------------------------------------------------------- step 5-7: prediction tables and forecast outputs


@register(
    "q_ensemble",
    f"""WITH {_NAIVE_SQL},
ens AS (SELECT n_name, wk, y, model, y_pred FROM pred
  UNION ALL SELECT n_name, wk, first(y), 'Ensamble', avg(y_pred) FROM pred GROUP BY n_name, wk)
SELECT n_name, wk, model, round(y_pred, 4) AS y_pred FROM ens""",
)
def q_ensemble(spark, d):
    """AG10 M16: the long prediction matrix plus its row mean as model 'Ensamble'."""
    from panelcast.operators import predict

    pr = predict.ensemble(naive_predictions(spark, d), by=["n_name", "wk"], keep=["y"])
    return pr.select("n_name", "wk", "model", r4("y_pred"))


_RUN_SPANS = (5, 8, 11)


def _runs(spark, d):
    """Three forecast runs (EWM of the filled count with spans 5, 8, 11, one week back)."""
    df, p = filled_panel(spark, d)
    names = [f"_r{k}" for k in range(len(_RUN_SPANS))]
    base = df.select(*p.keys, p.ts, p.t, p.seg, *[F.col("cnt").alias(n) for n in names])
    # all runs smoothed in one pass (one span per copy), lagged in one pass
    e = smooth.ewm(base, p, names, dict(zip(names, _RUN_SPANS)))
    e = features.lags(e, p, names, 1, fmt="{col}_l{j}")
    runs = F.array(*[F.struct(F.lit(k).alias("run_id"), F.col(f"{n}_l1").alias("total_cases")) for k, n in enumerate(names)])
    return e.select(*p.keys, p.ts, F.inline(runs))


def _runs_sql():
    ctes = []
    for k, s in enumerate(_RUN_SPANS):
        ctes.append(f"e{k} AS ({_ewm_sql('fp', {'e': 'cnt'}, s, 'n_name', 'wk')})")
    union = " UNION ALL ".join(
        f"SELECT n_name, wk, {k} AS run_id, lag(e, 1) OVER (PARTITION BY n_name ORDER BY t) AS total_cases FROM e{k}"
        for k in range(len(_RUN_SPANS))
    )
    return f"{_FILLED}, {', '.join(ctes)}, runs AS ({union})"


@register(
    "q_run_average",
    f"""WITH {_runs_sql()}
SELECT n_name, wk, CAST(trunc(avg(total_cases)) AS BIGINT) AS total_cases, count(DISTINCT run_id) AS runs
FROM runs GROUP BY 1, 2""",
)
def q_run_average(spark, d):
    """AG7 J4: three runs stacked long with run_id, averaged per week and truncated."""
    from panelcast.operators import forecast

    return forecast.average_runs(_runs(spark, d), ["n_name", "wk"])


@register(
    "q_best",
    f"""WITH {_runs_sql()},
sc AS (SELECT r.n_name, r.run_id, avg(abs(f.cnt - r.total_cases)) AS mae FROM runs r JOIN fp f ON r.n_name = f.n_name AND r.wk = f.wk
  WHERE r.total_cases IS NOT NULL AND f.cnt IS NOT NULL GROUP BY 1, 2)
SELECT n_name, first(run_id ORDER BY mae, run_id) AS best_run_id, round(min(mae), 4) AS best_mae FROM sc GROUP BY 1""",
)
def q_best(spark, d):
    """AG8: per nation, the run (smoothing span) with the least MAE; ties to the smaller id."""
    df, p = filled_panel(spark, d)
    runs = _runs(spark, d)
    j = runs.join(df.select("n_name", "wk", F.col("cnt").alias("y")), ["n_name", "wk"]).filter(F.col("total_cases").isNotNull() & F.col("y").isNotNull())
    sc = j.groupBy("n_name", "run_id").agg(F.avg(F.abs(F.col("y") - F.col("total_cases"))).alias("mae"))
    b = score.best_candidate(sc, ["n_name"], "run_id", "mae")
    return b.select("n_name", "best_run_id", r4("best_mae"))


@register(
    "q_compare",
    f"""WITH {_NAIVE_SQL},
a AS (SELECT n_name, wk, y_pred AS a FROM pred WHERE model = 'naive'),
b AS (SELECT n_name, wk, y_pred AS b FROM pred WHERE model = 'mean4')
SELECT coalesce(a.n_name, b.n_name) AS n_name, coalesce(a.wk, b.wk) AS wk, round(a, 4) AS a, round(b, 4) AS b, round(b - a, 4) AS delta
FROM a FULL JOIN b ON a.n_name = b.n_name AND a.wk = b.wk""",
)
def q_compare(spark, d):
    """Two forecasts side by side with their difference."""
    from panelcast.operators import forecast

    pr = naive_predictions(spark, d)
    a = pr.filter(F.col("model") == "naive")
    b = pr.filter(F.col("model") == "mean4")
    c = forecast.compare(a, b, ["n_name", "wk"], "y_pred")
    return c.select("n_name", "wk", r4("a"), r4("b"), r4("delta"))


@register(
    "q_blend",
    f"""WITH {_NAIVE_SQL},
w AS (SELECT n_name, CASE n_regionkey WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 END AS weight FROM nation),
a AS (SELECT n_name, wk, y_pred AS a FROM pred WHERE model = 'naive'),
b AS (SELECT n_name, wk, y_pred AS b FROM pred WHERE model = 'ewm4')
SELECT a.n_name, a.wk, CAST(trunc(coalesce(w.weight, 0.5) * a + (1 - coalesce(w.weight, 0.5)) * b) AS BIGINT) AS y_pred
FROM a JOIN b ON a.n_name = b.n_name AND a.wk = b.wk LEFT JOIN w ON a.n_name = w.n_name""",
)
def q_blend(spark, d):
    """Per-nation blend weights from the nation's region (region 0: first source,
    region 1: second, others half/half), int result."""
    from panelcast.operators import forecast
    from panelcast.sources.tables import read_table

    pr = naive_predictions(spark, d)
    nat = read_table(spark, d, "nation", "n_regionkey", "n_name")
    k = F.col("n_regionkey")
    weights = nat.select("n_name", F.when(k == 0, F.lit(1.0)).when(k == 1, F.lit(0.0)).alias("weight"))
    a = pr.filter(F.col("model") == "naive")
    b = pr.filter(F.col("model") == "ewm4")
    return forecast.blend(a, b, ["n_name", "wk"], "y_pred", weights=weights, weight_key=["n_name"])


@register(
    "q_attach",
    f"""WITH {_POS_SQL},
tmpl AS (SELECT n_name, isoyear(wk) AS year, weekofyear(wk) AS weekofyear, wk, pos FROM ps WHERE pos >= n - ceil(0.2 * n)),
{_NAIVE_SQL.split(',', 1)[0][:0]}pr AS (SELECT n_name, wk, avg(cnt) OVER (PARTITION BY n_name ORDER BY t ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS y_pred
  FROM ps),
j AS (SELECT t.n_name, t.year, t.weekofyear, t.pos, pr.y_pred FROM tmpl t LEFT JOIN pr ON t.n_name = pr.n_name AND t.wk = pr.wk)
SELECT n_name, year, weekofyear, pos, CAST(trunc(y_pred) AS BIGINT) AS total_cases FROM j""",
)
def q_attach(spark, d):
    """J2 SO1 SO3: forecasts joined into a template (last 20% of each series) by key,
    truncated to int, template ordinal kept for an ordered write."""
    from panelcast.operators import forecast, windows

    df, p = opanel(spark, d)
    pos = with_position(df, p)
    tmpl = pos.filter(F.col("_pos") >= F.col("_n") - F.ceil(F.col("_n") * 0.2)).select(
        "n_name",
        F.extract(F.lit("YEAROFWEEK"), F.col("wk")).cast("bigint").alias("year"),
        F.weekofyear("wk").cast("bigint").alias("weekofyear"),
        "wk",
        F.col("_pos").alias("pos"),
        F.lit(0).alias("total_cases"),
    )
    lg = features.lags(df.select(*p.keys, p.ts, p.t, p.seg, "cnt"), p, ["cnt"], 4, fmt="{col}_l{j}")
    # mean of the non-null values among the last four weeks
    vals = [F.col(f"cnt_l{j}") for j in range(1, 5)]
    n_ok = sum((v.isNotNull().cast("int") for v in vals), F.lit(0))
    tot = sum((F.coalesce(v, F.lit(0)) for v in vals), F.lit(0))
    pr = lg.select("n_name", "wk", F.when(n_ok > 0, tot / n_ok).alias("y_pred"))
    j = forecast.attach(tmpl, pr, ["n_name", "wk"], order="pos")
    return j.select("n_name", "year", "weekofyear", "pos", "total_cases")


@register(
    "q_minshift",
    f"""WITH {_NAIVE_SQL},
m AS (SELECT n_name, min(y_pred) AS mn FROM pred WHERE model = 'ewm4' GROUP BY 1)
SELECT p.n_name, p.wk, round(p.y_pred - m.mn, 4) AS y_pred FROM pred p JOIN m ON p.n_name = m.n_name WHERE p.model = 'ewm4'""",
)
def q_minshift(spark, d):
    """PR14: shift each nation's forecast so its minimum is 0."""
    from panelcast.plans.panel import seg_of, step_of

    pr = naive_predictions(spark, d).filter(F.col("model") == "ewm4")
    p = Panel(keys=("n_name",), ts="wk")
    pr = pr.withColumn(p.t, step_of("wk", "week")).withColumn(p.seg, seg_of(p.t, p.seg_steps))
    sh = clean.shift_to_zero_min(pr, p, ["y_pred"])
    return sh.select("n_name", "wk", r4("y_pred"))


@register(
    "q_debias",
    f"""WITH {_NAIVE_SQL},
pe AS (SELECT * FROM pred WHERE model = 'mean4'),
mp AS (SELECT n_name, avg(y_pred) AS mp FROM pe GROUP BY 1),
mr AS (SELECT n_name, avg(cnt) AS mr FROM panel GROUP BY 1),
adj AS (SELECT pe.n_name, pe.wk, pe.y_pred + (mr.mr - mp.mp) AS y FROM pe JOIN mp ON pe.n_name = mp.n_name JOIN mr ON pe.n_name = mr.n_name),
mn AS (SELECT n_name, min(y) AS mn FROM adj GROUP BY 1)
SELECT adj.n_name, adj.wk, round(adj.y - mn.mn, 4) AS y_pred FROM adj JOIN mn ON adj.n_name = mn.n_name""",
)
def q_debias(spark, d):
    """PR15: move each forecast to the history's mean, then shift to a zero minimum."""
    from panelcast.plans.panel import seg_of, step_of

    df, p = opanel(spark, d)
    pr = naive_predictions(spark, d).filter(F.col("model") == "mean4")
    pr = pr.withColumn(p.t, step_of("wk", "week")).withColumn(p.seg, seg_of(p.t, p.seg_steps))
    db = clean.debias(pr, p, "y_pred", df, "cnt")
    return db.select("n_name", "wk", r4("y_pred"))


# --------------------------------------------------------------------------- step 3-4: per-series linear models


def scaled_panel(spark, d):
    """Filled panel with cnt / avg_price / p1 z-scored per nation (the reference's normalise step)."""
    df, p = filled_panel(spark, d)
    z, st = scale.fit_transform(df.select(*p.keys, p.ts, p.t, p.seg, "cnt", "avg_price", "p1"), p, ["cnt", "avg_price", "p1"])
    return z, p, st


_SCALED_SQL = f"""{_FILLED},
zs AS (SELECT n_name, avg(cnt) AS mc, stddev_pop(cnt) AS sc, avg(avg_price) AS mp, stddev_pop(avg_price) AS sp,
  avg(p1) AS m1, stddev_pop(p1) AS s1 FROM fp GROUP BY 1),
zp AS (SELECT fp.n_name, fp.wk, fp.t,
  (cnt - mc) / CASE WHEN sc IS NULL OR sc = 0 THEN 1 ELSE sc END AS cnt,
  (avg_price - mp) / CASE WHEN sp IS NULL OR sp = 0 THEN 1 ELSE sp END AS avg_price,
  (p1 - m1) / CASE WHEN s1 IS NULL OR s1 = 0 THEN 1 ELSE s1 END AS p1
  FROM fp JOIN zs ON fp.n_name = zs.n_name),
mom AS (SELECT n_name, count(*) AS n, avg(avg_price) AS mx, avg(cnt) AS my,
  covar_pop(cnt, avg_price) * count(*) AS sxy, var_pop(avg_price) * count(*) AS sxx
  FROM zp WHERE cnt IS NOT NULL AND avg_price IS NOT NULL GROUP BY 1)"""


def _one_reg_sql(slope_expr: str) -> str:
    return f"""WITH {_SCALED_SQL},
w AS (SELECT n_name, mx, my, {slope_expr} AS w FROM mom)
SELECT n_name, round(my - w * mx, 4) + 0.0 AS intercept, round(w, 4) + 0.0 AS slope FROM w"""


def _linear_query(method, alpha=1.0, l1_ratio=0.5):
    def q(spark, d):
        from panelcast.models import linear

        z, p, _ = scaled_panel(spark, d)
        c = linear.fit(z, p, ["avg_price"], "cnt", method=method, alpha=alpha, l1_ratio=l1_ratio)
        # centred fits: the intercept is a mean of ~0, its sign is rounding noise -> +0.0
        return c.select("n_name", (round4(F.col("intercept")) + F.lit(0.0)).alias("intercept"), (round4(F.col("coef")[0]) + F.lit(0.0)).alias("slope"))

    q.__doc__ = f"M1 {method}: per-nation fit of the scaled target on the scaled price from cross-products."
    return q


register("q_ols1", _one_reg_sql("CASE WHEN sxx = 0 THEN 0 ELSE sxy / sxx END"))(_linear_query("ols"))
register("q_ridge", _one_reg_sql("sxy / (sxx + 1.0)"))(_linear_query("ridge", 1.0))
register("q_lasso", _one_reg_sql("CASE WHEN sxx = 0 THEN 0 ELSE sign(sxy) * greatest(abs(sxy) - n * 0.1, 0) / sxx END"))(_linear_query("lasso", 0.1))
register("q_enet", _one_reg_sql("sign(sxy) * greatest(abs(sxy) - n * 0.1 * 0.5, 0) / (sxx + n * 0.1 * 0.5)"))(_linear_query("enet", 0.1, 0.5))


@register(
    "q_ols_predict",
    f"""WITH {_SCALED_SQL},
w AS (SELECT n_name, mx, my, CASE WHEN sxx = 0 THEN 0 ELSE sxy / sxx END AS w FROM mom)
SELECT zp.n_name, zp.wk, round(zp.cnt, 4) AS y, round((w.my - w.w * w.mx) + w.w * zp.avg_price, 4) AS y_pred
FROM zp JOIN w ON zp.n_name = w.n_name""",
)
def q_ols_predict(spark, d):
    """M1a + predict: fitted values of the per-nation OLS, computed JVM-side from the coefficient table."""
    from panelcast.models import linear

    z, p, _ = scaled_panel(spark, d)
    c = linear.fit(z, p, ["avg_price"], "cnt")
    pr = linear.predict(z, p, c, ["avg_price"])
    return pr.select("n_name", "wk", r4("cnt").alias("y"), r4("y_pred"))


@register(
    "q_var1",
    f"""WITH {_SCALED_SQL},
l AS (SELECT n_name, cnt, lag(cnt, 1) OVER (PARTITION BY n_name ORDER BY t) AS c1 FROM zp),
l2 AS (SELECT * FROM l WHERE cnt IS NOT NULL AND c1 IS NOT NULL)
SELECT n_name, 'cnt' AS equation,
  round(CASE WHEN var_pop(c1) = 0 THEN avg(cnt) ELSE regr_intercept(cnt, c1) END, 4) AS intercept,
  round(CASE WHEN var_pop(c1) = 0 THEN 0 ELSE regr_slope(cnt, c1) END, 4) AS slope FROM l2 GROUP BY 1""",
)
def q_var1(spark, d):
    """M6 with one variable: AR(1) with a constant per nation on the scaled target."""
    from panelcast.models import var

    z, p, _ = scaled_panel(spark, d)
    c = var.fit(z, p, ["cnt"], 1)
    return c.select("n_name", "equation", round4(F.col("intercept")).alias("intercept"), round4(F.col("coef")[0]).alias("slope"))


def _train_test(spark, d, frac=0.22):
    from panelcast.operators import windows

    z, p, st = scaled_panel(spark, d)
    sp = windows.chrono_split(z, p, frac)
    return sp.filter(F.col("split") == "train").drop("split"), sp.filter(F.col("split") == "test").drop("split"), p, st


@register("q_var_order")
def q_var_order(spark, d):
    """M7: AIC/BIC/FPE/HQIC of VAR(p), p = 0..7, of (cnt, avg_price, p1) per nation."""
    from panelcast.models import var

    z, p, _ = scaled_panel(spark, d)
    return var.order_table(z.na.drop(), p, ["cnt", "avg_price", "p1"], 8)


@register("q_varx")
def q_varx(spark, d):
    """M8 + M6 forecast: VARX(1) of (cnt, avg_price) with p1 as exogenous, forecast over the test weeks."""
    from panelcast.models import var

    tr, te, p, _ = _train_test(spark, d)
    tr = tr.na.drop()
    return var.forecast(tr, te, p, ["cnt", "avg_price"], 1, exog=["p1"])


_AR_SQL = f"""{_SCALED_SQL},
pz AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY n_name) AS n FROM zp),
spl AS (SELECT *, pos >= n - ceil(0.22 * n) AS is_test FROM pz),
lg AS (SELECT n_name, cnt AS y, avg_price AS e, lag(cnt) OVER (PARTITION BY n_name ORDER BY t) AS x FROM spl WHERE NOT is_test),
hz AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY t) AS h FROM spl WHERE is_test),
la AS (SELECT n_name, cnt AS y0 FROM spl WHERE NOT is_test QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY t DESC) = 1),
ar AS (SELECT n_name, covar_pop(x, y) / var_pop(x) AS b, avg(y) - covar_pop(x, y) / var_pop(x) * avg(x) AS a FROM lg WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1),
fc AS (SELECT hz.n_name, hz.wk, hz.cnt, a * (1 - pow(b, h)) / (1 - b) + pow(b, h) * y0 AS f FROM hz JOIN ar ON hz.n_name = ar.n_name JOIN la ON hz.n_name = la.n_name)"""


@register("q_ar1_forecast", f"WITH {_AR_SQL}\nSELECT n_name, wk, round(f, 4) AS cnt_fc FROM fc")
def q_ar1_forecast(spark, d):
    """M6 M8: multi-step forecast of a one-variable VAR(1) over blocks of 16 test weeks."""
    from panelcast.models import var

    tr, te, p, _ = _train_test(spark, d)
    return var.forecast(tr, te, p, ["cnt"], 1, block_steps=16).select("n_name", "wk", r4("cnt_fc"))


@register("q_sbs1", f"WITH {_AR_SQL}\nSELECT n_name, wk, round(cnt, 4) AS y, round(f, 4) AS y_pred FROM fc")
def q_sbs1(spark, d):
    """M9: step-by-step VAR(1) of one variable; a row put on the fitted line does not move it, so the refits give the multi-step forecast."""
    from panelcast.models import var

    tr, te, p, _ = _train_test(spark, d)
    return var.step_by_step(tr, te, p, ["cnt"], "cnt", 1, block_steps=40).select("n_name", "wk", r4("y"), r4("y_pred"))


@register(
    "q_varx1",
    f"""WITH {_AR_SQL},
mo AS (SELECT n_name, var_pop(x) AS xx, var_pop(e) AS ee, covar_pop(x, e) AS xe, covar_pop(x, y) AS xy, covar_pop(e, y) AS ey, avg(x) AS mx, avg(e) AS me, avg(y) AS my
  FROM lg WHERE x IS NOT NULL AND y IS NOT NULL AND e IS NOT NULL GROUP BY 1),
co AS (SELECT *, (xy * ee - ey * xe) / (xx * ee - xe * xe) AS b, (ey * xx - xy * xe) / (xx * ee - xe * xe) AS g FROM mo),
sm AS (SELECT i.n_name, i.wk, i.h, b, sum(pow(b, i.h - j.h) * (my - b * mx - g * me + g * j.avg_price)) AS s
  FROM hz i JOIN hz j ON i.n_name = j.n_name AND j.h <= i.h JOIN co ON co.n_name = i.n_name GROUP BY 1, 2, 3, 4)
SELECT sm.n_name, wk, round(s + pow(b, h) * y0, 4) AS cnt_fc FROM sm JOIN la ON sm.n_name = la.n_name""",
)
def q_varx1(spark, d):
    """M8: VARX(1) of the count with the price as exogenous, forecast over blocks of 16 test weeks."""
    from panelcast.models import var

    tr, te, p, _ = _train_test(spark, d)
    return var.forecast(tr, te, p, ["cnt"], 1, exog=["avg_price"], block_steps=16).select("n_name", "wk", r4("cnt_fc"))


@register("q_var_sbs")
def q_var_sbs(spark, d):
    """M9 SO2: step-by-step VAR(3) forecast of the target with a refit after every step."""
    from panelcast.models import var

    tr, te, p, _ = _train_test(spark, d)
    return var.step_by_step(tr.na.drop(), te, p, ["avg_price", "p1", "cnt"], "cnt", 3).select("n_name", "wk", "y", "y_pred", "reason")


@register("q_var_dw")
def q_var_dw(spark, d):
    """AG9 T4: Durbin-Watson of each VAR(2) equation's residuals per nation."""
    from panelcast.models import var
    from panelcast.operators import stats

    z, p, _ = scaled_panel(spark, d)
    z = z.na.drop()
    c = var.fit(z, p, ["cnt", "avg_price"], 2)
    r = var.residuals(z, p, c, ["cnt", "avg_price"], 2)
    dw = stats.durbin_watson(r, p, "resid", by=["equation"])
    return dw.select("n_name", "equation", F.bround("dw", 2).alias("dw"))


@register(
    "q_diffreg",
    f"""WITH {_SCALED_SQL},
pz AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY n_name) AS n FROM zp),
spl AS (SELECT *, pos >= n - ceil(0.22 * n) AS is_test FROM pz),
dd AS (SELECT n_name, cnt - lag(cnt) OVER w AS dy, avg_price - lag(avg_price) OVER w AS dx FROM spl WHERE NOT is_test WINDOW w AS (PARTITION BY n_name ORDER BY t)),
b AS (SELECT n_name, sum(dx * dy) / sum(dx * dx) AS beta FROM dd WHERE dx IS NOT NULL AND dy IS NOT NULL GROUP BY 1),
la AS (SELECT n_name, cnt AS yT, avg_price AS xT FROM spl WHERE NOT is_test QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY t DESC) = 1)
SELECT spl.n_name, spl.wk, round(la.yT + (spl.avg_price - la.xT) * b.beta, 4) AS y_pred
FROM spl JOIN b ON spl.n_name = b.n_name JOIN la ON spl.n_name = la.n_name WHERE spl.is_test""",
)
def q_diffreg(spark, d):
    """First-difference regression on the scaled price; forecast y_T + (x - x_T) beta."""
    from panelcast.models import seasonal

    tr, te, p, _ = _train_test(spark, d)
    c = seasonal.diffreg_fit(tr, p, ["avg_price"], "cnt")
    fc = seasonal.diffreg_forecast(tr, te, p, ["avg_price"], "cnt", c)
    return fc.select("n_name", "wk", r4("y_pred"))


@register("q_arsearch")
def q_arsearch(spark, d):
    """Seasonal (52-week) difference, AR order by AIC (p <= 10) with the price as regressor, forecast."""
    from panelcast.models import seasonal

    tr, te, p, _ = _train_test(spark, d)
    return seasonal.seasonal_ar_search(tr.na.drop(), te, p, "cnt", ["avg_price"], m=52, max_p=10)


@register("q_additive")
def q_additive(spark, d):
    """Trend + changepoint hinges + yearly Fourier + price regressor; components and recombination."""
    from panelcast.models import additive

    tr, te, p, _ = _train_test(spark, d)
    fc = additive.fit_predict(tr.na.drop(), te, p, "cnt", ["avg_price"])
    return fc.select("n_name", "wk", "trend", "yearly", "extra_regressors", "yhat", additive.recombine(fc).alias("recombined"))


@register("q_additive_job")
def q_additive_job(spark, d):
    """Additive model per nation on the raw weekly count, recombined and scored over the last 30 % of the weeks."""
    from panelcast.operators import windows
    from panelcast.plans import jobs

    df, p = filled_panel(spark, d)
    sp = windows.chrono_split(df, p, 0.3)
    tr, te = sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "test")
    return jobs.additive_job(tr, te, p, "cnt", ["avg_price"])[1]


@register("q_negbin")
def q_negbin(spark, d):
    """M4 M5: negative binomial IRLS per nation on the raw weekly count, dispersion chosen by test MAE."""
    from panelcast.models import negbin
    from panelcast.operators import windows

    df, p = filled_panel(spark, d)
    df = scale.transform(df, p, scale.fit_scaler(df, p, ["avg_price"]), ["avg_price"]).na.drop(subset=["cnt", "avg_price"])
    sp = windows.chrono_split(df, p, 0.22)
    tr, te = sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "test")
    return negbin.search(tr, te, p, ["avg_price"], "cnt")


def _ml_frame(spark, d):
    tr, te, p, st = _train_test(spark, d)
    feats = ["avg_price", "p1", "cnt_l1", "cnt_l2"]

    def prep(x):
        return features.lags(x, p, ["cnt"], 2, fmt="{col}_l{j}").na.drop(subset=[*feats, "cnt"])

    return prep(tr), prep(te), p, feats


def _pooled_query(name):
    def q(spark, d):
        from panelcast.models import ml

        tr, te, p, feats = _ml_frame(spark, d)
        m = ml.model(name, feats, "cnt", "n_name", ["n_name", "wk"]).fit(tr)
        return m.transform(te).select("n_name", "wk", F.col("cnt").alias("y"), "y_pred")

    q.__doc__ = f"M2/M1: pooled {name} on lagged, scaled features; predictions on the test weeks."
    return q


register("q_tree")(_pooled_query("DecisionTreeRegressor"))
register("q_forest")(_pooled_query("RandomForestRegressor"))
register("q_gbt")(_pooled_query("GradientBoostingRegressor"))
register("q_bag")(_pooled_query("BaggingRegressor"))
register("q_extra_tree")(_pooled_query("ExtraTreeRegressor"))
register("q_extra")(_pooled_query("ExtraTreesRegressor"))
register("q_xgb")(_pooled_query("XGBRegressor"))
register("q_lgbm")(_pooled_query("LGBMRegressor"))
register("q_huber")(_pooled_query("HuberRegressor"))
register("q_sgd")(_pooled_query("SGDRegressor"))


_STUMP_SQL = f"""{_SCALED_SQL},
pz AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY n_name) AS n FROM zp),
spl AS (SELECT n_name, wk, avg_price AS x, cnt AS y, pos >= n - ceil(0.22 * n) AS is_test FROM pz WHERE avg_price IS NOT NULL AND cnt IS NOT NULL),
m0 AS (SELECT avg(y) AS m FROM spl WHERE NOT is_test),
g1 AS (SELECT x, count(*) AS n, sum(y - m) AS s FROM spl, m0 WHERE NOT is_test GROUP BY x),
p1 AS (SELECT x + (lead(x) OVER (ORDER BY x) - x) / 2 AS cut, sum(n) OVER (ORDER BY x) AS nl, sum(s) OVER (ORDER BY x) AS sl, sum(n) OVER () AS nt, sum(s) OVER () AS st FROM g1),
b1 AS (SELECT cut, sl / nl AS vl, (st - sl) / (nt - nl) AS vr FROM p1 WHERE cut IS NOT NULL ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) DESC, cut LIMIT 1)"""


@register(
    "q_stump",
    f"""WITH {_STUMP_SQL}
SELECT n_name, wk, round(y, 4) AS y, round(m + CASE WHEN x <= cut THEN vl ELSE vr END, 4) AS y_pred FROM spl, m0, b1 WHERE is_test""",
)
def q_stump(spark, d):
    """One cut of one feature over all training rows."""
    return _small_trees(spark, d, depth=1)


@register(
    "q_boost2",
    f"""WITH {_STUMP_SQL},
r2 AS (SELECT x, y - m - 0.5 * CASE WHEN x <= cut THEN vl ELSE vr END AS r FROM spl, m0, b1 WHERE NOT is_test),
g2 AS (SELECT x, count(*) AS n, sum(r) AS s FROM r2 GROUP BY x),
p2 AS (SELECT x + (lead(x) OVER (ORDER BY x) - x) / 2 AS cut, sum(n) OVER (ORDER BY x) AS nl, sum(s) OVER (ORDER BY x) AS sl, sum(n) OVER () AS nt, sum(s) OVER () AS st FROM g2),
b2 AS (SELECT cut AS cut2, sl / nl AS vl2, (st - sl) / (nt - nl) AS vr2 FROM p2 WHERE cut IS NOT NULL ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) DESC, cut LIMIT 1)
SELECT n_name, wk, round(y, 4) AS y, round(m + 0.5 * CASE WHEN x <= cut THEN vl ELSE vr END + 0.5 * CASE WHEN x <= cut2 THEN vl2 ELSE vr2 END, 4) AS y_pred FROM spl, m0, b1, b2 WHERE is_test""",
)
def q_boost2(spark, d):
    """M2e: two boosting rounds of one cut each, step size 0.5."""
    return _small_trees(spark, d, depth=1, trees=2, boost=0.5)


def _small_trees(spark, d, **settings):
    from panelcast.models import trees

    tr, te, p, _ = _train_test(spark, d)
    m = trees.TreeModel(trees.Spec(**settings), ["avg_price"], "cnt", key_cols=["n_name", "wk"]).fit(tr)
    return m.transform(te.where("cnt IS NOT NULL AND avg_price IS NOT NULL")).select("n_name", "wk", r4("cnt").alias("y"), r4("y_pred"))


@register("q_ada")
def q_ada(spark, d):
    """M2f: AdaBoost.R2 (7 rounds, exponential loss, rate 0.01) of weighted depth-3 trees."""
    from panelcast.models import ml

    tr, te, p, feats = _ml_frame(spark, d)
    m = ml.AdaBoostR2(feats, "cnt", series_col="n_name").fit(tr)
    return m.transform(te).select("n_name", "wk", F.col("cnt").alias("y"), "y_pred")


@register("q_matrix")
def q_matrix(spark, d):
    """M14 M16 AG10 AG2: registry fit of linear + pooled models, long prediction matrix with
    the ensemble, scored per model."""
    from panelcast.models import registry

    tr, te, p, feats = _ml_frame(spark, d)
    fitted = registry.fit_models(tr, p, ["LinearRegression", "ridge", "LassoLars", "ElasticNet", "DecisionTreeRegressor"], feats, "cnt")
    pm = registry.prediction_matrix(fitted, te, keep=["n_name", "wk", "cnt"])
    return score.score(pm.withColumnRenamed("cnt", "y"), by=("model",))


@register(
    "q_registry",
    f"""WITH {_SCALED_SQL},
pz AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY n_name) AS n FROM zp),
spl AS (SELECT *, pos >= n - ceil(0.22 * n) AS is_test FROM pz),
fit AS (SELECT n_name, CASE WHEN var_pop(avg_price) = 0 THEN 0 ELSE covar_pop(cnt, avg_price) / var_pop(avg_price) END AS w,
  avg(avg_price) AS mx, avg(cnt) AS my FROM spl WHERE NOT is_test AND cnt IS NOT NULL AND avg_price IS NOT NULL GROUP BY 1),
dd AS (SELECT n_name, cnt - lag(cnt) OVER w AS dy, avg_price - lag(avg_price) OVER w AS dx FROM spl WHERE NOT is_test WINDOW w AS (PARTITION BY n_name ORDER BY t)),
b AS (SELECT n_name, sum(dx * dy) / sum(dx * dx) AS beta FROM dd WHERE dx IS NOT NULL AND dy IS NOT NULL GROUP BY 1),
la AS (SELECT n_name, cnt AS yT, avg_price AS xT FROM spl WHERE NOT is_test QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY t DESC) = 1),
m AS (SELECT spl.n_name, spl.wk, (fit.my - fit.w * fit.mx) + fit.w * spl.avg_price AS ols, la.yT + (spl.avg_price - la.xT) * b.beta AS sar
  FROM spl LEFT JOIN fit ON spl.n_name = fit.n_name LEFT JOIN b ON spl.n_name = b.n_name LEFT JOIN la ON spl.n_name = la.n_name WHERE spl.is_test)
SELECT n_name, wk, 'LinearRegression' AS model, round(ols, 4) AS y_pred FROM m
UNION ALL SELECT n_name, wk, 'SARIMAX', round(sar, 4) FROM m
UNION ALL SELECT n_name, wk, 'Ensamble', round((ols + sar) / 2, 4) FROM m""",
)
def q_registry(spark, d):
    """M14 M16 AG10: prediction matrix of a per-series regression and a difference regression from the registry, with the ensemble."""
    from panelcast.models import registry

    tr, te, p, _ = _train_test(spark, d)
    fitted = registry.fit_models(tr, p, ["LinearRegression", "SARIMAX"], ["avg_price"], "cnt")
    return registry.prediction_matrix(fitted, te, keep=["n_name", "wk"]).select("n_name", "wk", "model", r4("y_pred"))


@register("q_registry_steps")
def q_registry_steps(spark, d):
    """Nearest neighbours, negative binomial and the seasonal search on the raw weekly count, with the ensemble, scored."""
    from panelcast.models import registry
    from panelcast.operators import windows

    df, p = filled_panel(spark, d)
    df = scale.transform(df, p, scale.fit_scaler(df, p, ["avg_price"]), ["avg_price"]).na.drop(subset=["cnt", "avg_price"])
    sp = windows.chrono_split(df, p, 0.22)
    tr, te = sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "test")
    fitted = registry.fit_models(tr, p, ["KNeighborsRegressor", "NegativeBinomial", "SARIMAX_auto"], ["avg_price"], "cnt")
    pm = registry.prediction_matrix(fitted, te, keep=["n_name", "wk", "cnt"])
    return score.score(pm.withColumnRenamed("cnt", "y").filter("y_pred IS NOT NULL"), by=("model",))


@register("q_gridsearch")
def q_gridsearch(spark, d):
    """3 contiguous folds, ridge alpha grid, mean validation R^2 per nation, best flagged."""
    from panelcast.models import search

    z, p, _ = scaled_panel(spark, d)
    z = features.lags(z, p, ["cnt"], 1, fmt="{col}_l{j}").na.drop()
    return search.grid_linear(z, p, ["avg_price", "cnt_l1"], "cnt", "ridge", [0.1, 1.0, 10.0, 100.0])


@register("q_walkforward")
def q_walkforward(spark, d):
    """Walk-forward frames (20 %), per-frame OLS, EWM(5) smoothing, un-scaled, mean MAE per nation."""
    from panelcast.operators import predict

    z, p, st = scaled_panel(spark, d)
    z = features.lags(z, p, ["cnt"], 1, fmt="{col}_l{j}").na.drop()
    _, mean = predict.walk_forward(z, p, ["avg_price", "cnt_l1"], "cnt", stats=st)
    return mean


@register("q_granger")
def q_granger(spark, d):
    """T1 AG5 AG6: Granger chi-square tests up to lag 12, min p per pair, as a matrix."""
    from panelcast.operators import stats

    z, p, _ = scaled_panel(spark, d)
    cols = ["cnt", "avg_price", "p1"]
    tests = stats.granger(z.na.drop(), p, cols, 12)
    return stats.granger_matrix(stats.granger_min_p(tests, p), p, cols)


@register("q_adf")
def q_adf(spark, d):
    """Augmented Dickey-Fuller per nation and column, lag by AIC."""
    from panelcast.operators import stats

    z, p, _ = scaled_panel(spark, d)
    return stats.adf(z.na.drop(), p, ["cnt", "avg_price", "p1"])


@register("q_johansen")
def q_johansen(spark, d):
    """Johansen trace test (no deterministic terms, 5 lagged differences)."""
    from panelcast.operators import stats

    z, p, _ = scaled_panel(spark, d)
    return stats.johansen(z.na.drop(), p, ["cnt", "avg_price", "p1"], 5)


@register(
    "q_profile",
    f"""WITH RECURSIVE {_FILLED},
{_pacf_ctes(['cnt', 'avg_price'])},
h AS ({_hist_sql('cnt')} UNION ALL {_hist_sql('avg_price')})
SELECT n_name, col AS "column", 'acf' AS kind, lag AS idx, round(acf, 4) AS value, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi FROM acf
UNION ALL SELECT n_name, col, 'pacf', lag, round(pacf, 4), NULL, NULL FROM pacf
UNION ALL SELECT n_name, col, 'hist', bin, CAST(count AS DOUBLE), round(lo, 4), round(hi, 4) FROM h""",
)
def q_profile(spark, d):
    """T5: histogram, ACF and PACF of each column as one long table."""
    from panelcast.operators import stats

    df, p = filled_panel(spark, d)
    pr = stats.profile(df, p, ["cnt", "avg_price"], _ACF_L, 25)
    return pr.select(*p.keys, "column", "kind", "idx", r4("value"), r4("lo"), r4("hi"))


# --------------------------------------------------------------------------- end-to-end jobs on the orders panel


def _orders_job(spark, d):
    from panelcast.plans import jobs

    df, p = opanel(spark, d)
    cfg = jobs.FeatureJob(target="cnt", composites=_COMP_SPEC, replacements={}, drop_raw=False, lags=2, month=True, test_frac=0.22)
    rows, stats, feats = jobs.feature_job(df, p, cfg)
    return rows, stats, feats, p


@register("q_train_score")
def q_train_score(spark, d):
    """Feature job (fill, composites, split, scale, lags, calendar) then fit,
    predict, smooth, un-scale and score three registry models and their ensemble."""
    from panelcast.plans import jobs

    rows, stats, feats, p = _orders_job(spark, d)
    _, sc = jobs.train_and_score(rows, p, feats, "cnt", ["LinearRegression", "ridge", "DecisionTreeRegressor"], stats)
    return sc


def _ewm5_runs_sql(runs: int) -> str:
    """Forecast jobs over per-nation regressions on the scaled price: smoothed, un-scaled, truncated, averaged over equal runs."""
    return f"""WITH {_SCALED_SQL},
pz AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY n_name) AS n FROM zp),
spl AS (SELECT *, pos >= n - ceil(0.22 * n) AS is_test FROM pz),
fit AS (SELECT n_name, avg_price_w AS w, my - avg_price_w * mx AS b FROM (SELECT n_name, CASE WHEN var_pop(avg_price) = 0 THEN 0 ELSE covar_pop(cnt, avg_price) / var_pop(avg_price) END AS avg_price_w,
  avg(avg_price) AS mx, avg(cnt) AS my FROM spl WHERE NOT is_test AND cnt IS NOT NULL AND avg_price IS NOT NULL GROUP BY 1)),
pr AS (SELECT spl.n_name, spl.wk, spl.t, b + w * avg_price AS p FROM spl JOIN fit ON spl.n_name = fit.n_name WHERE is_test),
sm AS (SELECT a.n_name, a.wk, sum(pow(2.0 / 3, a.t - h.t) * h.p) / sum(pow(2.0 / 3, a.t - h.t)) AS p
  FROM pr a JOIN pr h ON a.n_name = h.n_name AND h.t <= a.t WHERE h.p IS NOT NULL GROUP BY 1, 2)
SELECT sm.n_name, sm.wk, CAST(trunc(p * CASE WHEN sc IS NULL OR sc = 0 THEN 1 ELSE sc END + mc) AS BIGINT) AS total_cases, CAST({runs} AS BIGINT) AS runs
FROM sm JOIN zs ON sm.n_name = zs.n_name"""


@register("q_forecast_linear", _ewm5_runs_sql(2))
def q_forecast_linear(spark, d):
    """E4 IO3 IO4 J2 AG7 PR12: two runs of a per-nation regression, 'Ensamble' smoothed, un-scaled, attached, written
    a file a run, read again and averaged."""
    from panelcast.plans import jobs

    tr, te, p, st = _train_test(spark, d)
    tmpl = te.select("n_name", "wk", F.lit(0).alias("total_cases"))
    return jobs.forecast_runs(tr, te, p, ["avg_price"], "cnt", tmpl, ["n_name", "wk"], st, models=["LinearRegression"], runs=2, path=jobs.run_folder(spark))


@register("q_forecast_job")
def q_forecast_job(spark, d):
    """E4 J2 AG7 PR12: three runs (seeds differ) of an extra tree, a tree and a regression, their 'Ensamble' smoothed,
    un-scaled, attached to a template of the test weeks, written a file a run, read again and averaged."""
    from panelcast.plans import jobs

    rows, stats, feats, p = _orders_job(spark, d)
    tr, te = rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "test")
    tmpl = te.select("n_name", "wk", F.lit(0).alias("total_cases"))
    models = ["ExtraTreeRegressor", "DecisionTreeRegressor", "LinearRegression"]
    return jobs.forecast_runs(tr, te, p, feats, "cnt", tmpl, ["n_name", "wk"], stats, models=models, runs=3, path=jobs.run_folder(spark))


@register("q_var_job")
def q_var_job(spark, d):
    """E5: step-by-step VAR(2) forecast of the weekly count, smoothed, un-scaled,
    shifted to a zero minimum and truncated into a template."""
    from panelcast.plans import jobs

    tr, te, p, st = _train_test(spark, d)
    tmpl = te.select("n_name", "wk", F.lit(0).alias("total_cases"))
    return jobs.var_forecast_job(tr.na.drop(), te, p, ["avg_price", "p1", "cnt"], "cnt", 2, st, tmpl, ["n_name", "wk"])


@register(
    "q_sequence_job",
    f"""WITH {_SCALED_SQL},
nn AS (SELECT * FROM zp WHERE cnt IS NOT NULL AND avg_price IS NOT NULL AND p1 IS NOT NULL),
lst AS (SELECT n_name, wk, cnt AS y,
  list([cnt, avg_price, p1]) OVER (PARTITION BY n_name ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS x FROM nn),
txt AS (SELECT n_name, wk, y, list_transform(x, lambda r: array_to_string(list_transform(r, lambda v: coalesce(printf('%.4f', round(v, 4)), 'null')), ',')) AS rows_txt
  FROM lst WHERE len(x) = 4)
SELECT n_name, wk, round(y, 4) AS y, array_to_string(rows_txt[1:2], ';') || '|' || array_to_string(rows_txt[3:4], ';') AS x FROM txt""",
)
def q_sequence_job(spark, d):
    """Two-level (CNN-style) 4-week windows of the scaled panel."""
    from panelcast.plans import jobs

    z, p, _ = scaled_panel(spark, d)
    s = jobs.sequence_dataset(z.na.drop(), p, ["cnt", "avg_price", "p1"], "cnt", 4, mode="CNN")
    return s.select("n_name", "wk", r4("y"), F.concat_ws("|", F.transform("x", _seq_text_spark)).alias("x"))


@register(
    "q_plot_table",
    f"""WITH {_SCALED_SQL},
pz AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY n_name) AS n FROM zp),
spl AS (SELECT *, pos >= n - ceil(0.22 * n) AS is_test FROM pz WHERE cnt IS NOT NULL AND avg_price IS NOT NULL AND p1 IS NOT NULL),
fit AS (SELECT n_name, CASE WHEN var_pop(avg_price) = 0 THEN 0 ELSE covar_pop(cnt, avg_price) / var_pop(avg_price) END AS w,
  avg(avg_price) AS mx, avg(cnt) AS my FROM spl WHERE NOT is_test GROUP BY 1)
SELECT n_name, wk, 'train' AS series, round(cnt, 4) AS value FROM spl WHERE NOT is_test
UNION ALL SELECT n_name, wk, 'true', round(cnt, 4) FROM spl WHERE is_test
UNION ALL SELECT spl.n_name, spl.wk, 'predicted', round((fit.my - fit.w * fit.mx) + fit.w * spl.avg_price, 4)
  FROM spl JOIN fit ON spl.n_name = fit.n_name WHERE spl.is_test""",
)
def q_plot_table(spark, d):
    """Train values, true test values and OLS predictions aligned by week."""
    from panelcast.models import linear
    from panelcast.operators import forecast

    tr, te, p, _ = _train_test(spark, d)
    tr, te = tr.na.drop(), te.na.drop()
    c = linear.fit(tr, p, ["avg_price"], "cnt")
    pr = linear.predict(te, p, c, ["avg_price"])
    return forecast.plot_table(tr, te, pr, ["n_name", "wk"], "cnt").select("n_name", "wk", "series", r4("value"))


@register(
    "q_knn",
    f"""WITH {_SCALED_SQL},
pz AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY n_name) AS n
  FROM zp WHERE cnt IS NOT NULL AND avg_price IS NOT NULL AND p1 IS NOT NULL),
tr AS (SELECT * FROM pz WHERE pos < n - ceil(0.22 * n)),
te AS (SELECT * FROM pz WHERE pos >= n - ceil(0.22 * n)),
pairs AS (SELECT te.n_name, te.wk, tr.cnt AS y,
  row_number() OVER (PARTITION BY te.n_name, te.wk ORDER BY
    (te.avg_price - tr.avg_price) * (te.avg_price - tr.avg_price) + (te.p1 - tr.p1) * (te.p1 - tr.p1), tr.wk) AS rk
  FROM te JOIN tr ON te.n_name = tr.n_name)
SELECT n_name, wk, round(avg(y), 4) AS y_pred FROM pairs WHERE rk <= 20 GROUP BY 1, 2""",
)
def q_knn(spark, d):
    """M3: mean of the 20 nearest training weeks (scaled price, priority-1 price), exact grid search."""
    from panelcast.models import knn

    z, p, _ = scaled_panel(spark, d)
    z = z.na.drop(subset=["cnt", "avg_price", "p1"])
    from panelcast.operators import windows

    sp = windows.chrono_split(z, p, 0.22)
    tr, te = sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "test")
    pr = knn.knn_regress(tr, te, ["n_name"], "wk", ["avg_price", "p1"], "cnt", k=20)
    return pr.select("n_name", "wk", r4("y_pred"))


@register(
    "q_select_series",
    f"""WITH {PANEL_CTE}
SELECT n_name, wk, cnt AS y, 0 AS total_cases FROM panel WHERE n_name = 'NATION_7'""",
)
def q_select_series(spark, d):
    """PR1 PR9 PR16: one series selected, the target renamed to y, a placeholder target added."""
    df, p = opanel(spark, d)
    one = df.filter(F.col("n_name") == "NATION_7")
    r = clean.placeholder_target(clean.rename(one, {"cnt": "y"}), "total_cases", 0)
    return r.select("n_name", "wk", "y", "total_cases")


@register(
    "q_events_fill_lags",
    f"""WITH {EV_CTE},
f AS (SELECT event_type, hr, t, {_ffill_sql(['cnt', 'avg_value'], key='event_type')} FROM epanel),
l AS (SELECT event_type, hr, cnt, avg_value,
  lag(cnt, 1) OVER w AS cnt_l1, lag(cnt, 24) OVER w AS cnt_l24, lag(avg_value, 24) OVER w AS avg_value_l24,
  CAST(sum(coalesce(cnt, 0)) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_cnt
  FROM f WINDOW w AS (PARTITION BY event_type ORDER BY t))
SELECT event_type, hr, cnt, round(avg_value, 4) AS avg_value, cnt_l1, cnt_l24, round(avg_value_l24, 4) AS avg_value_l24, cum_cnt FROM l""",
)
def q_events_fill_lags(spark, d):
    """W1 W4 and a running sum on the hourly events panel (lags of 1 hour and 1 day)."""
    configure(spark)
    df, p = events_panel(spark, d)
    f = clean.ffill(df, p, ["cnt", "avg_value"])
    lg = features.lags(f, p, ["cnt", "avg_value"], 24, fmt="{col}_l{j}")
    lg = features.cumsum(lg, p, ["cnt"], suffix="_cum")
    return lg.select(
        *p.keys, p.ts, "cnt", r4("avg_value"), "cnt_l1", "cnt_l24", r4("avg_value_l24"), F.col("cnt_cum").alias("cum_cnt")
    )


_GRID_ALPHAS = [0.1, 1.0, 10.0, 100.0]


@register(
    "q_gridsearch1",
    f"""WITH {_SCALED_SQL},
cc AS (SELECT n_name, t, cnt AS y, avg_price AS x FROM zp WHERE cnt IS NOT NULL AND avg_price IS NOT NULL),
ps AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY n_name) AS n FROM cc),
fq AS (SELECT *, n // 3 AS q, n % 3 AS r FROM ps),
fo AS (SELECT *, CASE WHEN pos < (q + 1) * r THEN pos // (q + 1) ELSE r + (pos - (q + 1) * r) // q END AS fold FROM fq),
fs AS (SELECT n_name, fold, count(*) AS nf, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM fo GROUP BY 1, 2),
tot AS (SELECT n_name, sum(nf) AS tn, sum(sx) AS tsx, sum(sy) AS tsy, sum(sxx) AS tsxx, sum(sxy) AS tsxy FROM fs GROUP BY 1),
al AS (SELECT CAST(unnest([{', '.join(repr(a) for a in _GRID_ALPHAS)}]) AS DOUBLE) AS alpha),
tr AS (SELECT fs.*, al.alpha, tot.tn - fs.nf AS n_tr, tot.tsx - fs.sx AS sx_tr, tot.tsy - fs.sy AS sy_tr,
  tot.tsxx - fs.sxx AS sxx_tr, tot.tsxy - fs.sxy AS sxy_tr FROM fs JOIN tot ON fs.n_name = tot.n_name, al),
co AS (SELECT *, sx_tr / n_tr AS mx, sy_tr / n_tr AS my FROM tr),
wb AS (SELECT *, (sxy_tr - n_tr * mx * my) / ((sxx_tr - n_tr * mx * mx) + alpha) AS w FROM co),
wb2 AS (SELECT *, my - w * mx AS b FROM wb),
sc AS (SELECT n_name, alpha, fold,
  syy - 2 * (b * sy + w * sxy) + (b * b * nf + 2 * b * w * sx + w * w * sxx) AS sse, syy - sy * sy / nf AS sst, syy FROM wb2),
m AS (SELECT n_name, alpha, avg(CASE WHEN sst > 1e-9 * syy THEN 1 - sse / sst ELSE 0 END) AS mean_r2 FROM sc GROUP BY 1, 2),
bst AS (SELECT n_name, first(alpha ORDER BY mean_r2 DESC, alpha) AS balpha FROM m GROUP BY 1)
SELECT m.n_name, m.alpha, round(m.mean_r2, 4) AS mean_r2, m.alpha = bst.balpha AS best FROM m JOIN bst ON m.n_name = bst.n_name""",
)
def q_gridsearch1(spark, d):
    """Ridge alpha grid, 3 contiguous folds, mean validation R^2 per nation (one regressor)."""
    from panelcast.models import search

    z, p, _ = scaled_panel(spark, d)
    z = z.na.drop(subset=["cnt", "avg_price"])
    g = search.grid_linear(z, p, ["avg_price"], "cnt", "ridge", _GRID_ALPHAS)
    return g.select("n_name", "alpha", r4("mean_r2"), "best")


_WALK_SQL = f"""WITH {_SCALED_SQL},
cc AS (SELECT n_name, wk, t, cnt AS y, avg_price AS x FROM zp WHERE cnt IS NOT NULL AND avg_price IS NOT NULL),
ps AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY n_name) AS n FROM cc),
fz AS (SELECT *, floor(n * 0.2) AS size FROM ps),
fr AS (SELECT *, round_even(n / nullif(size, 0), 0) AS nfr, floor(pos / nullif(size, 0)) AS f FROM fz),
fa AS (SELECT *, CAST(f AS BIGINT) AS frame, least(size, n - f * size) AS flen FROM fr WHERE f < nfr),
pt AS (SELECT *, CASE WHEN pos - frame * size >= flen - ceil(flen * 0.3) THEN 'test' ELSE 'train' END AS part FROM fa),
fit AS (SELECT n_name, frame, CASE WHEN var_pop(x) = 0 THEN 0 ELSE covar_pop(y, x) / var_pop(x) END AS w, avg(x) AS mx, avg(y) AS my
  FROM (%s) WHERE part = 'train' GROUP BY 1, 2),
pr AS (SELECT pt.n_name, pt.frame, pt.t, pt.y, (fit.my - fit.w * fit.mx) + fit.w * pt.x AS yp
  FROM pt JOIN fit ON pt.n_name = fit.n_name AND pt.frame = fit.frame WHERE pt.part = 'test'),
sm AS (SELECT a.n_name, a.frame, a.t, a.y,
  sum(pow({repr(1 - 2 / 6)}, a.t - b.t) * b.yp) / sum(pow({repr(1 - 2 / 6)}, a.t - b.t)) AS yp
  FROM pr a JOIN pr b ON a.n_name = b.n_name AND a.frame = b.frame AND b.t <= a.t GROUP BY 1, 2, 3, 4),
us AS (SELECT sm.n_name, sm.frame,
  sm.y * CASE WHEN zs.sc IS NULL OR zs.sc = 0 THEN 1 ELSE zs.sc END + zs.mc AS y,
  sm.yp * CASE WHEN zs.sc IS NULL OR zs.sc = 0 THEN 1 ELSE zs.sc END + zs.mc AS yp FROM sm JOIN zs ON sm.n_name = zs.n_name),
mae AS (SELECT n_name, frame, avg(abs(y - yp)) AS mae FROM us GROUP BY 1, 2)
SELECT n_name, round(avg(mae), 4) AS mean_mae FROM mae GROUP BY 1"""


@register("q_walkforward1", _WALK_SQL.replace("%s", "SELECT * FROM pt"))
def q_walkforward1(spark, d):
    """M18 AG3: walk-forward frames (20 %), per-frame OLS on the scaled price, EWM(5) of the
    validation predictions, un-scaled, MAE per frame averaged per nation."""
    from panelcast.operators import predict

    z, p, st = scaled_panel(spark, d)
    z = z.na.drop(subset=["cnt", "avg_price"])
    _, mean = predict.walk_forward(z, p, ["avg_price"], "cnt", stats=st)
    return mean.select("n_name", r4("mean_mae"))


@register("q_walkforward2", _WALK_SQL.replace("%s", "SELECT f.n_name, f.frame, pt.x, pt.y, pt.part FROM (SELECT DISTINCT n_name, frame FROM pt) f JOIN pt ON pt.n_name = f.n_name AND pt.frame <= f.frame"))
def q_walkforward2(spark, d):
    """M18 AG3: the same with frames that train on all training rows so far, by running sums of cross products."""
    from panelcast.operators import predict

    z, p, st = scaled_panel(spark, d)
    z = z.na.drop(subset=["cnt", "avg_price"])
    _, mean = predict.walk_forward(z, p, ["avg_price"], "cnt", stats=st, expanding=True)
    return mean.select("n_name", r4("mean_mae"))


@register("q_walkforward_models")
def q_walkforward_models(spark, d):
    """M18 for models of the registry: boosting that goes on from frame to frame, a tree and a regression fitted anew, scores per model."""
    from panelcast.operators import predict

    z, p, st = scaled_panel(spark, d)
    z = features.lags(z, p, ["cnt"], 1, fmt="{col}_l{j}").na.drop()
    _, mean = predict.walk_forward_models(z, p, ["XGBRegressor", "DecisionTreeRegressor", "LinearRegression"], ["avg_price", "cnt_l1"], "cnt", carry=True, stats=st)
    return mean
