"""Panel description and the segment plan shared by every ordered operator.

A *panel* is a DataFrame holding many regularly sampled series: one or more
series-key columns, a time column, and measures.  Spark has no row order, so
each operator orders explicitly by an integer *step* column ``t`` (periods since
the epoch).

Scale plan
----------
Partitioning a window by the series key alone puts a whole series into one
task; if one series holds a third of all rows, that task holds a third of the
data.  Every ordered operator therefore partitions by ``(keys..., seg)`` where
``seg = floor(t / seg_steps)``.  On a regular panel a segment holds at most
``seg_steps`` rows, whatever the skew between series.  Work that crosses a
segment border is handled by

* a *tail map*: the last ``h`` steps of a segment are packed into one map per
  (series, next segment) for bounded look-back (lags, differences, sliding
  windows) and joined on exactly (keys, seg), so the panel is not shuffled; or
* a *carry*: a per-segment summary (one row per segment, so ``1/seg_steps`` of
  the data) is scanned in segment order and joined back (forward/back fill,
  running sums, row positions, smoothing).

Per-series statistics (means, counts, fitted coefficients) are fanned out to
``(keys..., seg)`` before they are joined back, so that join is spread over
segments as well and shares the panel's partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed anchors of the step index.  1970-01-05 is a Monday, matching
# date_trunc('week', ...) which starts weeks on Monday.
WEEK_ANCHOR = "1970-01-05"
DAY_ANCHOR = "1970-01-01"
FREQS = ("week", "day", "hour")


@dataclass(frozen=True)
class Panel:
    """Column roles of a panel DataFrame.

    ``keys``: series key columns; ``ts``: time column (DATE for week/day,
    TIMESTAMP_NTZ for hour); ``freq``: sampling period; ``t``/``seg``: names of
    the step and segment columns added by :func:`with_step`; ``seg_steps``:
    rows per segment (bounds the size of every window task).
    """

    keys: tuple[str, ...]
    ts: str
    freq: str = "week"
    t: str = "t"
    seg: str = "seg"
    seg_steps: int = 1 << 16

    def __post_init__(self):
        if isinstance(self.keys, str):
            object.__setattr__(self, "keys", (self.keys,))
        else:
            object.__setattr__(self, "keys", tuple(self.keys))
        if self.freq not in FREQS:
            raise ValueError(f"freq must be one of {FREQS}")
        if self.seg_steps < 1:
            raise ValueError("seg_steps must be positive")

    @property
    def part(self) -> list[str]:
        """Partition columns of every ordered window."""
        return [*self.keys, self.seg]

    @property
    def reserved(self) -> set[str]:
        return {*self.keys, self.ts, self.t, self.seg}

    def measures(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c not in self.reserved]

    def window(self, *extra: str):
        """Ordered window inside one segment of one series."""
        return Window.partitionBy(*self.part, *extra).orderBy(self.t)

    def running(self):
        return self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def seg_window(self):
        """Window over per-segment summary rows of one series (tiny)."""
        return Window.partitionBy(*self.keys).orderBy(self.seg)

    def with_segments(self, seg_steps: int) -> "Panel":
        return replace(self, seg_steps=seg_steps)


# --------------------------------------------------------------------------- steps


def step_of(ts: Column | str, freq: str) -> Column:
    """Integer period index of a time value (zone free for DATE / TIMESTAMP_NTZ)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    if freq == "week":
        return F.floor(F.datediff(c.cast("date"), F.lit(WEEK_ANCHOR).cast("date")) / 7).cast("long")
    if freq == "day":
        return F.datediff(c.cast("date"), F.lit(DAY_ANCHOR).cast("date")).cast("long")
    if freq == "hour":
        return (F.datediff(F.to_date(c), F.lit(DAY_ANCHOR).cast("date")).cast("long") * 24 + F.hour(c)).cast("long")
    raise ValueError(freq)


def time_of(t: Column | str, freq: str) -> Column:
    """Inverse of :func:`step_of`: start of the period."""
    c = F.col(t) if isinstance(t, str) else t
    if freq == "week":
        return F.date_add(F.lit(WEEK_ANCHOR).cast("date"), (c * 7).cast("int"))
    if freq == "day":
        return F.date_add(F.lit(DAY_ANCHOR).cast("date"), c.cast("int"))
    if freq == "hour":
        days = F.floor(c / 24).cast("int")
        hours = (c - days * 24).cast("int")
        return F.make_timestamp_ntz(
            F.year(F.date_add(F.lit(DAY_ANCHOR).cast("date"), days)),
            F.month(F.date_add(F.lit(DAY_ANCHOR).cast("date"), days)),
            F.dayofmonth(F.date_add(F.lit(DAY_ANCHOR).cast("date"), days)),
            hours,
            F.lit(0),
            F.lit(0),
        )
    raise ValueError(freq)


def period_start(ts: Column | str, freq: str) -> Column:
    """Truncate a timestamp to its period (DATE for week/day, TIMESTAMP_NTZ for hour)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    if freq == "week":
        return F.to_date(F.date_trunc("week", c))
    if freq == "day":
        return F.to_date(c)
    return F.date_trunc("hour", c).cast("timestamp_ntz")


def seg_of(t: Column | str, seg_steps: int) -> Column:
    c = F.col(t) if isinstance(t, str) else t
    return F.floor(c / F.lit(seg_steps)).cast("long")


def with_step(df: DataFrame, panel: Panel) -> DataFrame:
    """Add the step and segment columns from the time column."""
    df = df.withColumn(panel.t, step_of(panel.ts, panel.freq))
    return df.withColumn(panel.seg, seg_of(panel.t, panel.seg_steps))


def regularize(df: DataFrame, panel: Panel, cut_lineage: bool = True) -> DataFrame:
    """Spine every series from its first to its last period; gaps become NULL rows.

    ``df`` must be unique on (keys, period).  The spine is generated per
    (series, segment), so one very long series fans out over many tasks.
    The bounds and the data side both read ``df``; with ``cut_lineage`` it is
    checkpointed first (to ``spark.checkpoint.dir``), so an aggregate over a
    large scan is computed once, not once per branch.
    """
    S = panel.seg_steps
    d = with_step(df, panel)
    if cut_lineage:
        from panelcast.session import ensure_checkpoint_dir

        ensure_checkpoint_dir(df.sparkSession)
        d = d.checkpoint(eager=True)
    measures = [c for c in df.columns if c not in (*panel.keys, panel.ts)]
    bounds = d.groupBy(*panel.keys).agg(F.min(panel.t).alias("_lo"), F.max(panel.t).alias("_hi"))
    segs = bounds.select(
        *panel.keys,
        "_lo",
        "_hi",
        F.explode(F.sequence(seg_of("_lo", S), seg_of("_hi", S))).alias(panel.seg),
    )
    start = F.greatest(F.col("_lo"), F.col(panel.seg) * S)
    stop = F.least(F.col("_hi"), F.col(panel.seg) * S + (S - 1))
    spine = segs.select(*panel.keys, panel.seg, F.explode(F.sequence(start, stop)).alias(panel.t))
    out = spine.join(d.select(*panel.keys, panel.t, *measures), [*panel.keys, panel.t], "left")
    return out.select(*panel.keys, time_of(panel.t, panel.freq).alias(panel.ts), panel.t, panel.seg, *measures)


# --------------------------------------------------------------------------- carries


def seg_carry_last(df: DataFrame, panel: Panel, cols: list[str], reverse: bool = False) -> DataFrame:
    """Per (keys, seg): last (or first, if ``reverse``) non-null value of each column
    found in the *earlier* (or later) segments of the same series."""
    pick = F.min_by if reverse else F.max_by
    summ = df.groupBy(*panel.part).agg(
        *[pick(F.col(c), F.when(F.col(c).isNotNull(), F.col(panel.t))).alias(c) for c in cols]
    )
    w = panel.seg_window()
    if reverse:
        w = w.rowsBetween(1, Window.unboundedFollowing)
        sel = [F.first(c, ignorenulls=True).over(w).alias(f"_carry_{c}") for c in cols]
    else:
        w = w.rowsBetween(Window.unboundedPreceding, -1)
        sel = [F.last(c, ignorenulls=True).over(w).alias(f"_carry_{c}") for c in cols]
    return summ.select(*panel.part, *sel)


def seg_carry_sum(df: DataFrame, panel: Panel, exprs: dict[str, Column]) -> DataFrame:
    """Per (keys, seg): sum of each expression over the earlier segments of the series."""
    summ = df.groupBy(*panel.part).agg(*[F.sum(e).alias(n) for n, e in exprs.items()])
    w = panel.seg_window().rowsBetween(Window.unboundedPreceding, -1)
    return summ.select(*panel.part, *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"_carry_{n}") for n in exprs])


def row_index(df: DataFrame, panel: Panel, name: str = "_rn") -> DataFrame:
    """0-based position of each row inside its series (exact on irregular panels too).

    Local ``row_number`` inside the segment plus the row count of all earlier
    segments (a carry), so no task ever sees a whole series.
    """
    local = df.withColumn("_lrn", F.row_number().over(panel.window()) - 1)
    carry = seg_carry_sum(df, panel, {"_cnt": F.lit(1)})
    out = local.join(carry, panel.part, "left")
    return out.withColumn(name, (F.col("_lrn") + F.col("_carry__cnt")).cast("long")).drop("_lrn", "_carry__cnt")


# --------------------------------------------------------------------------- per-series tables


def attach_series(df: DataFrame, panel: Panel, stats: DataFrame, how: str = "left") -> DataFrame:
    """Join a per-series table (keyed by ``panel.keys``) back onto the panel.

    The table is first fanned out to the (keys, seg) pairs present in ``df``; the
    join then runs on (keys, seg), so a hot series is spread over its segments
    and the panel keeps the partitioning of its windows.  AQE broadcasts the
    fanned-out table when its measured size is small.
    """
    segs = df.select(*panel.part).distinct()
    fan = segs.join(stats, list(panel.keys), "inner")
    return df.join(fan, panel.part, how)


def with_position(df: DataFrame, panel: Panel, pos: str = "_pos", n: str = "_n") -> DataFrame:
    """Add the 0-based row position and the series length to every row.

    Both come from one per-segment row count: the offset of a segment is the
    count of the earlier segments, the length the count of all of them.  One
    small summary, one join on (keys, seg).
    """
    local = df.withColumn("_lrn", F.row_number().over(panel.window()) - 1)
    summ = df.groupBy(*panel.part).agg(F.count(F.lit(1)).alias("_cnt"))
    before = panel.seg_window().rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*panel.keys)
    summ = summ.select(
        *panel.part,
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(whole).alias(n),
    )
    out = local.join(summ, panel.part, "left")
    return out.withColumn(pos, (F.col("_lrn") + F.col("_off")).cast("long")).drop("_lrn", "_off")


WORK_DB = "panelcast_work"
# Tables this driver process wrote; only these are dropped again.
_OWN_TABLES: list[str] = []


def _work_db(spark) -> str:
    """Database for materialized panels, located in the shared checkpoint folder."""
    from panelcast.session import ensure_checkpoint_dir

    root = ensure_checkpoint_dir(spark).rstrip("/")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {WORK_DB} LOCATION '{root}/{WORK_DB}.db'")
    return WORK_DB


def work_table(spark, kind: str) -> str:
    """A new table name in the work database; :func:`release_materialized` drops it."""
    import uuid

    _OWN_TABLES.append(name := f"{_work_db(spark)}.{kind}_{uuid.uuid4().hex}")
    return name


BUCKET_BYTES = 256 << 20


def default_buckets(df: DataFrame) -> int:
    """Buckets by data size: one per ``BUCKET_BYTES`` of the tables and checkpoints behind ``df``, each counted once, and
    no fewer than one wave of tasks (or the shuffle setting, where that is less)."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = {(x := leaves.apply(i)).canonicalized(): _stored_bytes(spark, x) for i in range(leaves.size())}
    wave = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(1, wave, -(-sum(sizes.values()) // BUCKET_BYTES))


def _stored_bytes(spark, leaf) -> int:
    """Bytes of a table, or of a checkpoint's files: the optimizer's figure for a checkpoint is that of the joins
    behind it, which can be larger than the data by many powers of ten.  0 where it is unknown."""
    if leaf.getClass().getSimpleName() == "LogicalRDD":
        at = leaf.rdd().getCheckpointFile()
        if at.isEmpty():
            return 0
        path = spark._jvm.org.apache.hadoop.fs.Path(at.get())
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    size = int(str(leaf.stats().sizeInBytes()))
    return size if size < 1 << 60 else 0  # Spark's mark for an unknown size is larger


def materialize(df: DataFrame, panel: Panel, buckets: int | None = None) -> DataFrame:
    """Write the panel once as a table bucketed by (keys, seg) and read it back.

    Every ordered operator partitions by (keys, seg) -- or a refinement of it --
    and every per-series join is fanned out to (keys, seg), so on the bucketed
    table they run without shuffling the panel again, and the source scan and
    aggregation behind the panel are never recomputed by later branches.  The
    table lives in a work database under the session's ``spark.checkpoint.dir``
    (a shared folder on a cluster), so losing an executor does not lose it;
    :func:`release_materialized` drops the tables and their files.  Rows are
    first repartitioned with the same hash, so each task writes one file per
    bucket.  ``buckets`` defaults to :func:`default_buckets`.
    """
    spark = df.sparkSession
    n = buckets or default_buckets(df)
    name = work_table(spark, "panel")
    df.repartition(n, *panel.part).write.bucketBy(n, *panel.part).mode("error").saveAsTable(name)
    return spark.table(name)


def release_materialized(spark) -> int:
    """Drop the tables that this driver process wrote to the work database, by name (managed tables: files go too)."""
    n = len(_OWN_TABLES)
    while _OWN_TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_OWN_TABLES.pop()}")
    return n


# --------------------------------------------------------------------------- boundary look-back without a shuffle


def with_tail(df: DataFrame, panel: Panel, value: Column, h: int, name: str = "_tail") -> DataFrame:
    """Attach to every row a map ``t -> value`` of the last ``h`` steps of the
    previous segment of its series.

    Only rows within ``h`` steps of a segment's end are read into the maps
    (``h / seg_steps`` of the data); the join is on exactly (keys, seg), so on a
    panel bucketed by those columns the panel itself is not shuffled.
    """
    S = panel.seg_steps
    if h < 0 or h > S:
        raise ValueError(f"look-back {h} must be within [0, seg_steps={S}]")
    pos = F.pmod(F.col(panel.t), F.lit(S))
    tail = (
        df.filter(pos >= S - h)
        .groupBy(*panel.keys, (F.col(panel.seg) + 1).alias(panel.seg))
        .agg(F.map_from_entries(F.collect_list(F.struct(F.col(panel.t), value))).alias(name))
    )
    return df.join(tail, panel.part, "left")


def lag_col(panel: Panel, c: str, j: int, tail: str = "_tail") -> Column:
    """Value of ``c`` exactly ``j`` steps back (regular panel): inside the segment a
    window ``lag``, across the border a lookup in the previous segment's tail."""
    if j == 0:
        return F.col(c)
    inside = F.pmod(F.col(panel.t), F.lit(panel.seg_steps)) >= j
    return F.when(inside, F.lag(c, j).over(panel.window())).otherwise(F.try_element_at(F.col(tail), F.col(panel.t) - j)[c])


def with_lag_cols(df: DataFrame, panel: Panel, cols, lags, fmt: str = "{col}__{j}") -> DataFrame:
    """Add ``lag(c, j)`` columns for every c and j (j >= 1) without shuffling the panel."""
    cols, lags = list(cols), sorted({j for j in lags if j > 0})
    if not lags:
        return df
    d = with_tail(df, panel, F.struct(*[F.col(c) for c in cols]), max(lags))
    new = [lag_col(panel, c, j).alias(fmt.format(col=c, j=j)) for j in lags for c in cols]
    return d.select(*df.columns, *new)


def positional_steps(df: DataFrame, panel: Panel) -> DataFrame:
    """Step index = row position inside the series, ordered by the time column.

    For inputs whose rows *are* the periods (one row per week, dates not
    necessarily 7 days apart), so shifts and smoothing count rows as the
    reference does.  Positions come from a provisional segmentation by date and
    the per-segment row-count carry, so no task sees a whole series; the result
    is regular by construction.
    """
    prov = replace(panel, t="_pt", seg="_pseg")
    d = df.withColumn("_pt", step_of(panel.ts, "day")).withColumn("_pseg", seg_of("_pt", panel.seg_steps))
    d = row_index(d, prov, panel.t)
    return d.drop("_pt", "_pseg").withColumn(panel.seg, seg_of(panel.t, panel.seg_steps))
