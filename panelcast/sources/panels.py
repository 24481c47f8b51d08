"""Panels derived from the driver tables.

The reference works on weekly climate readings per city; the driver tables have
none, so two derived panels stand in:

* orders panel: orders x customer x nation, weekly per nation -- ``cnt`` (the
  target), ``avg_price`` and the average price per order priority (``p1``..``p5``)
  as parallel sensors;
* events panel: events per event type and hour -- ``cnt`` and ``avg_value``.

Aggregation happens before the spine, with map-side partial aggregation, so a
hot nation or event type costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.plans.panel import Panel, materialize, period_start, regularize
from panelcast.sources.tables import read_table

# Order priorities of the orders table, in natural order.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PRIORITY_COLS = [f"p{i}" for i in range(1, len(PRIORITIES) + 1)]

ORDERS_PANEL = Panel(keys=("n_name",), ts="wk", freq="week")
EVENTS_PANEL = Panel(keys=("event_type",), ts="hr", freq="hour")


def orders_by_nation(spark: SparkSession, data_dir: str) -> DataFrame:
    """Orders with the customer's nation name (o_totalprice, o_orderdate, o_orderpriority, n_name)."""
    o = read_table(spark, data_dir, "orders", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = read_table(spark, data_dir, "customer", "c_custkey", "c_nationkey")
    n = read_table(spark, data_dir, "nation", "n_nationkey", "n_name")
    cn = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_name")
    return o.join(cn, o.o_custkey == cn.c_custkey).drop("o_custkey", "c_custkey")


def exact_mean(value, cond=None):
    """Mean of a money column from an exact DECIMAL sum divided by the count.

    The sum does not depend on the order rows arrive in, so the result is the
    same double on every run and every engine.
    """
    v = value.cast("decimal(18,2)")
    if cond is not None:
        v = F.when(cond, v)
    n = F.count(v)
    return F.when(n > 0, F.sum(v).cast("double") / n)


def orders_weekly(spark: SparkSession, data_dir: str) -> DataFrame:
    """Weekly aggregate per nation, only weeks that have orders (not yet spined)."""
    j = orders_by_nation(spark, data_dir)
    price, prio = F.col("o_totalprice"), F.col("o_orderpriority")
    return j.groupBy("n_name", period_start("o_orderdate", "week").alias("wk")).agg(
        F.count(F.lit(1)).alias("cnt"),
        exact_mean(price).alias("avg_price"),
        *[exact_mean(price, prio == p).alias(c) for p, c in zip(PRIORITIES, PRIORITY_COLS)],
    )


def orders_panel(spark: SparkSession, data_dir: str, seg_steps: int | None = None) -> tuple[DataFrame, Panel]:
    """Regular weekly panel per nation: gaps are NULL rows.  Returns (df, panel)."""
    panel = ORDERS_PANEL if seg_steps is None else ORDERS_PANEL.with_segments(seg_steps)
    return materialize(regularize(orders_weekly(spark, data_dir), panel), panel), panel


def events_hourly(spark: SparkSession, data_dir: str) -> DataFrame:
    e = read_table(spark, data_dir, "events", "ts", "event_type", "value")
    return e.groupBy("event_type", period_start("ts", "hour").alias("hr")).agg(
        F.count(F.lit(1)).alias("cnt"), F.avg("value").alias("avg_value")
    )


def events_panel(spark: SparkSession, data_dir: str, seg_steps: int | None = None) -> tuple[DataFrame, Panel]:
    """Regular hourly panel per event type."""
    panel = EVENTS_PANEL if seg_steps is None else EVENTS_PANEL.with_segments(seg_steps)
    return materialize(regularize(events_hourly(spark, data_dir), panel), panel), panel
