"""Forecast tables: attach to a template, average runs, compare, blend, write and read.

J2 attach, SO1 stack series (free: all series live in one table), SO3 template
order, AG7 run average, J4 runs side by side (long union with ``run_id``), J5
compare, J6 blend, IO3/IO4 partitioned CSV outputs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.clean import to_int


def attach(template: DataFrame, pred: DataFrame, on: Sequence[str], target: str = "total_cases", y_pred: str = "y_pred", order: str | None = None) -> DataFrame:
    """Put predictions into the template's target column by key (not by
    position, Q8), truncated to int; rows without a prediction stay NULL.
    ``order`` names a template ordinal column kept for an ordered write (SO3)."""
    t = template.drop(target) if target in template.columns else template
    j = t.join(pred.select(*on, y_pred), list(on), "left")
    cols = [c for c in t.columns if c != order] + ([order] if order else [])
    return j.select(*cols, to_int(y_pred).alias(target))


def average_runs(runs: DataFrame, on: Sequence[str], target: str = "total_cases", run: str = "run_id") -> DataFrame:
    """AG7: mean of the target over runs, truncated to int."""
    return runs.groupBy(*on).agg(to_int(F.avg(target)).alias(target), F.countDistinct(run).alias("runs"))


def compare(a: DataFrame, b: DataFrame, on: Sequence[str], col: str, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Two forecasts side by side with their difference ``b - a``."""
    x, y = names
    j = a.select(*on, F.col(col).alias(x)).join(b.select(*on, F.col(col).alias(y)), list(on), "full")
    return j.withColumn("delta", F.col(y) - F.col(x))


def blend(a: DataFrame, b: DataFrame, on: Sequence[str], col: str, weights: DataFrame | None = None, weight_key: Sequence[str] = (), weight: float = 0.5) -> DataFrame:
    """``w*a + (1-w)*b`` per row, ``w`` from a small per-series weight table
    (joined on ``weight_key``; 1 or 0 chooses one source) or a constant; int result."""
    j = a.select(*on, F.col(col).alias("_a")).join(b.select(*on, F.col(col).alias("_b")), list(on), "inner")
    if weights is not None:
        j = j.join(weights.select(*weight_key, F.col("weight").alias("_w")), list(weight_key), "left")
        w = F.coalesce(F.col("_w"), F.lit(weight))
    else:
        w = F.lit(weight)
    return j.select(*on, to_int(w * F.col("_a") + (1 - w) * F.col("_b")).alias(col))


def write_runs(df: DataFrame, path: str, run: str = "run_id", mode: str = "overwrite") -> None:
    """IO4: one CSV folder per run (``run_id=k``), header on."""
    df.write.mode(mode).partitionBy(run).option("header", True).csv(path)


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """IO3: all runs at once; ``run_id`` comes back from the folder names."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_single(df: DataFrame, path: str, order: Sequence[str], mode: str = "overwrite") -> None:
    """IO4 + SO3: one ordered CSV file (for small forecast outputs only)."""
    df.orderBy(*order).coalesce(1).write.mode(mode).option("header", True).csv(path)


def plot_table(train: DataFrame, test: DataFrame, pred: DataFrame, on: Sequence[str], y: str, y_pred: str = "y_pred") -> DataFrame:
    """Training values, true test values and predictions aligned by key/time,
    as one long table (on..., series, value) ready for a chart."""
    a = train.select(*on, F.lit("train").alias("series"), F.col(y).cast("double").alias("value"))
    b = test.select(*on, F.lit("true").alias("series"), F.col(y).cast("double").alias("value"))
    c = pred.select(*on, F.lit("predicted").alias("series"), F.col(y_pred).cast("double").alias("value"))
    return a.unionByName(b).unionByName(c)
