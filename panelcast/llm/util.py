"""Helpers shared by the operators: staging in the cluster's shared folder, joins on hot groups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.session import ensure_checkpoint_dir, ship_package

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEAVY_SHARE = 2000


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers and the checkpoint folder known."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new folder name in the folder all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/panelcast-llm/{what}-{uuid.uuid4().hex}"


def stage(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here and a
    lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Left join of rows with one row per group, when a few groups may hold most rows.

    Groups of more than ``total / HEAVY_SHARE`` rows are fewer than HEAVY_SHARE, so they are
    broadcast (a proven bound) and their rows never shuffle; the other rows join by a shuffle in
    which no key is hot.  ``groups`` has ``keys``, ``size`` (rows in the group) and more columns.
    """
    bar = max(1, total // HEAVY_SHARE)
    extra = [c for c in groups.columns if c not in keys]
    heavy = F.broadcast(groups.where(F.col(size) > bar).select(*keys, F.struct(*extra).alias("__heavy")))
    light = groups.where(F.col(size) <= bar).select(*keys, F.struct(*extra).alias("__light"))
    first = rows.join(heavy, keys, "left")
    hit = first.where(F.col("__heavy").isNotNull()).withColumn("__light", F.lit(None).cast(light.schema["__light"].dataType))
    rest = first.where(F.col("__heavy").isNull()).join(light, keys, "left")
    both = hit.select(*rest.columns).unionAll(rest)
    got = F.coalesce("__heavy", "__light")
    return both.select(*rows.columns, *[got[c].alias(c) for c in extra])


def give_back() -> None:
    """Hand a Python worker's freed memory back to the machine: workers live on after a task, beside those of the next stage."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run):
    """A ``mapInArrow`` step whose worker gives its memory back at the end."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def lower_ascii(col):
    """A-Z to a-z, nothing else; null as empty."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER)
