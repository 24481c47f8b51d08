"""Session helpers: runtime settings the operators rely on, and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings applied to every session the library touches.  All of them are
# runtime SQL confs, so they can be set on a session someone else created.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Joins of per-series statistics back onto a panel: AQE measures the real
    # size of the statistics side at runtime and broadcasts it only below this.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    # Wide feature sets (many lagged columns behind not-null filters) make
    # constraint propagation grow combinatorially in the optimizer.
    "spark.sql.constraintPropagation.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`RUNTIME_CONF` to an existing session (idempotent) and make the
    package importable by the Python workers."""
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per SparkContext (``addPyFile``).

    The pandas steps run in Python workers, which import the package by name;
    this makes that work wherever the driver was started from.
    """
    import zipfile

    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(root)
    out = os.path.join(tempfile.mkdtemp(prefix="panelcast-pkg-"), "panelcast.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder (``spark.checkpoint.dir``).

    On a cluster the setting names a shared folder and is used as is.  Only when
    it is unset (local tests) a private scratch folder is created.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if d:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(d)
        return d
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    d = tempfile.mkdtemp(prefix="panelcast-ckpt-")
    sc.setCheckpointDir(d)
    spark.conf.set("spark.checkpoint.dir", d)
    return d


DRIVER_MEMORY = "16g"  # local mode: the driver is the executor


def get_spark(master: str | None = None, app: str = "panelcast", shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session for scripts and tests.  No UI server is started."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.driver.memory", os.environ.get("PANELCAST_DRIVER_MEMORY", DRIVER_MEMORY))
    )
    for k, v in RUNTIME_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
