"""Spark session and shared-folder helpers.

Cluster settings (shuffle partitions, AQE, checkpoint folder) are read from the
session when they exist; only local runs and tests fill in defaults.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path
from threading import Lock

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "panelcast", shuffle_partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """Return a session tuned for panel work; existing cluster settings win.
    ``driver_memory`` only matters for local masters, where the driver JVM does all the work."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if driver_memory and master.startswith("local"):
            builder = builder.config("spark.driver.memory", driver_memory)
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # per-query lineage cuts are dropped from the shared folder once unreferenced
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: ``spark.checkpoint.dir`` if the cluster names one.

    Only a local master, where driver and executors are one process, may go without: it gets a scratch
    folder. A cluster without the setting is an error, because a machine's own folder loses data.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="panelcast-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: written once, compressed, with column pruning."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/panelcast-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()
_shipping = Lock()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; they need not share the driver's folders."""
    context = spark.sparkContext
    with _shipping:  # fits side by side send it once
        if context.applicationId in _shipped:
            return
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp()) / "panelcast_package.zip"  # on the driver, which serves the file to executors
        with zipfile.ZipFile(path, "w") as out:
            for part in sorted(root.rglob("*.py")):
                out.write(part, part.relative_to(root.parent))
        context.addPyFile(str(path))
        _shipped.add(context.applicationId)
