"""Session and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", name: str = "pagelode") -> SparkSession:
    """A session for tests and the benchmark; on a cluster, pass your own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset, a session
    on one machine gets a temporary folder; any other is an error, as executors
    would write to disks that the others cannot see.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from the copy."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and continue from the files.

    A lost executor then costs a re-read, not the work before. The files go when
    the driver's JVM ends.
    """
    spark = df.sparkSession
    folder = staging_path(spark, name)
    df.write.parquet(folder)
    return spark.read.parquet(folder)


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(path.getParent())
    files.deleteOnExit(path)
    return folder


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions in Arrow and pandas operators are pickled by reference, so workers
    must be able to import them wherever the driver was started.
    """
    context = spark.sparkContext
    if getattr(context, "_pagelode_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "pagelode.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as packed:
        for path in sorted(root.rglob("*.py")):
            packed.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(target)
    context._pagelode_shipped = True
