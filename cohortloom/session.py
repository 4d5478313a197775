"""Session helpers: the shared scratch folder and written stage results."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` where the cluster sets it.

    Only a local session (tests) gets a temporary folder where neither that setting nor a checkpoint
    folder exists; on a cluster that is an error, as each executor would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not runs_locally(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cohortloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def runs_locally(spark: SparkSession) -> bool:
    """Whether the executors are threads of the driver."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a stage result as parquet to the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, and unlike a row-wise checkpoint
    later passes still read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, wherever they start, once per context."""
    context = spark.sparkContext
    if getattr(context, "_cohortloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):  # else it was imported from an archive that is shipped already
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="cohortloom-"), "cohortloom"), "zip",
                                      os.path.dirname(root), os.path.basename(root))
        context.addPyFile(archive)
    context._cohortloom_shipped = True


def configure(spark: SparkSession) -> SparkSession:
    """Ship the package to the workers, bound the batches they get and turn on run-time plan changes that hot keys need: joins may split a hot partition even
    where a later stage has to shuffle again for it."""
    # Rows may be whole texts: batches for Python workers stay small on both sides.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    for name in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled",
                 "spark.sql.adaptive.forceOptimizeSkewedJoin"):
        spark.conf.set(name, "true")
    ship_package(spark)
    return spark
