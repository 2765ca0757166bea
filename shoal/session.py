"""Session settings and the one place where intermediate tables are written."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "shoal", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; cluster settings win where they are given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).

    A temporary folder is made only for a local master, where driver and tasks share one disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="shoal-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per application; they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_shoal_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.TemporaryDirectory(prefix="shoal-")  # Spark serves the file from the driver while it runs
    path = os.path.join(folder.name, "shoal.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for base, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(base, name)
                    archive.write(file, os.path.join("shoal", os.path.relpath(file, top)))
    context.addPyFile(path)
    context._shoal_folder = folder
    context._shoal_shipped = True


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_folder(spark)}/shoal-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "rows") -> DataFrame:
    """Write ``df`` once and read it back: a fixed table that survives lost executors.

    Parquet rather than an RDD checkpoint, so that later steps still prune columns and push filters.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
