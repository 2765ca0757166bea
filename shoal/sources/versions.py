"""Dataset versions as partitioned Parquet under user/dataset/version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def version_path(root: str, user: str, dataset: str, version: str) -> str:
    return f"{root.rstrip('/')}/{user}/{dataset}/{version}"


def write_version(df: DataFrame, root: str, user: str, dataset: str, version: str) -> str:
    """Write one version; an existing one is never overwritten. A ``split`` column becomes the folder level."""
    path = version_path(root, user, dataset, version)
    writer = df.write.mode("errorifexists")
    if "split" in df.columns:
        writer = writer.partitionBy("split")
    writer.parquet(path)
    return path


def read_split(
    spark: SparkSession, root: str, user: str, dataset: str, version: str, split: str | None = None
) -> DataFrame:
    """A version, or one split of it (partition pruning); ``split`` is ignored when the version has none."""
    df = spark.read.parquet(version_path(root, user, dataset, version))
    if split is not None and "split" in df.columns:
        return df.where(F.col("split") == split)
    return df
