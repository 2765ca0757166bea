"""Exact, reproducible splits and systematic samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions.columns import base_name
from shoal.operators.ordering import below, hash_cutoffs, hash_key, row_index

TRAIN, TEST, DRIFT = "train", "test", "drift"
# Share of rows for training and test; the rest is for drift.
TRAIN_SHARE, TEST_SHARE = 0.70, 0.15


def split_sizes(n: int, at_least_one: bool = False) -> tuple[int, int]:
    """Rows for training and test; for images at least one each where there are enough."""
    train, test = int(n * TRAIN_SHARE), int(n * TEST_SHARE)
    if at_least_one:
        train = max(train, 1) if n else 0
        test = max(test, 1) if n > 2 else test
        train, test = min(train, n), min(test, n - min(train, n))
    return train, test


def should_split(df: DataFrame, rows: str = "row_count", features: str | Column = "feature_count") -> DataFrame:
    """A dataset is split when it has more than ten rows per feature and one more."""
    features = F.col(features) if isinstance(features, str) else features
    return df.withColumn("should_split", F.col(rows) > (features + 1) * 10)


def random_split_exact(
    df: DataFrame, key: Sequence[str], seed: int = 42, at_least_one: bool = False, keep: int = 4096
) -> DataFrame:
    """Adds ``split``: exactly 70 % train, 15 % test (rounded down) and the rest drift.

    Rows are ordered by a hash of their key. Only the two hash values at the borders are looked up, so
    the assignment is a comparison and no row moves. Keys need not be unique: rows that share a border's
    hash are divided by their position among themselves, equal rows by their number.
    """
    n = df.count()
    train, test = split_sizes(n, at_least_one)
    hashed = hash_key(seed, *key)
    cuts = hash_cutoffs(df, hashed, {None: [train, train + test]}, keep=keep, ties=True)[None]
    first, second = [None if c is None else c[0] for c in cuts]
    name = F.when(below(hashed, first), TRAIN).when(below(hashed, second), TEST).otherwise(DRIFT)
    tied = {c[0] for c in cuts if c is not None and c[1]}
    if not tied:
        return df.withColumn("split", name)
    out = df.where(~hashed.isin(*tied)).withColumn("split", name)
    for value in sorted(tied):
        border = df.where(hashed == value).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
        placed = row_index(border, df.columns, "__i")
        before = F.sum("__n").over(Window.orderBy("__i").rowsBetween(Window.unboundedPreceding, -1))
        place = F.coalesce(before, F.lit(0))  # one row for each distinct row that has this very hash
        rows = placed.withColumn("__first", place).withColumn(
            "__at", F.explode(F.sequence("__first", F.col("__first") + F.col("__n") - 1)))
        below_first, below_second = [
            F.lit(True) if c is None or c[0] > value else F.lit(False) if c[0] < value else F.col("__at") < c[1] for c in cuts]
        name = F.when(below_first, TRAIN).when(below_second, TEST).otherwise(DRIFT)
        out = out.unionByName(rows.withColumn("split", name).select(*df.columns, "split"))
    return out


def prefix_split(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Adds ``split`` by position: the first 70 %, the next 15 %, the rest."""
    indexed = row_index(df, order_by, "__i")
    train, test = split_sizes(indexed.count())
    name = F.when(F.col("__i") < train, TRAIN).when(F.col("__i") < train + test, TEST).otherwise(DRIFT)
    return indexed.withColumn("split", name).drop("__i")


def split_files(files: DataFrame, seed: int = 42, preserve_structure: bool = True) -> DataFrame:
    """Exact split of a file list; the new path starts with the split name."""
    out = random_split_exact(files, ["relative_path"], seed)
    inner = F.col("relative_path") if preserve_structure else base_name(F.col("relative_path"))
    return out.withColumn("path_in_split", F.concat_ws("/", "split", inner))


def detect_presplit(files: DataFrame, key: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Files per split folder for each dataset, and whether all three folders are there."""
    counts = [
        F.count_if(F.col("relative_path").startswith(s + "/")).alias(s) for s in (TRAIN, TEST, DRIFT)
    ]
    out = files.groupBy(*key).agg(*counts)
    return out.withColumn("presplit", (F.col(TRAIN) > 0) & (F.col(TEST) > 0) & (F.col(DRIFT) > 0))


def systematic_sample(
    df: DataFrame, target: int, order_by: Sequence[str], where: Column | None = None
) -> DataFrame:
    """Every n-th row by position, at most ``target``; n comes from the row count before ``where``.

    Positions are those after ``where``.
    """
    step = max(1, df.count() // target)
    kept = df if where is None else df.where(where)
    indexed = row_index(kept, order_by, "__i")
    chosen = (F.col("__i") % step == 0) & (F.col("__i") < step * target)
    return indexed.where(chosen).drop("__i")
