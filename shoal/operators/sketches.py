"""Sketches of a dataset version that are kept and merged: a new version reads only its new rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoal.functions.columns import NUMERIC, col, nan_to_null

# Columns per aggregate: each has two sketches as its state.
COLUMNS_PER_JOB = 25
# Size of the quantile sketch: ranks are off by about 1.3 % of the rows at 200, and by less in proportion to more.
RANK_K = 800
# Log2 of the registers of the distinct sketch: counts are off by about 1.6 % at 12.
DISTINCT_LOG_K = 14


def version_sketches(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Per column (and part, with ``by``): rows, missing values, a sketch of the distinct values, one of the ranks.

    NaN counts as missing. Only sketches are shuffled. Columns that aren't numbers have a null rank sketch.
    Without ``by`` an empty table gives one row per column with counts of 0.
    """
    df = nan_to_null(df)
    columns = list(columns or [c for c in df.columns if c not in by])
    tables = []
    for start in range(0, len(columns), COLUMNS_PER_JOB):
        part = columns[start : start + COLUMNS_PER_JOB]
        measures, cells = [F.count(F.lit(1)).alias("__rows")], []
        for i, c in enumerate(part):
            kind, ranks = df.schema[c].dataType, F.lit(None).cast("binary")
            value = F.when(col(c) == 0, F.lit(0).cast(kind)).otherwise(col(c)) \
                if isinstance(kind, (T.FloatType, T.DoubleType)) else col(c)  # -0.0 is 0.0
            measures += [F.count(col(c)).alias(f"__n{i}"),
                         F.hll_sketch_agg(value.cast("string"), DISTINCT_LOG_K).alias(f"__d{i}")]
            if isinstance(kind, NUMERIC):
                measures.append(F.kll_sketch_agg_double(value.cast("double"), RANK_K).alias(f"__q{i}"))
                ranks = F.col(f"__q{i}")
            cells.append(F.struct(
                F.lit(c).alias("column_name"), F.col("__rows").alias("row_count"),
                (F.col("__rows") - F.col(f"__n{i}")).alias("missing_count"),
                F.col(f"__d{i}").alias("distinct_sketch"), ranks.alias("rank_sketch")))
        one = df.groupBy(*[col(k) for k in by]).agg(*measures)
        tables.append(one.select(*[col(k) for k in by], F.explode(F.array(*cells)).alias("__x")).select(
            *[col(k) for k in by], "__x.*"))
    return reduce(DataFrame.unionByName, tables)


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """Sketches of the union of all parts and versions, one row per column."""
    return sketches.groupBy("column_name").agg(
        F.sum("row_count").alias("row_count"), F.sum("missing_count").alias("missing_count"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.when(F.count("rank_sketch") > 0, F.kll_merge_agg_double("rank_sketch")).alias("rank_sketch"))


def sketched_profile(sketches: DataFrame, probabilities: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Counts, about how many distinct values, and quantiles (values of the column) where there are numbers."""
    points = F.array(*[F.lit(float(p)) for p in probabilities])
    some = F.col("rank_sketch").isNotNull() & (F.col("row_count") > F.col("missing_count"))
    return sketches.select(
        "column_name", "row_count", "missing_count", F.hll_sketch_estimate("distinct_sketch").alias("distinct_count"),
        F.when(some, F.kll_sketch_get_quantile_double("rank_sketch", points)).alias("quantiles"))
