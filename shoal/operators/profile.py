"""Dataset profile: one row per column (or pair of columns), a fixed number of passes over the data."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoal.functions.columns import col, json_clean, nan_to_null, numeric_columns, string_columns
from shoal.operators.ordering import exact_quantiles

# Aggregates per job: wider ones leave whole-stage code generation.
AGGREGATES_PER_JOB = 100

#: Moments by name and the three quartiles, per column.
NumericStats = tuple[dict[str, dict[str, float | None]], dict[str, list[float | None]]]


def schema_profile(df: DataFrame) -> DataFrame:
    """Name, type and position of each column with the row count."""
    spark = df.sparkSession
    fields = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    columns = spark.createDataFrame(fields, "position int, column_name string, data_type string")
    return columns.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("row_count"))))


def profile_shape(df: DataFrame) -> DataFrame:
    """Row and column counts, column names and types in one row."""
    names = F.array(*[F.lit(f.name) for f in df.schema.fields])
    kinds = F.array(*[F.lit(f.dataType.simpleString()) for f in df.schema.fields])
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        names.alias("columns"),
        kinds.alias("dtypes"),
    )


def _chunks(items: Sequence, size: int):
    for i in range(0, len(items), size):
        yield items[i : i + size]


def aggregate_once(df: DataFrame, measures: dict[str, Column]) -> dict[str, object]:
    """Many aggregates over the whole table in as few passes as code generation allows."""
    result: dict[str, object] = {}
    for names in _chunks(list(measures), AGGREGATES_PER_JOB):
        row = df.agg(*[measures[n].alias(n) for n in names]).first()
        result.update(row.asDict())
    return result


def column_moments(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, float | None]]:
    """n, nulls, mean, sample and population deviation, min, max and corrected shape of each column.

    A pass for the means and one for the sums of powers of the distances from them: plain sums stay in generated code.
    """
    measures: dict[str, Column] = {"rows": F.count(F.lit(1))}
    for i, c in enumerate(columns):
        v = col(c).cast("double")
        measures |= {f"n_{i}": F.count(v), f"mean_{i}": F.avg(v), f"min_{i}": F.min(v), f"max_{i}": F.max(v)}
    got = aggregate_once(df, measures)
    powers: dict[str, Column] = {}
    for i, c in enumerate(columns):
        if got[f"n_{i}"] and got[f"min_{i}"] != got[f"max_{i}"]:
            d = col(c).cast("double") - F.lit(got[f"mean_{i}"])
            powers |= {f"s1_{i}": F.sum(d), f"s2_{i}": F.sum(d * d), f"s3_{i}": F.sum(d * d * d), f"s4_{i}": F.sum(d * d * (d * d))}
    sums = aggregate_once(df, powers) if powers else {}
    out = {}
    for i, c in enumerate(columns):
        n, m2, g1, g2 = got[f"n_{i}"], 0.0, None, None  # equal values have no shape
        if f"s1_{i}" in sums:
            s1, s2, s3, s4 = (sums[f"s{j}_{i}"] for j in range(1, 5))
            off = s1 / n  # what rounding left between the mean and the centre
            m2 = s2 - off * s1
            m3 = s3 - 3.0 * off * s2 + 2.0 * n * off * off * off
            m4 = s4 - 4.0 * off * s3 + 6.0 * off * off * s2 - 3.0 * n * off * off * off * off
            if m2 != 0:
                g1 = math.sqrt(n) * m3 / m2 / math.sqrt(m2)
                g2 = n * m4 / m2 / m2 - 3.0
        elif n and not math.isfinite(got[f"mean_{i}"]):
            m2 = g1 = g2 = math.nan
        skew = g1 * (n * (n - 1)) ** 0.5 / (n - 2) if n > 2 and g1 is not None else None
        kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) if n > 3 and g2 is not None else None
        out[c] = {
            "rows": got["rows"], "count": n, "mean": got[f"mean_{i}"], "std": math.sqrt(m2 / (n - 1)) if n > 1 else None,
            "std_pop": math.sqrt(m2 / n) if n else None, "min": got[f"min_{i}"], "max": got[f"max_{i}"],
            "skew": skew, "kurtosis": kurt, "skew_pop": g1,
        }
    return out


def _per_column(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """One row per column from aggregates already on the driver: bounded by the width of the table."""
    return df.sparkSession.createDataFrame(rows, schema)


def _quartiles(df: DataFrame, columns: Sequence[str], approx: bool) -> dict[str, list[float | None]]:
    points = [0.25, 0.5, 0.75]
    if not approx:
        return exact_quantiles(df, columns, points)
    got = aggregate_once(
        df, {f"q{i}": F.percentile_approx(col(c).cast("double"), points, 10_000) for i, c in enumerate(columns)}
    )
    return {c: got[f"q{i}"] or [None] * 3 for i, c in enumerate(columns)}


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> NumericStats:
    """Moments and quartiles per numeric column, to be shared by the reports made of them."""
    df = nan_to_null(df)
    columns = list(columns or numeric_columns(df))
    df = df.select(*[col(c) for c in columns])
    return column_moments(df, columns), _quartiles(df, columns, approx)


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False,
                     stats: NumericStats | None = None) -> DataFrame:
    """count, mean, std, min, quartiles (linear interpolation) and max per numeric column."""
    stats, quartiles = stats or numeric_stats(df, columns, approx)
    rows = [
        (c, s["count"], s["mean"], s["std"], s["min"], *quartiles[c], s["max"]) for c, s in stats.items()
    ]
    return _per_column(
        df, rows, "column_name string, count long, mean double, std double, min double, "
        "p25 double, p50 double, p75 double, max double",
    )


def missing_values(df: DataFrame) -> DataFrame:
    """Null count and fraction (0 to 1) of each column that has nulls."""
    df = nan_to_null(df)
    counts = [F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *counts)
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing_count"),
                 (F.col(f"m{i}") / F.col("rows")).alias("missing_fraction"))
        for i, c in enumerate(df.columns)
    ]))
    return one.select(cells.alias("x")).select("x.*").where("missing_count > 0")


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, value, n) with values as text: the one shuffle behind distinct counts and modes.

    Equal values are merged before the shuffle, so a dominant value costs one row per task.
    """
    columns = list(columns or df.columns)
    def text(c: str) -> Column:
        value = col(c)
        if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
            value = F.when(value == 0, F.lit(0.0).cast(df.schema[c].dataType)).otherwise(value)  # -0.0 is 0.0
        return value.cast("string")

    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), text(c).alias("value")) for c in columns]))
    return df.select(cells.alias("x")).groupBy("x.column_name", "x.value").agg(F.count(F.lit(1)).alias("n"))


def digested(c: str, kind: T.DataType) -> Column:
    """The column as a grouping key: long texts as their SHA-256, so that they are not shuffled whole."""
    if not isinstance(kind, T.StringType):
        return col(c)
    return F.when(F.length(col(c)) > 64, F.concat(F.lit("sha256:"), F.sha2(col(c), 256))).otherwise(col(c))


def unique_values(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct non-null values per column."""
    df = nan_to_null(df)
    columns = list(columns or df.columns)
    if approx:
        one = df.agg(*[F.approx_count_distinct(col(c)).alias(c) for c in columns])
        return one.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), col(c).alias("distinct_count")) for c in columns
        ])).alias("x")).select("x.*")
    kinds: dict[str, list[int]] = {}
    for i, c in enumerate(columns):
        kind = df.schema[c].dataType
        kinds.setdefault("double" if isinstance(kind, (T.FloatType, T.DoubleType)) else "long" if isinstance(
            kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else "string", []).append(i)
    out = None
    for kind, at in kinds.items():  # numbers are not made texts
        cells = F.explode(F.array(*[F.struct(
            F.lit(i).alias("c"), digested(columns[i], df.schema[columns[i]].dataType).cast(kind).alias("v")) for i in at]))
        one = df.select(cells.alias("x")).select("x.*").distinct().groupBy("c").agg(F.count("v").alias("distinct_count"))
        out = one if out is None else out.unionByName(one)
    return out.select(F.array(*map(F.lit, columns))[F.col("c")].alias("column_name"), "distinct_count")


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Each distinct row with its number of copies, where there is more than one."""
    return df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows beyond the first of each identical row; nulls are equal."""
    keys = df.select(*[digested(f.name, f.dataType).alias(f.name) for f in df.schema.fields])
    return duplicate_groups(keys).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"))


def duplicate_sample(df: DataFrame, size: int = 5) -> DataFrame:
    """The ``size`` smallest duplicated rows by content."""
    return duplicate_groups(df).orderBy(*[col(c) for c in df.columns]).limit(size)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 3) -> DataFrame:
    """Pearson correlation of each pair over the rows where both are present."""
    df = nan_to_null(df)
    columns = list(columns or numeric_columns(df))
    if not columns:
        return _per_column(df, [], "column_a string, column_b string, correlation double")
    numbers = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    centre = [m or 0.0 for m in numbers.agg(*[F.avg(c).alias(c) for c in numbers.columns]).first()]
    sums = numbers.mapInArrow(_pair_sums(centre), "a int, b int, n double, x double, y double, xx double, yy double, xy double")
    total = sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    n = F.col("n")
    spread = (F.col("xx") - F.col("x") * F.col("x") / n) * (F.col("yy") - F.col("y") * F.col("y") / n)
    r = F.when(spread > 0, (F.col("xy") - F.col("x") * F.col("y") / n) / F.sqrt(spread))
    names = F.array(*[F.lit(c) for c in columns])
    return total.select(names[F.col("a")].alias("column_a"), names[F.col("b")].alias("column_b"),
                        F.round(r, digits).alias("correlation"))


def _pair_sums(centre: Sequence[float]):
    """Sums over the rows where both of a pair are present, one row per pair and task; any number of columns is one pass."""
    k = len(centre)

    def run(batches):
        totals = np.zeros((6, k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - np.array(centre)
            there = ~np.isnan(x)
            if there.all():  # each sum over a pair is one over a column
                ones, sums, squares = np.ones((k, 1)), x.sum(axis=0), (x * x).sum(axis=0)
                totals += np.stack([len(x) * (ones @ ones.T), sums[:, None] @ ones.T, ones @ sums[None], squares[:, None] @ ones.T,
                                    ones @ squares[None], x.T @ x])
                continue
            x, m = np.where(there, x, 0.0), there.astype(float)
            totals += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        a, b = np.divmod(np.arange(k * k), k)
        flat = [t.ravel() for t in totals]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), *map(pa.array, flat)],
                                         ["a", "b", "n", "x", "y", "xx", "yy", "xy"])

    return run


def distribution_stats(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False,
                       stats: NumericStats | None = None) -> DataFrame:
    """mean, median, std, min, max and bias-corrected skew and excess kurtosis of non-empty columns."""
    stats, quartiles = stats or numeric_stats(df, columns, approx)
    rows = [
        (c, s["mean"], quartiles[c][1], s["std"], s["min"], s["max"], s["skew"], s["kurtosis"])
        for c, s in stats.items() if s["count"]
    ]
    return _per_column(
        df, rows, "column_name string, mean double, median double, std double, min double, max double, "
        "skew double, kurtosis double",
    )


def outliers_iqr(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False,
                 stats: NumericStats | None = None) -> DataFrame:
    """Rows outside 1.5 interquartile ranges; the percentage (0 to 100) is of all rows."""
    df = nan_to_null(df)
    columns = list(columns or numeric_columns(df))
    df = df.select(*[col(c) for c in columns])
    quartiles = stats[1] if stats else _quartiles(df, columns, approx)
    measures: dict[str, Column] = {"rows": F.count(F.lit(1))}
    for i, c in enumerate(columns):
        q1, _, q3 = quartiles[c]
        if q1 is None:
            measures[f"o{i}"] = F.lit(0).cast("long") + F.count_if(F.lit(False))
            continue
        margin = 1.5 * (q3 - q1)
        measures[f"o{i}"] = F.count_if((col(c) < q1 - margin) | (col(c) > q3 + margin))
    got = aggregate_once(df, measures)
    n = got["rows"]
    rows = [(c, got[f"o{i}"], 100.0 * got[f"o{i}"] / n if n else None) for i, c in enumerate(columns)]
    return _per_column(df, rows, "column_name string, outlier_count long, outlier_percent double")


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values (null included) per text column; ties by value, null last.

    The rank limit is applied in each task before the rows of a column meet.
    """
    columns = list(columns or string_columns(df))
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    ranked = value_counts(df, columns).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("column_name", "value", "n", "rank")


def needs_mitigation(df: DataFrame, tags: Sequence[str] = (), is_mitigated: bool = False) -> DataFrame:
    """Whether nulls, duplicates or skew call for cleaning, and no cleaning was done before."""
    df = nan_to_null(df)
    done = is_mitigated or any(t.lower() == "mitigated" for t in tags)
    columns = numeric_columns(df)
    any_null = F.lit(False)
    for c in df.columns:
        any_null = any_null | col(c).isNull()
    nulls = df.agg(F.coalesce(F.max(any_null), F.lit(False)).alias("has_missing"))
    copies = duplicate_rows(df).select((F.col("duplicate_rows") > 0).alias("has_duplicates"))
    stats = column_moments(df.select(*[col(c) for c in columns]), columns) if columns else {}
    skewed = any(abs(s["skew"] or 0.0) > 0.75 for s in stats.values())
    both = nulls.join(F.broadcast(copies)).withColumn("has_skew", F.lit(skewed))
    issue = F.col("has_missing") | F.col("has_duplicates") | F.col("has_skew")
    return both.withColumn("needs_mitigation", issue & F.lit(not done))


def profile_report(df: DataFrame, target: str | None = None) -> DataFrame:
    """The nested report as one JSON text, assembled from the long tables above; moments and quartiles are taken once."""
    spark = df.sparkSession

    def packed(table: DataFrame, name: str) -> DataFrame:
        fields = F.struct(*[col(c) for c in table.columns])
        return table.agg(F.sort_array(F.collect_list(fields)).alias(name))

    stats = numeric_stats(df)
    parts = profile_shape(df).withColumn("target_column", F.lit(target).cast("string"))
    for name, table in (
        ("summary_statistics", describe_numeric(df, stats=stats)),
        ("missing_values", missing_values(df)),
        ("unique_values", unique_values(df)),
        ("correlation_matrix", correlation_matrix(df)),
        ("distribution_statistics", distribution_stats(df, stats=stats)),
        ("outlier_detection", outliers_iqr(df, stats=stats)),
        ("categorical_value_counts", top_values(df) if string_columns(df) else
         spark.createDataFrame([], "column_name string, value string, n long, rank int")),
    ):
        parts = parts.join(F.broadcast(packed(table, name)))
    parts = parts.join(F.broadcast(duplicate_rows(df).withColumnRenamed("duplicate_rows", "duplicate_rows_count")))
    clean = json_clean(parts)
    return clean.select(F.to_json(F.struct(*[col(c) for c in clean.columns])).alias("report"))
