"""Cleaning and re-encoding: rules are fitted on the training split and applied to any split.

Order: fill, drop duplicates, encode, infer the task, correct skew, oversample (train only), scale columns
that are far from normal. Fitted state is bounded by columns and categories; log rows go with each step.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoal.functions.columns import NUMERIC, categorical_columns, col, lookup, nan_to_null, numeric_columns
from shoal.operators.neighbors import exact_neighbors
from shoal.operators.ordering import exact_quantiles, row_index, uniform
from shoal.operators.profile import aggregate_once, column_moments, digested, duplicate_rows, value_counts
from shoal.session import materialize

# Spellings of true and false, and the limits of the rules.
TRUE_TOKENS = ("true", "1", "yes", "t", "y")
FALSE_TOKENS = ("false", "0", "no", "f", "n")
BOOLEAN_SHARE, BOOLEAN_VALUES = 0.95, 3
TEXT_LENGTH, TEXT_VALUES = 20, 50
ONE_HOT_VALUES = 10
SKEW_LIMIT = 0.75
SMOTE_CLASSES, SMOTE_RATIO, SMOTE_NEIGHBORS = 8, 0.5, 5
KS_P_VALUE = 0.01
#: Different values that a task puts in order, on average.
KS_ROWS = 1_000_000

LogRow = tuple[str, str, str, str, str]
LOG_SCHEMA = "column string, transformation string, method string, original_value string, modified_value string"


@dataclass
class MitigationState:
    """What the training split taught."""

    target: str | None = None
    fill: dict[str, object] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)
    boolean_fill: dict[str, bool] = field(default_factory=dict)
    skew: dict[str, tuple] = field(default_factory=dict)  # column -> (method, lambda, mean, std)
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)
    log: list[LogRow] = field(default_factory=list)


# -- missing values ------------------------------------------------------------------------------


def _modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per column as text; the smallest on a tie."""
    if not columns:
        return {}
    counts = value_counts(df, columns).where("value is not null")
    rows = counts.groupBy("column_name").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("v"))
    return {r["column_name"]: r["v"] for r in rows.collect()}


def _null_counts(df: DataFrame) -> dict[str, int]:
    got = aggregate_once(df, {f"n{i}": F.count_if(col(c).isNull()) for i, c in enumerate(df.columns)})
    return {c: got[f"n{i}"] for i, c in enumerate(df.columns)}


def _fill_values(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    numbers = [c for c in columns if isinstance(df.schema[c].dataType, NUMERIC)]
    medians = exact_quantiles(df, numbers, [0.5]) if numbers else {}
    modes = _modes(df, [c for c in columns if c not in numbers])
    found = {**{c: q[0] for c, q in medians.items()}, **modes}
    return {c: found.get(c) for c in columns if found.get(c) is not None}


def _fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    def filled(c: str) -> Column:
        kind = df.schema[c].dataType
        if isinstance(kind, NUMERIC):
            return F.coalesce(col(c).cast("double"), F.lit(float(values[c])))
        return F.coalesce(col(c), F.lit(values[c]).cast(kind))

    return df.select(*[filled(c).alias(c) if c in values else col(c) for c in df.columns])


def fit_fill(train: DataFrame, state: MitigationState) -> DataFrame:
    """Median of numbers, else the mode, for columns with nulls. Returns the filled split."""
    nulls = {c: n for c, n in _null_counts(train).items() if n}
    state.fill = _fill_values(train, list(nulls))
    for c, value in state.fill.items():
        method = "median" if isinstance(train.schema[c].dataType, NUMERIC) else "mode"
        state.log.append((c, "missing_value_fill", method, f"{nulls[c]} missing", str(value)))
    return _fill(train, state.fill)


def apply_fill(df: DataFrame, state: MitigationState) -> DataFrame:
    """The training split's value, or the split's own where training had no nulls."""
    own = [c for c, n in _null_counts(df).items() if n and c not in state.fill]
    values = {c: v for c, v in state.fill.items() if c in df.columns}
    return _fill(df, {**values, **_fill_values(df, own)})


def drop_duplicates(df: DataFrame, had_duplicates: bool = True) -> DataFrame:
    return df.dropDuplicates() if had_duplicates else df


# -- categories ----------------------------------------------------------------------------------


def boolean_token(value: Column) -> Column:
    token = F.lower(F.trim(value.cast("string")))
    return F.when(token.isin(*TRUE_TOKENS), True).when(token.isin(*FALSE_TOKENS), False)


def text_column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column over all rows: distinct values, average length, share and majority of boolean tokens.

    Equal values are merged before the shuffle, and long texts travel as digests.
    """
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), digested(c, df.schema[c].dataType).cast("string").alias("value"),
                 F.length(col(c).cast("string")).alias("size")) for c in columns]))
    counts = df.select(cells.alias("x")).groupBy("x.column_name", "x.value", "x.size").agg(F.count(F.lit(1)).alias("n"))
    value, n = F.col("value"), F.col("n")
    token = boolean_token(value)
    filled = F.sum(F.when(value.isNotNull(), n).otherwise(0))
    stats = counts.groupBy("column_name").agg(
        filled.alias("filled"), F.count("value").alias("distinct_values"),
        (F.sum(F.col("size") * n) / filled).alias("average_length"),
        F.sum(F.when(token.isNotNull(), n).otherwise(0)).alias("token_rows"),
        F.sum(F.when(token, n).otherwise(0)).alias("true_rows"),
        F.sum(F.when(token.isNull(), n).otherwise(0)).alias("invalid_rows"),
    )
    text = (F.col("average_length") >= TEXT_LENGTH) | (F.col("distinct_values") >= TEXT_VALUES)
    boolean = (F.col("token_rows") / F.col("filled") >= BOOLEAN_SHARE) & (F.col("distinct_values") <= BOOLEAN_VALUES)
    kind = (
        F.when(F.col("filled") == 0, "one-hot").when(text, "text").when(boolean, "boolean")
        .when(F.col("distinct_values") <= ONE_HOT_VALUES, "one-hot").otherwise("label")
    )
    # equal counts: the smaller value, false, is the mode
    return stats.withColumns({"kind": kind, "mode": F.col("true_rows") * 2 > F.col("token_rows")})


def detect_text_like(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns to keep as raw text: long or varied values."""
    return text_column_stats(df, columns).select(
        "column_name", "distinct_values", "average_length", (F.col("kind") == "text").alias("text_like"))


def detect_boolean_like(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns that spell true and false: at least 95 % known tokens and at most three values."""
    boolean = (F.col("token_rows") / F.col("filled") >= BOOLEAN_SHARE) & (F.col("distinct_values") <= BOOLEAN_VALUES)
    return text_column_stats(df, columns).select(
        "column_name", "token_rows", "invalid_rows", F.coalesce(boolean, F.lit(False)).alias("boolean_like"))


def coerce_boolean(value: Column, fill: bool) -> Column:
    return F.coalesce(boolean_token(value), F.lit(fill))


def fit_encode(train: DataFrame, state: MitigationState) -> DataFrame:
    """Decide per text or boolean column (not the target) how it is encoded; returns the encoded split."""
    columns = [c for c in categorical_columns(train) if c != state.target]
    stats = {r["column_name"]: r for r in text_column_stats(train, columns).collect()} if columns else {}
    for c in columns:
        r = stats.get(c)
        is_boolean = isinstance(train.schema[c].dataType, T.BooleanType)
        state.kinds[c] = "boolean" if is_boolean else (r["kind"] if r else "one-hot")
        if state.kinds[c] == "boolean":
            state.boolean_fill[c] = bool(r and r["mode"])
    listed = [c for c in columns if state.kinds[c] in ("one-hot", "label")]
    if listed:  # fewer than TEXT_VALUES values each
        rows = value_counts(train, listed).where("value is not null").select("column_name", "value").collect()
        for c in listed:
            state.categories[c] = sorted(r["value"] for r in rows if r["column_name"] == c)
    for c in columns:
        n = stats[c]["distinct_values"] if c in stats else 0
        kind = state.kinds[c]
        if kind == "text":
            state.log.append((c, "encoding_skipped", "keep_text", str(n), "stays text"))
        elif kind == "boolean":
            if stats[c]["invalid_rows"]:
                state.log.append((c, "invalid_boolean_cleaned", "coerce_to_bool",
                                  f"{stats[c]['invalid_rows']} invalid value(s)", "the most frequent value in their place"))
            state.log.append((c, "encoding_skipped", "keep_boolean", "boolean-like", "stays true or false"))
        elif kind == "one-hot":
            state.log.append((c, "encoding", "one-hot", str(n), f"a column for each of {len(state.categories[c])} values"))
        else:
            state.log.append((c, "encoding", "label_encoding", str(n), f"numbered 0 to {n - 1}"))
    return apply_encode(train, state)


def one_hot(column: str, categories: Sequence[str]) -> list[Column]:
    """One boolean column per category; a value not seen in training is false everywhere."""
    text = col(column).cast("string")
    return [F.coalesce(text == F.lit(v), F.lit(False)).alias(f"{column}_{v}") for v in categories]


def label_encode(column: str, classes: Sequence[str]) -> Column:
    """Position in the sorted training classes, -1 for an unseen value."""
    table = {v: str(i) for i, v in enumerate(classes)}
    return F.coalesce(lookup(col(column).cast("string"), table).cast("int"), F.lit(-1)) if table else F.lit(-1)


def apply_encode(df: DataFrame, state: MitigationState) -> DataFrame:
    kept, added = [], []
    for c in df.columns:
        kind = state.kinds.get(c)
        if kind == "boolean":
            kept.append(coerce_boolean(col(c), state.boolean_fill[c]).alias(c))
        elif kind == "label":
            kept.append(label_encode(c, state.categories[c]).alias(c))
        elif kind == "one-hot":
            added += one_hot(c, state.categories[c])
        else:
            kept.append(col(c))
    return df.select(*kept, *added)


def infer_task(df: DataFrame, target: str | None) -> DataFrame:
    """(target_type, task): whole numbers and texts are classes, fractional numbers a regression."""
    spark = df.sparkSession
    if target is None or target not in df.columns:
        return spark.createDataFrame([(None, "unknown")], "target_type string, task string")
    kind = df.schema[target].dataType
    value = col(target)
    fraction = F.count_if(value.cast("double") != F.floor(value.cast("double"))) \
        if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)) else F.lit(0).cast("long") + F.count_if(F.lit(False))
    one = df.agg(fraction.alias("fractions"), F.count_distinct(value).alias("n"))
    named = F.when(F.col("fractions") > 0, "continuous").when(F.col("n") <= 2, "binary").otherwise("multiclass") \
        if isinstance(kind, (*NUMERIC, T.StringType, T.BooleanType)) else F.lit("unknown")
    task = F.when(F.col("target_type").isin("binary", "multiclass"), "classification").when(
        F.col("target_type") == "continuous", "regression").otherwise("other")
    return one.select(named.alias("target_type")).withColumn("task", task)


# -- skew ----------------------------------------------------------------------------------------


def yeo_johnson(x: Column, power: float | Column) -> Column:
    """The Yeo-Johnson transform of a column with an exponent (a number or a column)."""
    lam = power if isinstance(power, Column) else F.lit(float(power))
    return _yeo_johnson(x >= 0, F.log1p(F.abs(x)), lam)


def _yeo_johnson(positive: Column, size: Column, lam: Column) -> Column:
    """The transform from the sign and ``size`` = log(1 + |x|): one exponential per exponent."""
    rate = F.when(positive, lam).otherwise(2.0 - lam)
    grown = F.when(F.abs(rate) < 1e-12, size).otherwise(F.expm1(rate * size) / rate)
    return F.when(positive, grown).otherwise(-grown)


def yeo_johnson_fit(df: DataFrame, columns: Sequence[str], passes: int = 4, points: int = 9) -> dict[str, float]:
    """Exponent of greatest likelihood per column.

    The likelihood needs only the variance of the transformed values and one sum. Each pass meets every value
    with a grid of exponents and aggregates per column and exponent in one partial aggregate; the grid closes
    in around the best exponent.
    """
    if not columns:
        return {}
    cells = F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), col(c).cast("double").alias("x")) for i, c in enumerate(columns)]))
    x = F.col("x")
    values = df.select(cells.alias("v")).select("v.*").where("x is not null").select(
        "c", (x >= 0).alias("positive"), F.log1p(F.abs(x)).alias("size"))
    grids = {i: [-4.0 + 8.0 * j / (points - 1) for j in range(points)] for i in range(len(columns))}
    best: dict[int, float] = {}
    for _ in range(passes):
        table = F.create_map(*[
            x for i, grid in grids.items()
            for x in (F.lit(i), F.array(*[F.struct(F.lit(j).alias("j"), F.lit(p).alias("p")) for j, p in enumerate(grid)]))])
        tried = values.withColumn("g", F.explode(F.element_at(table, F.col("c")))).select("*", "g.*")
        rows = tried.groupBy("c", "j").agg(
            F.count(F.lit(1)).alias("n"),
            F.var_pop(_yeo_johnson(F.col("positive"), F.col("size"), F.col("p"))).alias("v"),
            F.sum(F.when(F.col("positive"), F.col("size")).otherwise(-F.col("size"))).alias("s")).collect()
        fits = {i: [-math.inf] * points for i in grids}
        for r in rows:
            if r["v"] is not None and math.isfinite(r["v"]) and r["v"] > 0:
                p = grids[r["c"]][r["j"]]
                fits[r["c"]][r["j"]] = -0.5 * r["n"] * math.log(r["v"]) + (p - 1.0) * r["s"]
        for i, grid in grids.items():
            f = fits[i]
            top = max(range(points), key=lambda j: f[j])
            step = grid[1] - grid[0]
            best[i] = grid[top]
            if 0 < top < points - 1 and math.isfinite(f[top - 1]) and math.isfinite(f[top + 1]):
                bend = f[top - 1] - 2.0 * f[top] + f[top + 1]
                if bend < 0:
                    best[i] += 0.5 * step * (f[top - 1] - f[top + 1]) / bend
            grids[i] = [grid[top] - step + 2.0 * step * j / (points - 1) for j in range(points)]
    return {c: best[i] for i, c in enumerate(columns)}


def scale_params(df: DataFrame, values: Mapping[str, Column]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation (1 where it is 0) per expression."""
    names = list(values)
    got = aggregate_once(df, {
        key: e for i, c in enumerate(names) for key, e in (
            (f"m{i}", F.avg(values[c])), (f"d{i}", F.stddev_pop(values[c])))})
    return {c: (got[f"m{i}"] or 0.0, got[f"d{i}"] or 1.0) for i, c in enumerate(names)}


def standard_scale(df: DataFrame, params: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.select(*[
        ((col(c).cast("double") - params[c][0]) / params[c][1]).alias(c) if c in params else col(c) for c in df.columns
    ])


def fit_skew(train: DataFrame, state: MitigationState) -> DataFrame:
    """Columns with population skew beyond 0.75: Yeo-Johnson if all values are positive, then standardise."""
    columns = [c for c in numeric_columns(train) if c != state.target]
    stats = column_moments(train.select(*[col(c) for c in columns]), columns) if columns else {}
    skewed = [c for c in columns if abs(stats[c]["skew_pop"] or 0.0) > SKEW_LIMIT]
    positive = [c for c in skewed if stats[c]["min"] > 0 and stats[c]["count"] == stats[c]["rows"]]
    powers = yeo_johnson_fit(train, positive)
    values = {c: yeo_johnson(col(c).cast("double"), powers[c]) if c in powers else col(c).cast("double") for c in skewed}
    params = scale_params(train, values) if values else {}
    for c in skewed:
        method = "yeo-johnson" if c in powers else "standard_scaler"
        state.skew[c] = (method, powers.get(c), *params[c])
    out = apply_skew(train, state)
    after = aggregate_once(out, {f"s{i}": F.skewness(col(c)) for i, c in enumerate(skewed)}) if skewed else {}
    for i, c in enumerate(skewed):
        state.log.append((c, "skew_correction", state.skew[c][0], str(round(stats[c]["skew_pop"], 3)),
                          str(round(after[f"s{i}"] or 0.0, 3))))
    return out


def apply_skew(df: DataFrame, state: MitigationState) -> DataFrame:
    def corrected(c: str) -> Column:
        _, power, mean, std = state.skew[c]
        x = col(c).cast("double")
        return ((x if power is None else yeo_johnson(x, power)) - mean) / std

    return df.select(*[corrected(c).alias(c) if c in state.skew else col(c) for c in df.columns])


# -- oversampling --------------------------------------------------------------------------------


def smote_gate(df: DataFrame, target: str, task: str = "classification") -> DataFrame:
    """One row: whether to oversample, the number of neighbours, and the reason if not."""
    other = [f.name for f in df.schema.fields
             if f.name != target and not isinstance(f.dataType, (*NUMERIC, T.BooleanType))]
    counts = df.where(col(target).isNotNull()).groupBy(col(target)).count()
    one = counts.agg(F.count(F.lit(1)).alias("classes"), F.min("count").alias("smallest"), F.max("count").alias("largest"))
    ratio = F.col("smallest") / F.col("largest")
    shown = ", ".join(other[:5]) + ("..." if len(other) > 5 else "")
    reason = (
        F.when(F.lit(task != "classification"), "target not discrete classification labels")
        .when(F.lit(bool(other)), f"columns that are not numbers: {shown}")
        .when(F.col("classes") > SMOTE_CLASSES, F.concat(F.lit("too many classes: "), "classes"))
        .when(~((ratio < SMOTE_RATIO) & (F.col("smallest") >= 2)),
              F.concat(F.lit("imbalance_ratio="), F.round(ratio, 3), F.lit(", min_class="), "smallest"))
    )
    k = F.least(F.lit(SMOTE_NEIGHBORS), F.col("smallest") - 1).cast("int")
    return one.withColumns({"k_neighbors": k, "reason": reason, "oversample": reason.isNull()})


def smote(df: DataFrame, target: str, k: int = SMOTE_NEIGHBORS, seed: int = 42, **search: int) -> DataFrame:
    """Every class raised to the size of the largest with points between a row and a near row of its class.

    Neighbours are exact. Equal rows are merged before the search: copies are each other's nearest
    neighbours, so a point with more than ``k`` copies needs none. Base row, neighbour and position on the
    segment come from hashes, so the result does not depend on partitioning.
    """
    features = [c for c in df.columns if c != target]
    sizes = {r["g"]: r["count"] for r in df.groupBy(col(target).cast("string").alias("g")).count().collect()}
    most = max(sizes.values())
    missing = {g: most - n for g, n in sorted(sizes.items()) if n < most}
    if not missing:
        return df
    tag = col(target).cast("string").isin(*missing)
    numbers = [col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)]
    names = [f"f{i}" for i in range(len(features))]
    rows = df.where(tag).select(col(target).cast("string").alias("g"), *numbers)
    rows = row_index(rows, names, "position", ["g"])
    distinct = materialize(rows.groupBy("g", *names).agg(
        F.count(F.lit(1)).alias("copies"), F.min("position").alias("id")), "distinct")

    # one row per synthetic point: class, base position, neighbour number, place on the segment
    starts, total = [], 0
    for g, n in missing.items():
        starts.append((g, total, n))
        total += n
    draws = df.sparkSession.range(total).withColumnRenamed("id", "draw")
    g, first, size = F.lit(None).cast("string"), F.lit(0), F.lit(1)
    for name, start, n in starts:
        here = F.col("draw") >= start
        g, first, size = (F.when(here, a).otherwise(b) for a, b in ((name, g), (start, first), (sizes[name], size)))
    draws = draws.select(
        "draw", g.alias("g"), F.least(F.floor(uniform(seed, F.lit("b"), "draw") * size), size - 1).alias("position"),
        F.floor(uniform(seed, F.lit("n"), "draw") * k).cast("int").alias("turn"),
        uniform(seed, F.lit("u"), "draw").alias("u"))
    # equal rows are neighbours in position: the base is the distinct point that starts at or before it
    spans = distinct.select("g", "id", "copies", F.explode(F.sequence(F.col("id"), F.col("id") + F.least(
        F.col("copies"), F.lit(k + 1)) - 1)).alias("position"))
    few = draws.join(spans, ["g", "position"])
    rest = draws.join(spans.select("g", "position"), ["g", "position"], "left_anti")
    repeated = rest.join(rows.select("g", "position", *names), ["g", "position"]).select(
        "draw", "g", *names).withColumns({f"n_{c}": F.col(c) for c in names}).withColumn("u", F.lit(0.0))
    few = few.where(F.col("copies") <= k).unionByName(few.where(F.col("copies") > k).withColumn("turn", F.lit(0)))
    base = few.join(distinct.drop("copies"), ["g", "id"])
    itself = base.where(F.col("turn") < F.col("copies") - 1).select(
        "draw", "g", "u", *names, *[F.col(c).alias(f"n_{c}") for c in names])
    outside = base.where(F.col("turn") >= F.col("copies") - 1).withColumn("turn", F.col("turn") - (F.col("copies") - 1))
    near = exact_neighbors(distinct, "g", "id", names, k, outside.select("g", "id"), seed=seed, **search)
    far = distinct.select("g", F.col("id").alias("neighbor"), F.col("copies").alias("n_copies"),
                          *[F.col(c).alias(f"n_{c}") for c in names])
    near = near.join(far, ["g", "neighbor"])
    upto = Window.partitionBy("g", "id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("upto", F.sum("n_copies").over(upto)).drop("distance", "rank", "neighbor")
    picked = outside.join(near, ["g", "id"]).where(
        (F.col("turn") < F.col("upto")) & (F.col("turn") >= F.col("upto") - F.col("n_copies")))
    columns = ["draw", "g", "u", *names, *[f"n_{c}" for c in names]]
    made = picked.select(*columns).unionByName(itself.select(*columns)).unionByName(repeated.select(*columns))

    def value(i: int, c: str) -> Column:
        point = F.col(f"f{i}") + F.col("u") * (F.col(f"n_f{i}") - F.col(f"f{i}"))
        kind = df.schema[c].dataType
        return (point != 0.0 if isinstance(kind, T.BooleanType) else point.cast(kind)).alias(c)

    out = [F.col("g").cast(df.schema[target].dataType).alias(c) if c == target else value(features.index(c), c)
           for c in df.columns]
    return df.unionByName(made.select(*out))


# -- columns far from normal ---------------------------------------------------------------------


def kolmogorov_p(x: float) -> float:
    """Upper tail of the Kolmogorov distribution."""
    if x < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2.0 * sum((-1) ** (j - 1) * math.exp(-2.0 * j * j * x * x) for j in range(1, 101))))


def ks_normality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distance of each column from a normal law of its mean and deviation, with a p-value.

    The p-value uses half the rows as effective size: the power of a comparison with a normal sample of
    the same size, without drawing one. Equal values are counted before they are put in order: only the first and
    the last of them can be farthest from the law, and no task gets all rows of a frequent value.
    """
    schema = "column_name string, statistic double, p_value double, differs boolean"
    stats = column_moments(df.select(*[col(c) for c in columns]), columns) if columns else {}
    good = [c for c in columns if stats[c]["count"] and stats[c]["std"] and not math.isnan(stats[c]["std"])]
    gaps = {}
    if good:
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), col(c).cast("double").alias("v")) for i, c in enumerate(good)]))
        kinds = df.select(cells.alias("x")).select("x.*").where("v is not null").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
        kinds = materialize(kinds, "values")
        tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(kinds.count() / KS_ROWS))
        placed = row_index(kinds, ["v"], "i", ["c"], partitions=tasks, copies="n")
        law = np.array([[stats[c]["mean"], stats[c]["std"], stats[c]["count"]] for c in good])

        def gap(batches):
            most = np.zeros(len(law))
            for batch in batches:
                c, v, i, m = (batch[x].to_numpy() for x in ("c", "v", "i", "n"))
                z = (v - law[c, 0]) / law[c, 1] / math.sqrt(2.0)
                below = 0.5 * (1.0 + np.array([math.erf(x) for x in z.tolist()]))
                n = law[c, 2]
                np.maximum.at(most, c, np.maximum(np.abs((i + m) / n - below), np.abs(i / n - below)))
            yield pa.RecordBatch.from_pydict({"c": pa.array(range(len(most)), pa.int32()), "d": pa.array(most)})

        gaps = dict(placed.select("c", "v", "i", "n").mapInArrow(gap, "c int, d double").groupBy("c").agg(F.max("d")).collect())
    rows = []
    for c in columns:
        d = gaps.get(good.index(c)) if c in good else None
        p = None if d is None else kolmogorov_p(math.sqrt(stats[c]["count"] / 2.0) * d)
        rows.append((c, d, p, p is not None and p < KS_P_VALUE))
    return df.sparkSession.createDataFrame(rows, schema)


def fit_drift_scale(train: DataFrame, state: MitigationState, columns: Sequence[str]) -> DataFrame:
    """Standardise the columns that differ from a normal law."""
    columns = [c for c in columns if c in train.columns]
    flagged = [r["column_name"] for r in ks_normality(train, columns).collect() if r["differs"]] if columns else []
    state.scale = scale_params(train, {c: col(c).cast("double") for c in flagged}) if flagged else {}
    for c in flagged:
        state.log.append((c, "drift_mitigation", "standard_scaler", str(round(state.scale[c][0], 3)), "0.0"))
    return standard_scale(train, state.scale)


def align_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Training columns in training order and of their type; extra ones go, missing ones are 0 (false, or "0")."""
    return df.select(*[(col(f.name) if f.name in df.columns else F.lit(0)).cast(f.dataType).alias(f.name) for f in schema])


# -- the whole ------------------------------------------------------------------------------------


def fit(train: DataFrame, target: str | None = None, had_duplicates: bool | None = None, seed: int = 42,
        oversample: bool = True) -> tuple[DataFrame, MitigationState]:
    """All steps on the training split; the state serves the other splits."""
    state = MitigationState(target=target)
    df = fit_fill(nan_to_null(train), state)
    copies = duplicate_rows(df).first()["duplicate_rows"] if had_duplicates is None else int(had_duplicates)
    if copies:
        state.log.append(("all", "duplicate_removal", "drop_duplicates", f"{copies} duplicates", "one row of each kind stays"))
    df = materialize(drop_duplicates(df, bool(copies)), "train")
    df = fit_encode(df, state)
    kind = infer_task(df, target).first()
    if target is not None and isinstance(df.schema[target].dataType, T.StringType):
        state.log.append((target, "target_encoding_skipped", "keep_labels", "object/categorical labels", "kept as-is"))
    state.log.append((target or "unknown", "task_inference", "type_of_target", str(kind["target_type"]), kind["task"]))
    numbers = [c for c in numeric_columns(df) if c != target]
    df = fit_skew(df, state)
    if kind["task"] == "classification":
        gate = smote_gate(df, target, kind["task"]).first()
        if gate["oversample"] and oversample:
            before = df
            df = materialize(smote(before, target, gate["k_neighbors"], seed), "balanced")
            state.log.append((target, "oversampling", f"SMOTE(k_neighbors={gate['k_neighbors']})",
                              str(gate["smallest"]), str(gate["largest"])))
        elif gate["reason"]:
            state.log.append((target, "oversampling_skipped", "SMOTE", str(gate["classes"]), f"Skipped ({gate['reason']})"))
    return fit_drift_scale(df, state, numbers), state


def apply(df: DataFrame, state: MitigationState, had_duplicates: bool = True) -> DataFrame:
    """The fitted steps on another split (no oversampling)."""
    out = drop_duplicates(apply_fill(nan_to_null(df), state), had_duplicates)
    out = apply_skew(apply_encode(out, state), state)
    return standard_scale(out, {c: p for c, p in state.scale.items() if c in out.columns})


def log_table(df: DataFrame, state: MitigationState) -> DataFrame:
    return df.sparkSession.createDataFrame(state.log, LOG_SCHEMA)


def mitigate(
    train: DataFrame, test: DataFrame, drift: DataFrame, target: str | None = None, seed: int = 42
) -> tuple[DataFrame, DataFrame, MitigationState]:
    """All three splits cleaned with rules from ``train``: (rows with ``split``, log, state)."""
    whole = train.unionByName(test).unionByName(drift)
    copies = duplicate_rows(nan_to_null(whole)).first()["duplicate_rows"] > 0
    fitted, state = fit(train, target, copies, seed)
    parts = {"train": fitted}
    for name, df in (("test", test), ("drift", drift)):
        parts[name] = align_schema(apply(df, state, copies), fitted.schema)
    out = None
    for name, df in parts.items():
        df = df.withColumn("split", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out, log_table(train, state), state


MITIGATED_TAGS = ("mitigated", "bias-corrected")  # fixed values


def publish_mitigated(
    cat: DataFrame, root: str, user: str, dataset: str, target: str | None = None, seed: int = 42, now: Column | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Mitigate the newest version of a dataset and write the three splits as its next version.

    Returns the new catalog record, the transformation report and the report on the new rows, both keyed by user,
    dataset and version for ``catalog.upsert``; None if the newest version is mitigated already. ``cat`` has user_id,
    dataset_id, version, name, tags and created_at.
    """
    from shoal.operators.catalog import latest_version, next_versions
    from shoal.operators.profile import profile_report
    from shoal.sources.versions import read_split, write_version

    spark = cat.sparkSession
    mine = cat.where((F.col("user_id") == user) & (F.col("dataset_id") == dataset))
    newest = latest_version(mine, ["user_id", "dataset_id"]).first()
    if newest is None or set(MITIGATED_TAGS) & set(newest["tags"] or []):
        return None
    parts = [read_split(spark, root, user, dataset, newest["version"], s).drop("split") for s in ("train", "test", "drift")]
    rows, log, _ = mitigate(*parts, target=target, seed=seed)
    version = next_versions(mine, 1).first()["next_version"]
    write_version(rows, root, user, dataset, version)
    written = read_split(spark, root, user, dataset, version)
    when = now if now is not None else F.current_timestamp()
    key = [F.lit(user).alias("user_id"), F.lit(dataset).alias("dataset_id"), F.lit(version).alias("version")]
    tags = [*(newest["tags"] or []), *MITIGATED_TAGS]
    record = written.groupBy().agg(F.count(F.lit(1)).alias("row_count")).select(
        *key, F.lit(f"{newest['name']} (Mitigated)").alias("name"), F.array(*map(F.lit, tags)).alias("tags"), "row_count",
        when.alias("created_at"))
    changes = log.groupBy().agg(F.to_json(F.sort_array(F.collect_list(F.struct(*log.columns)))).alias("report"))
    report = profile_report(written.drop("split")).select(F.to_json(F.struct("*")).alias("report"))
    return record, changes.select(*key, "report", when.alias("updated_at")), report.select(*key, "report", when.alias("updated_at"))
