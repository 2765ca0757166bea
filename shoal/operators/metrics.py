"""Error signals, scores and task types of prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoal.functions.columns import NUMERIC, col
from shoal.operators.ordering import block_totals, row_index
from shoal.session import materialize

# Beyond this rank Spark's window group limit no longer applies (spark.sql.optimizer.windowGroupLimitThreshold).
RANK_LIMIT = 1_000
# Ranges of class values that guesses are looked up in.
RANGES = 1_000


def normalize_label(df: DataFrame, column: str) -> Column:
    """Label as text: null is ``NA``, whole floats lose their fraction, outer blanks go."""
    value, kind = col(column), df.schema[column].dataType
    text = F.trim(value.cast("string"))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        text = F.when(F.isnan(value), F.lit(None)).when(value == F.floor(value), value.cast("long").cast("string")) \
            .otherwise(text)
    return F.coalesce(text, F.lit("NA"))


def error_signal(
    df: DataFrame, y_true: str, y_pred: str, task: str, proba: str | None = None, into: str = "error"
) -> DataFrame:
    """What drift detection watches.

    Classification: 1 - probability of the true class, or 0/1 without that probability.
    Regression: absolute error, 0 where either side is not a number.
    """
    if task == "regression":
        gap = F.abs(col(y_pred).try_cast("double") - col(y_true).try_cast("double"))
        return df.withColumn(into, F.coalesce(F.nanvl(gap, F.lit(0.0)), F.lit(0.0)))
    truth, guess = normalize_label(df, y_true), normalize_label(df, y_pred)
    missed = F.when(truth == guess, 0.0).otherwise(1.0)
    if proba is not None:
        missed = F.coalesce(1.0 - F.element_at(col(proba), truth), missed)
    return df.withColumn(into, missed)


def nearest_class_label(df: DataFrame, y_true: str, y_pred: str, into: str = "y_pred_label") -> DataFrame:
    """Fractional predictions as the nearest numeric class (ties to the smaller), rounded if classes are text.

    Distinct classes and distinct guesses together are cut into at most ``RANGES`` ranges of similar size, however few
    the classes are. Inside a range the class before and after each guess is found by a window; where there is none,
    the class of the nearest range that has one counts. No row is compared with more than two classes.
    """
    found = df.where(col(y_true).isNotNull()).select(col(y_true).cast("string").alias("c")).distinct()
    value = F.col("c").try_cast("double")
    kinds = found.agg(F.bool_or(value.isNull()).alias("text"), F.count(F.lit(1)).alias("n")).first()
    guess = col(y_pred).cast("double")
    if kinds["text"]:
        return df.withColumn(into, F.bround(guess).cast("long").cast("string"))
    if not kinds["n"]:
        return df.withColumn(into, F.lit(None).cast("string"))
    classes = found.select(value.alias("v")).distinct()
    guesses = df.where(guess.isNotNull() & ~F.isnan(guess)).select(guess.alias("v")).distinct()
    points = materialize(classes.withColumn("k", F.col("v")).unionByName(
        guesses.withColumn("k", F.lit(None).cast("double"))), "points")
    cuts = sorted(set(points.approxQuantile("v", [i / RANGES for i in range(1, RANGES)], 0.1 / RANGES)))
    cuts_ = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    cut = F.size(F.filter(cuts_, lambda c: c <= F.col("v")))
    points = points.withColumn("r", cut)
    inside = Window.partitionBy("r").orderBy("v")
    near = points.withColumns({
        "low": F.last("k", ignorenulls=True).over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        "high": F.first("k", ignorenulls=True).over(inside.rangeBetween(Window.currentRow, Window.unboundedFollowing))})
    ranges = points.where("k is not null").groupBy("r").agg(
        F.min("v").alias("first"), F.max("v").alias("last")).collect()  # RANGES rows
    ends = {row["r"]: row for row in ranges}
    borders, last = [], None
    for r in range(len(cuts) + 1):
        borders.append([r, last, None])
        last = ends[r]["last"] if r in ends else last
    following = None
    for border in reversed(borders):
        border[2] = following
        following = ends[border[0]]["first"] if border[0] in ends else following
    borders = df.sparkSession.createDataFrame(borders, "r int, before double, after double")
    near = near.where("k is null").join(F.broadcast(borders), "r")
    low, high, v = F.coalesce("low", "before"), F.coalesce("high", "after"), F.col("v")
    chosen = F.when(high.isNull() | (low.isNotNull() & (v - low <= high - v)), low).otherwise(high)
    labels = near.select(v.alias("__g"), chosen.cast("long").cast("string").alias(into))
    return df.join(labels, guess == F.col("__g"), "left").drop("__g")


def class_counts(df: DataFrame, y_true: Column, y_pred: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Per class: rows that have it, rows predicted as it, and rows where both agree."""
    confusion = df.groupBy(*keys, y_true.alias("y"), y_pred.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    cells = F.explode(F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("hits")),
    ))
    rows = confusion.select(*keys, cells.alias("x")).select(*keys, "x.*")
    return rows.groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])


def classification_metrics(df: DataFrame, y_true: str, y_pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; a score without denominator is 0."""
    per_class = class_counts(df, normalize_label(df, y_true), normalize_label(df, y_pred), keys)
    n, hits = F.col("support"), F.col("hits")
    precision = F.when(F.col("predicted") > 0, hits / F.col("predicted")).otherwise(0.0)
    recall = F.when(n > 0, hits / n).otherwise(0.0)
    f1 = F.when(n + F.col("predicted") > 0, 2.0 * hits / (n + F.col("predicted"))).otherwise(0.0)
    total = F.sum(n)
    return per_class.groupBy(*keys).agg(
        total.alias("rows"), (F.sum(hits) / total).alias("accuracy"),
        (F.sum(n * precision) / total).alias("precision"), (F.sum(n * recall) / total).alias("recall"),
        (F.sum(n * f1) / total).alias("f1_score"),
    )


def regression_metrics(df: DataFrame, y_true: str, y_pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, MSE, RMSE and R² over rows where both sides are numbers."""
    y, p = col(y_true).try_cast("double"), col(y_pred).try_cast("double")
    pairs = df.select(*keys, y.alias("y"), p.alias("p")).where("y is not null and p is not null")
    pairs = pairs.where(~F.isnan("y") & ~F.isnan("p"))
    gap = F.col("y") - F.col("p")
    out = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse"),
        F.var_pop("y").alias("spread"),
    )
    r2 = F.when(F.col("spread") > 0, 1.0 - F.col("mse") / F.col("spread")).when(F.col("mse") == 0, 1.0).otherwise(0.0)
    return out.withColumns({"rmse": F.sqrt("mse"), "r2": r2}).drop("spread")


def _is_right(df: DataFrame, y_true: str, y_pred: str) -> Column:
    return (normalize_label(df, y_true) == normalize_label(df, y_pred)).cast("int")


def window_accuracy(
    df: DataFrame, y_true: str, y_pred: str, order_by: Sequence[str], width: int, keys: Sequence[str] = (),
    block: int = 100_000,
) -> DataFrame:
    """Adds the accuracy over the last ``width`` rows and over all rows so far, per key."""
    marked = df.withColumn("__right", _is_right(df, y_true, y_pred))
    # positions over all keys: blocks then hold a part of a large key or many small ones
    indexed = row_index(marked, [*keys, *order_by], "__i")
    right = F.col("__right")
    both = block_totals(indexed, keys, "__i", {"__all": right, "__n": F.lit(1)}, {"__recent": right}, width, block)
    return both.select(
        *df.columns, (F.col("__n") - 1).alias("row_index"),
        (F.col("__recent") / F.least("__n", F.lit(width))).alias("window_accuracy"),
        (F.col("__all") / F.col("__n")).alias("cumulative_accuracy"),
    )


def final_window_score(
    df: DataFrame, y_true: str, y_pred: str, order_by: Sequence[str], width: int, keys: Sequence[str] = (),
    task: str = "classification",
) -> DataFrame:
    """Accuracy (or mean absolute error) over the last ``width`` rows of each key."""
    newest = [F.desc(c) for c in order_by]
    if width <= RANK_LIMIT:  # a small rank limit is applied in each task before the rows of a key meet
        last = Window.partitionBy(*keys).orderBy(*newest)
        tail = df.withColumn("__r", F.row_number().over(last)).where(F.col("__r") <= width)
    else:
        tail = row_index(df, newest, "__r", keys).where(F.col("__r") < width)
    if task == "regression":
        score = F.avg(F.abs(col(y_true).try_cast("double") - col(y_pred).try_cast("double")))
        return tail.groupBy(*keys).agg(score.alias("final_window_mae"))
    return tail.groupBy(*keys).agg(F.avg(_is_right(df, y_true, y_pred)).alias("final_window_accuracy"))


def holdout_accuracy(df: DataFrame, y_true: str, y_pred: str, split: str = "split") -> DataFrame:
    """Accuracy on the test rows."""
    return df.where(F.col(split) == "test").agg(F.avg(_is_right(df, y_true, y_pred)).alias("accuracy"))


def infer_problem_type(df: DataFrame, target: str, simple: bool = False) -> DataFrame:
    """``multiclass`` or ``regression`` from type and distinct values; ``simple`` looks at 20 values only."""
    names = ("classification", "regression") if simple else ("multiclass", "regression")
    numeric = isinstance(df.schema[target].dataType, NUMERIC)
    one = df.agg(F.count_distinct(col(target)).alias("distinct_values"), F.count(F.lit(1)).alias("rows"))
    few = F.col("distinct_values") <= 20
    if not simple:
        few = few | (F.col("distinct_values") / F.col("rows") < 0.05)
    kind = F.when(few | F.lit(not numeric), names[0]).otherwise(names[1])
    return one.withColumn("problem_type", kind)


def drift_params(df: DataFrame, rows: str = "row_count", task: str = "task") -> DataFrame:
    """Window size and drift strength for a dataset's size and task."""
    n = F.col(rows)
    classes = F.col(task) == "classification"
    window = (
        F.when(classes & (n < 500), 150).when(classes, 200)
        .when(n < 100, F.greatest(F.lit(20), F.floor(n / 4)))
        .otherwise(F.least(F.lit(200), F.greatest(F.lit(50), F.floor(n / 10))))
    )
    strength = F.when(classes & (n < 500), 1.5).when(classes, 0.80).when(n < 100, 0.08).otherwise(0.05)
    return df.withColumns({"window_size": window.cast("long"), "drift_strength": strength})
