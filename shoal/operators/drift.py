"""Concept drift: detection on ordered series, injection of drift, retraining on windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoal.functions.adwin import Adwin, DriftMonitor
from shoal.functions.columns import NUMERIC, categorical_columns, col, numeric_columns
from shoal.operators.ordering import below, hash_cutoffs, hash_key, row_index, standard_normal, uniform
from shoal.session import materialize


def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def scan_series(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], values: Sequence[str], out: T.StructType,
    make: Callable[[], object], step: Callable[[object, tuple], tuple | None],
) -> DataFrame:
    """Feed each key's rows in order to a small state machine.

    Rows stream through a sorted partition; a task holds one Arrow batch and one state, never a series.
    """
    placed = df.select(*keys, *order_by, *[c for c in values if c not in (*keys, *order_by)])
    placed = (placed.repartition(*keys) if keys else placed.repartition(1)).sortWithinPartitions(*keys, *order_by)
    names = [f.name for f in out.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, machine = None, make()
        for batch in batches:
            found = []
            ids = zip(*[batch[k].tolist() for k in keys]) if keys else [()] * len(batch)
            for key, row in zip(ids, zip(*[batch[v].tolist() for v in values])):
                if key != current:
                    current, machine = key, make()
                hit = step(machine, row)
                if hit is not None:
                    found.append((*key, *hit))
            if found:
                yield pd.DataFrame(found, columns=names)

    return placed.mapInPandas(run, out)


def in_blocks(df: DataFrame, value: str, order_by: Sequence[str], keys: Sequence[str], block: int) -> tuple[DataFrame, list[str]]:
    """Sum, rows and squared deviations of each ``block`` neighbouring rows of a key, by a parallel aggregate.

    Returns the blocks (``__t``, ``__n``, ``__s``) and the columns that order them. ``block`` means the same at any size.
    """
    present = df.where(col(value).isNotNull()).select(*keys, *order_by, col(value).cast("double").alias("__t"))
    if block <= 1:
        return present.withColumns({"__n": F.lit(1), "__s": F.lit(0.0)}), list(order_by)
    v = F.col("__t")
    return row_index(present, order_by, "__i", keys).groupBy(*keys, F.floor(F.col("__i") / block).alias("__block")).agg(
        F.sum(v).alias("__t"), F.count(v).alias("__n"), (F.var_pop(v) * F.count(v)).alias("__s")), ["__block"]


def adwin(df: DataFrame, value: str, order_by: Sequence[str], keys: Sequence[str] = (), delta: float = 0.1,
          block: int = 1) -> DataFrame:
    """Detections per key: (index, mean of the shrunken window, its size).

    With ``block`` = 1 each value is one element. A larger block sums that many neighbouring rows with a
    parallel aggregate first and tests once per block, so that only one row in ``block`` goes through the
    sequential part. Every row counts; the index is the block's last row.
    """
    present, order = in_blocks(df, value, order_by, keys, block)
    out = T.StructType(_key_fields(df, keys) + [
        T.StructField("row_index", T.LongType()), T.StructField("window_mean", T.DoubleType()),
        T.StructField("window_rows", T.LongType())])

    def make():
        return [Adwin(delta), 0]

    def step(state, row):
        state[1] += row[1]
        if state[0].add(*row):
            return state[1] - 1, state[0].total / state[0].n, state[0].n
        return None

    return scan_series(present, keys, order, ["__t", "__n", "__s"], out, make, step)


def column_drift_scan(df: DataFrame, order_by: Sequence[str], column: str | None = None, delta: float = 0.01,
                      block: int = 1) -> DataFrame:
    """Drift along one numeric column (the first by default) of a whole table; see ``adwin`` for ``block``."""
    column = column or numeric_columns(df)[0]
    return adwin(df, column, order_by, (), delta, block).withColumn("column_analyzed", F.lit(column))


def monitor_drift(
    df: DataFrame, error: str, order_by: Sequence[str], keys: Sequence[str] = (), window: int = 150,
    delta: float = 0.1, min_samples: int = 50, cooldown: int = 50, block: int = 1,
) -> DataFrame:
    """Alarms per key: row index, rows in the window, mean error so far.

    The gates count rows. A larger ``block`` sums neighbouring rows in parallel first, as in ``adwin``.
    """
    present, order = in_blocks(df, error, order_by, keys, block)
    out = T.StructType(_key_fields(df, keys) + [
        T.StructField("row_index", T.LongType()), T.StructField("window_size", T.LongType()),
        T.StructField("mean_error_so_far", T.DoubleType())])
    return scan_series(present, keys, order, ["__t", "__n", "__s"], out,
                       lambda: DriftMonitor(window, delta, min_samples, cooldown), lambda monitor, row: monitor.add(*row))


# -- drift injection -----------------------------------------------------------------------------


def _segment(index: Column, edges: Sequence[int]) -> Column:
    """Number of inner edges at or below the position."""
    out = F.lit(0)
    for edge in edges:
        out = out + (index >= F.lit(edge)).cast("int")
    return out


def _swap_values(df: DataFrame, column: str, within: Sequence[str], chosen: Column, seed: int) -> DataFrame:
    """Where ``chosen``, another of the values that occur within the group, picked by hash.

    Values are numbered per group and looked up with equi-joins, so their number is not bounded.
    """
    kinds = df.where(col(column).isNotNull()).select(*within, col(column).alias("__v")).distinct()
    numbered = materialize(row_index(kinds, ["__v"], "__j", within), "values")
    sizes = numbered.groupBy(*within).agg(F.count(F.lit(1)).alias("__m")) if within else numbered.agg(
        F.count(F.lit(1)).alias("__m"))
    picked = df.where(chosen).withColumn("__v", col(column))
    marked = picked.join(numbered, [*within, "__v"], "left").drop("__v")
    marked = marked.join(sizes, list(within), "left") if within else marked.join(F.broadcast(sizes))
    others = F.col("__m") - F.when(F.col("__j").isNull(), 0).otherwise(1)
    pick = F.floor(uniform(seed, "row_index") * others)
    pick = pick + F.when(F.col("__j").isNotNull() & (pick >= F.col("__j")), 1).otherwise(0)
    # a group of one value keeps it
    marked = marked.withColumn("__pick", F.when(F.col("__m") > 1, pick).otherwise(F.coalesce("__j", F.lit(0))))
    options = numbered.select(*within, F.col("__v").alias("__new"), F.col("__j").alias("__pick"))
    out = marked.join(options, [*within, "__pick"], "left")
    value = F.when(F.col("__m") > 1, F.col("__new")).otherwise(col(column))
    swapped = out.select(*[value.alias(c) if c == column else col(c) for c in df.columns])
    return df.where(~F.coalesce(chosen, F.lit(False))).unionByName(swapped)


def infer_drift_task(df: DataFrame, target: str | None) -> str:
    if target is None:
        return "regression"
    if not isinstance(df.schema[target].dataType, NUMERIC):
        return "classification"
    few = df.agg(F.count_distinct(col(target)).alias("n")).first()["n"] <= 20
    return "classification" if few else "regression"


def induce_drift(
    df: DataFrame, order_by: Sequence[str], n_drifts: int = 10, strength: float = 0.3, seed: int = 42,
    target: str | None = None, task: str = "auto", noise: float = 1.0, ignore: Sequence[str] = (),
) -> DataFrame:
    """``n_drifts`` abrupt changes: consecutive segments by position, all but the first transformed.

    Numbers are scaled, shifted and blurred; a growing share of text and boolean values is swapped within the
    segment; labels are flipped, or a regression target shifted. ``noise`` = 0 leaves out the blur.
    Columns named in ``ignore`` (keys) stay. Adds ``row_index`` and ``segment``.
    """
    indexed = row_index(df, order_by, "row_index")
    n = indexed.count()
    if n < n_drifts + 1:
        raise ValueError(f"{n_drifts} drifts need at least {n_drifts + 1} rows, got {n}")
    task = infer_drift_task(df, target) if task == "auto" else task
    edges = [i * n // (n_drifts + 1) for i in range(n_drifts + 2)]
    s = F.col("segment")
    out = indexed.withColumn("segment", _segment(F.col("row_index"), edges[1:-1]))
    sign = F.when(s % 2 == 1, 1.0).otherwise(-1.0)
    scale = F.when(s % 3 == 0, 1.8).otherwise(0.5)
    blur = noise * max(0.05, 0.25 * strength)
    skip = {target, *ignore}
    changed = {}
    for i, c in enumerate(c for c in numeric_columns(df) if c not in skip):
        value = col(c).cast("double") * scale + sign * s * strength
        if blur:
            value = value + blur * standard_normal(seed, F.lit(i), "row_index")
        changed[c] = F.when(s > 0, value).otherwise(col(c).cast("double"))
    if target is not None and task == "regression" and isinstance(df.schema[target].dataType, NUMERIC):
        value = col(target).cast("double") + 0.75 * sign * s * strength
        if noise:
            value = value + noise * max(0.02, 0.08 * strength) * standard_normal(seed, F.lit("target"), "row_index")
        changed[target] = F.when(s > 0, value).otherwise(col(target).cast("double"))
    out = out.withColumns(changed) if changed else out

    swaps = [(c, ["segment"], 0.6, 0.15) for c in categorical_columns(df) if c not in skip]
    if target is not None and task == "classification":
        swaps.append((target, [], 0.7, 0.20))
    for i, (c, within, top, base) in enumerate(swaps):
        hashed = hash_key(seed + 1 + i, "row_index")
        shares = {k: int((edges[k + 1] - edges[k]) * min(top, base + 0.05 * k)) for k in range(1, n_drifts + 1)}
        cuts = hash_cutoffs(indexed.where(F.col("row_index") >= edges[1]), hashed,
                            {k: [share] for k, share in shares.items()},
                            group=_segment(F.col("row_index"), edges[1:-1]))
        chosen = F.lit(False)
        for k, (cut,) in cuts.items():
            chosen = chosen | ((s == k) & below(hashed, cut))
        out = _swap_values(out, c, within, chosen, seed + 101 + i)
    return out


def induce_noise_ramp(
    df: DataFrame, order_by: Sequence[str], strength: float = 0.1, seed: int = 42, target: str | None = None,
    ignore: Sequence[str] = (),
) -> DataFrame:
    """Normal noise on all numbers but the target, growing over ten equal segments. Adds ``row_index``."""
    indexed = row_index(df, order_by, "row_index")
    n = indexed.count()
    size = n // 10 if n >= 10 else max(n, 1)
    factor = (F.least(F.floor(F.col("row_index") / size), F.lit(9)) + 1) * strength
    changed = {
        c: col(c).cast("double") + factor * standard_normal(seed, F.lit(i), "row_index")
        for i, c in enumerate(c for c in numeric_columns(df) if c != target and c not in ignore)
    }
    if not changed:
        raise ValueError("no numeric columns to apply drift to")
    return indexed.withColumns(changed)


# -- retraining ----------------------------------------------------------------------------------


def training_windows(indexed: DataFrame, log: DataFrame, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """The last ``width`` rows up to each alarm, tagged with ``event_index``.

    A range join by equal blocks of ``width`` positions: an alarm meets the rows of two blocks only.
    """
    t = F.col("event_index")
    events = log.select(*keys, F.col("row_index").alias("event_index"))
    first = F.floor(F.greatest(t - (width - 1), F.lit(0)) / width)
    events = events.withColumn("__block", F.explode(F.sequence(first, F.floor(t / width))))
    rows = indexed.withColumn("__block", F.floor(F.col("row_index") / width))
    near = rows.join(events, [*keys, "__block"])
    return near.where((F.col("row_index") <= t) & (F.col("row_index") > t - width)).drop("__block")


# Batches per block when intervals of batches are joined to rows.
INTERVAL_BLOCK = 64

MODEL_FIELDS = [
    T.StructField("event_index", T.LongType()), T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("weights", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("trained_rows", T.LongType()),
]


def retrain_on_window(
    indexed: DataFrame, log: DataFrame, width: int, features: Sequence[str], target: str,
    task: str = "classification", keys: Sequence[str] = (), ridge: float = 1e-3,
) -> DataFrame:
    """One linear model per alarm, fitted to its last ``width`` rows.

    Each model sees at most ``width`` rows, so a task fits it with one least-squares solve; classification
    gets one set of weights per class. The last weight of each set is the intercept.
    """
    windows = training_windows(indexed.select(*keys, "row_index", *features, target), log, width, keys)
    windows = windows.withColumn(target, col(target).cast("string" if task == "classification" else "double"))
    out = T.StructType(_key_fields(indexed, keys) + MODEL_FIELDS)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=[target]).sort_values("row_index")
        classes, weights = _least_squares(rows[list(features)].to_numpy(dtype=float), rows[target].to_numpy(), task, ridge)
        first = [rows[k].iloc[0] for k in keys]
        return pd.DataFrame([(*first, int(rows["event_index"].iloc[0]), classes, weights.tolist(), len(rows))],
                            columns=[f.name for f in out.fields])

    return windows.groupBy(*keys, "event_index").applyInPandas(fit, out)


def _least_squares(x: np.ndarray, y: np.ndarray, task: str, ridge: float) -> tuple[list[str], np.ndarray]:
    """Classes and weights (one set per class, the last weight is the intercept) of a window."""
    x = np.column_stack([np.nan_to_num(x), np.ones(len(x))])
    classes = sorted(set(y)) if task == "classification" else []
    goal = (y[:, None] == np.array(classes, dtype=object)[None, :]) if classes else y[:, None]
    scale = np.maximum(np.abs(x).max(axis=0), 1e-12) if len(x) else np.ones(x.shape[1])
    z = x / scale
    weights = np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ goal.astype(float)) / scale[:, None]
    return classes, weights.T


def _scores(features: Sequence[str]) -> Column:
    x = F.array(*[F.coalesce(col(f).cast("double"), F.lit(0.0)) for f in features], F.lit(1.0))
    return F.transform("weights", lambda w: F.aggregate(
        F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v))


def rescore(
    indexed: DataFrame, models: DataFrame, features: Sequence[str], y_pred: str, proba: str | None = None,
    task: str = "classification", keys: Sequence[str] = (), batch: int = 512,
) -> DataFrame:
    """Predictions of the model in force: a new model counts from the batch after its alarm.

    Each model is in force for an interval of batches. Intervals are cut at blocks of ``INTERVAL_BLOCK``
    batches, so that rows find theirs with an equi-join on the block; no pass over the rows in order.
    """
    spot = F.floor(F.col("event_index") / batch) + 1
    newest = models.groupBy(*keys, spot.alias("__from")).agg(
        F.max_by(F.struct("classes", "weights"), "event_index").alias("__model"))
    following = F.lead("__from").over(Window.partitionBy(*keys).orderBy("__from"))  # over the models only
    last = indexed.agg(F.floor(F.max("row_index") / batch).alias("m")).first()["m"]
    spans = newest.withColumn("__to", F.coalesce(following - 1, F.lit(last))).where(F.col("__from") <= F.col("__to"))
    spans = spans.withColumn("__block", F.explode(F.sequence(
        F.floor(F.col("__from") / INTERVAL_BLOCK), F.floor(F.col("__to") / INTERVAL_BLOCK))))
    rows = indexed.withColumn("__batch", F.floor(F.col("row_index") / batch))
    rows = rows.withColumn("__block", F.floor(F.col("__batch") / INTERVAL_BLOCK))
    on = [rows[c].eqNullSafe(spans[c]) for c in (*keys, "__block")] + [
        rows["__batch"] >= spans["__from"], rows["__batch"] <= spans["__to"]]
    joined = rows.join(spans, on, "left").select(*[rows[c] for c in indexed.columns], "__model.classes", "__model.weights")
    scores = _scores(features)
    has = F.col("weights").isNotNull()
    if task == "classification":
        best = F.array_position(scores, F.array_max(scores)) - 1
        guess = F.get("classes", best.cast("int"))
        clipped = F.transform(scores, lambda v: F.least(F.greatest(v, F.lit(1e-6)), F.lit(1.0)))
        total = F.aggregate(clipped, F.lit(0.0), lambda acc, v: acc + v)
        new = {y_pred: F.when(has, guess).otherwise(col(y_pred).cast("string"))}
        if proba is not None:
            shares = F.map_from_arrays("classes", F.transform(clipped, lambda v: v / total))
            new[proba] = F.when(has, shares).otherwise(col(proba))
    else:
        new = {y_pred: F.when(has, scores[0]).otherwise(col(y_pred).cast("double"))}
    return joined.withColumns(new).select(*indexed.columns)


class _Retrainer:
    """State of one series: the monitor, the last rows, the model in force. Rows come in batches of fixed positions."""

    def __init__(self, settings: dict, task: str, shares: bool, ridge: float):
        self.monitor, self.task, self.shares, self.ridge = DriftMonitor(**settings), task, shares, ridge
        self.window = settings["window"]
        self.x, self.y, self.classes, self.weights = None, None, [], None
        self.in_force: list[str] = []  # classes of the model that the next batch is judged with

    def batch(self, x: np.ndarray, truth: np.ndarray, error: np.ndarray):
        """(predictions, shares) or None while the original ones count, and alarms as (place, size, mean error)."""
        guess = shares = None
        if self.weights is not None:
            scores = np.column_stack([np.nan_to_num(x), np.ones(len(x))]) @ self.weights.T
            if self.task == "classification":
                clipped = np.clip(scores, 1e-6, 1.0)
                shares = clipped / clipped.sum(axis=1, keepdims=True)
                guess = np.array(self.classes, dtype=object)[scores.argmax(axis=1)]
                error = (guess != truth).astype(float)
                if self.shares:
                    place = {c: i for i, c in enumerate(self.classes)}
                    at = np.array([place.get(t, -1) for t in truth])
                    error = np.where(at >= 0, 1.0 - shares[np.arange(len(at)), at], error)
            else:
                guess = scores[:, 0]
                error = np.nan_to_num(np.abs(guess - truth.astype(float)))
        base = 0 if self.x is None else len(self.x)
        self.x = x if self.x is None else np.vstack([self.x, x])
        self.y = truth if self.y is None else np.concatenate([self.y, truth])
        alarms = []
        for i, e in enumerate(error.tolist()):
            hit = self.monitor.add(e)
            if hit is not None:
                alarms.append((i, *hit[1:]))
        if alarms:  # the newest model counts, from the next batch
            last = base + alarms[-1][0] + 1
            near = slice(max(0, last - self.window), last)
            known = ~pd.isna(self.y[near])
            if known.any():
                self.classes, self.weights = _least_squares(self.x[near][known], self.y[near][known], self.task, self.ridge)
        self.x, self.y = self.x[-self.window:], self.y[-self.window:]
        return guess, shares, alarms


def monitor_and_retrain(
    df: DataFrame, order_by: Sequence[str], features: Sequence[str], y_true: str, y_pred: str,
    proba: str | None = None, task: str = "classification", keys: Sequence[str] = (), window: int = 150,
    delta: float = 0.1, min_samples: int = 50, cooldown: int = 50, batch: int = 512, ridge: float = 1e-3,
) -> tuple[DataFrame, DataFrame]:
    """Detection and retraining together: (final predictions with ``row_index``, drift log).

    One shuffle and one pass: the rows of a key stream through a sorted partition in batches of ``batch``. Between two
    batches a task holds the window, the monitor's state and the model in force. An alarm refits a linear model
    on the last ``window`` rows; its predictions count from the next batch and feed the monitor from there.
    """
    from shoal.operators.metrics import error_signal, normalize_label

    names = list(df.columns)
    truth = normalize_label(df, y_true) if task == "classification" else col(y_true).try_cast("double")
    known = error_signal(df, y_true, y_pred, task, proba, "__error").withColumns(
        {"__truth": F.when(col(y_true).isNotNull(), truth) if task == "classification" else truth,
         y_pred: col(y_pred).cast("string" if task == "classification" else "double")}
        | {f"__x{i}": col(f).cast("double") for i, f in enumerate(features)})
    fields = [known.schema[c] for c in names]
    out = T.StructType([*fields, T.StructField("row_index", T.LongType()), T.StructField("__size", T.LongType()),
                        T.StructField("__mean", T.DoubleType())])
    columns = [f"__x{i}" for i in range(len(features))]
    placed = (known.repartition(*keys) if keys else known.repartition(1)).sortWithinPartitions(*keys, *order_by)
    settings = dict(window=window, delta=delta, min_samples=min_samples, cooldown=cooldown)

    def judged(state: _Retrainer, rows: pd.DataFrame, start: int) -> pd.DataFrame:
        guess, shares, alarms = state.batch(rows[columns].to_numpy(dtype=float), rows["__truth"].to_numpy(),
                                            rows["__error"].to_numpy(dtype=float))
        done = rows[names].copy()
        done["row_index"] = np.arange(start, start + len(rows))
        done["__size"], done["__mean"] = pd.Series(pd.NA, rows.index, dtype="Int64"), np.nan
        for place, size, mean in alarms:
            done.iloc[place, -2:] = [size, mean]
        if guess is not None:
            done[y_pred] = guess
            if proba is not None and shares is not None:
                done[proba] = [dict(zip(state.in_force, row)) for row in shares.tolist()]
        state.in_force = state.classes
        return done

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, held, start = None, None, [], 0

        def drain(force: bool) -> Iterator[pd.DataFrame]:
            nonlocal held, start
            rows = pd.concat(held) if len(held) > 1 else held[0] if held else None
            at = 0
            while rows is not None and (len(rows) - at >= batch or force and at < len(rows)):
                part = rows.iloc[at:at + batch]
                yield judged(state, part, start)
                start, at = start + len(part), at + len(part)
            held = [rows.iloc[at:]] if rows is not None and at < len(rows) else []

        for frame in batches:
            frame = frame.reset_index(drop=True)
            ids = list(zip(*[frame[k].tolist() for k in keys])) if keys else [()] * len(frame)
            borders = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
            for a, b in zip(borders, borders[1:]):
                if a == b:
                    continue
                if state is None or ids[a] != current:
                    yield from drain(True)
                    current, state, start = ids[a], _Retrainer(settings, task, proba is not None, ridge), 0
                held.append(frame.iloc[a:b])
                yield from drain(False)
        yield from drain(True)

    done = materialize(placed.select(*names, "__truth", "__error", *columns)
                       .mapInPandas(run, out), "retrained")
    log = done.where("__size IS NOT NULL").select(
        *keys, "row_index", F.col("__size").alias("window_size"), F.col("__mean").alias("mean_error_so_far"))
    return done.drop("__size", "__mean"), log


def drift_report(log: DataFrame, metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One report per key: whether drift was found, where, and the scores, as JSON."""
    fields = [c for c in metrics.columns if c not in keys]
    found = log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_drifts"), F.min("row_index").alias("first_drift"),
        F.max("row_index").alias("last_drift"))
    out = metrics.join(found, list(keys), "left")
    total = F.coalesce("total_drifts", F.lit(0))
    message = F.when(total > 0, F.lit(None).cast("string")).otherwise("no drift detected")
    report = F.to_json(F.struct(
        (total > 0).alias("drift_detected"), total.alias("total_drifts"), F.col("first_drift"), F.col("last_drift"),
        F.struct(*[col(c) for c in fields]).alias("metrics"), message.alias("message")))
    return out.select(*keys, (total > 0).alias("drift_detected"), total.alias("total_drifts"), report.alias("report"))


REPORT_KEY = ("user_id", "dataset_id", "dataset_version", "model_id", "model_version")  # fixed values


def publish_drift_report(reports: DataFrame, found: DataFrame, models: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Reports with the new ones upserted by their five-part key, and the models with their new versions.

    ``found`` has user_id, dataset_id, dataset_version, model_id, drift_detected and report; ``models`` user_id, model_id
    and version. Where drift was found the report belongs to the retrained model, which gets the next version;
    else to the newest one there is.
    """
    from shoal.functions.columns import version_number
    from shoal.operators.catalog import upsert

    last = models.groupBy("user_id", "model_id").agg(F.coalesce(F.max(version_number(F.col("version"))), F.lit(0)).alias("__last"))
    joined = found.join(last, ["user_id", "model_id"], "left").withColumn("__last", F.coalesce("__last", F.lit(0)))
    number = F.greatest(F.col("__last") + F.col("drift_detected").cast("int"), F.lit(1))
    named = joined.withColumn("model_version", F.concat(F.lit("v"), number.cast("string"))).withColumn("updated_at", now)
    updated = upsert(reports, named.select(*REPORT_KEY, "report", "updated_at"), list(REPORT_KEY))
    fresh = named.where("drift_detected").select("user_id", "model_id", F.col("model_version").alias("version"))
    return updated, models.select("user_id", "model_id", "version").unionByName(fresh).distinct()
