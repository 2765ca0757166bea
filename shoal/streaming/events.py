"""Events between the stages of the work: parsing, checking, first delivery, next trigger, completion.

All functions but ``pipeline_status`` and ``dedup_triggers`` are the same for tables and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of a trigger, in its ``input`` or (old events) at the top.
FIELDS = (
    "user_id string, dataset_id string, dataset_version string, model_id string, model_version string, "
    "task_category string, task_type string, target_column_name string, target_column string, "
    "window_size string, report_type string, level string"
)
TRIGGER = f"task_id string, event_id string, event_type string, timestamp string, input struct<{FIELDS}>, {FIELDS}"

# Completion event, error type and default message of each stage.
STAGES = {
    "bias": ("bias-detection-complete", "BiasDetectionError", "Bias detection failed"),
    "automl": ("automl-complete", "AutoMLError", "AutoML training failed"),
    "xai": ("xai-complete", "XAIError", "XAI report generation failed"),
    "drift": ("concept-drift-complete", "ConceptDriftError", "Concept drift retraining failed"),
}
# Fields of the output of each stage.
OUTPUTS = {
    "bias": ("bias_report_id", "dataset_id", "dataset_version", "user_id"),
    "automl": ("model_id", "model_version", "dataset_id", "dataset_version", "user_id"),
    "xai": ("xai_report_id", "dataset_id", "dataset_version", "user_id", "model_id", "model_version"),
    "drift": ("model_id", "model_version", "dataset_id", "dataset_version", "user_id", "drift_detected", "message",
              "drift_metrics"),
}
# Fixed value: message of a drift run that found none.
NO_DRIFT = "No concept drift detected"
# The trigger that follows each finished stage, and the order of the stages.
NEXT_TRIGGER = {
    "dataset.uploaded": "bias-trigger.reported",
    "bias-detection-complete": "automl-trigger.reported",
    "automl-complete": "concept-drift-trigger",
    "concept-drift-complete": "xai-trigger",
}
STAGE_ORDER = ("dataset.uploaded", "bias-detection-complete", "automl-complete", "concept-drift-complete",
               "xai-complete")


def parse_events(messages: DataFrame) -> DataFrame:
    """Trigger fields from ``input``, or from the message itself in old events; bad JSON in ``quarantine``."""
    from shoal.sources.events import read_events

    e = read_events(messages, TRIGGER)
    inner = F.col("event.input")

    def field(name: str) -> Column:
        return F.when(inner.isNotNull(), inner[name]).otherwise(F.col(f"event.{name}"))

    return e.select(
        F.coalesce("event.task_id", "event.event_id").alias("task_id"), F.col("event.event_type").alias("event_type"),
        F.try_to_timestamp("event.timestamp").alias("timestamp"), field("user_id").alias("user_id"),
        field("dataset_id").alias("dataset_id"),
        F.coalesce(field("dataset_version"), F.lit("v1")).alias("dataset_version"),
        field("model_id").alias("model_id"), F.coalesce(field("model_version"), F.lit("v1")).alias("model_version"),
        F.lower(F.trim(F.coalesce(F.nullif(field("task_category"), F.lit("")), F.lit("tabular")))).alias("task_category"),
        field("task_type").alias("task_type"),
        F.coalesce(F.nullif(field("target_column_name"), F.lit("")), field("target_column")).alias("target_column"),
        F.coalesce(field("window_size").try_cast("int"), F.lit(100)).alias("window_size"),
        field("report_type").alias("report_type"), field("level").alias("level"), "quarantine",
    )


def _absent(*names: str) -> Column:
    test = F.lit(False)
    for n in names:
        test = test | F.col(n).isNull() | (F.col(n) == "")
    return test


def validate_triggers(events: DataFrame, kind: str) -> DataFrame:
    """Adds ``failure_reason`` (null for a good trigger); ``kind`` is bias, automl or drift."""
    if kind == "drift":
        reason = F.when(_absent("user_id", "dataset_id", "model_id"), "Missing required fields").when(
            _absent("target_column"), "Missing target_column_name")
    else:
        reason = F.when(_absent("user_id", "dataset_id"), "Missing user_id or dataset_id in event")
        if kind == "automl":
            reason = reason.when((F.col("task_category") == "tabular") & _absent("target_column", "task_type"),
                                 "Tabular task requires target_column_name and task_type")
    return events.withColumn("failure_reason", reason)


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where("failure_reason is null").drop("failure_reason")


def rejected(checked: DataFrame, kind: str) -> DataFrame:
    """Failure events of the refused triggers."""
    bad = checked.where("failure_reason is not null")
    return complete_events(bad.withColumns({"success": F.lit(False), "error_message": F.col("failure_reason")}), kind)


def dedup_triggers(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """The first delivery of each task. A stream forgets a task ``within`` after it (bounded state)."""
    if events.isStreaming:
        return events.withWatermark("timestamp", within).dropDuplicatesWithinWatermark(["task_id"])
    rest = [c for c in events.columns if c not in ("task_id", "timestamp")]  # break ties of the time
    first = events.groupBy("task_id").agg(F.min_by(F.struct(*events.columns), F.struct("timestamp", *rest)).alias("x"))
    return first.select("x.*")


def dataset_events(cat: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One upload event per dataset: its newest split version if there is one, else the newest original.

    A version is split when ``custom_metadata.split`` is there, unless a column ``has_split`` says so.
    """
    if "has_split" not in cat.columns:
        cat = cat.withColumn("has_split", F.col("custom_metadata.split").isNotNull())
    rank = F.struct(F.col("has_split"), F.col("created_at"), F.col("version"))
    pick = cat.groupBy("user_id", "dataset_id").agg(F.max_by(F.struct(*cat.columns), rank).alias("d"))
    when = as_of if as_of is not None else F.current_timestamp()
    dropped = {"has_split", "files"}
    count = F.when(F.size("d.files") > 0, F.size("d.files")).otherwise(1)
    body = F.struct(*[F.col(f"d.{c}").alias(c) for c in cat.columns if c not in dropped], count.alias("file_count"))
    event_id = F.concat_ws("_", F.lit("dataset.uploaded"), "dataset_id", F.unix_timestamp(when).cast("string"))
    value = F.to_json(F.struct(
        F.lit("dataset.uploaded").alias("event_type"), event_id.alias("event_id"),
        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), body.alias("dataset")))
    return pick.select(F.col("dataset_id").alias("key"), value.alias("value"), "user_id", "d.version",
                       count.alias("file_count"))


def trigger_next(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """The trigger after each finished stage, with the row count from the catalog.

    ``events`` has event_type, task_id, user_id, dataset_id, dataset_version, failed; failed ones and those
    without user or dataset start nothing.
    """
    table = F.create_map(*[F.lit(x) for item in NEXT_TRIGGER.items() for x in item])
    following = F.element_at(table, F.col("event_type"))
    good = events.where(~_absent("user_id", "dataset_id")).where(~F.col("failed")).withColumn("next_event", following)
    rows = catalog.select("user_id", "dataset_id", F.col("version").alias("dataset_version"),
                          F.col("row_count").alias("record_count"))
    joined = good.where("next_event is not null").join(rows, ["user_id", "dataset_id", "dataset_version"], "left")
    return joined.select("task_id", "user_id", "dataset_id", "dataset_version", "next_event", "record_count")


def complete_events(results: DataFrame, kind: str) -> DataFrame:
    """Completion messages: ``output`` on success, ``failure`` otherwise (drift keeps its context there)."""
    event, error, text = STAGES[kind]
    ok = F.col("success")
    if "drift_detected" in results.columns and "message" not in results.columns:
        results = results.withColumn("message", F.when(~F.col("drift_detected"), NO_DRIFT))
    fields = [F.col(c).alias(c) if c in results.columns else F.lit(None).cast("string").alias(c) for c in OUTPUTS[kind]]
    output = F.struct(*fields)
    shown = output if kind == "drift" else F.when(ok, output)
    message = F.col("error_message") if "error_message" in results.columns else F.lit(None).cast("string")
    failure = F.when(~ok, F.struct(F.lit(error).alias("error_type"),
                                   F.coalesce(message, F.lit(text)).alias("error_message")))
    body = F.struct(
        F.col("task_id"), F.lit(event).alias("event_type"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), shown.alias("output"),
        failure.alias("failure"))
    return results.select(F.col("task_id").alias("key"), F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def pipeline_status(triggers: DataFrame, completions: DataFrame, within: str = "6 hours") -> DataFrame:
    """Per task: when it was triggered and completed, how it ended and how long it took.

    On streams both sides carry watermarks, every completion counts and a task is given up ``within`` after its
    trigger. On tables the last completion counts, however late.
    """
    t = triggers.select("task_id", "dataset_id", F.col("timestamp").alias("triggered_at"))
    c = completions.select(F.col("task_id").alias("done_id"), "success", F.col("timestamp").alias("completed_at"))
    if triggers.isStreaming:
        t, c = t.withWatermark("triggered_at", "10 minutes"), c.withWatermark("completed_at", "10 minutes")
    else:
        c = c.groupBy("done_id").agg(F.max_by(F.struct("success", "completed_at"), "completed_at").alias("x"))
        c = c.select("done_id", "x.*")
    on = (F.col("task_id") == F.col("done_id")) & (F.col("completed_at") >= F.col("triggered_at"))
    if triggers.isStreaming:
        on = on & (F.col("completed_at") <= F.col("triggered_at") + F.expr(f"interval {within}"))
    joined = t.join(c, on, "left_outer")
    status = F.when(F.col("success"), "success").when(~F.col("success"), "failure").otherwise("open")
    took = F.unix_micros("completed_at") - F.unix_micros("triggered_at")
    return joined.select("task_id", "dataset_id", "triggered_at", "completed_at", status.alias("status"),
                         (took / 1_000_000).alias("latency_seconds"))


def stage_reached(events: DataFrame) -> DataFrame:
    """The furthest stage of each dataset."""
    order = F.array(*[F.lit(s) for s in STAGE_ORDER])
    place = F.array_position(order, F.col("event_type"))
    best = events.where(place > 0).groupBy("user_id", "dataset_id").agg(F.max(place).alias("stage_no"))
    return best.withColumn("stage", F.element_at(order, F.col("stage_no").cast("int")))


def upload_job_progress(progress: DataFrame) -> DataFrame:
    """The latest report of each upload job and the share of files processed."""
    body = F.struct(*[c for c in progress.columns if c != "job_id"])
    last = progress.groupBy("job_id").agg(F.max_by(body, F.struct("updated_at", "processed_files")).alias("x"))
    share = F.when(F.col("total_files") > 0, F.col("processed_files") / F.col("total_files"))
    return last.select("job_id", "x.*").withColumn("share_done", share)
