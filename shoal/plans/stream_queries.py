"""Event flow. The events table stands for messages; every event type plays a part. Streams read the table
from files and run until all of it is processed."""

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from shoal.operators import metrics
from shoal.plans.catalog_queries import CATALOG_SQL, dataset_catalog
from shoal.plans.drift_queries import stream as prediction_stream
from shoal.plans.registry import query, table
from shoal.session import fresh_path
from shoal.sources import events as event_source
from shoal.sources import message_log
from shoal.streaming import events as flow
from shoal.streaming import leases, monitor
from shoal.streaming.outputs import outputs, split_triggers
from shoal.streaming.run import as_stream, run_available


#: Begin of the task ids of closing rows; no task's id begins so.
NO_TASK = "\0closing-"


def messages(spark, sf):
    """Triggers: clicks in the present form, views in the flat old form, signups without target, purchases
    without user, errors as broken JSON."""
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    user = F.when(kind != "purchase", F.concat(F.lit("u"), "user_id"))
    target = F.when(kind != "signup", "label")
    fields = F.struct(user.alias("user_id"), F.lit("d").alias("dataset_id"), F.lit("m").alias("model_id"),
                      F.lit("classification").alias("task_type"), target.alias("target_column_name"))
    new = F.to_json(F.struct(F.concat(F.lit("t"), "event_id").alias("task_id"), kind.alias("event_type"),
                             stamp.alias("timestamp"), fields.alias("input")))
    old = F.to_json(F.struct(F.concat(F.lit("t"), "event_id").alias("event_id"), kind.alias("event_type"),
                             stamp.alias("timestamp"), user.alias("user_id"), F.lit("d").alias("dataset_id"),
                             F.lit("v7").alias("dataset_version"), F.lit("label").alias("target_column"),
                             F.lit(250).alias("window_size")))
    value = F.when(kind == "view", old).when(kind == "error", F.substring(new, 1, 40)).otherwise(new)
    return e.select(F.col("event_id").cast("string").alias("key"), value.alias("value"))


PARSED_SQL = """(SELECT event_id, concat('t', event_id) AS task_id, event_type, date_trunc('second', ts) AS timestamp,
 CASE WHEN event_type <> 'purchase' THEN concat('u', user_id) END AS user_id, 'd' AS dataset_id,
 CASE event_type WHEN 'view' THEN 'v7' ELSE 'v1' END AS dataset_version, CASE WHEN event_type <> 'view' THEN 'm' END
 AS model_id, CASE WHEN event_type <> 'view' THEN 'classification' END AS task_type,
 CASE WHEN event_type <> 'signup' THEN 'label' END AS target_column,
 CASE event_type WHEN 'view' THEN 250 ELSE 100 END AS window_size FROM events WHERE event_type <> 'error')"""


def _plain(df):
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("parse_events", f"""SELECT task_id, event_type, timestamp, user_id, dataset_id, dataset_version, model_id,
 task_type, target_column, window_size, false AS bad FROM {PARSED_SQL} UNION ALL SELECT NULL, NULL, NULL, NULL, NULL,
 'v1', NULL, NULL, NULL, 100, true FROM events WHERE event_type = 'error'""")
def parse_events(spark, sf):
    out = _plain(flow.parse_events(messages(spark, sf)))
    return out.select("task_id", "event_type", "timestamp", "user_id", "dataset_id", "dataset_version", "model_id",
                      "task_type", "target_column", "window_size", F.col("quarantine").isNotNull().alias("bad"))


@query("parse_events_stream", f"""SELECT task_id, user_id, window_size, false AS bad FROM {PARSED_SQL} UNION ALL
 SELECT NULL, NULL, 100, true FROM events WHERE event_type = 'error'""")
def parse_events_stream(spark, sf):
    parsed = flow.parse_events(as_stream(messages(spark, sf)))
    return run_available(parsed.select("task_id", "user_id", "window_size", F.col("quarantine").isNotNull().alias("bad")))


@query("validate_triggers", f"""SELECT 'automl' AS kind, task_id, CASE WHEN user_id IS NULL THEN
 'Missing user_id or dataset_id in event' WHEN target_column IS NULL OR task_type IS NULL THEN
 'Tabular task requires target_column_name and task_type' ELSE 'none' END AS failure_reason FROM {PARSED_SQL}
 UNION ALL SELECT 'drift', task_id, CASE WHEN user_id IS NULL OR model_id IS NULL THEN 'Missing required fields'
 WHEN target_column IS NULL THEN 'Missing target_column_name' ELSE 'none' END FROM {PARSED_SQL}
 UNION ALL SELECT 'bias', task_id, CASE WHEN user_id IS NULL THEN 'Missing user_id or dataset_id in event'
 ELSE 'none' END FROM {PARSED_SQL}""")
def validate_triggers(spark, sf):
    parsed = flow.parse_events(messages(spark, sf)).where("quarantine is null")
    out = None
    for kind in ("automl", "drift", "bias"):
        one = flow.validate_triggers(parsed, kind).select(
            F.lit(kind).alias("kind"), "task_id", F.coalesce("failure_reason", F.lit("none")).alias("failure_reason"))
        out = one if out is None else out.unionByName(one)
    return out


@query("rejected_triggers", f"""SELECT task_id AS key, concat('{{"task_id":"', task_id,
 '","event_type":"automl-complete","timestamp":"', strftime(timestamp, '%Y-%m-%dT%H:%M:%S'),
 '","output":null,"failure":{{"error_type":"AutoMLError","error_message":"', CASE WHEN user_id IS NULL THEN
 'Missing user_id or dataset_id in event' ELSE 'Tabular task requires target_column_name and task_type' END, '"}}}}')
 AS value FROM {PARSED_SQL} WHERE user_id IS NULL OR target_column IS NULL OR task_type IS NULL""")
def rejected_triggers(spark, sf):
    parsed = flow.parse_events(messages(spark, sf)).where("quarantine is null")
    return flow.rejected(flow.validate_triggers(parsed, "automl"), "automl")


SPLIT_SQL = f"""SELECT task_id, CASE WHEN user_id IS NULL THEN 'Missing user_id or dataset_id in event'
 WHEN target_column IS NULL OR task_type IS NULL THEN 'Tabular task requires target_column_name and task_type' ELSE 'accepted' END AS came_to
 FROM {PARSED_SQL}"""


class Interrupted(Exception):
    """A failure that a query brings about to start again after it."""


@query("split_triggers_stream", SPLIT_SQL)
def split_triggers_stream(spark, sf):
    """Good and refused triggers from one read of a message log. The second batch fails between its two outputs and is run
    again: nothing is lost or there twice."""
    path, log = fresh_path(spark, "split"), fresh_path(spark, "log")
    message_log.append_log(as_stream(messages(spark, sf).repartition(3), files_per_trigger=1), log, f"{log}-sent").awaitTermination()
    parsed = flow.parse_events(message_log.read_log(spark, log)).where("quarantine is null")
    failed = []

    def written(number, name):
        if number == 0 and name == "accepted" and not failed:
            failed.append(number)
            raise Interrupted

    try:
        split_triggers(parsed, "automl", path, written).awaitTermination()
    except StreamingQueryException:
        split_triggers(parsed, "automl", path, written).awaitTermination()
    good, bad = outputs(spark, path)
    reason = F.get_json_object("value", "$.failure.error_message")
    return good.select("task_id", F.lit("accepted").alias("came_to")).unionAll(bad.select(F.col("key"), reason))


@query("message_log", """SELECT event_id, user_id, event_type FROM events""")
def messages_of_log(spark, sf):
    """Events through a message log: written by a stream in several batches, read by another."""
    log = fresh_path(spark, "log")
    sent = event_source.to_messages(table(spark, sf, "events").select("event_id", "user_id", "event_type"), "event_id")
    message_log.append_log(as_stream(sent.repartition(4), files_per_trigger=1), log, f"{log}-sent").awaitTermination()
    got = run_available(message_log.read_log(spark, log))
    read = event_source.read_events(got, "event_id long, user_id long, event_type string")
    return read.select("event.*")


@query("dataset_events", f"""SELECT user_id, dataset_id AS key, version, file_count FROM (SELECT *, 1 AS file_count
 FROM {CATALOG_SQL} QUALIFY row_number() OVER (PARTITION BY user_id, dataset_id ORDER BY file_type = 'csv' DESC,
 created_at DESC, version DESC) = 1)""")
def dataset_events(spark, sf):
    cat = dataset_catalog(spark, sf).withColumn("has_split", F.col("file_type") == "csv")
    return flow.dataset_events(cat).select("user_id", "key", "version", "file_count")


COMPLETE = {"click": "bias-detection-complete", "view": "dataset.uploaded", "purchase": "automl-complete",
            "signup": "concept-drift-complete", "error": "xai-complete"}
STAGE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COMPLETE.items()) + " END"


def stage_events(spark, sf):
    stage = F.create_map(*[F.lit(x) for item in COMPLETE.items() for x in item])
    return table(spark, sf, "events").select(
        F.concat(F.lit("t"), "event_id").alias("task_id"), F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("d"), F.floor("value").cast("string")).alias("dataset_id"), F.lit("v1").alias("dataset_version"),
        F.element_at(stage, F.col("event_type")).alias("event_type"), (F.col("value") > 100).alias("failed"),
        F.col("ts").cast("timestamp").alias("timestamp"))


@query("trigger_next", """WITH n AS (SELECT c_custkey, count(*) AS record_count FROM orders JOIN customer
 ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT concat('t', event_id) AS task_id, CASE event_type WHEN 'view' THEN 'bias-trigger.reported' WHEN 'click' THEN
 'automl-trigger.reported' WHEN 'purchase' THEN 'concept-drift-trigger' ELSE 'xai-trigger' END AS next_event,
 coalesce(record_count, -1) AS record_count FROM events LEFT JOIN n ON c_custkey = user_id AND floor(value) = 7
 WHERE event_type <> 'error' AND value <= 100""")
def trigger_next(spark, sf):
    sizes = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("row_count"))
    catalog = sizes.select(F.col("o_custkey").cast("string").alias("user_id"), F.lit("d7").alias("dataset_id"),
                           F.lit("v1").alias("version"), "row_count")
    out = flow.trigger_next(stage_events(spark, sf), catalog)
    return out.select("task_id", "next_event", F.coalesce("record_count", F.lit(-1)).alias("record_count"))


def deliveries(spark, sf):
    """Every user's events of a day are deliveries of one task, by the hour: many have equal times."""
    ts = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select(
        F.concat(F.lit("t"), "user_id").alias("task_id"), "event_id", ts.alias("timestamp"))


@query("dedup_triggers", """SELECT concat('t', user_id) AS task_id, arg_min(event_id, (date_trunc('hour', ts), event_id)) AS event_id FROM events
 GROUP BY user_id""")
def dedup_triggers(spark, sf):
    return flow.dedup_triggers(deliveries(spark, sf)).select("task_id", "event_id")


@query("dedup_triggers_stream", "SELECT DISTINCT concat('t', user_id) AS task_id FROM events")
def dedup_triggers_stream(spark, sf):
    first = flow.dedup_triggers(as_stream(deliveries(spark, sf)), within="60 days")
    return run_available(first.select("task_id", "timestamp")).select("task_id")


@query("monitor_stream")
def monitor_stream(spark, sf):
    rows = metrics.error_signal(prediction_stream(spark, sf), "y_true", "y_pred", "classification", "proba")
    rows = rows.select("event_type", "event_id", "error").orderBy("event_id")
    alarms = monitor.stream_drift_monitor(as_stream(rows, files_per_trigger=100), "event_type", "event_id",
                                          "error", delta=0.9, min_samples=30)
    return run_available(alarms)


def lease_events(spark, sf):
    op = F.when(F.col("event_type").isin("click", "view"), "claim").when(
        F.col("event_type") == "signup", "heartbeat").when(F.col("event_type") == "purchase", "release").otherwise(
        F.when(F.col("value") > 100, "complete").otherwise("claim"))
    rows = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("user_id"), F.lit("d").alias("dataset_id"),
        F.lit(None).cast("string").alias("dataset_version"), F.lit("m").alias("model_id"),
        F.lit("").alias("model_version"), F.col("event_id").alias("seq"), "ts",
        F.concat(F.lit("t"), F.floor(F.col("value") / 10).cast("string")).alias("task_id"), op.alias("op"))
    return rows.withColumn("job_key", leases.job_key())


@query("lease_claims")
def lease_claims(spark, sf):
    return leases.lease_claims(lease_events(spark, sf))


@query("lease_claims_stream")
def lease_claims_stream(spark, sf):
    rows = lease_events(spark, sf).orderBy("seq").select("job_key", "seq", "ts", "task_id", "op")
    return run_available(leases.stream_lease_claims(as_stream(rows, files_per_trigger=100)))


def lease_protocol(spark, sf):
    """Claims, heartbeats, releases and completions, a hundred times as dense as the events. Every ninth event uses a task id
    that four users share."""
    rows = table(spark, sf, "events").select(
        F.concat("user_id", F.lit("|d|v1|m|v1")).alias("job_key"), F.col("event_id").alias("seq"),
        F.timestamp_seconds(F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 100_000)).alias("ts"),
        F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("t"), F.col("user_id") - F.col("user_id") % 4)).otherwise(
            F.concat(F.lit("t"), "user_id", F.lit("-"), F.floor(F.col("value") / 40))).alias("task_id"),
        F.when(F.col("event_type") == "signup", "heartbeat").when(F.col("event_type") == "purchase", "release").when(
            (F.col("event_type") == "error") & (F.col("value") > 100), "complete").otherwise("claim").alias("op"))
    return rows


LEASE_SQL = """WITH RECURSIVE e AS (SELECT concat(user_id, '|d|v1|m|v1') AS job_key, event_id AS seq, epoch_ms(ts) // 100000 * 1000 AS ms,
 CASE WHEN event_id % 9 = 0 THEN concat('t', user_id - user_id % 4) ELSE concat('t', user_id, '-', floor(value / 40)::BIGINT) END AS task,
 CASE WHEN event_type = 'signup' THEN 'heartbeat' WHEN event_type = 'purchase' THEN 'release'
  WHEN event_type = 'error' AND value > 100 THEN 'complete' ELSE 'claim' END AS op FROM events),
n AS (SELECT *, count(*) FILTER (op = 'release') OVER (PARTITION BY task ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
 AS life FROM e),
x AS (SELECT job_key, seq, ms, task, op, op = 'claim' AND job_key <> first_job AS refused,
 row_number() OVER (PARTITION BY job_key ORDER BY ms, seq) AS rn, lead(ms) OVER (PARTITION BY job_key ORDER BY ms, seq) AS next_ms
 FROM n LEFT JOIN (SELECT task, life, arg_min(job_key, (ms, seq)) AS first_job FROM n WHERE op = 'claim' GROUP BY ALL) USING (task, life)),
s AS (SELECT DISTINCT job_key, 0::BIGINT AS rn, NULL::VARCHAR AS holder, '' AS status, 0::BIGINT AS alive, '' AS outcome FROM x
 UNION ALL SELECT job_key, rn, CASE WHEN o IN ('granted', 'reclaimed') THEN task WHEN o <> 'released' THEN holder END,
  CASE WHEN o IN ('granted', 'reclaimed') THEN 'in_progress' WHEN o = 'released' THEN '' WHEN o = 'completed' THEN o ELSE status END,
  CASE WHEN o IN ('granted', 'reclaimed', 'alive') THEN ms ELSE alive END, o
 FROM (SELECT x.job_key, x.rn, x.task, x.ms, holder, status, alive, CASE WHEN refused THEN 'rejected_other_job'
   WHEN op = 'claim' THEN CASE WHEN holder IS NULL THEN 'granted' WHEN status = 'completed' THEN 'rejected_completed'
    WHEN holder = task AND ms - alive < 120000 THEN 'rejected_in_progress'
    WHEN holder <> task AND ms - alive < 300000 THEN 'rejected_claimed' ELSE 'reclaimed' END
   WHEN holder IS DISTINCT FROM task THEN 'not_found' WHEN op = 'release' THEN 'released'
   WHEN status <> 'in_progress' THEN 'not_found' WHEN op = 'complete' THEN 'completed' ELSE 'alive' END AS o
  FROM s JOIN x ON x.job_key = s.job_key AND x.rn = s.rn + 1))
SELECT job_key, ms AS "at", seq, task AS task_id, op, outcome FROM x JOIN s USING (job_key, rn)
UNION ALL SELECT job_key, alive + l, -1, holder, 'expire', name FROM x JOIN s USING (job_key, rn),
 (VALUES (120000, 'idle'), (300000, 'stale')) v(l, name)
 WHERE status = 'in_progress' AND alive + l > ms AND (next_ms IS NULL OR alive + l <= next_ms)"""


@query("lease_log", LEASE_SQL)
def lease_log(spark, sf):
    return leases.lease_log(lease_protocol(spark, sf)).withColumn("seq", F.coalesce("seq", F.lit(-1)))


def leases_of_stream(events, delay="10 minutes", files=1, progress=None):
    """The lease log of a finished table read as a stream in two queries, each with a closing row."""
    end = events.agg((F.max("ts") + F.expr("interval 90 days")).alias("ts"))

    def closing(columns):
        known = {"ts": F.col("ts"), "at": F.unix_millis("ts")}
        return end.select(*[known.get(c, F.lit(NO_TASK if t == "string" else 0)).cast(t).alias(c) for c, t in columns.items()])

    names = {"job_key": "string", "seq": "long", "ts": "timestamp", "op": "string", "task_id": "string"}
    bound = run_available(leases.stream_bind_tasks(
        as_stream(events.select(*names), files_per_trigger=files, last=closing(names)), delay), progress=progress)
    names = dict(bound.dtypes)
    return run_available(leases.stream_lease_log(
        as_stream(bound, files_per_trigger=files, last=closing(names)), delay), progress=progress)


@query("lease_log_stream", LEASE_SQL)
def lease_log_stream(spark, sf):
    return leases_of_stream(lease_protocol(spark, sf), files=100).withColumn("seq", F.coalesce("seq", F.lit(-1)))


@query("job_key", """SELECT event_id AS seq, concat(user_id, '|d|v1|m|v1') AS job_key, concat(user_id,
 '|d|v1|m|v1|data_explanation|beginner') AS report_key FROM events""")
def job_key(spark, sf):
    rows = lease_events(spark, sf).withColumns({"report_type": F.lit(" Analyze-Data"), "level": F.lit("")})
    return rows.select("seq", "job_key", leases.job_key(report=True).alias("report_key"))


STATUS_SQL = """WITH t AS (SELECT concat('t', event_id) AS task_id, concat('u', user_id) AS dataset_id, ts
 AS triggered_at FROM events), c AS (SELECT concat('t', event_id) AS task_id, value <= 100 AS success,
 ts + to_seconds(floor(value * 100)::BIGINT) AS completed_at FROM events WHERE event_type <> 'error'
 UNION ALL SELECT concat('t', event_id), true, ts + INTERVAL 10 HOURS FROM events WHERE {again})
SELECT t.task_id, dataset_id, triggered_at, completed_at, CASE WHEN success THEN 'success' WHEN NOT success THEN
 'failure' ELSE 'open' END AS status, coalesce((epoch_us(completed_at) - epoch_us(triggered_at)) / 1e6, -1.0) AS latency
 FROM t LEFT JOIN {done} c ON c.task_id = t.task_id {bound}"""


def _both_ends(spark, sf, again="false"):
    """Triggers and completions; the tasks of ``again`` are reported once more after ten hours."""
    e = table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    triggers = e.select(F.concat(F.lit("t"), "event_id").alias("task_id"),
                        F.concat(F.lit("u"), "user_id").alias("dataset_id"), ts.alias("timestamp"))
    done = e.where("event_type <> 'error'").select(
        F.concat(F.lit("t"), "event_id").alias("task_id"), (F.col("value") <= 100).alias("success"),
        (ts + F.make_dt_interval(secs=F.floor(F.col("value") * 100))).alias("timestamp"))
    late = e.where(again).select(F.concat(F.lit("t"), "event_id").alias("task_id"), F.lit(True).alias("success"),
                                 (ts + F.expr("interval 10 hours")).alias("timestamp"))
    return triggers, done.union(late)


def _status(out):
    return out.select("task_id", "dataset_id", F.col("triggered_at").cast("timestamp_ntz").alias("triggered_at"),
                      F.col("completed_at").cast("timestamp_ntz").alias("completed_at"), "status",
                      F.coalesce("latency_seconds", F.lit(-1.0)).alias("latency"))


AGAIN = "event_id % 7 = 0"
DONE_SQL = "(SELECT task_id, arg_max(success, completed_at) AS success, max(completed_at) AS completed_at FROM c GROUP BY task_id)"


@query("pipeline_status", STATUS_SQL.format(again=AGAIN, done=DONE_SQL, bound=""))
def pipeline_status(spark, sf):
    return _status(flow.pipeline_status(*_both_ends(spark, sf, AGAIN)))


@query("pipeline_status_stream", STATUS_SQL.format(
    again="false", done="c", bound="AND completed_at <= triggered_at + INTERVAL 6 HOURS"))
def pipeline_status_stream(spark, sf):
    """A closing row on both sides, long after the last event, lets the watermark pass every open task.

    Its key is no task's and never null: rows with a null join key are dropped before they can move the watermark.
    """
    triggers, done = _both_ends(spark, sf)
    return _status(status_of_streams(triggers, done))


def status_of_streams(triggers, done):
    """Pipeline status of two finished tables read as streams, with every task that is still open."""
    end = triggers.select("timestamp").union(done.select("timestamp")).agg(
        (F.max("timestamp") + F.expr("interval 90 days")).alias("timestamp"))
    streams = [as_stream(triggers, files_per_trigger=100, last=end.select(
                   F.lit(NO_TASK + "triggered").alias("task_id"), F.lit(None).cast("string").alias("dataset_id"), "timestamp")),
               as_stream(done, files_per_trigger=100, last=end.select(
                   F.lit(NO_TASK + "completed").alias("task_id"), F.lit(True).alias("success"), "timestamp"))]
    return run_available(flow.pipeline_status(*streams)).where(~F.col("task_id").startswith(NO_TASK))


@query("stage_reached", f"""WITH s AS (SELECT user_id::VARCHAR AS user_id, concat('d', floor(value)::INT) AS dataset_id,
 list_position(['dataset.uploaded', 'bias-detection-complete', 'automl-complete', 'concept-drift-complete',
 'xai-complete'], {STAGE_SQL}) AS n FROM events)
SELECT user_id, dataset_id, max(n)::BIGINT AS stage_no, ['dataset.uploaded', 'bias-detection-complete',
 'automl-complete', 'concept-drift-complete', 'xai-complete'][max(n)] AS stage FROM s GROUP BY ALL""")
def stage_reached(spark, sf):
    return flow.stage_reached(stage_events(spark, sf))


@query("complete_events", """SELECT concat('t', event_id) AS key, concat('{"task_id":"t', event_id,
 '","event_type":"bias-detection-complete","timestamp":"', strftime(ts, '%Y-%m-%dT%H:%M:%S'), '","output":',
 CASE WHEN value <= 100 THEN concat('{"bias_report_id":"r', event_id, '","dataset_id":"d","dataset_version":"v1","user_id":"',
 user_id, '"},"failure":null}') ELSE
 'null,"failure":{"error_type":"BiasDetectionError","error_message":"Bias detection failed"}}' END) AS value
 FROM events""")
def complete_events(spark, sf):
    results = table(spark, sf, "events").select(
        F.concat(F.lit("t"), "event_id").alias("task_id"), F.col("ts").alias("timestamp"),
        (F.col("value") <= 100).alias("success"), F.concat(F.lit("r"), "event_id").alias("bias_report_id"),
        F.lit("d").alias("dataset_id"), F.lit("v1").alias("dataset_version"),
        F.col("user_id").cast("string").alias("user_id"))
    return flow.complete_events(results, "bias")


@query("upload_job_progress", """SELECT user_id AS job_id, event_type AS phase, event_id AS processed_files,
 round(event_id / 1000000.0, 9) AS share_done FROM events QUALIFY row_number() OVER (PARTITION BY user_id
 ORDER BY ts DESC, event_id DESC) = 1""")
def upload_job_progress(spark, sf):
    progress = table(spark, sf, "events").select(
        F.col("user_id").alias("job_id"), F.col("event_type").alias("phase"), F.col("event_id").alias("processed_files"),
        F.lit(1000000).alias("total_files"), F.col("ts").alias("updated_at"))
    out = flow.upload_job_progress(progress)
    return out.select("job_id", "phase", "processed_files", F.round("share_done", 9).alias("share_done"))


@query("complete_drift_events", """SELECT concat('t', event_id) AS key, concat('{"task_id":"t', event_id,
 '","event_type":"concept-drift-complete","timestamp":"', strftime(ts, '%Y-%m-%dT%H:%M:%S'),
 '","output":{"model_id":"m","model_version":"v1","dataset_id":"d","dataset_version":"v1","user_id":"', user_id,
 '","drift_detected":', CASE WHEN value > 20 THEN 'true,"message":null' ELSE 'false,"message":"No concept drift detected"' END,
 ',"drift_metrics":{"total_drifts":', floor(value)::BIGINT, '}},"failure":', CASE WHEN value <= 100 THEN 'null}' ELSE
 '{"error_type":"ConceptDriftError","error_message":"Concept drift retraining failed"}}' END) AS value FROM events""")
def complete_drift_events(spark, sf):
    results = table(spark, sf, "events").select(
        F.concat(F.lit("t"), "event_id").alias("task_id"), F.col("ts").alias("timestamp"),
        (F.col("value") <= 100).alias("success"), F.lit("m").alias("model_id"), F.lit("v1").alias("model_version"),
        F.lit("d").alias("dataset_id"), F.lit("v1").alias("dataset_version"), F.col("user_id").cast("string").alias("user_id"),
        (F.col("value") > 20).alias("drift_detected"),
        F.struct(F.floor("value").cast("long").alias("total_drifts")).alias("drift_metrics"))
    return flow.complete_events(results, "drift")
