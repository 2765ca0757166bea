"""Leases on jobs: who may work on a job key, decided in event time.

A claim on a free key is granted. While the holder is fresh nobody gets it; the holder's own task may take a
lease back once it is not fresh, another task only once it is stale. A completed job is never granted again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoal.operators.drift import scan_series
from shoal.streaming.ordered import Machine, in_order

# Seconds since the last sign of life.
FRESH_SECONDS, STALE_SECONDS = 120, 300
# Spellings of a report on data rather than on a model.
DATA_REPORTS = ("data_explanation", "data", "analyze_data", "driver_data")


def job_key(*fields: str, report: bool = False) -> Column:
    """``user|dataset|version|model|version`` with v1 for absent versions; reports add type and level."""
    names = fields or ("user_id", "dataset_id", "dataset_version", "model_id", "model_version")
    defaults = ("", "", "v1", "", "v1")
    parts = [F.coalesce(F.nullif(F.col(n), F.lit("")), F.lit(d)) for n, d in zip(names, defaults)]
    if report:
        kind = F.replace(F.lower(F.trim(F.coalesce("report_type", F.lit("")))), F.lit("-"), F.lit("_"))
        parts.append(F.when(kind.isin(*DATA_REPORTS), "data_explanation").otherwise("model_explanation"))
        parts.append(F.coalesce(F.nullif(F.col("level"), F.lit("")), F.lit("beginner")))
    return F.concat_ws("|", *parts)


class Lease:
    """State of one job key: holder, status, last sign of life (seconds)."""

    def __init__(self, task: str | None = None, status: str = "", alive: float = 0.0):
        self.task, self.status, self.alive = task, status, alive

    def apply(self, op: str, task: str, at: float) -> str:
        if op == "claim":
            return self._claim(task, at)
        if self.task != task:
            return "not_found"
        if op == "release":
            self.task, self.status = None, ""
            return "released"
        if self.status != "in_progress":
            return "not_found"
        if op == "complete":
            self.status = "completed"
            return "completed"
        self.alive = at
        return "alive"

    def _claim(self, task: str, at: float) -> str:
        outcome = "granted"
        if self.task is not None:
            age = max(0.0, at - self.alive)
            if self.status == "completed":
                return "rejected_completed"
            if self.task == task:
                if age < FRESH_SECONDS:
                    return "rejected_in_progress"
            elif age < STALE_SECONDS:
                return "rejected_claimed"
            outcome = "reclaimed"
        self.task, self.status, self.alive = task, "in_progress", at
        return outcome


def lease_claims(events: DataFrame) -> DataFrame:
    """Outcome of each event in a table of (job_key, seq, ts, op, task_id), in the order of ts and seq.

    Rows stream through sorted partitions; a task keeps one lease, whatever the number of events of a key.
    """
    rows = events.withColumn("at", F.col("ts").cast("timestamp").cast("double"))
    out = T.StructType([events.schema["job_key"], T.StructField("seq", T.LongType()),
                        T.StructField("task_id", T.StringType()), T.StructField("op", T.StringType()),
                        T.StructField("outcome", T.StringType())])
    return scan_series(rows, ["job_key"], ["at", "seq"], ["seq", "task_id", "op", "at"], out, Lease,
                       lambda lease, r: (int(r[0]), r[1], r[2], lease.apply(r[2], r[1], float(r[3]))))


class Claims(Machine):
    """A lease of a stream; times in microseconds."""

    def __init__(self):
        self.lease = Lease()

    def load(self, task, status, alive):
        self.lease = Lease(task, status, alive)

    def dump(self):
        return self.lease.task, self.lease.status, float(self.lease.alive)

    def feed(self, at, seq, op, task):
        return [(seq, task, op, self.lease.apply(op, task, at / 1e6))]


def stream_lease_claims(events: DataFrame) -> DataFrame:
    """The same on a stream: one small typed state per job key, the rows of a micro-batch in order."""
    columns = {"at": (F.unix_micros(F.col("ts").cast("timestamp")), "long"), "seq": (F.col("seq"), "long"),
               "op": (F.col("op"), "string"), "task": (F.col("task_id"), "string")}
    told = in_order(events, F.col("job_key"), columns, "task string, status string, alive double",
                    "key string, seq long, task_id string, op string, outcome string", Claims, width=3_600_000_000)
    return told.withColumnRenamed("key", "job_key")


# ---- the whole protocol: tasks bound to a job, leases that run out

LOG = "at long, seq long, task_id string, op string, outcome string"


class Binding(Machine):
    """A task belongs to the job key of its first claim until it's released; times in milliseconds."""

    def __init__(self):
        self.job = None

    def load(self, job):
        self.job = job

    def dump(self):
        return (self.job,)

    def feed(self, at, seq, op, job):
        refused = False
        if op == "claim":
            self.job = self.job or job
            refused = self.job != job
        elif op == "release":
            self.job = None
        return [(at, seq, op, job, refused)]


class ExpiringLease(Machine):
    """A lease that tells when its holder was last heard of too long ago; times in milliseconds.

    After ``FRESH_SECONDS`` without a sign of life it's ``idle``: the holder's own task may take it back. After
    ``STALE_SECONDS`` it's ``stale``: any task may. Each is told once, before a row of the same time.
    """

    STEPS = ((FRESH_SECONDS * 1000, "idle"), (STALE_SECONDS * 1000, "stale"))

    def __init__(self):
        self.lease, self.told = Lease(), 0

    def load(self, task, status, alive, told):
        self.lease, self.told = Lease(task, status, alive / 1000), told

    def dump(self):
        return self.lease.task, self.lease.status, int(round(self.lease.alive * 1000)), self.told

    def due(self):
        if self.lease.status != "in_progress" or self.told == len(self.STEPS):
            return None
        return int(round(self.lease.alive * 1000)) + self.STEPS[self.told][0]

    def until(self, at):
        out = []
        while (due := self.due()) is not None and due <= at:
            out.append((due, None, self.lease.task, "expire", self.STEPS[self.told][1]))
            self.told += 1
        return out

    def feed(self, at, seq, op, task, refused):
        if refused:
            return [(at, seq, task, op, "rejected_other_job")]
        outcome = self.lease.apply(op, task, at / 1000)
        if outcome in ("granted", "reclaimed", "alive"):
            self.told = 0
        return [(at, seq, task, op, outcome)]

    def end(self):
        return self.until(1 << 62)


def _fed(make: Callable[[], Machine], rows: DataFrame, key: str, columns: list[str], out: str) -> DataFrame:
    """What a machine per key tells of a table whose rows it sees in the order of ``columns``, to the end of time."""
    names = [x.split()[0] for x in out.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, machine = None, make()
        for batch in batches:
            found = []
            for name, row in zip(batch[key].tolist(), zip(*[batch[c].tolist() for c in columns])):
                if name != current:
                    found += [(current, *x) for x in machine.end()]
                    current, machine = name, make()
                found += [(current, *x) for x in (*machine.until(row[0]), *machine.feed(*row))]
            yield pd.DataFrame(found, columns=names, dtype=object)
        yield pd.DataFrame([(current, *x) for x in machine.end()], columns=names, dtype=object)

    return rows.select(key, *columns).repartition(key).sortWithinPartitions(key, *columns).mapInPandas(run, out)


def bind_tasks(events: DataFrame) -> DataFrame:
    """``task_id, at, seq, op, job_key, refused`` of a table of (job_key, seq, ts, op, task_id): a claim is refused while its
    task belongs to another job. Rows in the order of ts (in milliseconds) and seq; ids, keys and times must not be null."""
    rows = events.select("task_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "seq", "op", "job_key")
    return _fed(Binding, rows, "task_id", ["at", "seq", "op", "job_key"],
                "task_id string, at long, seq long, op string, job_key string, refused boolean")


def lease_log(events: DataFrame) -> DataFrame:
    """``job_key, at, seq, task_id, op, outcome``: what came of each event, and when leases became idle and stale (op
    ``expire``, no seq). First every task is bound to a job, then every job's lease is followed; each machine holds a few
    numbers, whatever the number of a key's rows."""
    rows = bind_tasks(events).withColumnRenamed("task_id", "task")
    return _fed(ExpiringLease, rows, "job_key", ["at", "seq", "op", "task", "refused"], f"job_key string, {LOG}")


def stream_bind_tasks(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """``bind_tasks`` on a stream, keyed by task: rows may come out of order by up to ``delay``."""
    columns = {"at": (F.unix_millis("ts"), "long"), "seq": (F.col("seq"), "long"), "op": (F.col("op"), "string"),
               "job": (F.col("job_key"), "string")}
    told = in_order(events, F.col("task_id"), columns, "job string",
                    "key string, at long, seq long, op string, job_key string, refused boolean", Binding, 60_000, "ts", delay)
    return told.select(F.col("key").alias("task_id"), "at", "seq", "op", "job_key", "refused",
                       F.timestamp_millis("at").alias("ts"))


def stream_lease_log(bound: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The leases of a stream of bound rows (see ``stream_bind_tasks``), keyed by job: a timer ends a lease whose holder
    is silent. The two are separate queries with a table between them, as each may only tell of what its watermark has passed."""
    columns = {n: (F.col(c), t) for n, c, t in (("at", "at", "long"), ("seq", "seq", "long"), ("op", "op", "string"),
                                               ("task", "task_id", "string"), ("refused", "refused", "boolean"))}
    told = in_order(bound, F.col("job_key"), columns, "task string, status string, alive long, told int", f"key string, {LOG}",
                    ExpiringLease, 60_000, "ts", delay)
    return told.withColumnRenamed("key", "job_key")
