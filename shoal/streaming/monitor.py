"""Drift monitoring on a stream of errors, one small state per key."""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.functions.adwin import DriftMonitor
from shoal.streaming.ordered import Machine, in_order

OUT = ("key string, row_index long, seq long, window_size long, mean_error_so_far double, late_rows long")


class Monitor(Machine):
    """The window's histogram and some counters. A row whose number is not beyond the last one seen is late."""

    def __init__(self, window: int, delta: float, min_samples: int, cooldown: int):
        self.monitor, self.last, self.late, self.told = DriftMonitor(window, delta, min_samples, cooldown), None, 0, 0

    def load(self, monitor, last, late):
        self.monitor.restore(json.loads(monitor))
        self.last, self.late, self.told = last, late, late

    def dump(self):
        return json.dumps(self.monitor.dump()), self.last, self.late

    def take(self, seq, error):
        if self.last is not None and seq <= self.last:
            self.late += 1
            return []
        self.last = seq
        hit = self.monitor.add(error)
        if hit is None:
            return []
        self.told = self.late
        return [(hit[0], seq, hit[1], hit[2], self.late)]

    def feed(self, seq, error):
        return self.take(seq, error)

    def end(self):
        """Late rows that no alarm of the batch tells of."""
        return [(None, self.last, None, None, self.late)] if self.late > self.told else []


class TimedMonitor(Monitor):
    """The same in event time."""

    def feed(self, at, seq, error):
        return self.take(seq, error)


def stream_drift_monitor(
    errors: DataFrame, key: str, seq: str, error: str, window: int = 150, delta: float = 0.1, min_samples: int = 50,
    cooldown: int = 50,
) -> DataFrame:
    """Alarms of each key as its rows arrive. A row whose ``seq`` is not beyond the last one of an earlier micro-batch is late:
    it is counted and left out; late rows that no alarm of their batch tells of are told by a row without alarm (null
    ``row_index``). Rows without number or error are left out. The state is the window's histogram and some counters."""
    errors = errors.where(F.col(seq).isNotNull() & F.col(error).isNotNull())
    return in_order(errors, F.col(key).cast("string"), {"seq": (F.col(seq), "long"), "error": (F.col(error), "double")}, _STATE, OUT,
                    functools.partial(Monitor, window, delta, min_samples, cooldown), width=8192)


def ordered_drift_monitor(
    errors: DataFrame, key: str, event_time: str, seq: str | Column, error: str, window: int = 150, delta: float = 0.1,
    min_samples: int = 50, cooldown: int = 50, delay: str = "10 minutes",
) -> DataFrame:
    """Alarms of each key in the order of event time (to the millisecond) and ``seq``, which must ascend with it, whatever
    the order in which rows arrive: a row waits until the watermark has come to it. Only rows that come after the watermark are
    late; Spark counts them (``ordered.late_rows``)."""
    errors = errors.where(F.col(event_time).isNotNull() & F.col(error).isNotNull())
    columns = {"at": (F.unix_millis(event_time), "long"), "seq": (F.col(seq) if isinstance(seq, str) else seq, "long"),
               "error": (F.col(error), "double")}
    return in_order(errors, F.col(key).cast("string"), columns, _STATE, OUT,
                    functools.partial(TimedMonitor, window, delta, min_samples, cooldown), 3_600_000, event_time, delay)


_STATE = "monitor string, last long, late long"
