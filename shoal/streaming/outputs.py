"""Two outputs of one read of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from shoal.streaming.events import accepted, rejected, validate_triggers

OUTPUTS = ("accepted", "rejected")


def split_triggers(events: DataFrame, kind: str, path: str, written: Callable[[int, str], None] | None = None) -> StreamingQuery:
    """Starts a query that writes good triggers to ``accepted`` and failure events of the others to ``rejected``.

    A batch is read and checked once, into a folder of its own; both outputs are written from that, each under the number of
    the batch. A batch that is run again after a failure replaces what it wrote, so every trigger is there once.
    ``written`` is told of each output as it's done.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark, folder = batch.sparkSession, f"batch={number}"
        validate_triggers(batch, kind).write.mode("overwrite").parquet(f"{path}/checked/{folder}")
        checked = spark.read.parquet(f"{path}/checked/{folder}")
        for name, rows in zip(OUTPUTS, (accepted(checked), rejected(checked, kind))):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/{folder}")
            if written:
                written(number, name)

    return (events.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True).start())


def outputs(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """What ``split_triggers`` has written: accepted triggers and failure events, with the number of their ``batch``."""
    return tuple(spark.read.parquet(f"{path}/{name}") for name in OUTPUTS)
