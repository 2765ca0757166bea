"""Running a stream over everything that is there, into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shoal.session import fresh_path


def run_available(stream: DataFrame, label: str = "stream", mode: str = "append", progress: list | None = None) -> DataFrame:
    """Process all available input, then stop; the result as a table. ``progress`` gets what Spark told of each batch."""
    spark = stream.sparkSession
    path = fresh_path(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path + "/rows")
        .option("checkpointLocation", path + "/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress
    return spark.read.schema(stream.schema).parquet(path + "/rows")


def as_stream(table: DataFrame, label: str = "input", files_per_trigger: int = 2, last: DataFrame | None = None) -> DataFrame:
    """A table written out and read back as a stream of its files; ``last`` is written after it, in a file of its own."""
    path = fresh_path(table.sparkSession, label)
    table.write.parquet(path)
    if last is not None:
        last.write.mode("append").parquet(path)
    reader = table.sparkSession.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)
