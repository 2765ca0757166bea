"""A message log in a folder as a stream source and sink with offsets: keyed messages, partitions, commits by batch."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage)
from pyspark.sql.types import StructType

from shoal.sources.files import file_system, opened

SCHEMA = "partition int, offset long, key string, value string"


@dataclass
class Segment(InputPartition):
    """Neighbouring messages of a partition, from one file."""

    file: str
    partition: int
    first: int
    skip: int
    take: int


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: partition, name and number of messages."""

    files: list


class Log:
    """A folder with ``data`` (files of JSON lines) and ``commits`` (one file per batch, which names the batch's files).

    Only files that a commit names are part of the log. The offsets of a partition follow the order of the commits.
    """

    def __init__(self, path: str, partitions: int = 4):
        self.path, self.partitions = path.rstrip("/"), partitions

    def commits(self) -> list[tuple[int, list]]:
        """Batch and files of every commit, in order."""
        system, folder = file_system(f"{self.path}/commits")
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        names = sorted(f.base_name for f in found if f.base_name.endswith(".json"))
        out = []
        for name in names:
            with system.open_input_file(f"{folder}/{name}") as file:
                out.append((int(name.removesuffix(".json")), json.loads(file.read())))
        return out

    def segments(self) -> list[Segment]:
        sizes, out = {}, []
        for _, files in self.commits():
            for partition, name, count in files:
                first = sizes.get(partition, 0)
                out.append(Segment(name, partition, first, 0, count))
                sizes[partition] = first + count
        return out

    def end(self) -> dict[str, int]:
        sizes = {str(p): 0 for p in range(self.partitions)}
        for s in self.segments():
            sizes[str(s.partition)] = s.first + s.take
        return sizes

    def between(self, start: dict, end: dict) -> list[Segment]:
        out = []
        for s in self.segments():
            first, stop = max(s.first, start.get(str(s.partition), 0)), min(s.first + s.take, end.get(str(s.partition), 0))
            if first < stop:
                out.append(Segment(s.file, s.partition, first, first - s.first, stop - first))
        return out

    def read(self, part: Segment) -> Iterator[tuple]:
        with opened(f"{self.path}/data/{part.file}") as file:
            for number, line in enumerate(_lines(file)):
                if number >= part.skip + part.take:
                    return
                if number >= part.skip:
                    key, value = json.loads(line)
                    yield part.partition, part.first + number - part.skip, key, value


def _lines(file) -> Iterator[bytes]:
    """Lines of a stream, a megabyte at a time."""
    rest = b""
    while piece := file.read(1 << 20):
        *lines, rest = (rest + piece).split(b"\n")
        yield from lines
    if rest:
        yield rest


class MessageLog(DataSource):
    """``spark.readStream.format("message_log")`` and ``writeStream``; options ``path`` and ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return SCHEMA

    def _log(self) -> Log:
        return Log(self.options["path"], int(self.options.get("partitions", 4)))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Whole(self._log())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Growing(self._log())

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _Appending(self._log(), schema.names)


class _Whole(DataSourceReader):
    def __init__(self, log: Log):
        self.log = log

    def partitions(self) -> list[Segment]:
        return self.log.segments() or [Segment("", 0, 0, 0, 0)]

    def read(self, partition: Segment) -> Iterator[tuple]:
        return self.log.read(partition) if partition.take else iter(())


class _Growing(DataSourceStreamReader):
    """Offsets are the number of messages taken of each partition; a batch takes all that are committed."""

    def __init__(self, log: Log):
        self.log = log

    def initialOffset(self) -> dict:
        return {str(p): 0 for p in range(self.log.partitions)}

    def latestOffset(self) -> dict:
        return self.log.end()

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return self.log.between(start, end)

    def read(self, partition: Segment) -> Iterator[tuple]:
        return self.log.read(partition)

    def commit(self, end: dict) -> None:
        """Messages stay in the log."""


class _Appending(DataSourceStreamWriter):
    """Tasks write files under names of their own; the commit of a batch names them in one file. A batch that is written
    again, after a failure, finds its commit and adds nothing; files of attempts that failed stay unnamed."""

    def __init__(self, log: Log, names: list[str]):
        self.log, self.key, self.value = log, names.index("key"), names.index("value")

    def write(self, iterator) -> Written:
        system, folder = file_system(f"{self.log.path}/data")
        system.create_dir(folder)
        attempt, out, counts = uuid.uuid4().hex, {}, {}
        try:
            for row in iterator:
                key, value = row[self.key], row[self.value]
                partition = zlib.crc32((key or "").encode()) % self.log.partitions
                if partition not in out:
                    out[partition] = system.open_output_stream(f"{folder}/{partition}-{attempt}.jsonl")
                    counts[partition] = 0
                out[partition].write(json.dumps([key, value]).encode() + b"\n")
                counts[partition] += 1
        finally:
            for file in out.values():
                file.close()
        return Written([[p, f"{p}-{attempt}.jsonl", n] for p, n in counts.items()])

    def commit(self, messages: list, batchId: int) -> None:
        system, folder = file_system(f"{self.log.path}/commits")
        system.create_dir(folder)
        target = f"{folder}/{batchId:012d}.json"
        if system.get_file_info(target).type != fs.FileType.NotFound:
            return
        files = sorted(f for m in messages if m is not None for f in m.files)
        unnamed = f"{folder}/.{uuid.uuid4().hex}"
        with system.open_output_stream(unnamed) as file:
            file.write(json.dumps(files).encode())
        system.move(unnamed, target)

    def abort(self, messages: list, batchId: int) -> None:
        """Nothing is part of the log before its commit."""


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MessageLog)


def read_log(spark: SparkSession, path: str, partitions: int = 4):
    """The messages of a log as a stream: partition, offset, key, value."""
    register(spark)
    return spark.readStream.format("message_log").options(path=path, partitions=partitions).load()


def append_log(messages, path: str, checkpoint: str, partitions: int = 4):
    """A query that appends the messages (key, value) of a stream; each once, however often it is started again."""
    register(messages.sparkSession)
    return (messages.select("key", "value").writeStream.format("message_log").options(path=path, partitions=partitions)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
