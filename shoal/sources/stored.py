"""A keyed table in hash partitions with versions: an upsert rewrites only the partitions that it touches."""

from __future__ import annotations

import functools
import json
import os
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoal.operators.catalog import upsert
from shoal.session import materialize
from shoal.sources.files import file_system

BUCKET = "__bucket"


@dataclass(frozen=True)
class Version:
    """One state of the table: the folder of every hash partition that has rows."""

    number: int
    folders: dict[str, str]
    schema: T.StructType
    keys: list[str]
    buckets: int


def _create_once(path: str, content: bytes) -> bool:
    """Makes a file with its whole content, unless there is one: of two writers only one succeeds."""
    system, target = file_system(path)
    folder, name = target.rsplit("/", 1)
    system.create_dir(folder)
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as file:
        file.write(content)
    try:
        if isinstance(system, fs.LocalFileSystem):
            os.link(draft, target)
        elif isinstance(system, fs.HadoopFileSystem):
            system.move(draft, target)  # fails where the target exists
            return True
        else:
            raise NotImplementedError(f"no way to create a file only once in {system.type_name}")
    except (FileExistsError, OSError):
        if system.get_file_info(target).type == fs.FileType.NotFound:
            raise
        system.delete_file(draft)
        return False
    system.delete_file(draft)
    return True


class Stored:
    """A folder with ``data`` and ``versions``; a version is a file that names the folder of each hash partition.

    Readers see one version whole. A writer prepares the touched partitions in a new folder, then creates the next version's
    file. If another writer was faster, it takes that version over and tries the next number; if that one has rewritten a
    partition that it touched itself, it prepares its partitions again. So no row of either is lost.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _bucket(self, keys: Sequence[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int").alias(BUCKET)

    def version(self, number: int | None = None) -> Version:
        """The given version, or the newest one."""
        system, folder = file_system(f"{self.path}/versions")
        if number is None:
            found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
            numbers = [int(f.base_name.removesuffix(".json")) for f in found if f.base_name[0] != "."]
            if not numbers:
                raise ValueError(f"no table in {self.path}")
            number = max(numbers)
        with system.open_input_file(f"{folder}/{number:012d}.json") as file:
            told = json.loads(file.read())
        return Version(number, told["folders"], T.StructType.fromJson(told["schema"]), told["keys"], told["buckets"])

    def _commit(self, version: Version) -> bool:
        told = {"folders": version.folders, "schema": version.schema.jsonValue(), "keys": version.keys, "buckets": version.buckets}
        return _create_once(f"{self.path}/versions/{version.number:012d}.json", json.dumps(told).encode())

    def _write(self, rows: DataFrame, buckets: Sequence[int]) -> dict[str, str]:
        name = uuid.uuid4().hex
        rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{name}")
        return {str(b): f"{name}/{BUCKET}={b}" for b in buckets}

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())

    def create(self, rows: DataFrame, keys: Sequence[str], buckets: int = 64) -> int:
        """The first version. Keys are not null; ``buckets`` bounds what an upsert of one row rewrites."""
        placed = materialize(rows.select("*", self._bucket(keys, buckets)), "stored")
        folders = self._write(placed, self._touched(placed))
        if not self._commit(Version(1, folders, rows.schema, list(keys), buckets)):
            raise ValueError(f"there is a table in {self.path}")
        return 1

    def read(self, number: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of a version, of all or some hash partitions."""
        version = self.version(number)
        names = [f for b, f in version.folders.items() if buckets is None or int(b) in buckets]
        if not names:
            return self.spark.createDataFrame([], version.schema)
        return self.spark.read.schema(version.schema).parquet(*[f"{self.path}/data/{n}" for n in names])

    def find(self, **key) -> DataFrame:
        """The rows with the given whole key, from the one hash partition that can hold them."""
        version = self.version()
        one = self.spark.range(1).select(*[F.lit(key[k]).cast(version.schema[k].dataType).alias(k) for k in version.keys])
        bucket = one.select(self._bucket(version.keys, version.buckets)).first()[0]
        rows = self.read(version.number, [bucket])
        return rows.where(functools.reduce(lambda a, b: a & b, [F.col(k) == F.lit(key[k]) for k in version.keys]))

    def upsert(self, updates: DataFrame, before_commit: Callable[[], None] = lambda: None, **rules) -> int:
        """The newest update per key over the table (see ``catalog.upsert`` for the rules), as a new version."""
        first = self.version()
        placed = materialize(updates.select("*", self._bucket(first.keys, first.buckets)), "updates")
        touched = self._touched(placed)
        if not touched:
            return first.number
        while True:
            seen = self.version()
            old = self.read(seen.number, touched)
            new = upsert(old, placed.drop(BUCKET), seen.keys, **rules)
            folders = self._write(new.select("*", self._bucket(seen.keys, seen.buckets)), touched)
            before_commit()
            while True:
                now = self.version()
                if any(now.folders.get(str(b)) != seen.folders.get(str(b)) for b in touched):
                    break
                following = Version(now.number + 1, now.folders | folders, now.schema, now.keys, now.buckets)
                if self._commit(following):
                    return following.number

