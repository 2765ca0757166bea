"""Helpers of the operators: Arrow slices of bounded size, words and 64-bit hashes as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Members of a bucket that meet in one group; larger buckets are cut into blocks and every pair of blocks is a group.
BLOCK = 1024
#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 8 << 20
_PRIME = U64(0x9E3779B97F4A7C15)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def held_out(doc_id: Column) -> Column:
    """The fifth of the rows that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names; every other column is pruned, so none can clash."""
    small_batches(df.sparkSession)
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` between Spark and its Python workers, for this session.

    Spark's own limit is 64 MB; with several workers and copies on both sides that adds up to most of a small executor.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(key).lower().rstrip("b")
    if not given.isdigit() or int(given) > BATCH_BYTES:  # Spark's default has a unit
        spark.conf.set(key, str(BATCH_BYTES))


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Batches of about ``limit`` bytes of ``column``, at least one row each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in one array, and where each row begins and ends; null counts as empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def byte_class(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(members, np.uint8)] = True
    return table


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of word bytes that stays inside a row, and the first word of each row."""
    inside = is_word[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums of a polynomial over the bytes, modulo 2**64; see ``span_hash``."""
    global _powers
    if len(_powers[0]) <= len(data):
        n = len(data) * 5 // 4 + 16
        inverse = U64(pow(int(_PRIME), -1, 1 << 64))
        _powers = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(n, p, U64)]))
                        for p in (_PRIME, inverse))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * _powers[0][:len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes in [start, end), the same wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _powers[1][starts] + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of ``range(start, start + count)`` for all pairs."""
    total = int(counts.sum())
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return np.arange(total, dtype=np.int64) + shift


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows with equal (integer) keys from batches that are sorted by them; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        change[0] = bool(held) and any(held[-1][k][-1].as_py() != batch[k][0].as_py() for k in keys)
        borders = np.flatnonzero(change)
        start = 0
        for stop in borders.tolist():
            if stop > start:
                held.append(batch.slice(start, stop - start))
            if held:
                yield pa.Table.from_batches(held)
            held, start = [], stop
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def blocked(buckets: DataFrame, size: int = BLOCK, block_bytes: int = 1 << 24) -> DataFrame:
    """``low, high, block, blocks`` added to (bucket, id, size of the bucket): the pairs of blocks a member meets in.

    A bucket of up to ``size`` members is one group; a larger one is cut by a hash of the ids into blocks, and each
    pair of blocks is a group of at most about two blocks, so memory is bounded and all pairs still meet. A column ``bytes``,
    the bytes of all members of the bucket, also cuts buckets of more than ``block_bytes``.
    """
    blocks = F.ceil(F.col("size") / F.lit(size))
    if "bytes" in buckets.columns:
        blocks = F.greatest(blocks, F.ceil(F.col("bytes") / F.lit(block_bytes)))
    return (buckets.withColumn("blocks", blocks.cast("int"))
            .withColumn("block", F.expr("CASE WHEN blocks = 1 THEN 0 ELSE int(pmod(xxhash64(id, bucket), blocks)) END"))
            .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
            .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
            .drop("other", "size", "bytes"))
