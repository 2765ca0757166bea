"""Repeated byte strings by suffix sorting of the places where repeats can be."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import U64, blocked, expand, flat, grouped, mix, only, prefix_sums, sliced, span_hash
from shoal.session import materialize

#: Bytes of contexts that are sorted together.
SORT_BYTES = 1 << 19
#: Contexts of one anchor that are sorted in one group; more are spread over pairs of blocks.
GROUP = 256


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values, from minima up to and from block borders."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, ~U64(0))
    padded[:n] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    last = np.arange(n - width + 1)
    return np.minimum(back[last], ahead[last + width - 1])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """The anchor of a string of ``length`` bytes is its gram of least hash, the leftmost of equals: equal strings have
    equal anchors at the same place. For every run of neighbouring strings of a row with the same anchor: row, hash of
    the gram, hash of all bytes of the run with the anchor's place in it, and first and last start in the row."""
    width = length - gram + 1
    starts_in = np.maximum(np.diff(offsets) - length + 1, 0)
    if not starts_in.any():
        return (np.zeros(0, np.int64),) * 5
    sums = prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    grams = span_hash(sums, at, at + gram)
    low = U64(max(1, int(len(data)).bit_length()))
    ranked = (grams >> low << low) | at.astype(U64)
    least = window_minima(ranked, width) & ((U64(1) << low) - U64(1))
    start = expand(offsets[:-1], starts_in)
    row = np.repeat(np.arange(len(starts_in)), starts_in)
    anchor = least[start].astype(np.int64)
    change = np.ones(len(start), bool)
    change[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
    a = np.flatnonzero(change)
    b = np.concatenate([a[1:], [len(start)]]) - 1
    first, last, place = start[a], start[b], anchor[a]
    whole = mix(span_hash(sums, first, last + length) + (place - first).astype(U64) * U64(0x9FB21C651E98DF25))
    return row[a], grams[place], whole, first - offsets[row[a]], last - offsets[row[a]]


def two_stage_order(data: bytes, begins: np.ndarray, ends: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Sorted starts of the wanted suffixes, each running to the end of its context ``[begin, end)``.

    A suffix is of type B if it is smaller than its successor (the one that starts a byte later), else of type A. Only
    type B is sorted directly. Type A is induced: going up the buckets of the first byte, a bucket's type A suffixes come
    first, in the order of their successors, which stand in earlier buckets or earlier in the same one.
    ``wanted`` marks starts; suffixes that these are induced from are added on the way and left out at the end.
    """
    text = np.frombuffer(data, np.uint8).astype(np.int16)
    n = len(text)
    following = np.full(n, -1, np.int16)
    following[:-1] = text[1:]
    following[ends - 1] = -1  # a context's end is smaller than any byte
    index = np.arange(n)
    differs = np.where(text != following, index, n)
    differs = np.minimum.accumulate(differs[::-1])[::-1]  # the next place where a byte differs from its successor
    rising = text[differs] < following[differs]
    next_rising = np.minimum.accumulate(np.where(rising, index, n)[::-1])[::-1]
    context_end = np.repeat(ends, ends - begins)
    # every wanted suffix needs its successors up to the first of type B
    reach = np.minimum(next_rising, context_end - 1)
    depth = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(wanted)
    np.add.at(depth, at, 1)
    np.add.at(depth, reach[at] + 1, -1)
    needed = np.cumsum(depth)[:-1] > 0

    direct = np.flatnonzero(needed & rising)
    keys = [data[i:e] for i, e in zip(direct.tolist(), context_end[direct].tolist())]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)] if len(keys) else direct
    del keys
    induced = np.flatnonzero(needed & ~rising)
    by_byte = np.argsort(text[induced], kind="stable")
    induced = induced[by_byte]
    induced_at = np.searchsorted(text[induced], np.arange(257))
    direct_at = np.searchsorted(text[direct], np.arange(257))
    rank = np.full(n + 1, -1, np.int64)
    order, done = [], 0
    for byte in range(256):
        bucket = induced[induced_at[byte]:induced_at[byte + 1]]
        if len(bucket):
            wave = bucket[following[bucket] < byte]
            ended = following[wave] < 0
            wave = wave[np.argsort(np.where(ended, -1, rank[wave + 1]), kind="stable")]
            while len(wave):  # runs of one byte, one byte longer each time
                rank[wave] = done + np.arange(len(wave))
                done += len(wave)
                order.append(wave)
                wave = wave[wave > 0] - 1
                wave = wave[needed[wave] & (text[wave] == byte) & (following[wave] == byte)]
        bucket = direct[direct_at[byte]:direct_at[byte + 1]]
        rank[bucket] = done + np.arange(len(bucket))
        done += len(bucket)
        order.append(bucket)
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    return order[wanted[order]]


def repeated_starts(data: bytes, begins: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Starts, with ``length`` bytes of context after them, whose first ``length`` bytes are those of another start.

    Equal strings are neighbours in the suffix order, so common prefixes of neighbours suffice."""
    wanted = np.zeros(len(data), bool)
    wanted[expand(begins, np.maximum(ends - begins - length + 1, 0))] = True
    order = two_stage_order(data, begins, ends, wanted).tolist()
    found, before = set(), None
    for at, this in zip(order, (data[i:i + length] for i in order)):
        if this == before:
            found.add(at)
            found.add(last)  # noqa: F821 - set in the round before
        before, last = this, at
    return np.array(sorted(found), np.int64)


def _anchored(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            data, offsets = flat(batch["text"])
            row, h, whole, first, last = anchors(data, offsets, length, gram)
            yield pa.RecordBatch.from_arrays(
                [batch["key"].take(pa.array(row)), pa.array(h.view(np.int64)), pa.array(whole.view(np.int64)),
                 pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["key", "anchor", "whole", "first", "last"])
    return run


def _contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, members in zip(*(batch[c].to_pylist() for c in ("key", "text", "members"))):
                if members:
                    data = text.encode()
                    yield pa.RecordBatch.from_pydict({
                        "key": pa.array([key] * len(members), pa.binary()),
                        "bucket": pa.array([m["anchor"] for m in members], pa.int64()),
                        "id": pa.array([m["place"] for m in members], pa.int64()),
                        "first": pa.array([m["first"] for m in members], pa.int32()),
                        "context": pa.array([data[m["first"]:m["last"] + length] for m in members], pa.binary())})
    return run


def _sorter(length: int):
    """Sorts the contexts of many groups at once; pairs of blocks, which share contexts, one by one."""
    def solve(tables: list[pa.Table]) -> pa.RecordBatch:
        whole = pa.concat_tables(tables)
        contexts = whole["context"].to_pylist()
        size = np.array([len(x) for x in contexts], np.int64)
        ends = np.cumsum(size)
        starts = repeated_starts(b"".join(contexts), ends - size, ends, length)
        row = np.searchsorted(ends, starts, "right")
        first = whole["first"].to_numpy()[row] + starts - (ends - size)[row]
        # neighbouring starts of one context make one run
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (first[1:] != first[:-1] + 1)
        a = np.flatnonzero(new)
        b = np.concatenate([a[1:], [len(row)]])[:len(a)] - 1
        return pa.RecordBatch.from_arrays(
            [whole["key"].combine_chunks().take(pa.array(row[a], pa.int64())),
             pa.array(first[a], pa.int32()), pa.array(first[b] + length, pa.int32())], ["key", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for group in grouped(batches, ["bucket", "low", "high"]):
            if group.num_rows < 2:
                continue
            if group["blocks"][0].as_py() > 1:
                yield solve([group])
                continue
            held.append(group)
            size += group["context"].nbytes
            if size >= SORT_BYTES:
                yield solve(held)
                held, size = [], 0
        if held:
            yield solve(held)
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the bytes that their runs cover; runs that touch are one."""
    for batch in batches:
        removed, spans, kept, hashes, found = [], [], [], [], []
        for text, runs in zip(batch["text"].to_pylist(), batch["runs"].to_pylist()):
            data, merged = text.encode(), []
            for start, stop in sorted((r["start"], r["stop"]) for r in runs):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], stop)
                else:
                    merged.append([start, stop])
            edges = [0, *(x for run in merged for x in run), len(data)]
            rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            removed.append(len(data) - len(rest))
            spans.append(len(merged))
            kept.append(rest)
            hashes.append(hashlib.sha256(rest).hexdigest())
            found.append([x for run in merged for x in run])
        yield pa.RecordBatch.from_arrays(
            [batch["key"], pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(hashes, pa.string()),
             pa.array(found, pa.list_(pa.int64()))], ["key", "n_removed", "n_spans", "kept_sha256", "removed"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 100,
                   block: int = GROUP) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed`` for every row: bytes that are part of a string of
    ``length`` bytes that also starts anywhere else. ``removed`` are the removed runs (start, end, start, end, ...).

    Sorting all suffixes of a corpus is out of reach, and most of them are like no other. Equal strings have equal
    anchors (see ``anchors``), so only strings whose anchor occurs elsewhere can repeat; anchors are found where the texts
    are read, about one for 150 bytes, and their counts are aggregated before the shuffle. Where the whole context of
    an anchor (all strings that it stands for) occurs twice, all of it is repeated. What is left are contexts that
    share an anchor but differ, the borders of repeats: one context of each kind is sent to its anchor's group, and there
    the suffixes are sorted in two stages and neighbours compared byte by byte. Groups larger than a block are
    spread over pairs of blocks. Copies of whole texts are one text: they are only counted.

    Null and empty texts have no bytes; ids may be null or repeated (each row is a place of its own); other
    columns are not read.
    """
    rows = (only(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
            .withColumn("sha", F.sha2("text", 256)).withColumn("key", F.unhex(F.substring("sha", 1, 32))))
    n_bytes = F.octet_length("text")
    place = F.xxhash64("key", "first")
    runs = rows.where(n_bytes >= length).select("key", "text").mapInArrow(
        _anchored(length, gram), "key binary, anchor long, whole long, first int, last int").withColumn("place", place)
    repeated = materialize(runs.groupBy("anchor").agg(
        F.min("place").alias("a"), F.max("place").alias("b"), F.min("whole").alias("c"), F.max("whole").alias("d"))
        .where("a != b").selectExpr("anchor", "c != d AS mixed"), "anchors")
    found = materialize(runs.join(repeated, "anchor").distinct(), "runs")
    wholes = materialize(found.groupBy("anchor", "whole").agg(F.min("place").alias("one"), F.max("place").alias("b"))
                         .selectExpr("anchor", "whole", "one", "one != b AS same"), "wholes")
    judged = found.join(wholes, ["anchor", "whole"]).selectExpr(
        "key", f"CASE WHEN same THEN struct(first AS start, last + {length} AS stop) END AS run",
        "CASE WHEN mixed AND place = one THEN struct(anchor, place, first, last) END AS member")
    by_text = judged.groupBy("key").agg(F.collect_list("run").alias("runs"), F.collect_list("member").alias("members"))
    texts = rows.where(n_bytes >= length).groupBy("key").agg(F.first("text").alias("text"))
    involved = materialize(texts.join(by_text, "key"), "involved")
    members = materialize(involved.select(F.explode("members.anchor").alias("bucket")).groupBy("bucket").agg(
        F.count("*").alias("size")).where("size > 1"), "groups")
    contexts = involved.where("size(members) > 0").mapInArrow(
        _contexts(length), "key binary, bucket long, id long, first int, context binary").join(members, "bucket")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the work is sorting: not to be dealt by bytes
    sorted_runs = materialize(
        blocked(contexts, block).select("bucket", "low", "high", "block", "blocks", "key", "first", "context")
        .repartition(tasks, "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
        .mapInArrow(_sorter(length), "key binary, start int, stop int"), "sorted")
    more = sorted_runs.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("more"))
    cut = materialize(
        involved.select("key", "text", "runs").join(more, "key", "left")
        .select("key", "text", F.expr("concat(runs, coalesce(more, array()))").alias("runs")).where("size(runs) > 0")
        .mapInArrow(_cut, "key binary, n_removed long, n_spans long, kept_sha256 string, removed array<long>"), "cut")
    measured = rows.select("doc_id", "key", "sha", n_bytes.cast("long").alias("n_bytes"))
    copied = materialize(measured.where(F.col("n_bytes") >= length).groupBy("key").count().where("count > 1").select("key"), "copied")
    return (measured.join(cut, "key", "left").join(copied.withColumn("copied", F.lit(True)), "key", "left")
            .selectExpr("doc_id", "n_bytes",
                        "CASE WHEN copied THEN n_bytes ELSE coalesce(n_removed, 0L) END AS n_removed",
                        "CASE WHEN copied THEN 1L ELSE coalesce(n_spans, 0L) END AS n_spans",
                        "CASE WHEN copied THEN sha2('', 256) ELSE coalesce(kept_sha256, sha) END AS kept_sha256",
                        "CASE WHEN copied THEN array(0L, n_bytes) ELSE coalesce(removed, array()) END AS removed"))
