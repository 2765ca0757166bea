"""Near-duplicate texts: SuperMinHash signatures, banding, verification on full sets, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import (
    BLOCK, U64, blocked, byte_class, expand, flat, grouped, lower, mix, only, prefix_sums, sliced, span_hash, words,
)
from shoal.llm.components import connected_components
from shoal.session import materialize

#: Word bytes: all but the space and tab, line feed, vertical tab, form feed, carriage return.
WORD = ~byte_class(b" \t\n\x0b\x0c\r")


def bands_for(percent: int, rows_max: int = 8, values: int = 128, missed: float = 1e-4) -> tuple[int, int]:
    """Bands and rows per band: the most rows for which a pair at the threshold is missed with at most ``missed``."""
    for rows in range(rows_max, 0, -1):
        if (1 - (percent / 100) ** rows) ** (values // rows) <= missed:
            return values // rows, rows
    return values, 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every row as sorted 64-bit hashes, one row after another, and where each row begins.

    A row of fewer than ``size`` words has one shingle of all its words; a row without words has none.
    """
    data = lower(data)
    starts, ends, first = words(data, offsets, WORD)
    hashes, counts = span_hash(prefix_sums(data), starts, ends), np.diff(first)
    n = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    at = expand(first[:-1], n)
    row = np.repeat(np.arange(len(n)), n)
    value = np.repeat(np.minimum(counts, size), n).astype(U64)
    for i in range(size):
        inside = i < np.repeat(counts, n)
        place = np.minimum(at + i, max(len(hashes) - 1, 0))
        value = np.where(inside, mix(value * U64(0x9FB21C651E98DF25) + hashes[place]), value)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return value[fresh], np.searchsorted(row[fresh], np.arange(len(n) + 1))


def super_minhash(values: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (rows x m) of the sets ``values[offsets[i]:offsets[i + 1]]``.

    An element's j-th rank j + r falls on the j-th place of a random permutation of the m slots, which is built by
    Fisher-Yates steps from the element's own random numbers; a slot keeps the smallest rank. All elements take step j
    together, and a set stops as soon as no slot can still become smaller, that is when all are below j + 1.
    The permutation is not stored: the place of step j is found by undoing the earlier swaps.
    """
    n = len(offsets) - 1
    best = np.full((n, m), np.inf)
    row = np.repeat(np.arange(n), np.diff(offsets))
    state, picks = values, []
    flat_best = best.reshape(-1)
    for j in range(m):
        if not len(row):
            break
        draw = mix(state + U64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        rank = j + (draw >> U64(11)) * 2.0 ** -53
        pick = (j + (mix(draw) % U64(m - j))).astype(np.int64)
        slot = pick.copy()
        for t in range(j - 1, -1, -1):
            slot[slot == picks[t]] = t
        np.minimum.at(flat_best, row * m + slot, rank)
        picks.append(pick)
        going = (best.max(1) > j + 1)[row]
        if not going.all():
            row, state, picks = row[going], state[going], [x[going] for x in picks]
    return best


def _signer(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            values, offsets = shingle_sets(*flat(batch["text"]), size)
            signature = super_minhash(values, offsets, bands * rows).view(U64)
            n = np.diff(offsets)
            keys = np.zeros((len(n), bands), U64)
            for i in range(rows):
                keys = mix(keys * U64(0x9FB21C651E98DF25) + signature[:, i::rows][:, :bands])
            keys = mix(keys + np.arange(1, bands + 1, dtype=U64))  # a band's values only meet their like
            raw = values.tobytes()
            digest = [xxhash.xxh3_128_digest(raw[8 * a:8 * b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([
                batch["id"], pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()),
                                         pa.array(keys.view(np.int64).ravel()))], ["id", "n", "key", "bands"])
    return run


def _set_builder(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            values, offsets = shingle_sets(*flat(batch["text"]), size)
            raw = values.tobytes()
            sets = [raw[8 * a:8 * b] for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())],
                ["id", "key", "members"])
    return run


def _links(sets: list[np.ndarray], blocks: np.ndarray, cross: bool, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links in a group: (i, j) with 100 * |intersection| >= percent * |union|.

    Intersections of one set with all earlier ones are counted along the postings of its elements.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(term, kind="stable")
    posted, borders = owner[order], np.searchsorted(term[order], np.arange(term.max() + 2))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    root, out = np.arange(len(sets)), []
    for i in range(1, len(sets)):
        terms = term[begins[i]:begins[i + 1]]
        shared = np.bincount(posted[expand(borders[terms], borders[terms + 1] - borders[terms])], minlength=len(sets))[:i]
        linked = 100 * shared >= percent * (sizes[:i] + sizes[i] - shared)
        if cross:
            linked &= blocks[:i] != blocks[i]
        near = np.flatnonzero(linked)
        for r, j in zip(*np.unique(root[near], return_index=True)):
            if root[i] != r:
                out.append((i, int(near[j])))
                root[root == root[i]] = r
    return out


def _verifier(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["bucket", "low", "high"]):
            if group.num_rows < 2:
                continue
            ids = group["id"].to_pylist()
            sets = [np.frombuffer(x, U64) for x in group["members"].to_pylist()]
            cross = group["low"][0] != group["high"][0]
            found = _links(sets, group["block"].to_numpy(), cross, percent)
            yield pa.RecordBatch.from_pydict({"a": pa.array([ids[i] for i, _ in found], pa.int64()),
                                              "b": pa.array([ids[j] for _, j in found], pa.int64())})
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                    percent: int = 80, values: int = 128, block: int = BLOCK, block_bytes: int = 1 << 24) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row; ids are integers.

    Rows with equal shingle sets are one class from the start (a digest of the set, aggregated before the shuffle), so a
    text with millions of copies is one candidate. Classes that share a band of their signature meet in a bucket;
    buckets with the same members are looked at once; the full sets are compared there, with no other filter, and only
    a spanning forest of the links leaves the task. Buckets larger than a block, by members or by the bytes of their
    sets, are spread over pairs of blocks.
    Sets are compared as sets of 64-bit hashes of the shingles. With ``values`` slots, a pair exactly at the threshold
    is missed with a probability of at most 1e-4 (see ``bands_for``), less above it.

    Null, empty and blank texts have no shingles, link with nothing and are kept. Rows with a null id are kept and
    get a null component. Rows that repeat an id are judged by their own text. Other columns are not read.
    """
    bands, rows = bands_for(percent, values=values)
    texts = only(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    signed = materialize(texts.mapInArrow(_signer(shingle_words, bands, rows), "id long, n long, key binary, bands array<long>"),
                         "signatures")
    classes = materialize(signed.where("n > 0 AND id IS NOT NULL").groupBy("key").agg(
        F.min("id").alias("id"), F.min("n").alias("n"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("id", "key", "n", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(
        F.count("*").alias("size"), F.sum(F.col("n") * 8).alias("bytes"), F.sum(F.xxhash64("id", "key").cast("decimal(20)")).alias("total"),
        F.bit_xor(F.xxhash64("key", "id")).alias("mixed")).where("size > 1")
    buckets = materialize(buckets.groupBy("size", "bytes", "total", "mixed").agg(F.min("bucket").alias("bucket")).select(
        "bucket", "size", "bytes"), "buckets")
    members = materialize(banded.drop("n").join(buckets, "bucket"), "members")
    needed = members.select("id").distinct()
    # sent by id at every size: a broadcast of the ids, which grow with the input, would only do for small tables
    sets = texts.join(needed.hint("merge"), "id").mapInArrow(_set_builder(shingle_words), "id long, key binary, members binary").dropDuplicates(
        ["id", "key"])
    groups = blocked(members.join(sets, ["id", "key"]), block, block_bytes).select("bucket", "low", "high", "block", "id", "members")
    edges = materialize(groups.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "id")
                        .mapInArrow(_verifier(percent), "a long, b long").distinct(), "links")
    components = materialize(connected_components(edges, "a", "b"), "components")
    of_class = materialize(
        classes.select("key", "id").join(components, F.col("id") == F.col("vertex"), "left")
        .select("key", F.coalesce("component", "id").alias("component")), "members_of")
    return (signed.select("id", "n", "key").join(of_class, "key", "left")
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.expr("CASE WHEN n > 0 AND id IS NOT NULL THEN component ELSE id END").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                         percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates; all columns as they are.

    Rows that repeat a non-null id count as copies: one of them stays. Rows with a null id all stay.
    """
    judged = near_duplicates(docs, id_col, text_col, shingle_words, percent)
    of_id = F.expr("bool_or(kept)").alias("kept")
    ids = materialize(judged.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(
        of_id, F.count("*").alias("n")).where("NOT kept OR n > 1"), "decisions")
    # fewer ids go than stay: the smaller side decides whether the texts have to move at all
    same = docs[id_col].cast("long") == ids["__id"]
    rows = docs.join(ids.where("NOT kept"), same, "left_anti")
    repeated = ids.where("kept")
    if repeated.isEmpty():
        return rows
    same = rows[id_col].cast("long") == repeated["__id"]
    return rows.join(repeated, same, "left_anti").unionByName(
        rows.join(repeated, same, "left_semi").dropDuplicates([id_col]))
