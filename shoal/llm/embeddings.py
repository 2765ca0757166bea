"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import BLOCK, U64, blocked, grouped, mix, only
from shoal.llm.components import connected_components
from shoal.session import materialize

#: Linked pairs whose tables are compared at once.
PAIRS = 200_000


def tables_for(rows: int, cosine: float, recall: float) -> tuple[int, int]:
    """Bits per table so that a bucket holds about one row that is not near, and tables for the recall at the threshold."""
    bits = max(8, min(60, math.ceil(math.log2(max(rows, 2)))))
    same = 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same ** bits))) if same < 1 else 1


def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([20240229, dim]).standard_normal((dim, bits * tables))


def _hasher(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            column = batch["v"]
            n, size = len(column), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            values = column.flatten()
            nulls = np.asarray(values.is_null())
            flat = np.asarray(values.fill_null(0).cast(pa.float64())) + 0.0  # one zero
            ends = np.cumsum(size)
            keys: list[bytes | None] = [None] * n
            vectors: list[bytes | None] = [None] * n
            codes: list[np.ndarray | None] = [None] * n
            for dim in np.unique(size[size > 0]).tolist():
                rows = np.flatnonzero(size == dim)
                at = (ends[rows] - dim)[:, None] + np.arange(dim)
                x = flat[at]
                good = np.isfinite(x).all(1) & ~nulls[at].any(1) & (x != 0).any(1)
                rows, x = rows[good], x[good]
                if not len(rows):
                    continue
                if dim not in planes:
                    planes[dim] = _planes(dim, bits, tables)
                scaled = x / np.abs(x).max(1, keepdims=True)
                sign = (scaled @ planes[dim] > 0).reshape(len(rows), tables, bits).astype(U64)
                code = (sign << np.arange(bits, dtype=U64)).sum(2, dtype=U64)
                code = mix(mix(code + U64(dim << 48)) + np.arange(1, tables + 1, dtype=U64)).view(np.int64)
                for i, row in enumerate(rows.tolist()):
                    vectors[row] = x[i].tobytes()
                    keys[row] = xxhash.xxh3_128_digest(vectors[row])
                    codes[row] = code[i]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(keys, pa.binary()), pa.array(vectors, pa.binary()), pa.array(codes, pa.list_(pa.int64()))],
                ["id", "key", "vector", "codes"])
    return run


def _verifier(cosine: float):
    """Links of a group by exact cosines. A pair is counted in the first table that joins it and nowhere else; a row gives
    its number of links (copies of a linked vector count each) and a spanning forest's edge, if any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["bucket", "low", "high"]):
            m = group.num_rows
            if m < 2:
                continue
            x = np.frombuffer(b"".join(group["vector"].to_pylist()), np.float64).reshape(m, -1)
            x = x / np.abs(x).max(1, keepdims=True)
            x = x / np.sqrt((x * x).sum(1))[:, None]
            near = np.triu(x @ x.T >= cosine, 1)
            if group["low"][0] != group["high"][0]:
                block = group["block"].to_numpy()
                near &= block[:, None] != block[None, :]
            a, b = np.nonzero(near)
            if not len(a):
                continue
            codes = np.array(group["codes"].to_pylist(), np.int64)
            table = int(np.flatnonzero(codes[0] == group["bucket"][0].as_py())[0])
            fresh = np.concatenate([~(codes[a[i:i + PAIRS], :table] == codes[b[i:i + PAIRS], :table]).any(1)
                                    for i in range(0, len(a), PAIRS)])
            a, b = a[fresh], b[fresh]
            copies = group["copies"].to_numpy()
            links = np.bincount(a, copies[b], m) + np.bincount(b, copies[a], m)
            ids = group["id"].to_pylist()
            forest = _forest(a, b, m)
            rows = np.flatnonzero(links)
            yield pa.RecordBatch.from_pydict({
                "id": pa.array([ids[i] for i in rows] + [ids[i] for i, _ in forest], pa.int64()),
                "other": pa.array([None] * len(rows) + [ids[j] for _, j in forest], pa.int64()),
                "key": pa.array([group["key"][int(i)].as_py() for i in rows] + [None] * len(forest), pa.binary()),
                "links": pa.array([int(links[i]) for i in rows] + [0] * len(forest), pa.int64())})
    return run


def _forest(a: np.ndarray, b: np.ndarray, m: int) -> list[tuple[int, int]]:
    """Edges that join the linked rows of a group: each row to the smallest row of its component."""
    label = np.arange(m)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return [(int(i), int(label[i])) for i in np.flatnonzero(label != np.arange(m))]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95,
                 recall: float = 0.99, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row; ids are integers.

    Equal vectors are one class from the start. A table's hash is the signs of the products with random planes;
    classes with the same signs in a table meet there and their cosines are computed in double precision. The
    number of bits grows with the logarithm of the rows, the number of tables follows from ``recall``, the share of
    pairs found that lie exactly at the threshold (nearer ones are found more often). Buckets larger than a
    block are spread over pairs of blocks. Only vectors of the same length are compared.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Rows with a null id get
    a null component and are kept; rows that repeat an id and a vector count as copies. Other columns are not read.
    """
    rows = only(vectors, id=id_col, v=vector_col).withColumn("id", F.col("id").cast("long"))
    bits, tables = tables_for(rows.count(), cosine, recall)
    hashed = materialize(rows.mapInArrow(_hasher(bits, tables), "id long, key binary, vector binary, codes array<long>"), "hashed")
    classes = materialize(hashed.where("key IS NOT NULL AND id IS NOT NULL").groupBy("key").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector"),
        F.first("codes").alias("codes")), "classes")
    coded = classes.select("id", "key", F.explode("codes").alias("bucket"))
    buckets = materialize(coded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = blocked(coded.join(buckets, "bucket"), block).join(classes, ["id", "key"])
    found = materialize(members.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "id")
                        .select("bucket", "low", "high", "block", "id", "key", "copies", "vector", "codes")
                        .mapInArrow(_verifier(cosine), "id long, other long, key binary, links long"), "links")
    components = materialize(connected_components(found.where("other IS NOT NULL"), "id", "other"), "components")
    totals = found.where("other IS NULL").groupBy("key").agg(F.sum("links").alias("links"))
    judged = materialize(
        classes.select("key", "id", "copies").join(totals, "key", "left")
        .join(components, F.col("id") == F.col("vertex"), "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
                F.coalesce("component", "id").alias("component")), "judged")
    return (hashed.select("id", "key").join(judged, "key", "left")
            .select(F.col("id").alias("vec_id"), F.expr("CASE WHEN id IS NULL THEN 0L ELSE coalesce(links, 0L) END").alias("n_links"),
                    F.expr("CASE WHEN id IS NULL THEN NULL ELSE coalesce(component, id) END").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
