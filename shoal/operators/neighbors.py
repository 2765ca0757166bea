"""Exact nearest neighbours within groups, without comparing all pairs of a group.

The space of a large group is cut into cells at borders taken from a bounded sample; every point lies in one cell, so one
pass places them all. A query first looks into its own cell; the distance of its k-th neighbour there then tells which
other cells may hold a nearer point, and only those are visited.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoal.functions.columns import col
from shoal.session import materialize

#: Queries of a cell, on average.
PART_ROWS = 2_000
#: Sampled points of a cell, on average.
FAN = 24
#: Points of a cell, on average, however few the queries are.
CELL_ROWS = 50_000
#: Numbers that the sample brings to the driver at most; beyond it the cells grow.
SAMPLED = 8_000_000
#: Distances that a task holds at a time.
BLOCK = 1 << 20


@dataclass
class Cells:
    """Trees of borders, one per large group, in one list of nodes.

    Points whose coordinate ``axis`` is at most ``border`` go to node ``child``, the others to the next one. A node
    without child is a cell (``child`` is the node itself) and keeps its number as the cell's.
    """

    roots: dict[str, int]
    axis: np.ndarray
    border: np.ndarray
    child: np.ndarray

    @property
    def count(self) -> int:
        return int((self.child == np.arange(len(self.child))).sum())

    def place(self, node: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The cell of each point, from the root of its group."""
        rows = np.arange(len(x))
        while True:
            below = self.child[node]
            inner = below != node
            if not inner.any():
                return node
            node = np.where(inner, below + (x[rows, self.axis[node]] > self.border[node]), node)

    def near(self, root: int, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells that a point at most ``bound`` from ``x`` can lie in."""
        row, node, gaps = np.arange(len(x)), np.full(len(x), root), np.zeros(x.shape)
        limit = bound * bound * (1.0 + 1e-12)
        rows, cells = [], []
        while len(row):
            leaf = self.child[node] == node
            rows.append(row[leaf])
            cells.append(node[leaf])
            row, node, gaps = row[~leaf], node[~leaf], gaps[~leaf]
            axis, each = self.axis[node], np.arange(len(row))
            beyond = x[row, axis] - self.border[node]
            sides = []
            for side, gap in ((0, beyond), (1, -beyond)):
                apart = gaps.copy()
                apart[each, axis] = np.maximum(apart[each, axis], gap)
                kept = (apart * apart).sum(axis=1) <= limit[row]
                sides.append((row[kept], (self.child[node] + side)[kept], apart[kept]))
            row, node, gaps = (np.concatenate(pair) for pair in zip(*sides))
        return np.concatenate(rows), np.concatenate(cells)


def cut_cells(samples: dict[str, np.ndarray], wanted: dict[str, int]) -> Cells:
    """Cuts each group's sample at the median of its widest side until it is in so many parts.

    Equal points are never parted, so a group of few different points has fewer cells.
    """
    axis, border, child, roots = [], [], [], {}

    def add() -> int:
        for values, empty in ((axis, 0), (border, 0.0), (child, len(child))):
            values.append(empty)
        return len(child) - 1

    for g, points in samples.items():
        roots[g] = add()
        todo = [(roots[g], points, float(wanted[g]))]
        while todo:
            node, x, parts = todo.pop()
            if parts < 1.5 or len(x) < 2:
                continue
            side = np.ptp(x, axis=0)
            a = int(np.argmax(side))
            if not side[a] > 0.0:
                continue
            values = np.sort(x[:, a])
            cut = values[(len(values) - 1) // 2]
            if cut == values[-1]:
                cut = values[np.searchsorted(values, cut) - 1]
            left = x[:, a] <= cut
            axis[node], border[node], child[node] = a, cut, add()
            share = parts * left.mean()
            todo += [(child[node], x[left], share), (add(), x[~left], parts - share)]
    return Cells(roots, np.array(axis), np.array(border), np.array(child))


def _nearest(ids: np.ndarray, points: np.ndarray, qs: np.ndarray, asked: np.ndarray, k: int) -> Iterator[tuple]:
    """(query, point, distance) of the k nearest others by distance, then place; ``ids`` ascend, with unknown ones last."""
    step = max(1, BLOCK // max(1, len(points)))
    for start in range(0, len(qs), step):
        ask, q = asked[start:start + step], qs[start:start + step]
        gaps = np.zeros((len(ask), len(points)))
        for d in range(points.shape[1]):  # differences, without cancellation
            gap = ask[:, d, None] - points[None, :, d]
            gap *= gap
            gaps += gap
        first, last = np.searchsorted(ids, q, "left"), np.searchsorted(ids, q, "right")
        for more in range(int((last - first).max(initial=0))):
            own = np.flatnonzero(first + more < last)
            gaps[own, first[own] + more] = np.inf
        if len(points) > k:
            limit = np.partition(gaps, k - 1, axis=1)[:, k - 1]
            row, at = np.nonzero(gaps <= (limit * (1.0 + 1e-15))[:, None])  # squares that differ may have one root
        else:
            row, at = np.nonzero(np.isfinite(gaps))
        distance = np.sqrt(gaps[row, at])
        order = np.lexsort((at, distance, row))
        row, at, distance = row[order], at[order], distance[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        kept = (rank < k) & np.isfinite(distance)
        yield row[kept] + start, at[kept], distance[kept]


def _columns(table: pa.Table | pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.stack([table[c].to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table[c].to_numpy()
                     for c in names], axis=1)


def exact_neighbors(
    points: DataFrame, group: str, key: str, features: Sequence[str], k: int, queries: DataFrame | None = None,
    part_rows: int = PART_ROWS, fan: int = FAN, seed: int = 42,
) -> DataFrame:
    """(group, key, neighbor, distance, rank) for each query point: its k nearest others of the same group.

    ``points`` holds points with an integer ``key`` per group; ``queries`` (group, key) picks the points to look up, all
    by default. Ties go to the smaller key. Points with unknown coordinates are nobody's neighbours and have none. A cell
    has about ``part_rows`` queries, and its borders come from ``fan`` sampled points a cell; the driver gets the sample,
    which is bounded, and a row per large group.
    """
    xs = [f"x{i}" for i in range(len(features))]
    base = points.select(col(group).cast("string").alias("g"), col(key).cast("long").alias("id"),
                         *[col(f).cast("double").alias(x) for f, x in zip(features, xs)])
    base = base.where(" AND ".join(["g IS NOT NULL", *[f"abs({x}) < double('inf')" for x in xs]]))
    if queries is None:
        base = base.withColumn("asked", F.lit(True))
    else:
        only = queries.select(col(group).cast("string").alias("g"), col(key).cast("long").alias("id")).distinct()
        only = materialize(only, "asked").withColumn("asked", F.lit(True))
        base = base.join(only, ["g", "id"], "left").withColumn("asked", F.col("asked").isNotNull())
    base = materialize(base.select("g", "id", *xs, "asked"), "points")
    cells = _fit_cells(base, xs, part_rows, max(fan, 2), seed)
    if cells is None:
        placed = base.withColumn("cell", F.lit(0))
    else:
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = pa.array(list(cells.roots), pa.string())
            roots = np.array([*cells.roots.values(), 0])
            for batch in batches:
                found = pc.fill_null(pc.index_in(batch["g"], value_set=names), len(names)).to_numpy(zero_copy_only=False)
                large = np.flatnonzero(found < len(names))
                cell = np.zeros(batch.num_rows, np.int32)
                cell[large] = cells.place(roots[found[large]], _columns(batch, xs)[large])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

        placed = materialize(base.mapInArrow(place, T.StructType([*base.schema.fields, T.StructField("cell", T.IntegerType())])), "placed")
    members = _members(placed, xs, k)

    def block(last: bool):
        """The k best points of a slice of a cell; ``last`` or not, also the other cells to look into."""
        def run(table: pa.Table) -> pa.Table:
            g = table["g"][0].as_py()
            inside, ask = table.filter(table["member"]), table.filter(table["asked"])
            ids = pc.fill_null(inside["id"], np.iinfo(np.int64).max).to_numpy()
            known = pc.is_valid(inside["id"]).to_numpy()
            order = np.lexsort((ids, ~known))
            ids, known, x = ids[order], known[order], _columns(inside, xs)[order]
            qs, at = pc.fill_null(ask["id"], np.iinfo(np.int64).max).to_numpy(), _columns(ask, xs)
            unknown = pc.is_null(ask["id"]).to_numpy()
            own = ids[:known.sum()]
            if not len(qs) or not len(ids):
                found = [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]
            else:
                # a query without a key is no point's copy: no place in the keys is its own
                found = [np.concatenate(c) for c in zip(*_nearest(own, x, np.where(unknown, np.iinfo(np.int64).min, qs), at, k))]
            row, near, distance = found
            who, cell, empty = row, np.zeros(0, np.int32), 0
            if not last and cells is not None and g in cells.roots and len(qs) and table["slice"][0].as_py() == 0:
                have = np.bincount(row, minlength=len(qs))
                bound = np.full(len(qs), np.inf)
                full = np.flatnonzero(have >= k)
                bound[full] = distance[np.cumsum(have)[full] - 1]
                more, cell = cells.near(cells.roots[g], at, bound)
                other = cell != table["cell"][0].as_py()
                more, cell = more[other], cell[other].astype(np.int32)
                who, empty = np.concatenate([row, more]), len(more)
            blank = np.arange(len(who)) >= len(row)
            neighbor = pa.array(np.concatenate([ids[near], np.zeros(empty, np.int64)]) if len(ids) else np.zeros(len(who), np.int64),
                                mask=np.concatenate([~known[near], np.ones(empty, bool)]))
            return pa.table({
                "g": pa.array([g] * len(who), pa.string()), "id": pa.array(qs[who], pa.int64(), mask=unknown[who]),
                "neighbor": neighbor, "distance": pa.array(np.concatenate([distance, np.zeros(empty)]), mask=blank),
                "cell": pa.array(np.concatenate([np.zeros(len(row), np.int32), cell]), mask=~blank),
                **{c: pa.array(at[who, i], mask=~blank) for i, c in enumerate(xs)}})

        return run

    schema = "g string, id long, neighbor long, distance double, cell int, " + ", ".join(f"{x} double" for x in xs)

    def search(rows: DataFrame, last: bool) -> DataFrame:
        if cells is not None:  # the work is in the cells, not in the bytes
            tasks = max(4 * rows.sparkSession.sparkContext.defaultParallelism, cells.count // 16)
            rows = rows.repartition(min(cells.count, tasks), "g", "cell", "slice")
        return rows.groupBy("g", "cell", "slice").applyInArrow(block(last), schema)

    found = search(members, False)
    if cells is not None:
        found = materialize(found, "own")
        probes = materialize(found.where("cell IS NOT NULL").select("g", "id", *xs, "cell"), "probes")
        visited = probes.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n")).drop("n")
        there = members.where("member").join(visited, ["g", "cell"], "left_semi").withColumn("asked", F.lit(False))
        sliced = there.groupBy("g", "cell").agg(F.max("slice").alias("most"))
        again = probes.join(sliced, ["g", "cell"]).select(
            "g", "id", *xs, F.lit(True).alias("asked"), "cell", F.lit(False).alias("member"),
            F.explode(F.sequence(F.lit(0), F.col("most"))).alias("slice"))
        found = found.where("cell IS NULL").unionByName(search(there.unionByName(again), True))
    nearest = Window.partitionBy("g", "id").orderBy("distance", "neighbor")
    best = found.select("g", "id", "neighbor", "distance").withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return best.select(col("g").alias(group), col("id").alias(key), "neighbor", "distance", "rank")


def _fit_cells(base: DataFrame, xs: Sequence[str], part_rows: int, fan: int, seed: int) -> Cells | None:
    """Cells for the groups that need more than one; none if all are small."""
    sizes = base.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("asked"))
    parts = F.greatest(F.ceil(F.col("asked") / part_rows), F.ceil(F.col("n") / CELL_ROWS))
    room = max(1, SAMPLED // (fan * (len(xs) + 1)))
    large = sizes.withColumn("parts", parts).where("parts > 1 AND asked > 0").orderBy(F.desc("parts"), "g").limit(room).collect()
    if not large:
        return None
    shrink = min(1.0, room / sum(r["parts"] for r in large))
    wanted = {r["g"]: max(2, math.ceil(r["parts"] * shrink)) for r in large}
    chance = F.create_map(*[F.lit(v) for r in large for v in (r["g"], min(1.0, fan * wanted[r["g"]] / r["n"]))])
    drawn = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / float(1 << 30)
    sample: pd.DataFrame = base.select("g", *xs).where(drawn < F.element_at(chance, F.col("g"))).toPandas()
    return cut_cells({g: rows[list(xs)].to_numpy(float) for g, rows in sample.groupby("g", sort=True)}, wanted)


def _members(placed: DataFrame, xs: Sequence[str], k: int) -> DataFrame:
    """Rows with ``member`` and ``slice``: the points of a crowded cell are dealt to slices, each of which meets all queries.

    A cell is crowded where many points are equal. Of those, no query can need more than the k smallest keys besides
    its own, and of a key that repeats k rows.
    """
    sizes = placed.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("probes"))
    crowded = sizes.where((F.col("n") > 4 * CELL_ROWS) & (F.col("probes") > 0)).select("g", "cell")
    rows = placed.withColumns({"member": F.lit(True), "slice": F.lit(0)})
    crowded = materialize(crowded, "crowded")
    if crowded.isEmpty():
        return rows
    full = placed.join(crowded, ["g", "cell"], "left_semi")
    keys = Window.partitionBy("g", "cell", *xs).orderBy("id")
    copies = Window.partitionBy("g", "cell", *xs, "id").orderBy(F.lit(1))
    few = full.withColumn("r", F.dense_rank().over(keys)).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(copies)).where(F.col("r") <= k).drop("r")
    few = materialize(few.withColumns({"asked": F.lit(False), "member": F.lit(True)}), "few")
    slices = few.groupBy("g", "cell").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("slices"))
    dealt = few.join(slices, ["g", "cell"]).withColumn("slice", F.pmod(F.xxhash64("id", F.lit(1)), "slices").cast("int"))
    asking = full.where("asked").withColumn("member", F.lit(False)).join(slices, ["g", "cell"]).withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    out = rows.join(crowded, ["g", "cell"], "left_anti")
    return out.unionByName(dealt.drop("slices")).unionByName(asking.drop("slices"))
