"""Prefix trie of conversations: sorted sequences, common prefixes of neighbours, union-find from the deepest one up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import grouped, only, sliced
from shoal.session import materialize

#: Bytes of a turn in a sequence: half a SHA-256 of role and text, and the bytes of the text.
UNIT = 20
#: Bytes of sequences that are joined at once in a task.
SLICE = 1 << 18
#: Neighbouring forests that are joined in a task.
FAN = 32
#: Conversation ids that differ in their last twelve bits only make one piece of an end list.
PIECE_BITS = 12

_CELL = pa.struct([("depth", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()),
                   ("saved", pa.int64()), ("ends", pa.string())])
_NODE = [("key", pa.binary()), ("parent_key", pa.binary()), ("parent", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()),
         ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string())]
_CHAIN = [("part", pa.int64()), ("side", pa.int64()), ("link", pa.int64()), ("units", pa.binary()), ("cells", pa.list_(_CELL))]
_OUT = pa.schema(_NODE + _CHAIN)
_CELLS = "array<struct<depth: long, n: long, low: long, children: long, leaves: long, saved: long, ends: string>>"
_SCHEMA = ("key binary, parent_key binary, parent long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, "
           f"saved long, ends string, part long, side long, link long, units binary, cells {_CELLS}")


@dataclass(slots=True)
class Cell:
    """What is known of the members of a node that do not come from a deeper node of the same chain."""

    n: int = 0
    low: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str | None = None

    def add(self, other: Cell) -> None:
        self.n += other.n
        self.low = other.low if self.low is None else self.low if other.low is None else min(self.low, other.low)
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends if other.ends is None else other.ends


@dataclass(slots=True)
class Chain:
    """The nodes on the way from the root to a sequence's end, with what hangs on them by depth."""

    units: bytes
    cells: dict[int, Cell]

    @property
    def depth(self) -> int:
        return len(self.units) // UNIT

    def size(self, depth: int) -> int:
        """Bytes of the text of the turn at ``depth``; the root has none."""
        return int.from_bytes(self.units[depth * UNIT - 4:depth * UNIT], "big") if depth else 0

    def key(self, depth: int) -> bytes:
        return hashlib.sha256(self.units[:depth * UNIT]).digest()[:16]


def common_prefix(a: bytes, b: bytes) -> int:
    """Turns that two sequences begin with in common."""
    most, at = min(len(a), len(b)), 0
    while at < most and a[at:at + UNIT] == b[at:at + UNIT]:
        at += UNIT
    return at // UNIT


@dataclass(slots=True)
class Component:
    """Neighbouring sequences that are joined so far. A closed one is known whole down from ``depth``; an open one holds
    the first or the last sequence, so that more may come to every node on the way to that."""

    chain: Chain
    depth: int
    top: Cell
    waiting: list = field(default_factory=list)  # children of the top, as rows that lack their parent's id
    below: dict[int, Cell] = field(default_factory=dict)  # of nodes nearer to the root; of an open one, of all nodes
    open: bool = False


class Forest:
    """Joins neighbouring chains from the deepest common prefix up; finished nodes go to ``rows``."""

    def __init__(self, keyed: bool):
        self.keyed, self.rows = keyed, []

    def _lift(self, c: Component, depth: int) -> None:
        """Finishes the nodes below ``depth``, so that ``depth`` is the component's top."""
        while c.depth > depth:
            self._finish(c)
            row = c.waiting.pop()
            above = Cell(c.top.n, c.top.low, 1, row[7], row[8])
            if (more := c.below.pop(c.depth - 1, None)) is not None:
                above.add(more)
            c.depth, c.top, c.waiting = c.depth - 1, above, [row]

    def _finish(self, c: Component) -> None:
        """The top as a row; its children know their parent now."""
        for child in c.waiting:
            child[2] = c.top.low
            self.rows.append(child)
        leaves = c.top.leaves if c.top.children else 1
        saved = c.top.saved + (c.top.n - 1) * c.chain.size(c.depth)
        c.waiting = [[c.chain.key(c.depth) if self.keyed else None, None, None, c.top.low, c.depth, c.top.n, c.top.children,
                      leaves, saved, c.top.ends]]

    def _attach(self, c: Component, to: Component, depth: int) -> None:
        """A closed component becomes part of the open node at ``depth``; its children will look for that by its key."""
        self._lift(c, depth)
        key = to.chain.key(depth) if c.waiting else None
        for child in c.waiting:
            child[1] = key
            self.rows.append(child)
        for at, cell in ((depth, c.top), *c.below.items()):
            to.below.setdefault(at, Cell()).add(cell)

    def join(self, chains: list[Chain], links: list[int], final: bool) -> tuple[list[Chain], int | None]:
        """``links`` are the common prefixes of neighbours. Returns the first and the last chain with all that hangs on them,
        and their common prefix; with ``final`` nothing is left open and every node becomes a row."""
        root = list(range(len(chains)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        parts = []
        for i, chain in enumerate(chains):
            cells = dict(chain.cells)
            if not final and i in (0, len(chains) - 1):
                parts.append(Component(chain, chain.depth, Cell(), [], cells, True))
            else:
                parts.append(Component(chain, chain.depth, cells.pop(chain.depth, Cell()), [], cells))
        upper = None
        for i in sorted(range(len(links)), key=links.__getitem__, reverse=True):
            x, y, depth = find(i), find(i + 1), links[i]
            a, b = parts[x], parts[y]
            root[y] = x
            if a.open and b.open:
                upper = (depth, {d: c for d, c in b.below.items() if d > depth})
                for at, cell in b.below.items():
                    if at <= depth:
                        a.below.setdefault(at, Cell()).add(cell)
            elif a.open:
                self._attach(b, a, depth)
            elif b.open:
                self._attach(a, b, depth)
                parts[x] = b
            else:
                self._lift(a, depth)
                self._lift(b, depth)
                a.top.add(b.top)
                a.waiting += b.waiting
                for at, cell in b.below.items():
                    a.below.setdefault(at, Cell()).add(cell)
            parts[y] = parts[x]
        if final:
            whole = parts[find(0)]
            self._lift(whole, 0)
            self._finish(whole)
            self.rows += whole.waiting
            return [], None
        first = Chain(chains[0].units, parts[find(0)].below)
        if len(chains) == 1:
            return [first], None
        return [first, Chain(chains[-1].units, upper[1])], upper[0]


def _batches(rows: list[list]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 8192):
        part = rows[at:at + 8192]
        columns = [pa.array(x, f.type) for x, f in zip(zip(*part), _OUT)]
        yield pa.RecordBatch.from_arrays(columns + [pa.nulls(len(part), f.type) for f in list(_OUT)[len(_NODE):]], schema=_OUT)


def _contracted(part: int, chains: list[Chain], link: int | None) -> pa.RecordBatch:
    rows = [{"part": part, "side": side, "link": link, "units": chain.units, "cells": [
        {"depth": d, **{f: getattr(c, f) for f in Cell.__slots__}} for d, c in chain.cells.items()]} for side, chain in enumerate(chains)]
    return pa.RecordBatch.from_pylist(rows, _OUT)


def _local(limit: int):
    """Forest of a sorted partition, slice by slice: what is finished is told, two chains go on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains, link = [], None
        for batch in sliced(batches, "units", limit):
            units = batch["units"].to_pylist()
            new = [Chain(u, {len(u) // UNIT: Cell(n, low, ends=ends)})
                   for u, n, low, ends in zip(units, *(batch[c].to_pylist() for c in ("n", "low", "ends")))]
            links = [*([link] if len(chains) == 2 else []), *([common_prefix(chains[-1].units, units[0])] if chains else []),
                     *(common_prefix(a, b) for a, b in zip(units, units[1:]))]
            forest = Forest(bool(chains))
            chains, link = forest.join(chains + new, links, False)
            yield from _batches(forest.rows)
        if chains:
            yield _contracted(TaskContext.get().partitionId(), chains, link)
    return run


def _across(final: bool):
    """Joins the forests of a group of neighbouring partitions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["group"]):
            rows, forest = group.to_pylist(), Forest(True)
            chains = [Chain(r["units"], {c.pop("depth"): Cell(**c) for c in r["cells"]}) for r in rows]
            links = [a["link"] if a["part"] == b["part"] else common_prefix(a["units"], b["units"]) for a, b in zip(rows, rows[1:])]
            chains, link = forest.join(chains, links, final)
            yield from _batches(forest.rows)
            if chains:
                yield _contracted(rows[0]["group"], chains, link)
    return run


def sequences(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """``conv_id, turns``: one row per conversation, its turns as 40 hex digits each (digest of role and text, bytes of text).

    Turns ascend by ``turn``, null first; equal ones by digest, so that no row is lost. Null roles and texts count as empty. Rows
    without ``conv_id`` belong to no conversation. Only digests are shuffled; a conversation is one row of 40 bytes a turn.
    """
    rows = only(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv_id is not null")
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    size = F.octet_length(text)
    unit = F.concat(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32),
                    F.lpad(F.lower(F.hex(size)), 8, "0"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", unit.alias("unit"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "unit")))["unit"].alias("turns"))


def with_common_heads(convs: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """Every conversation c again: its first h turns are those of conversation c - c % ``family`` (all if it has fewer, none
    if there is no such conversation), then come its own after the first h; h = crc32(c) % (``most`` + 1)."""
    base, head = F.expr(f"conv_id - conv_id % {family}"), F.crc32(F.col("conv_id").cast("string")) % (most + 1)
    heads = convs.where(base == F.col("conv_id")).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    joined = convs.select("conv_id", "turns", base.alias("base"), head.cast("int").alias("h")).join(heads, "base", "left")
    return joined.selectExpr("conv_id", "concat(slice(coalesce(head, array()), 1, h), slice(turns, h + 1, greatest(size(turns) - h, 0))) AS turns")


def _end_lists(convs: DataFrame) -> DataFrame:
    """``seq, ends``: SHA-256 over the ascending ids of the conversations of each sequence, comma-joined.

    Pieces of the text are made in parallel; SHA-256 itself can only go through the pieces of a sequence one after the other,
    which one task does without holding them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, state = None, None
        for batch in batches:
            done = []
            for seq, piece in zip(batch["seq"].to_pylist(), batch["piece"].to_pylist()):
                if seq != before:
                    if state:
                        done.append((before, state.hexdigest()))
                    before, state = seq, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done])], ["seq", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([before], pa.binary()), pa.array([state.hexdigest()])], ["seq", "ends"])

    block = F.expr(f"shiftright(conv_id, {PIECE_BITS})").alias("block")
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))
    pieces = convs.groupBy("seq", block).agg(F.array_join(ids, ",").alias("piece"))
    return pieces.repartition("seq").sortWithinPartitions("seq", "block").select("seq", "piece").mapInArrow(run, "seq binary, ends string")


def prefix_trie(convs: DataFrame, limit: int = SLICE, fan: int = FAN) -> DataFrame:
    """A row per node of the trie of the sequences in (conv_id, turns): ``conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256``.

    Equal sequences become one, with the number and the smallest of their conversations. Sequences are sorted by range
    partitions, which no common prefix, however frequent, makes uneven. In a partition every sequence begins as a component; the
    common prefixes of neighbours are taken from the deepest up, and where two components meet at a depth, there is a
    branching node; the nodes between the meeting points have one child. Nodes on the way to a partition's first or last
    sequence stay open: a partition is contracted to these two chains, with sums of all that hangs on them, and
    chains of neighbouring partitions are joined likewise, 32 partitions at a time, until one forest is left. Finished
    children of open nodes get their parent's id by a join at the end.

    A conversation without turns ends at the root. No conversations give no rows. A task holds a slice of 256 kB of sequences
    and two chains; a single sequence is held whole (20 bytes a turn).
    """
    spark = convs.sparkSession
    joined = F.unhex(F.array_join("turns", ""))
    convs = convs.select("conv_id", joined.alias("units")).withColumn("seq", F.unhex(F.substring(F.sha2("units", 256), 1, 32)))
    convs = materialize(convs, "sequences")
    distinct = convs.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), F.first("units").alias("units"))
    classes = materialize(distinct.join(_end_lists(convs.select("seq", "conv_id")), "seq"), "classes")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(classes.select("units", "n", "low", "ends").repartitionByRange(tasks, "units")
                        .sortWithinPartitions("units").mapInArrow(_local(limit), _SCHEMA), "forests")
    levels = [found]
    while (top := found.agg(F.max("part")).first()[0]) is not None:
        group = F.expr(f"part div {fan}").alias("group")
        chains = found.where("part is not null").select(group, "part", "side", "link", "units", "cells")
        found = materialize(chains.repartition("group").sortWithinPartitions("group", "part", "side").mapInArrow(
            _across(top < fan), _SCHEMA), "forests")
        levels.append(found)
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.union(more)
    nodes = nodes.where("depth is not null").select(*[n for n, _ in _NODE])
    parents = nodes.where("key is not null").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("known"))
    whole = nodes.where("parent_key is null").union(
        nodes.where("parent_key is not null").join(parents, "parent_key").withColumn("parent", F.col("known")).select(*nodes.columns))
    return whole.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
