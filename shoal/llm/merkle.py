"""A Merkle manifest of a dataset: trees of SHA-256 kept as append logs in postorder, with proofs by address."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoal.llm.common import only
from shoal.operators.ordering import row_index
from shoal.session import materialize

#: Levels of a block: one builder writes the tree over 2**LEVELS neighbouring entries.
LEVELS = 8
LEFT, RIGHT, ALONE = b"L", b"R", b"-"
_STEP = 33  # bytes of a step of a path: where the sibling stands, and its digest


def position(level: int, number: int, entries: int) -> int:
    """Place in the log of the node ``number`` of ``level`` of a tree over ``entries``, all counted from 0.

    Nodes are written as soon as all entries below them are there. When entry ``e`` comes, 2e - popcount(e) nodes are
    complete: the sum of the sizes 2**(h + 1) - 1 of the full subtrees that make up e entries. The entry is written,
    then the nodes that it completes, level by level. The last entry completes the unfinished ones too.
    """
    last = min((number + 1) << level, entries) - 1
    return 2 * last - last.bit_count() + level


def height(entries: int) -> int:
    return max(entries - 1, 0).bit_length()


def parent(*children: bytes) -> bytes:
    """Digest of a node from the digests (32 bytes) of its children; digests are hashed as hex text."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def build_log(entries: list[bytes], levels: int) -> list[bytes]:
    """The nodes over ``entries`` up to ``levels`` in the order of their completion; the last one is the top.

    A node's left sibling stands before the subtree just finished, whose size is known: 2**(level + 1) - 1 back.
    """
    log: list[bytes] = []
    for e, digest in enumerate(entries):
        level = 0
        log.append(digest)
        while e >> level & 1:
            digest = parent(log[-(2 << level)], digest)
            log.append(digest)
            level += 1
    last = len(entries) - 1
    while level < levels:  # the right edge: nodes with fewer children, even one
        left = last >> level & 1
        digest = parent(log[position(level, (last >> level) - 1, len(entries))], digest) if left else parent(digest)
        log.append(digest)
        level += 1
    return log


def path_in(log: list[bytes], entry: int, entries: int, levels: int) -> bytes:
    """The siblings on the way from an entry to the top, a step of 33 bytes per level."""
    steps = []
    for level in range(levels):
        number = entry >> level
        other = number ^ 1
        if other << level >= entries:
            steps.append(ALONE + bytes(32))
        else:
            steps.append((LEFT if other < number else RIGHT) + log[position(level, other, entries)])
    return b"".join(steps)


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that follows from a leaf and the siblings on its way."""
    for at in range(0, len(path), _STEP):
        side, sibling = path[at:at + 1], path[at + 1:at + _STEP]
        digest = parent(digest) if side == ALONE else parent(sibling, digest) if side == LEFT else parent(digest, sibling)
    return digest


def siblings(path: bytes) -> bytes:
    """Digest of all siblings of a path in its order."""
    return parent(*(path[at + 1:at + _STEP] for at in range(0, len(path), _STEP) if path[at:at + 1] != ALONE))


def _levels(block: int, entries: int) -> int:
    """Levels of a block: all of them, but for a tree of one block, which ends at its own top."""
    return LEVELS if block else height(entries)


def _builder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks, entries = batch["block"].to_pylist(), batch["entries"].to_pylist()
        logs = [build_log(x, _levels(block, len(x))) for block, x in zip(blocks, entries)]
        yield pa.RecordBatch.from_arrays(
            [batch["tree"], batch["block"], pa.array([len(x) for x in entries], pa.int32()),
             pa.array([b"".join(x) for x in logs], pa.binary()), pa.array([x[-1] for x in logs], pa.binary())],
            ["tree", "block", "size", "log", "top"])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path to the root of every entry of a block; of documents also what is known of them."""
    for batch in batches:
        rows, numbers, paths = [], [], []
        for row, (block, size, packed, above) in enumerate(zip(*(batch[c].to_pylist() for c in ("block", "size", "log", "path")))):
            log = [packed[at:at + 32] for at in range(0, len(packed), 32)]
            levels = _levels(block, size)
            for entry in range(size):
                rows.append(row)
                numbers.append((block << LEVELS) + entry)
                paths.append(path_in(log, entry, size, levels) + above)
        rows = pa.array(rows, pa.int64())
        columns = {"tree": batch["tree"].take(rows), "block": pa.array(numbers, pa.int64()), "path": pa.array(paths, pa.binary()),
                   **{c: batch[c].take(rows) for c in ("subroot", "root")}}
        if "documents" in batch.schema.names:
            columns |= {f.name: part for f, part in zip(batch["documents"].type.value_type, batch["documents"].flatten().flatten())}
        yield pa.RecordBatch.from_pydict(columns)


def grow(entries: DataFrame) -> list[DataFrame]:
    """Trees over (tree, number, digest), numbered from 0 in each tree: the logs of every tier; the last has the tops.

    An aligned builder takes 256 neighbouring entries of a tree, whatever the number of the tree's entries, and
    appends nodes in the order of their completion; its top is an entry of the next tier. Tiers are added until every
    tree is one block. A tier is a written table of (tree, block, size, log, top), a log being its digests one by one.
    """
    tiers = []
    while True:
        members = F.sort_array(F.collect_list(F.struct("number", "digest")))
        blocks = entries.groupBy("tree", F.shiftright("number", LEVELS).alias("block")).agg(members.alias("m"))
        tiers.append(materialize(blocks.select("tree", "block", F.col("m.digest").alias("entries")).mapInArrow(
            _builder, "tree string, block long, size int, log binary, top binary"), "merkle"))
        if not tiers[-1].agg(F.max("block")).first()[0]:
            return tiers
        entries = tiers[-1].select("tree", F.col("block").alias("number"), F.col("top").alias("digest"))


@dataclass
class Manifest:
    """Numbered leaves, the logs of the trees over them, the trees in their order, and the logs of the tree over these."""

    leaves: DataFrame  # tree, number, id, digest, found
    tiers: list[DataFrame]
    trees: DataFrame  # tree, number, top
    root_tiers: list[DataFrame]


def manifest(leaves: DataFrame) -> Manifest:
    """Builds the trees over a written table of (tree, id, digest, found, place).

    Leaves of a tree ascend by id, then digest, then place (any unique number), null first; trees ascend by their name.
    Leaves are numbered by one range shuffle of some hundred bytes a row. Copies of a leaf are leaves of their own.
    """
    numbered = row_index(leaves, ["id", "digest", "place"], "number", keys=["tree"]).drop("place")
    tiers = grow(numbered)
    trees = materialize(row_index(tiers[-1].select("tree", "top"), ["tree"], "number"), "trees")
    return Manifest(numbered, tiers, trees, grow(trees.select(F.lit("").alias("tree"), "number", F.col("top").alias("digest"))))


def proofs(made: Manifest) -> DataFrame:
    """``tree, block, path, subroot, root, id, digest, found`` of every leaf (``block`` is its number in the tree).

    A block's log holds the siblings of its entries at places known in closed form; those above are the same for the whole
    block. So the way goes down from the root: the path of a block is looked up once and extended for its entries.
    """
    schema = "tree string, block long, path binary, subroot binary, root binary"
    nothing = F.lit(b"")
    above = made.root_tiers[-1].select("tree", "block", nothing.alias("path"), nothing.alias("subroot"), F.col("top").alias("root"))
    for tier in reversed(made.root_tiers):
        above = tier.join(above, ["tree", "block"]).drop("top").mapInArrow(_paths, schema)
    above = made.trees.join(above.select(F.col("block").alias("number"), "path", "root"), "number").select(
        "tree", F.lit(0).cast("long").alias("block"), "path", F.col("top").alias("subroot"), "root")
    for tier in reversed(made.tiers[1:]):
        above = tier.join(above, ["tree", "block"]).drop("top").mapInArrow(_paths, schema)
    known = F.struct("number", "id", "digest", "found")
    tasks = int(made.leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the work is hashing: not to be dealt by bytes
    documents = made.leaves.withColumn("block", F.shiftright("number", LEVELS)).repartition(tasks, "tree", "block").groupBy(
        "tree", "block").agg(F.sort_array(F.collect_list(known)).alias("documents"))
    of_id = made.leaves.schema["id"].dataType.simpleString()
    return made.tiers[0].join(above, ["tree", "block"]).drop("top").join(documents, ["tree", "block"]).mapInArrow(
        _paths, f"{schema}, number long, id {of_id}, digest binary, found binary").drop("number")


def verify(proved: DataFrame) -> DataFrame:
    """Adds ``proof_sha256``, the digest of the siblings, and ``folded_root``, which follows from ``found`` (else
    ``digest``) and the siblings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch["path"].to_pylist()
            now = [found or digest for found, digest in zip(batch["found"].to_pylist(), batch["digest"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([siblings(p) for p in paths], pa.binary()),
                 pa.array([fold(d, p) for d, p in zip(now, paths)], pa.binary())],
                [*batch.schema.names, "proof_sha256", "folded_root"])
    added = T.StructType([*proved.schema.fields, T.StructField("proof_sha256", T.BinaryType()), T.StructField("folded_root", T.BinaryType())])
    return proved.mapInArrow(run, added)


def leaf(*fields: Column) -> Column:
    """SHA-256, in hex, of the fields: ``-`` for null, else bytes, colon and value."""
    shown = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown]), 256)


def document_leaves(docs: DataFrame, tampered: Column | None = None, id_col: str = "doc_id", source_col: str = "source",
                    lang_col: str = "lang", length_col: str = "n_chars", text_col: str = "text") -> DataFrame:
    """``tree, id, digest, found, place`` of every document, written once; the texts go no further.

    ``found`` is the digest of the rows that ``tampered`` marks, after 1 was added to a length that is not null. A null
    language is a tree of its own, before all others. Null ids, null and empty texts, and repeated rows are leaves like any
    other; other columns are not read.
    """
    rows = only(docs, doc_id=id_col, source=source_col, lang=lang_col, n_chars=length_col, text=text_col)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = [F.col("n_chars").cast("decimal(20)") + 1 if f is fields[3] else f for f in fields]
    changed = F.col("n_chars").isNotNull() & (tampered if tampered is not None else F.lit(False))
    return materialize(rows.select(
        F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit("")).alias("tree"), F.col("doc_id").alias("id"),
        F.unhex(leaf(*fields)).alias("digest"), F.when(changed, F.unhex(leaf(*more))).alias("found"),
        F.monotonically_increasing_id().alias("place")), "leaves")


def audit(docs: DataFrame, tampered: Column | None = None, **columns: str) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every document (see ``document_leaves``):
    the manifest of the table, and whether each document, tampered with or not, still proves its place in it.

    One tree per language over the documents by id, and one over the languages' tops. An empty table gives no rows.
    """
    proved = verify(proofs(manifest(document_leaves(docs, tampered, **columns))))
    shown = [F.lower(F.hex(c)).alias(n) for n, c in (
        ("leaf", "digest"), ("subroot", "subroot"), ("root", "root"), ("proof_sha256", "proof_sha256"), ("folded_root", "folded_root"))]
    return proved.select(F.col("id").alias("doc_id"), *shown, (F.col("folded_root") == F.col("root")).alias("verified"))
