"""Language of texts by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import U64, flat, held_out, only, sliced
from shoal.session import fresh_path, materialize

#: Bytes of context of the longest order.
ORDER = 3
#: Nodes of the deepest order of a language that are broadcast at once; more are scored in several passes.
MAX_NODES = 250_000
#: Values of the last two context bytes; a pass has all nodes of a range of them.
PAIRS = 1 << 16
_PAIR = "shiftright(code, 8) & 65535"


def contexts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the code of its three preceding bytes (zeros before the text) and itself."""
    size = np.diff(offsets)
    at = np.arange(len(data)) + 3 * (np.repeat(np.arange(len(size)), size) + 1)
    padded = np.zeros(len(data) + 3 * len(size) + 3, np.uint32)
    padded[at] = data
    return padded[at - 3] << np.uint32(24) | padded[at - 2] << np.uint32(16) | padded[at - 1] << np.uint32(8) | padded[at]


class Tree:
    """Context tree of one language with frozen counts; shorter contexts have the sums of the longer ones.

    Of a range of pairs the nodes give all contexts of two and three bytes that end in it; ``short`` then has the sums of
    the whole language for orders 1 and 0.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, short: tuple[np.ndarray, np.ndarray] | None = None):
        self.levels = []
        for order in range(ORDER, -1, -1):
            below, sums = short if short is not None and order < 2 else (codes, counts)
            keys = below.astype(np.uint64) & U64((1 << 8 * (order + 1)) - 1)
            keys, where = np.unique(keys, return_inverse=True)
            n = np.bincount(where, sums, len(keys))
            context, owner = np.unique(keys >> U64(8), return_inverse=True)
            total = np.bincount(owner, n, len(context))
            distinct = np.bincount(owner, minlength=len(context)).astype(float)
            self.levels.append((order, keys, n, context, owner, total, distinct))
        # what a context's symbols weigh in the next shorter context, where they are excluded after an escape
        self.excluded = []
        for (_, keys, _, context, owner, _, _), (order, low_keys, low_n, *_) in zip(self.levels, self.levels[1:]):
            low = np.searchsorted(low_keys, keys & U64((1 << 8 * (order + 1)) - 1))
            self.excluded.append(np.bincount(owner, low_n[low], len(context)) if len(keys) else np.zeros(0))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Exact code length of the last byte after the three before it: escapes by method C, with exclusion."""
        codes = codes.astype(np.uint64)
        cost, open_ = np.zeros(len(codes)), np.arange(len(codes))
        gone_n, gone_d = np.zeros(len(codes)), np.zeros(len(codes))
        for i, (order, keys, n, context, _, total, distinct) in enumerate(self.levels):
            code = codes[open_] & U64((1 << 8 * (order + 1)) - 1)
            at = np.searchsorted(context, code >> U64(8))
            seen = at < len(context)
            seen[seen] = context[at[seen]] == code[seen] >> U64(8)
            rows, at, code = open_[seen], at[seen], code[seen]
            t, d = total[at] - gone_n[rows], distinct[at] - gone_d[rows]
            place = np.searchsorted(keys, code)
            hit = place < len(keys)
            hit[hit] = keys[place[hit]] == code[hit]
            cost[rows[hit]] += np.log2((t[hit] + d[hit]) / n[place[hit]])
            miss, real = ~hit, ~hit & (d > 0)  # an escape is free where all symbols are excluded
            cost[rows[real]] += np.log2((t[real] + d[real]) / d[real])
            gone_d[rows[miss]] = distinct[at[miss]]
            if i < len(self.excluded):
                gone_n[rows[miss]] = self.excluded[i][at[miss]]
            open_ = np.sort(np.concatenate([open_[~seen], rows[miss]]))
        cost[open_] += np.log2(256 - gone_d[open_])
        return cost


class Scorer:
    """Code lengths of all languages for every known context, with a hash table over them.

    With ``short`` it is that of one pass: bytes whose context's last two bytes are outside the pairs add nothing.
    """

    def __init__(self, model: dict[str, tuple[np.ndarray, np.ndarray]], short: dict[str, tuple] | None = None,
                 low: int = 0, high: int = PAIRS):
        self.names = sorted(model)
        self.trees = [Tree(*model[x], short[x] if short else None) for x in self.names]
        self.low, self.high = low, high
        self.known = np.unique(np.concatenate([model[x][0] for x in self.names]))
        self.cost = np.stack([t.bits(self.known) for t in self.trees], 1).astype(np.float32)
        self.shift = U64(64 - max(10, int(4 * len(self.known)).bit_length()))
        slot = self.slot(self.known)
        self.table = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.table[slot] = np.arange(len(self.known))

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(U64) * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each row in each language."""
        out = np.zeros((len(offsets) - 1, len(self.names)))
        if not len(data):
            return out
        codes = contexts(data, offsets)
        if (self.low, self.high) == (0, PAIRS):
            cost = self.costs(codes)
        else:
            pairs = codes >> np.uint32(8) & np.uint32(PAIRS - 1)
            inside = (pairs >= self.low) & (pairs < self.high)
            cost = np.zeros((len(codes), len(self.names)), np.float32)
            cost[inside] = self.costs(codes[inside])
        full = np.flatnonzero(np.diff(offsets) > 0)
        out[full] = np.add.reduceat(cost, offsets[full], axis=0, dtype=np.float64)
        return out

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each code in each language."""
        at = self.table[self.slot(codes)]
        other = np.flatnonzero((at < 0) | (self.known[at] != codes))  # not in its slot, or not known at all
        cost = self.cost[at]
        if len(other):
            place = np.minimum(np.searchsorted(self.known, codes[other]), len(self.known) - 1)
            cost[other] = self.cost[place]
            strange = other[self.known[place] != codes[other]]
            if len(strange):
                fresh, where = np.unique(codes[strange], return_inverse=True)
                cost[strange] = np.stack([t.bits(fresh) for t in self.trees], 1)[where]
        return cost


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of contexts per language, summed within the task while they are fewer than a million."""
    names: dict[str, int] = {}
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

    def shown(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(names), pa.string()).take(pa.array((keys >> U64(32)).astype(np.int64))),
             pa.array((keys & U64(0xFFFFFFFF)).astype(np.int64)), pa.array(counts)], ["lang", "code", "n"])

    for batch in sliced(batches, "text"):
        data, offsets = flat(batch["text"])
        lang = np.array([names.setdefault(x, len(names)) for x in batch["lang"].to_pylist()], U64)
        parts.append(np.unique(contexts(data, offsets).astype(U64) | np.repeat(lang, np.diff(offsets)) << U64(32),
                               return_counts=True))
        if sum(len(k) for k, _ in parts) > 2_000_000:
            parts = [merged()]
            if len(parts[0][0]) > 1_000_000:
                yield shown(*parts.pop())
    if parts:
        yield shown(*merged())


class Model(dict):
    """Codes and counts of each language's nodes: all of them, or those of the first pass if there are several.

    ``nodes`` is the written table of all nodes, ``borders`` are the passes' ranges of pairs, and ``short`` has the sums
    of each language by its last two bytes.
    """

    def __init__(self, nodes: DataFrame, sizes: dict[str, int], max_nodes: int):
        self.nodes, self.borders, self.short = nodes, [0, PAIRS], None
        if max(sizes.values(), default=0) > max_nodes:
            self.borders = _borders(nodes, max_nodes)
            pairs = nodes.groupBy("lang", F.expr("code & 65535").alias("code")).agg(F.sum("n").alias("n"))
            self.short = {x: _arrays(pairs.where(F.col("lang") == x)) for x in sizes}
        super().__init__(self.part(*self.borders[:2], sorted(sizes)))

    def part(self, low: int, high: int, names: list[str] | None = None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """The nodes of a range of pairs; every language is there, if need be without nodes."""
        rows = self.nodes.where(f"{_PAIR} BETWEEN {low} AND {high - 1}") if high - low < PAIRS else self.nodes
        return {x: _arrays(rows.where(F.col("lang") == x)) for x in names or list(self)}


def _arrays(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    kept = nodes.select("code", "n").toPandas().sort_values("code")
    return kept["code"].to_numpy(np.uint32), kept["n"].to_numpy(float)


def _borders(nodes: DataFrame, max_nodes: int) -> list[int]:
    """Borders of ranges of pairs in which no language has more than ``max_nodes`` nodes, or which are one pair."""
    borders, filled = [0], {}
    sizes = nodes.groupBy(F.expr(_PAIR).alias("pair"), "lang").count().groupBy("pair").agg(
        F.collect_list(F.struct("lang", "count")).alias("sizes"))
    for pair, found in sizes.orderBy("pair").toLocalIterator():
        if pair > borders[-1] and any(filled.get(lang, 0) + n > max_nodes for lang, n in found):
            borders.append(pair)
            filled = {}
        for lang, n in found:
            filled[lang] = filled.get(lang, 0) + n
    return [*borders, PAIRS]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        max_nodes: int = MAX_NODES) -> Model:
    """Codes and counts of each language's deepest contexts, from all labelled texts outside the held-out fifth.

    Every byte of every such text is counted, and every node is kept in a written table. ``max_nodes`` bounds what is held
    at once, not the model: where a language has more, the nodes are dealt by the last two bytes of their context, and
    each range of pairs is a pass of ``predict``, with the same result. Null languages and ids are left out; null and
    empty texts add nothing, and a language with no bytes is not learned.
    """
    rows = only(docs, doc_id=id_col, text=text_col, lang=lang_col)
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    nodes = materialize(rows.select("text", "lang").mapInArrow(_counter, "lang string, code long, n long")
                        .groupBy("lang", "code").agg(F.sum("n").alias("n")), "nodes")
    return Model(nodes, dict(nodes.groupBy("lang").count().collect()), max_nodes)


def _lettered(texts: pa.Array) -> np.ndarray:
    return np.array([bool(x) and any(map(str.isalpha, x)) for x in texts.to_pylist()], bool)


def _judged(ids: pa.Array, lettered: np.ndarray, bits: np.ndarray, names: list[str]) -> pa.RecordBatch:
    best = bits.argmin(1)
    low = bits[np.arange(len(best)), best]
    score = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1)
    found = [names[i] if ok else "und" for i, ok in zip(best, lettered)]
    return pa.RecordBatch.from_arrays([
        ids, pa.array(found, pa.string()), pa.array(np.where(lettered, score, 0.0)),
        pa.array(np.where(lettered, low, 0.0))], ["doc_id", "lang_pred", "score", "bits"])


def _passes(rows: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lettered, passes`` (array of pass, bits): each pass is written, by the digests of the texts, before the
    next part of the model is broadcast."""
    spark, path = rows.sparkSession, fresh_path(rows.sparkSession, "bits")
    keyed = rows.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    for number, (low, high) in enumerate(zip(model.borders, model.borders[1:])):
        shared = spark.sparkContext.broadcast((model.part(low, high), model.short))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, number=number, low=low, high=high) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(*shared.value, low, high)
            for batch in sliced(batches, "text"):
                bits = scorer.bits(*flat(batch["text"]))
                lettered = _lettered(batch["text"]) if number == 0 else np.zeros(len(bits), bool)
                yield pa.RecordBatch.from_arrays([
                    batch["digest"], pa.array(np.full(len(bits), number), pa.int32()), pa.array(lettered),
                    pa.array(list(bits), pa.list_(pa.float64()))], ["digest", "pass", "lettered", "bits"])

        found = keyed.select("digest", "text").mapInArrow(run, "digest string, pass int, lettered boolean, bits array<double>")
        found.write.mode("append").parquet(path)
        shared.destroy()
    found = spark.read.schema("digest string, pass int, lettered boolean, bits array<double>").parquet(path)
    found = found.groupBy("digest", "pass").agg(F.max("lettered").alias("lettered"), F.max("bits").alias("bits"))
    found = found.groupBy("digest").agg(F.max("lettered").alias("lettered"),
                                        F.sort_array(F.collect_list(F.struct("pass", "bits"))).alias("passes"))
    return keyed.select("doc_id", "digest").join(found, "digest").drop("digest")


def predict(docs: DataFrame, model: dict[str, tuple[np.ndarray, np.ndarray]], id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, bits``: the language with the shortest code and its share among all, equal priors.

    ``und`` with score 0 if the text is null, empty or has no letter, or nothing was learned; ties go to the first name.
    ``bits`` is the code length in the predicted language. A model of several passes is scored pass by pass, each over
    all texts; the code lengths of a text are then added up.
    """
    rows = only(docs, doc_id=id_col, text=text_col)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, bits double"
    if isinstance(model, Model) and len(model.borders) > 2:
        names = sorted(model)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = np.array([np.sum([y["bits"] for y in x], 0) for x in batch["passes"].to_pylist()])
                lettered = batch["lettered"].to_numpy(zero_copy_only=False)
                yield _judged(batch["doc_id"], lettered, bits.reshape(-1, len(names)), names)

        return _passes(rows, model).mapInArrow(added, schema)
    shared = docs.sparkSession.sparkContext.broadcast(dict(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in sliced(batches, "text"):
            if scorer is None:
                yield _judged(batch["doc_id"], np.zeros(batch.num_rows, bool), np.zeros((batch.num_rows, 1)), ["und"])
            else:
                yield _judged(batch["doc_id"], _lettered(batch["text"]), scorer.bits(*flat(batch["text"])), scorer.names)

    return rows.mapInArrow(run, schema)
