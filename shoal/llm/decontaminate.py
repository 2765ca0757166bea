"""Benchmark passages in documents: a prefix-filtered join of item windows with document words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import U64, byte_class, expand, flat, lower, mix, only, prefix_sums, sliced, span_hash, words
from shoal.session import materialize

#: Word bytes after lower-casing: a-z, 0-9 and all of UTF-8 beyond ASCII.
WORD = byte_class(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))
#: Windows that are joined in one pass over the documents; it bounds what is broadcast (about 150 bytes a window).
PASS_WINDOWS = 200_000


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``item_id, words``: every distinct run of ``size`` words of an item, or all its words if it has fewer.

    Items without words, without text or without an id have none.
    """
    items = only(benchmark, item_id=id_col, text=text_col).selectExpr(
        "item_id", "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        r"'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', 0) AS w")
    return (items.where("item_id IS NOT NULL AND size(w) > 0")
            .selectExpr("item_id", "explode(transform(sequence(1, greatest(size(w) - {0} + 1, 1)), "
                        "i -> slice(w, i, {0}))) AS words".format(size)).distinct())


def _word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key of each word from its first and last eight bytes and its length; only a filter."""
    length = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    head, tail = np.zeros(len(starts), U64), np.zeros(len(starts), U64)
    back = np.maximum(ends - 8, starts)
    for i in range(8):
        inside = i < length
        head |= np.where(inside, padded[starts + i], 0).astype(U64) << U64(8 * i)
        tail |= np.where(inside, padded[back + i], 0).astype(U64) << U64(8 * i)
    return mix(head + mix(tail + length.astype(U64)))


def _keys_of(tokens: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(tokens), np.uint8)
    ends = np.cumsum([len(x) for x in tokens], dtype=np.int64)
    return _word_keys(data, ends - np.array([len(x) for x in tokens], np.int64), ends)


class Vocabulary:
    """Words of the items by key; words that share a key share a slot, which only makes more candidates."""

    def __init__(self, tokens: list[bytes]):
        self.keys = np.unique(_keys_of(tokens)) if tokens else np.zeros(0, U64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> U64(44)).astype(np.int64)] = True

    def slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``keys`` of vocabulary words, and their slots."""
        at = np.flatnonzero(self.seen[(keys >> U64(44)).astype(np.int64)])
        slot = np.searchsorted(self.keys, keys[at])
        good = slot < len(self.keys)
        good[good] = self.keys[slot[good]] == keys[at[good]]
        return at[good], slot[good]


class Index(NamedTuple):
    """Windows of one pass, by the slot of their rarest word."""

    tokens: list[bytes]  # the rarest words
    starts: np.ndarray  # of each slot's entries
    window: np.ndarray
    offset: np.ndarray  # words before the rarest word in its window
    sizes: np.ndarray  # words of each window
    hashes: np.ndarray  # of each window's words
    texts: list[tuple[bytes, ...]]
    numbers: np.ndarray  # of the windows, in the table of windows


def _window_hashes(sums: np.ndarray, powers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers[starts])


_FORWARD, _BACK = U64(0xD6E8FEB86659FD93), U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def _word_sums(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes)
    forward, back = (np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(n, p, U64)])) for p in (_FORWARD, _BACK))
    sums = np.zeros(n + 1, U64)
    np.cumsum(hashes * forward[:n], out=sums[1:])
    return sums, back


def _hash_words(tokens: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(tokens), np.uint8)
    ends = np.cumsum([len(x) for x in tokens], dtype=np.int64)
    return span_hash(prefix_sums(data), ends - np.array([len(x) for x in tokens], np.int64), ends)


def _frequencies(docs: DataFrame, vocabulary: DataFrame) -> dict[bytes, int]:
    """In how many places of the documents each item word stands (by key: an upper bound for words that share one)."""
    tokens = [x.word.encode() for x in vocabulary.toLocalIterator()]
    shared = docs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(shared.value)
        counts = np.zeros(len(known.keys), np.int64)
        for batch in sliced(batches, "text"):
            data, offsets = flat(batch["text"])
            data = lower(data)
            starts, ends, _ = words(data, offsets, WORD)
            counts += np.bincount(known.slots(_word_keys(data, starts, ends))[1], minlength=len(counts))
        slot = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(slot, pa.int64()), "n": pa.array(counts[slot], pa.int64())})

    if not tokens:
        return {}
    totals = dict(docs.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect())
    slots = Vocabulary(tokens).keys.searchsorted(_keys_of(tokens))
    return {token: totals.get(int(slot), 0) for token, slot in zip(tokens, slots)}


def _index(rows: list, rarity: dict[bytes, int]) -> Index:
    interned: dict[str, bytes] = {}
    texts = [tuple(interned.setdefault(x, x.encode()) for x in row.words) for row in rows]
    rarest = [min(range(len(w)), key=lambda i: (rarity.get(w[i], 0), w[i])) for w in texts]
    tokens = [w[i] for w, i in zip(texts, rarest)]
    slots = Vocabulary(tokens).keys.searchsorted(_keys_of(tokens)) if tokens else np.zeros(0, np.int64)
    order = np.argsort(slots, kind="stable")
    sizes = np.array([len(w) for w in texts], np.int64)
    hashes = np.zeros(0, U64)
    if texts:
        ends = np.cumsum(sizes)
        sums, back = _word_sums(_hash_words([x for w in texts for x in w]))
        hashes = _window_hashes(sums, back, ends - sizes, ends)
    n_slots = int(slots.max()) + 1 if len(slots) else 0
    return Index(tokens, np.searchsorted(slots[order], np.arange(n_slots + 1)), order,
                 np.array(rarest, np.int64)[order], sizes, hashes, texts, np.array([row.number for row in rows], np.int64))


def _matches(index: Index, known: Vocabulary, data, starts, ends, first) -> tuple[np.ndarray, np.ndarray]:
    """First word and window of every occurrence: join on the rarest word, bounds, hash, then the words themselves."""
    at, slot = known.slots(_word_keys(data, starts, ends))
    counts = index.starts[slot + 1] - index.starts[slot]
    entry = expand(index.starts[slot], counts)
    window, begin = index.window[entry], np.repeat(at, counts) - index.offset[entry]
    row = np.searchsorted(first, np.repeat(at, counts), "right") - 1
    # the window must fit between the first and the last word of the text
    fits = (begin >= first[row]) & (begin + index.sizes[window] <= first[row + 1])
    begin, window = begin[fits], window[fits]
    if not len(begin):
        return begin, window
    sums, back = _word_sums(span_hash(prefix_sums(data), starts, ends))
    same = _window_hashes(sums, back, begin, begin + index.sizes[window]) == index.hashes[window]
    begin, window = begin[same], window[same]
    checked: dict[tuple[int, bytes], bool] = {}
    raw, inside = data.tobytes() if len(begin) else b"", np.zeros(len(begin), bool)
    for i, (b, w) in enumerate(zip(begin.tolist(), window.tolist())):
        last = b + int(index.sizes[w])
        key = (w, raw[starts[b]:ends[last - 1]])
        if key not in checked:
            checked[key] = tuple(raw[starts[x]:ends[x]] for x in range(b, last)) == index.texts[w]
        inside[i] = checked[key]
    return begin[inside], window[inside]


def _covered(index: Index, known: Vocabulary, texts: pa.Array):
    """The first word of each row, which words are covered, and first word and window of every occurrence."""
    data, offsets = flat(texts)
    data = lower(data)
    starts, ends, first = words(data, offsets, WORD)
    begin, window = _matches(index, known, data, starts, ends, first)
    depth = np.zeros(len(starts) + 1, np.int64)
    np.add.at(depth, begin, 1)
    np.add.at(depth, begin + index.sizes[window], -1)
    return first, np.cumsum(depth)[:-1] > 0, begin, window


def _finder(shared, key: str):
    """For each row: its words, the covered runs of words (start, end, start, end, ...) and the numbers of the windows found."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        known = Vocabulary(index.tokens)
        for batch in sliced(batches, "text"):
            first, covered, begin, window = _covered(index, known, batch["text"])
            before, after = np.zeros(len(covered), bool), np.zeros(len(covered), bool)
            before[1:], after[:-1] = covered[:-1], covered[1:]
            before[first[:-1][first[:-1] < len(covered)]] = False
            after[first[1:][first[1:] > 0] - 1] = False
            run_starts, run_ends = np.flatnonzero(covered & ~before), np.flatnonzero(covered & ~after) + 1
            bounds = np.searchsorted(run_starts, first)
            base = np.repeat(first[:-1], np.diff(bounds))
            row = np.searchsorted(first, begin, "right") - 1
            met = np.unique(np.stack([row, index.numbers[window]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([
                batch[key], pa.array(np.diff(first), pa.int64()),
                pa.ListArray.from_arrays(pa.array(bounds * 2, pa.int32()), pa.array(
                    np.stack([run_starts - base, run_ends - base], 1).ravel(), pa.int64())),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(met[:, 0], np.arange(batch.num_rows + 1)), pa.int32()),
                                         pa.array(met[:, 1], pa.int64()))], [key, "n_words", "runs", "windows"])
    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs and windows of all passes put together."""
    for batch in batches:
        runs = []
        for found in batch["all_runs"].to_pylist():
            out: list[int] = []
            for start, end in sorted((x[i], x[i + 1]) for x in found for i in range(0, len(x), 2)):
                if out and start <= out[-1]:
                    out[-1] = max(out[-1], end)
                else:
                    out += [start, end]
            runs.append(out)
        yield pa.RecordBatch.from_arrays(
            [batch["digest"], batch["n_words"], pa.array(runs, pa.list_(pa.int64())), batch["windows"]],
            ["digest", "n_words", "runs", "windows"])


#: Words in the runs.
_N_HIT = "aggregate(transform(runs, (x, i) -> CASE WHEN i % 2 = 0 THEN -x ELSE x END), 0L, (n, x) -> n + x)"


def _digest(text: str):
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _by_text(keyed: DataFrame, indexes: list) -> DataFrame:
    """Runs and windows of each distinct text over all passes."""
    schema = "digest string, n_words long, runs array<long>, windows array<long>"
    texts = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    found = texts.mapInArrow(_finder(indexes[0], "digest"), schema)
    for index in indexes[1:]:
        found = found.union(texts.mapInArrow(_finder(index, "digest"), schema))
    return found.groupBy("digest").agg(
        F.max("n_words").alias("n_words"), F.collect_list("runs").alias("all_runs"),
        F.array_sort(F.flatten(F.collect_list("windows"))).alias("windows")).mapInArrow(_merged, schema)


def _indexes(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, size: int,
             pass_windows: int) -> tuple[list, DataFrame]:
    """One broadcast index for each pass, and the table of ``number, item_id`` of the windows.

    An index holds each distinct window once, by a number; which items have it, and how many, is only in the table."""
    pairs = materialize(item_windows(benchmark, item_col, item_text_col, size), "pairs")
    kinds = materialize(pairs.select("words").distinct().withColumn("number", F.monotonically_increasing_id()), "windows")
    pieces = max(1, -(-kinds.count() // pass_windows))
    indexes = []
    for piece in range(pieces):
        part = kinds.where(F.pmod(F.xxhash64("words"), F.lit(pieces)) == piece)
        rarity = _frequencies(rows, part.select(F.explode("words").alias("word")).distinct())
        indexes.append(rows.sparkSession.sparkContext.broadcast(_index(part.collect(), rarity)))
    return indexes, pairs.join(kinds, "words").select("number", "item_id")


def _with_items(found: DataFrame, carriers: DataFrame) -> DataFrame:
    """``items`` in place of ``windows``: looked up once for every distinct list of windows."""
    found = materialize(found.withColumn("met", F.when(F.size("windows") > 0, F.sha2(F.array_join("windows", ","), 256))), "found")
    lists = found.where("met IS NOT NULL").groupBy("met").agg(F.first("windows").alias("windows"))
    items = lists.select("met", F.explode("windows").alias("number")).join(carriers, "number").select("met", "item_id").distinct()
    items = items.groupBy("met").agg(F.array_sort(F.collect_list(F.col("item_id").cast("long"))).alias("items"))
    return found.join(items, "met", "left").withColumn("items", F.coalesce("items", F.array().cast("array<long>"))).drop("met", "windows")


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", size: int = 13,
                  pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """``doc_id, n_words, n_hit, runs, items`` for every row of ``docs``.

    An item's windows are its runs of ``size`` words (all its words if it has fewer). As a window is contained whole or
    not at all, its necessary prefix is one token: its word that is rarest over all documents, counted first. Words
    of the documents are joined with those tokens; the join is a lookup in a broadcast index where the
    documents are read, so no text is shuffled. A candidate has to fit between the first and last word of its text,
    its words' hash must agree, and then the words themselves are compared over the item-sized window.

    ``runs`` are the covered runs of words (start, end, start, end, ...), ``n_hit`` their words, ``items`` the sorted ids
    of items with an occurring window. Item ids are integers. At most about ``pass_windows`` windows are broadcast
    at once, each once however many items have it; a larger benchmark is cut by a hash and joined in several passes, whose
    runs are united by text. Items are joined to the windows found by a table, once for every distinct list of windows.

    Null and empty texts have no words. Items without words or id find nothing; equal windows of several items count
    for each; repeated rows of either table change nothing but the number of rows. Other columns are not read.
    """
    rows = only(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    indexes, carriers = _indexes(rows, benchmark, item_col, item_text_col, size, pass_windows)
    if len(indexes) == 1:
        found = rows.mapInArrow(_finder(indexes[0], "doc_id"),
                                f"doc_id {kind}, n_words long, runs array<long>, windows array<long>")
    else:
        keyed = rows.withColumn("digest", _digest("text"))
        found = keyed.select("doc_id", "digest").join(_by_text(keyed, indexes), "digest").drop("digest")
    return _with_items(found, carriers).withColumn("n_hit", F.expr(_N_HIT))


def contaminated(n_hit, n_words):
    """A twentieth of the words or more are benchmark passages."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                        item_text_col: str = "text", size: int = 13, pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """``docs`` without contaminated rows, all columns as they are; by the index of ``find_passages``, applied where the
    rows are read (with several passes: by the digests of contaminated texts)."""
    rows = only(docs, text=text_col)
    indexes, _ = _indexes(rows, benchmark, item_col, item_text_col, size, pass_windows)
    if len(indexes) > 1:
        found = _by_text(rows.withColumn("digest", _digest("text")), indexes)
        bad = found.where(contaminated(F.expr(_N_HIT), F.col("n_words"))).select(F.col("digest").alias("__digest"))
        return docs.join(bad, _digest(text_col) == F.col("__digest"), "left_anti")
    shared = indexes[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        known = Vocabulary(index.tokens)
        for batch in sliced(batches, text_col):
            first, covered, _, _ = _covered(index, known, batch.column(text_col))
            total = np.concatenate([[0], np.cumsum(covered)])
            n_hit = total[first[1:]] - total[first[:-1]]
            yield batch.filter(pa.array(~contaminated(n_hit, np.diff(first))))

    return docs.mapInArrow(run, docs.schema)
