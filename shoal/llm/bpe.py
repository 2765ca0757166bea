"""Byte-level BPE over chunks of texts, and back."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import only, sliced

#: Pieces whose ids a task remembers at once; it only saves work.
REMEMBERED = 60_000


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def tokens_of(ranks: bytes) -> dict[int, bytes]:
    return {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, ranks.splitlines())}


class Codec:
    """Cuts a text into pieces by the pattern and merges each piece by the ranks; remembers pieces it has seen."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {token: rank for rank, token in tokens_of(ranks).items()}
        self.find = regex.compile(pattern)
        # one piece at a time: the pattern takes whatever it is given whole
        self.merges = tiktoken.Encoding("piece", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks, special_tokens={})
        self.packed = _Packed(self.merges.encode_ordinary)

    def encode(self, text: str, ahead: int = 0) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers. Its last ``ahead`` characters are only looked at: they
        follow a boundary, and what stands before it may depend on them."""
        if len(self.packed) > REMEMBERED:
            self.packed.clear()
        pieces = self.find.findall(text)
        while ahead > 0:
            ahead -= len(pieces.pop())
        return b"".join(map(self.packed.__getitem__, pieces))


class _Packed(dict):
    def __init__(self, merge: Callable[[str], list[int]]):
        super().__init__()
        self.merge = merge

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = array("I", self.merge(piece)).tobytes()
        return ids


def _chunked(chunk_chars: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(batch["digest"].to_pylist(), batch["text"].to_pylist()):
                for no, start in enumerate(range(0, len(text), chunk_chars)):
                    stop = min(len(text), start + chunk_chars + overlap)
                    yield pa.RecordBatch.from_pydict({
                        "digest": pa.array([digest]), "chunk": pa.array([no], pa.int32()),
                        "start": pa.array([start], pa.int64()), "last": pa.array([stop == len(text)]),
                        "text": pa.array([text[start:stop]])})
                    if stop == len(text):
                        break
    return run


def _boundaries(pattern: str, chunk_chars: int, overlap: int):
    """For each chunk: boundaries that its scan found where it overlaps its neighbours, and its first sure boundary.

    Between a character that is no white space and one that is, every scan has a boundary, wherever it began: no
    alternative of the pattern joins the two. From there on a scan is the one of the whole text, until the last two
    characters of the chunk, where what follows it could still change a match.
    """
    sure = regex.compile(r"\S(?=\s)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern)
        for batch in batches:
            heads, tails, firsts = [], [], []
            for no, start, last, text in zip(*(batch[c].to_pylist() for c in ("chunk", "start", "last", "text"))):
                ends = np.cumsum(np.array([0, *map(len, find.findall(text))], np.int64))
                if not last:
                    ends = ends[ends <= len(text) - 2]
                first = sure.search(text)
                heads.append((ends[ends <= overlap] + start).tolist())
                tails.append((ends[ends >= chunk_chars] + start).tolist())
                firsts.append(0 if no == 0 else None if first is None else start + first.end())
            yield pa.RecordBatch.from_pydict({
                "digest": batch["digest"], "chunk": batch["chunk"], "start": batch["start"],
                "head": pa.array(heads, pa.list_(pa.int64())), "tail": pa.array(tails, pa.list_(pa.int64())),
                "sure": pa.array(firsts, pa.int64())})
    return run


def _encoder(ranks, pattern: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value, pattern)
        for batch in sliced(batches, "text"):
            ahead = batch["ahead"].to_pylist() if "ahead" in batch.schema.names else [0] * batch.num_rows
            ids = [codec.encode(x or "", n) for x, n in zip(batch["text"].to_pylist(), ahead)]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in keep), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                [*keep, "n_tokens", "ids"])
    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of segments from their chunks, or ids of texts from their segments, in order."""
    for batch in batches:
        whole, ahead = [], []
        for parts in batch["parts"].to_pylist():
            parts.sort(key=lambda x: x["chunk"])
            ahead.append(len(parts[-1]["ahead"]))
            whole.append("".join(x["text"] for x in parts) + parts[-1]["ahead"])
        yield pa.RecordBatch.from_arrays([batch["digest"], batch["segment"], pa.array(whole), pa.array(ahead, pa.int32())],
                                         ["digest", "segment", "text", "ahead"])


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = [b"".join(x["ids"] for x in sorted(parts, key=lambda x: x["segment"])) for parts in batch["parts"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch["digest"], pa.array([len(x) // 4 for x in whole], pa.int64()), pa.array(whole, pa.binary())],
            ["digest", "n_tokens", "ids"])


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           chunk_chars: int = 32_768, overlap: int = 512) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit integers) for every row of ``docs``.

    A text of up to ``chunk_chars + overlap`` characters is one chunk and is encoded where it is read. Longer texts, each
    distinct one once, are cut into overlapping chunks that are dealt over all tasks and pre-tokenised there. A chunk
    takes over from the one before at the first boundary that both scans found in the overlap and that is known to
    be one of the whole text; without such a place (a very long run without white space) the chunks become one segment.
    Segments are then encoded in parallel and the ids put together in order, so the result is that of the whole text.

    Null or empty texts have no ids; ids may be null or repeated (each row is encoded); other columns are not read.
    The vocabulary file is read by the driver only and broadcast (about 1 MB).
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    rows = only(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    long = F.length("text") > chunk_chars + overlap
    short = rows.where(~F.coalesce(long, F.lit(False))).mapInArrow(
        _encoder(ranks, pattern, ["doc_id"]), f"doc_id {kind}, n_tokens long, ids binary")

    long_rows = rows.where(long).withColumn("digest", F.sha2("text", 256))
    chunks = (long_rows.groupBy("digest").agg(F.first("text").alias("text"))
              .mapInArrow(_chunked(chunk_chars, overlap), "digest string, chunk int, start long, last boolean, text string")
              .repartition("digest", "chunk"))
    scans = chunks.mapInArrow(
        _boundaries(pattern, chunk_chars, overlap),
        "digest string, chunk int, start long, head array<long>, tail array<long>, sure long")
    order = "PARTITION BY digest ORDER BY chunk"
    cuts = (scans.selectExpr("digest", "chunk", "start", "head", f"lag(tail) OVER ({order}) AS tail",
                             f"lag(sure) OVER ({order}) AS sure")
            .selectExpr("digest", "chunk", "start", "CASE WHEN chunk = 0 THEN 0 ELSE "
                        "array_min(filter(array_intersect(head, tail), x -> x >= sure)) END AS cut")
            .selectExpr("digest", "chunk", "start", "cut",
                        f"max(CASE WHEN cut IS NOT NULL THEN chunk END) OVER ({order}) AS segment",
                        f"lead(chunk) OVER ({order}) IS NULL AS final", f"lead(cut) OVER ({order}) AS next_cut"))
    # the part of each chunk that its segment takes: up to the next cut, or to the next chunk's start inside a segment
    parts = (chunks.join(cuts.drop("start"), ["digest", "chunk"])
             .selectExpr("digest", "segment", "chunk", "text", "next_cut", "coalesce(cut, start) - start AS skip",
                         f"CASE WHEN final THEN length(text) WHEN next_cut IS NOT NULL THEN next_cut - start "
                         f"ELSE {chunk_chars} END AS stop")
             .selectExpr("digest", "segment", "chunk", "substring(text, int(skip + 1), int(stop - skip)) AS text",
                         "CASE WHEN next_cut IS NULL THEN '' ELSE substring(text, int(stop + 1), 2) END AS ahead"))
    segments = parts.groupBy("digest", "segment").agg(F.collect_list(F.struct("chunk", "text", "ahead")).alias("parts")).mapInArrow(
        _joined, "digest string, segment int, text string, ahead int")
    encoded = (segments.mapInArrow(_encoder(ranks, pattern, ["digest", "segment"]),
                                   "digest string, segment int, n_tokens long, ids binary")
               .groupBy("digest").agg(F.collect_list(F.struct("segment", "ids")).alias("parts"))
               .mapInArrow(_joined_ids, "digest string, n_tokens long, ids binary"))
    return short.unionByName(long_rows.select("doc_id", "digest").join(encoded, "digest").drop("digest"))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the tokens' bytes one after another. Null ids give null."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        tokens = tokens_of(ranks.value)
        for batch in sliced(batches, "ids"):
            raw = [None if x is None else b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist()))
                   for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, "decoded"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{names}, decoded binary")
