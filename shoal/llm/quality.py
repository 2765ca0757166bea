"""Quality of texts by a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import U64, byte_class, expand, flat, held_out, mix, only, prefix_sums, sliced, small_batches, span_hash, words

_SPACE = byte_class(b" \t\n\x0b\x0c\r")
#: Byte classes whose shares are statistics; every byte of a text is in one of them or is a lower-case letter.
CLASSES = {
    "upper": byte_class(bytes(range(65, 91))), "digit": byte_class(b"0123456789"), "space": _SPACE & ~byte_class(b"\n"),
    "line": byte_class(b"\n"), "stop": byte_class(b".,;:?'\"-()"), "bang": byte_class(b"!"), "bar": byte_class(b"|"),
    "symbol": byte_class(b"#$%&*+/<=>@[\\]^_`{}~"), "wide": byte_class(bytes(range(128, 256))),
}
STATISTICS = (*(f"share_{x}" for x in CLASSES), "log_bytes", "log_words", "word_mean", "word_spread", "repeated_words",
              "top_word", "same_as_last", "repeated_triples", "repeated_lines", "line_mean")


def _distinct(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the most frequent value of each row."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(fresh)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, row[at], np.diff(np.concatenate([at, [len(row)]])))
    return np.bincount(row[at], minlength=n), most


def statistics(texts: pa.Array) -> np.ndarray:
    """Transformed statistics (rows x len(STATISTICS)): counts become log(1 + n), shares asin(sqrt(part / (whole + a))),
    where ``a`` keeps the shares of a few bytes, words or lines from looking like those of a long text."""
    data, offsets = flat(texts)
    n, size = len(texts), np.diff(offsets)
    share = lambda part, whole, a=20: np.arcsin(np.sqrt(np.clip(part / (whole + a), 0, 1)))
    columns = []
    for members in CLASSES.values():
        inside = np.concatenate([[0], np.cumsum(members[data], dtype=np.int64)])
        columns.append(share(inside[offsets[1:]] - inside[offsets[:-1]], size, 100))
    sums = prefix_sums(data)
    starts, ends, first = words(data, offsets, ~_SPACE)
    count = np.diff(first)
    row = np.repeat(np.arange(n), count)
    length = (ends - starts).astype(float)
    mean = np.bincount(row, length, n) / np.maximum(count, 1)
    spread = np.sqrt(np.maximum(np.bincount(row, length ** 2, n) / np.maximum(count, 1) - mean ** 2, 0))
    hashes = span_hash(sums, starts, ends)
    distinct, most = _distinct(row, hashes, n)
    again = np.zeros(len(row), bool)
    again[1:] = (row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1])
    triples = np.maximum(count - 2, 0)
    at = expand(first[:-1], triples)
    triple = mix(mix(hashes[at] * U64(3) + hashes[at + 1]) + hashes[at + 2]) if len(at) else hashes[:0]
    distinct_triples, _ = _distinct(np.repeat(np.arange(n), triples), triple, n)
    line_starts, line_ends, line_first = words(data, offsets, ~byte_class(b"\n"))
    lines = np.diff(line_first)
    distinct_lines, _ = _distinct(np.repeat(np.arange(n), lines), span_hash(sums, line_starts, line_ends), n)
    columns += [np.log1p(size), np.log1p(count), np.log1p(mean), np.log1p(spread), share(count - distinct, count), share(np.maximum(most - 1, 0), count),
                share(np.bincount(row[again], minlength=n), count),
                share(triples - distinct_triples, triples), share(lines - distinct_lines, lines, 5), np.log1p(size / np.maximum(lines, 1))]
    return np.stack(columns, 1)


class Model(NamedTuple):
    """Scale of the statistics, and for each class its mean, Cholesky factor (inverted once), log determinant, prior."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_dets: list[float]
    log_priors: list[float]
    constant: float | None  # the score if a class has no rows

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1 from the difference of the log densities."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.centre) / self.scale
        log = [p - 0.5 * (det + (((z - m) @ f.T) ** 2).sum(1))
               for m, f, det, p in zip(self.means, self.factors, self.log_dets, self.log_priors)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, x`` for every row; null counts as empty."""
    rows = only(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            x = statistics(batch["text"])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()),
                                                           pa.array(x.ravel()))], ["doc_id", "x"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each label: rows, sums and sums of products of the statistics, one row per entry."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        labels = batch["label"].to_numpy()
        x = np.array(batch["x"].to_pylist(), float).reshape(len(labels), -1)
        for label in np.unique(labels).tolist():
            part = x[labels == label]
            part = np.hstack([np.ones((len(part), 1)), part])
            totals[label] = totals.get(label, 0) + part.T @ part
    for label, total in totals.items():
        yield pa.RecordBatch.from_pydict({"label": pa.array([label] * total.size, pa.int32()),
                                          "place": pa.array(range(total.size), pa.int32()), "total": pa.array(total.ravel())})


def fit(features: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
        shrinkage: float | None = None, pooling: float = 0.01) -> Model:
    """A quadratic discriminant from all labelled rows outside the held-out fifth.

    Each class covariance is mixed with the pooled one (``pooling``) and then with a multiple of the identity of the
    same trace (``shrinkage``; by default d / (d + n) for d statistics and n rows of the class, much where it is known
    from few rows), so it can be inverted for any number of rows. The moments are summed where the rows
    are; the driver gets two matrices of the size of the statistics. Several labels of one id count as the
    smallest; null labels and ids, and labels other than 0 and 1, are left out. If a class has no rows the
    score is the share of the other one, or 0.5 without any labels.
    """
    known = only(labels, doc_id=id_col, label=label_col).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    rows = features.join(known, "doc_id").select("label", "x")
    totals = rows.mapInArrow(_moments, "label int, place int, total double").groupBy("label", "place").agg(F.sum("total").alias("total"))
    d = len(STATISTICS) + 1
    moments = {0: np.zeros(d * d), 1: np.zeros(d * d)}
    for label, place, total in totals.collect():
        moments[label][place] = total
    moments = [moments[k].reshape(d, d) for k in (0, 1)]
    counts = [m[0, 0] for m in moments]
    if not min(counts):
        constant = 0.5 if not sum(counts) else counts[1] / sum(counts)
        return Model(np.zeros(d - 1), np.ones(d - 1), [], [], [], [], constant)
    whole = sum(moments)
    centre = whole[0, 1:] / whole[0, 0]
    scale = np.sqrt(np.maximum(np.diag(whole)[1:] / whole[0, 0] - centre ** 2, 1e-12))
    means, spreads = [], []
    for m, n in zip(moments, counts):
        mean = m[0, 1:] / n
        means.append((mean - centre) / scale)
        spreads.append((m[1:, 1:] / n - np.outer(mean, mean)) / np.outer(scale, scale))
    pooled = sum(s * n for s, n in zip(spreads, counts)) / sum(counts)
    factors, log_dets = [], []
    for spread, n in zip(spreads, counts):
        share = (d - 1) / (d - 1 + n) if shrinkage is None else shrinkage
        spread = (1 - pooling) * spread + pooling * pooled
        spread = (1 - share) * spread + share * max(np.trace(spread) / (d - 1), 1e-6) * np.eye(d - 1)
        factor = np.linalg.cholesky(spread)
        factors.append(np.linalg.inv(factor))
        log_dets.append(2 * float(np.log(np.diag(factor)).sum()))
    return Model(centre, scale, means, factors, log_dets, [float(np.log(n / sum(counts))) for n in counts], None)


def score(features: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for every row of ``features``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch["x"].to_pylist(), float).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.score(x))], ["doc_id", "score"])

    return features.mapInArrow(run, f"doc_id {features.schema['doc_id'].dataType.simpleString()}, score double")


def reject(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; all columns as they are, scored where they are read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            yield batch.filter(pa.array(model.score(statistics(batch.column(text_col))) >= threshold))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
