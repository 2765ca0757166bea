"""URL rules in a sorted array of 64-bit digests."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import only

#: Bytes of rules that are broadcast; beyond that the candidates are joined with the rules.
MAX_SHARED = 64 << 20


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def split(column: str) -> tuple[str, str]:
    """SQL expressions of the host and the path of a url."""
    rest = f"substring({column}, locate('://', {column}) + 3)"
    has = f"coalesce(locate('://', {column}), 0) > 0"
    host = f"regexp_extract({rest}, '^[^/?#]*', 0)"
    low = f"translate({host}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = f"regexp_extract(substring({rest}, length({host}) + 1), '^[^?#]*', 0)"
    return f"CASE WHEN {has} THEN {low} ELSE '' END", f"CASE WHEN {has} THEN {path} ELSE '' END"


def digest(host: str, path: str) -> int:
    return xxhash.xxh64_intdigest(f"{host}\n{path}".encode())


class Digests:
    """The array, memory-mapped from an unlinked scratch file of this worker, and the rules' strings beside it."""

    def __init__(self, rules: list[Rule]):
        keys = np.array([digest(r.host, r.path) for r in rules], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.rules = [rules[i] for i in order]
        self.file = tempfile.TemporaryFile()
        keys[order].tofile(self.file)
        self.file.flush()
        self.keys = np.memmap(self.file, np.uint64, "r", shape=(len(rules),)) if rules else np.zeros(0, np.uint64)
        self.labels = max((r.host.count(".") + 1 for r in rules), default=0)
        self.path_sizes = sorted({len(r.path) for r in rules}, reverse=True)

    def candidates(self, host: str, path: str) -> Iterator[tuple[str, str]]:
        """Every host suffix and path prefix that a rule could have."""
        parts = host.split(".")
        for n in range(1, min(len(parts), self.labels) + 1):
            suffix = ".".join(parts[-n:])
            for size in self.path_sizes:
                if size <= len(path):
                    yield suffix, path[:size]

    def best(self, hosts: list[str], paths: list[str]) -> list[Rule | None]:
        """The longest rule that fits each url: one binary search for all candidates, then the strings themselves."""
        row, asked = [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            for candidate in self.candidates(host, path):
                row.append(i)
                asked.append(candidate)
        out: list[Rule | None] = [None] * len(hosts)
        keys = np.array([digest(*x) for x in asked], np.uint64)
        left, right = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
        for x in np.flatnonzero(right > left).tolist():
            for rule in self.rules[left[x]:right[x]]:
                if (rule.host, rule.path) == asked[x] and (out[row[x]] is None or _rank(rule) > _rank(out[row[x]])):
                    out[row[x]] = rule
        return out


def _rank(rule: Rule) -> tuple[int, int, bool]:
    return len(rule.text), len(rule.host), rule.verdict == "block"


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row.

    A rule fits its host and all subdomains if the path begins with the rule's. The longest (host and path together)
    wins, then the longer host, then ``block``; without a rule the verdict is ``default``. Each task maps the sorted
    digests once and probes all candidates of a batch with one binary search; strings are compared where digests
    agree. Rules of more than ``MAX_SHARED`` bytes need ``judge_joined``, which gives the same rows by a join.

    Null urls and urls without ``://`` have an empty host and path, which no rule fits. Other columns are not read.
    """
    if sum(len(r.text) + 16 for r in rules) > MAX_SHARED:
        raise ValueError("too many rules to share with every task; write them as a table and use judge_joined")
    rows = _split_rows(pages, id_col, url_col)
    shared = pages.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests(shared.value)
        for batch in batches:
            best = digests.best(batch["host"].to_pylist(), batch["path"].to_pylist())
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array([r and r.text for r in best], pa.string()),
                pa.array([r.verdict if r else default for r in best], pa.string())], [*batch.schema.names, "rule", "verdict"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def _split_rows(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    host, path = split("url")
    return only(pages, page_id=id_col, url=url_col).selectExpr("page_id", f"{host} AS host", f"{path} AS path")


def judge_joined(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 default: str = "allow") -> DataFrame:
    """As ``judge``, with rules of any number in a table ``host, path, verdict``: distinct urls are expanded to their
    candidates and joined on the digest and the strings, the best rule is aggregated before the shuffle."""
    rows = _split_rows(pages, id_col, url_col)
    bounds = rules.agg(F.max(F.size(F.split("host", r"\."))), F.collect_set(F.length("path"))).first()
    labels, sizes = bounds[0] or 0, ",".join(map(str, bounds[1])) or "cast(null AS int)"
    asked = rows.select("host", "path").distinct().selectExpr(
        "host", "path", f"explode(transform(sequence(1, least(size(split(host, '[.]')), {max(labels, 1)})), "
        "n -> array_join(slice(split(host, '[.]'), -n, n), '.'))) AS suffix").selectExpr(
        "host", "path", "suffix", f"explode(filter(array({sizes}), n -> n <= length(path))) AS size").selectExpr(
        "host", "path", "suffix", "substring(path, 1, size) AS prefix")
    keyed = rules.selectExpr("host AS suffix", "path AS prefix", "verdict AS v")
    found = asked.join(keyed, [F.xxhash64(asked.suffix, asked.prefix) == F.xxhash64(keyed.suffix, keyed.prefix),
                               asked.suffix == keyed.suffix, asked.prefix == keyed.prefix])
    best = found.groupBy("host", "path").agg(F.max(F.struct(
        F.length(F.concat(keyed.suffix, keyed.prefix)).alias("a"), F.length(keyed.suffix).alias("b"), (F.col("v") == "block").alias("c"),
        F.concat(keyed.suffix, keyed.prefix).alias("rule"), F.col("v").alias("verdict"))).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
