"""Secret scans with a trigram index: rules become Boolean trigram queries, matches of the index are verified."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shoal.llm.common import flat, lower, only, sliced, small_batches

try:
    from re import _constants as _codes, _parser
except ImportError:  # before Python 3.11
    import sre_constants as _codes
    import sre_parse as _parser


class Rule(NamedTuple):
    kind: str
    pattern: str
    min_chars: int
    group: int = 0  # the group that must have min_chars; the span is always the whole match
    ignore_case: bool = False
    until: str = ""  # the span runs on to the end of this pattern, if that comes before the rule's next match

    def compile(self) -> re.Pattern:
        return re.compile(self.pattern, re.A | (re.I if self.ignore_case else 0))


# The base kinds in their order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
MORE = (
    # to the END line; of a key cut short, the lines of base64
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:(?:\s|\\[nr])+[A-Za-z0-9+/]{16,}={0,2})*", 27,
         until=r"-----END [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 36),
)

#: A set of strings larger than this is not followed further; the query then asks for less.
MAX_STRINGS = 64


def trigram_query(pattern: str) -> list[frozenset[bytes]]:
    """A Boolean query in disjunctive form that every match satisfies: one of the sets occurs in full.

    Trigrams are of UTF-8 bytes with A-Z lower-cased. The pattern's parse tree is walked with the set of strings that a
    part can be exactly (None if it is open); exact neighbours are multiplied out, and every string known to occur
    gives its trigrams. ``[frozenset()]`` means that no trigram is mandatory: all texts have to be scanned.
    """
    found = _needs(_parser.parse(pattern))
    return sorted(set(found), key=sorted) if all(found) else [frozenset()]


def _grams(strings: set[str]) -> list[frozenset[bytes]]:
    out = []
    for text in strings:
        data = text.lower().encode() if text.isascii() else b""
        out.append(frozenset(data[i:i + 3] for i in range(len(data) - 2)))
    return out


def _both(a: list[frozenset], b: list[frozenset]) -> list[frozenset]:
    return [x | y for x, y in product(a, b)] if len(a) * len(b) <= MAX_STRINGS else a if all(a) else b


def _needs(tree) -> list[frozenset[bytes]]:
    """The query of a sequence: exact runs are joined, each closed run and each open part adds its own query."""
    query, run = [frozenset()], {""}
    for op, value in tree:
        exact = _exact(op, value)
        if exact is not None and len(run) * len(exact) <= MAX_STRINGS:
            run = {x + y for x, y in product(run, exact)}
            continue
        query, run = _both(query, _grams(run)), exact if exact is not None else {""}
        if exact is None:
            if op is _codes.SUBPATTERN:
                query = _both(query, _needs(value[-1]))
            elif op is _codes.BRANCH:
                query = _both(query, [x for branch in value[1] for x in _needs(branch)])
            elif op in (_codes.MAX_REPEAT, _codes.MIN_REPEAT) and value[0] > 0:
                query = _both(query, _needs(value[2]))
    return _both(query, _grams(run))


def _exact(op, value) -> set[str] | None:
    """All strings that the part matches, if they are few."""
    if op is _codes.LITERAL:
        return {chr(value)}
    if op is _codes.IN and value and value[0][0] is not _codes.NEGATE and all(x[0] is _codes.LITERAL for x in value):
        return {chr(x[1]) for x in value}
    if op is _codes.SUBPATTERN:
        return _exact_run(value[-1])
    if op is _codes.BRANCH:
        parts = [_exact_run(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if op in (_codes.MAX_REPEAT, _codes.MIN_REPEAT) and value[1] is not _codes.MAXREPEAT and value[1] <= 4:
        once = _exact_run(value[2])
        if once is not None and sum(len(once) ** n for n in range(value[0], value[1] + 1)) <= MAX_STRINGS:
            return {"".join(x) for n in range(value[0], value[1] + 1) for x in product(once, repeat=n)}
    return None


def _exact_run(tree) -> set[str] | None:
    out = {""}
    for op, value in tree:
        more = _exact(op, value)
        if more is None or len(out) * len(more) > MAX_STRINGS:
            return None
        out = {x + y for x, y in product(out, more)}
    return out


class Postings:
    """Inverted index of one block of texts: for each trigram that some rule asks for, the rows that have it."""

    def __init__(self, texts: pa.Array, wanted: dict[bytes, int], slots: np.ndarray):
        data, offsets = flat(texts)
        data = lower(data)
        self.rows = len(texts)
        if len(data) < 3:
            self.lists = [np.zeros(0, np.int64)] * len(wanted)
            return
        codes = data[:-2].astype(np.int32) << 16 | data[1:-1].astype(np.int32) << 8 | data[2:]
        at = np.flatnonzero(slots[codes] >= 0)
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + 2 < offsets[row + 1]  # a trigram must not reach into the next text
        pairs = np.unique(slots[codes[at[inside]]].astype(np.int64) * self.rows + row[inside])
        borders = np.searchsorted(pairs, np.arange(len(wanted) + 1) * self.rows)
        self.lists = [pairs[a:b] % self.rows for a, b in zip(borders, borders[1:])]

    def candidates(self, query: list[list[int]]) -> np.ndarray:
        """Rows that have all trigrams of one of the alternatives; the shortest list is intersected first."""
        found = np.zeros(self.rows, bool)
        for alternative in query:
            if not alternative:
                return np.arange(self.rows)
            lists = sorted((self.lists[x] for x in alternative), key=len)
            rows = lists[0]
            for other in lists[1:]:
                rows = rows[np.isin(rows, other, assume_unique=True)]
            found[rows] = True
        return np.flatnonzero(found)


def _bordered(matches: Iterator[re.Match], size: int) -> Iterator[tuple[re.Match, int]]:
    """Each match and where the next one starts; ``size`` for the last one."""
    held = None
    for match in matches:
        if held is not None:
            yield held, match.start()
        held = match
    if held is not None:
        yield held, size


class Scanner:
    """Rules with their trigram queries, for blocks of texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        queries = [trigram_query(x.pattern) for x in rules]
        self.wanted = {gram: i for i, gram in enumerate(sorted({g for q in queries for alt in q for g in alt}))}
        self.slots = np.full(1 << 24, -1, np.int16)
        for gram, i in self.wanted.items():
            self.slots[int.from_bytes(gram)] = i
        self.rules = [(n, rule, rule.compile(), re.compile(rule.until, re.A), [[self.wanted[g] for g in alt] for alt in query])
                      for n, (rule, query) in enumerate(zip(rules, queries))]

    def scan(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule number, end), by start and then rule; code points, end exclusive."""
        index, strings = Postings(texts, self.wanted, self.slots), texts.to_pylist()
        spans: list[list[tuple[int, int, int]]] = [[] for _ in strings]
        for n, rule, pattern, until, query in self.rules:
            for row in index.candidates(query).tolist():
                text = strings[row] or ""
                for match, border in _bordered(pattern.finditer(text), len(text)):
                    if match.end(rule.group) - match.start(rule.group) >= rule.min_chars:
                        last = until.search(text, match.end(), border) if rule.until else None
                        spans[row].append((match.start(), n, (last or match).end()))
        for found in spans:
            found.sort()
        return spans


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """``doc_id, spans`` (array of kind, start, end) for every row.

    The index is partitioned by document: each block of texts gets posting lists of the trigrams that the rules ask
    for, the rules' queries are answered on them, and only candidates meet the regex. No text is shuffled, nothing is
    collected, and a block is about half a megabyte of text or one longer row. Rules without a mandatory trigram scan all texts.

    Null and empty texts have an empty list; ids may be null or repeated; other columns are not read.
    """
    rows = only(docs, doc_id=id_col, text=text_col)
    kinds = [x.kind for x in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in sliced(batches, "text"):
            spans = [[{"kind": kinds[n], "start": a, "end": b} for a, n, b in x] for x in scanner.scan(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(spans, SPANS)], ["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, "
                                "spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None,
           rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """``docs`` with every found span replaced by ``[kind]`` (overlapping spans as one, named by the first).

    All other columns pass through, but for ``length_col``, which gets the new length of changed texts; rows without a
    find stay as they are, null stays null.
    """
    kinds = [x.kind for x in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in sliced(batches, text_col):
            column, at = batch.column(text_col), batch.schema.get_field_index(text_col)
            texts = column.to_pylist()
            spans = scanner.scan(column)
            for row, found in enumerate(spans):
                if found:
                    texts[row] = _masked(texts[row], found, kinds)
            out = batch.set_column(at, batch.schema.field(at), pa.array(texts, column.type))
            if length_col is not None:
                at = batch.schema.get_field_index(length_col)
                sizes = [len(t) if f else n for t, f, n in zip(texts, spans, batch.column(at).to_pylist())]
                out = out.set_column(at, batch.schema.field(at), pa.array(sizes, batch.schema.field(at).type))
            yield out

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def _masked(text: str, spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    out, done = [], 0
    for start, n, end in spans:
        if start >= done:
            out += [text[done:start], f"[{kinds[n]}]"]
        done = max(done, end)
    return "".join(out) + text[done:]
