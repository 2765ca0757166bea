"""Text search over catalog records by postings of trigrams, in place of a regex over every record."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions.columns import col, matches_any
from shoal.session import materialize

# Trigrams of a pattern that are looked up: one bit each.
LOOKUPS = 60


def required_trigrams(pattern: str) -> list[list[str]] | None:
    """Per alternative the lower-case trigrams that any match holds; None if some alternative needs none.

    Only plain characters count. Groups, escapes and nested classes are not looked into: such patterns give None.
    """
    if any(c in pattern for c in "\\()"):
        return None
    alternatives, runs, run, at = [], [], "", 0
    while at <= len(pattern):
        c = pattern[at] if at < len(pattern) else "|"
        if c in "?*{":  # the character before may be missing
            run = run[:-1]
        elif c not in "|[]}.^$+" and c.isascii():
            run += c.lower()
            at += 1
            continue
        runs.append(run)
        run = ""
        if c in "[{":
            end = pattern.find("]" if c == "[" else "}", at + 1)
            body = pattern[at + 1 : end]
            if end < 0 or body in ("", "^") or "[" in body:
                return None
            at = end
        if c == "|":
            grams = sorted({r[i : i + 3] for r in runs for i in range(len(r) - 2)})
            if not grams:
                return None
            alternatives.append(grams)
            runs = []
        at += 1
    return alternatives


def trigram_postings(records: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(gram, keys, field): each trigram of each lower-cased text column, written once.

    Every task orders its postings by gram, so that a lookup reads the row groups of its grams only; nothing is
    shuffled, and a frequent gram is spread over all files. Nulls and texts of less than three characters have none.
    """
    texts = F.explode(F.array(*[
        F.struct(F.lit(i).alias("field"), F.lower(col(c).cast("string")).alias("text")) for i, c in enumerate(columns)]))
    rows = records.select(*[col(k) for k in keys], texts.alias("__x")).where("__x.text is not null")
    # a look-ahead gives all overlapping trigrams without a lambda; one that cuts a surrogate pair only lets more candidates through
    grams = F.array_distinct(F.regexp_extract_all("__x.text", F.lit("(?s)(?=(...))"), 1))
    postings = rows.select(F.explode(grams).alias("gram"), *[col(k) for k in keys], F.col("__x.field").alias("field"))
    # the order of gram as one number, which Spark sorts by its digits rather than by comparing equal texts
    order = F.shiftleft(F.ascii("gram").cast("long"), 42) + F.shiftleft(
        F.ascii(F.substring("gram", 2, 1)).cast("long"), 21) + F.ascii(F.substring("gram", 3, 1))
    return materialize(postings.where(F.length("gram") == 3).sortWithinPartitions(order), "postings")


def search_postings(records: DataFrame, postings: DataFrame, keys: Sequence[str], pattern: str,
                    columns: Sequence[str]) -> DataFrame:
    """The records of which a column matches the pattern, letters in either case; the rows of a full scan.

    ``postings`` were made from the same keys and columns. A record is a candidate if one field holds all
    trigrams of an alternative; candidates are verified by the regex. A pattern without trigrams scans.
    """
    matched = matches_any(pattern, columns)
    alternatives = required_trigrams(pattern)
    if alternatives is None:
        return records.where(matched)
    share = max(1, LOOKUPS // len(alternatives))
    alternatives = [grams[:share] for grams in alternatives]  # fewer trigrams only let more candidates through
    grams = sorted({g for a in alternatives for g in a})
    if len(grams) > LOOKUPS:
        return records.where(matched)
    bit = {g: 1 << i for i, g in enumerate(grams)}
    mark = reduce(lambda rest, g: F.when(F.col("gram") == g, F.lit(bit[g]).cast("long")).otherwise(rest), grams,
                  F.lit(0).cast("long"))
    held = postings.where(F.col("gram").isin(grams)).groupBy(*[col(k) for k in keys], "field").agg(
        F.bit_or(mark).alias("__held"))
    masks = [F.lit(sum(bit[g] for g in a)).cast("long") for a in alternatives]
    full = reduce(or_, [F.col("__held").bitwiseAND(m) == m for m in masks])
    names = {k: f"__key{i}" for i, k in enumerate(keys)}
    candidates = held.where(full).groupBy(*[col(k).alias(name) for k, name in names.items()]).agg(
        F.bool_or(full).alias("__full"))
    same = reduce(and_, [col(k).eqNullSafe(F.col(name)) for k, name in names.items()])
    # The test names both sides, so that it stays in the join: only candidates meet the regex.
    return records.join(candidates, same & F.when(F.col("__full"), matched)).select(*[col(c) for c in records.columns])
