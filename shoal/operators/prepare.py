"""Preparation of public tables: columns, names, labels, cleaning."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoal.functions.columns import col, column_for

# Fields of the census table that hold numbers.
CENSUS_NUMBERS = ("age", "fnlwgt", "education-num", "capital-gain", "capital-loss", "hours-per-week")


def drop_pattern_columns(df: DataFrame, suffix: str = "_name", also: Sequence[str] = ()) -> DataFrame:
    return df.select(*[col(c) for c in df.columns if not c.endswith(suffix) and c not in also])


def rename_and_require(
    df: DataFrame, drop: Sequence[str], rename: Mapping[str, str], required: str | None = None
) -> DataFrame:
    """Drop and rename columns; rows without the required value go."""
    out = df.drop(*drop).withColumnsRenamed(dict(rename))
    return out.na.drop(subset=[required]) if required and required in out.columns else out


def clean_census(*parts: DataFrame, label: str = "income", numbers: Sequence[str] = CENSUS_NUMBERS) -> DataFrame:
    """Union of the parts with trimmed fields, no trailing dots on the label, ``?`` as null, numbers typed."""
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    cleaned = []
    for f in rows.schema.fields:
        value = col(f.name)
        if isinstance(f.dataType, T.StringType):
            value = F.trim(value)
            if f.name == label:
                value = F.trim(F.rtrim(value, F.lit(".")))
            value = F.nullif(value, F.lit("?"))
            if f.name in numbers:
                value = value.try_cast("double")
        cleaned.append(value.alias(f.name))
    return rows.select(*cleaned)


def union_schema(parts: Mapping[str, DataFrame], tag: str = "split") -> DataFrame:
    """Union over all columns of the parts (sorted by name), each row tagged with its part."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return rows.select(*[col(c) for c in sorted(rows.columns)])


def join_labels(texts: DataFrame, labels: DataFrame, key: str = "id", text: str = "tweet",
                aliases: Sequence[str] = ("text", "content"), label: str = "label") -> DataFrame:
    """(key, text, label) columns of both tables under their standard names, and whatever else they have.

    Each role is looked up by name, then by its aliases. A label table without the label's name has it in its last column
    beside the key.
    """
    roles = {column_for(texts.columns, key): key, column_for(texts.columns, text, *aliases): text}
    named = column_for(labels.columns, label) or [c for c in labels.columns if c != column_for(labels.columns, key)][-1]
    left = texts.withColumnsRenamed({old: new for old, new in roles.items() if old is not None})
    return left.join(labels.withColumnsRenamed({column_for(labels.columns, key): key, named: label}), key)


def normalize_headers(df: DataFrame) -> DataFrame:
    """Column names with outer blanks removed and inner ones collapsed."""
    return df.toDF(*[re.sub(r"\s+", " ", c.strip()) for c in df.columns])


def slug(text: str) -> str:
    """Lower-case words of letters, digits and underscores, joined by underscores."""
    kept = "".join(c if c.isascii() and (c.isalnum() or c == "_") else " " for c in text.lower())
    return "_".join(kept.split()).strip("_")


# Words of a target's name, all of a group with any of its second half.
TARGET_WORDS = (("default", ("next", "month")),)


def detect_target(df: DataFrame, into: str | None = None) -> DataFrame:
    """Rename the target: the column whose name scores most for words of a target; the last one if none scores."""
    def score(place: int) -> tuple[int, int]:
        name = df.columns[place].lower()
        hits = sum(first in name and any(w in name for w in rest) for first, rest in TARGET_WORDS)
        return hits, -place if hits else place

    target = df.columns[max(range(len(df.columns)), key=score)]
    return df.withColumnRenamed(target, into or slug(target))
