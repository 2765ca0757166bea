"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def col(name: str) -> Column:
    """A column by exact name, also when it holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of a missing value: NaN in float columns becomes null."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floating:
        return df
    return df.select(
        *[F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floating else col(c) for c in df.columns]
    )


def finite_or_null(value: Column) -> Column:
    """NaN and the infinities become null, as JSON has no spelling for them."""
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(~bad, value)


def json_clean(df: DataFrame) -> DataFrame:
    """``finite_or_null`` on every float, also inside arrays and structs."""

    def clean(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return finite_or_null(value)
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(value, lambda _, v: clean(v, kind.valueType))
        if isinstance(kind, T.StructType):
            fields = [clean(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
            return F.when(value.isNotNull(), F.struct(*fields))
        return value

    return df.select(*[clean(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def lookup(key: Column, table: Mapping[str, str], default: Column | None = None) -> Column:
    """A small fixed mapping as a map literal."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    hit = F.element_at(F.create_map(*pairs), key)
    return F.coalesce(hit, default) if default is not None else hit


def matches_any(pattern: str, columns: Sequence[str]) -> Column:
    """Case-insensitive regular expression on any of the columns; null does not match."""
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.col(c).rlike("(?i)" + pattern), F.lit(False))
    return test


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """Lower-case extension without the dot, empty when there is none."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def normalize_relpath(path: Column) -> Column:
    """Forward slashes, and no dots or slashes in front."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[./]+", "")


def version_number(version: Column) -> Column:
    """The integer after ``v``; null for other spellings."""
    return F.when(version.startswith("v"), F.substring(version, 2, 2147483647).try_cast("int"))


def column_for(columns: Sequence[str], *names: str) -> str | None:
    """The column that plays a role: the one whose name, without case and outer blanks, stands earliest among ``names``."""
    place = {name.strip().lower(): i for i, name in reversed(list(enumerate(names))) if name.strip()}
    known = [(place[c.strip().lower()], c) for c in columns if c.strip().lower() in place]
    return min(known, default=(0, None), key=lambda x: x[0])[1]
