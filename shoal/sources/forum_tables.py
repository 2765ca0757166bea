"""Forum tables to and from their exchange forms: display tables and bulk JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoal.functions.columns import col, lookup

# Display name of each column, per sheet.
SHEETS: dict[str, dict[str, str]] = {
    "Themes": {
        "theme_id": "Theme ID", "name": "Theme Name", "description": "Description", "views": "Views",
        "expert_id": "Expert ID", "problem_category": "Problem Category", "model_category": "Model Category",
        "domain_category": "Domain Category", "created_at": "Created At",
    },
    "Documents": {
        "document_id": "Document ID", "title": "Title", "description": "Description", "file_path": "File Path",
        "file_size": "File Size (bytes)", "content_type": "Content Type", "expert_id": "Expert ID",
        "theme_id": "Theme ID", "created_at": "Created At",
    },
    "Questions": {
        "question_id": "Question ID", "title": "Question Title", "body": "Question Body", "created_at": "Created At",
        "views": "Views", "expert_id": "Expert ID", "theme_id": "Theme ID",
    },
    "Answers": {
        "answer_id": "Answer ID", "description": "Answer Description", "created_at": "Created At",
        "question_id": "Question ID", "expert_id": "Expert ID", "parent_id": "Parent Answer ID",
    },
    "Votes": {
        "vote_id": "Vote ID", "expert_id": "Expert ID", "answer_id": "Answer ID", "vote_value": "Vote Value",
        "created_at": "Created At", "updated_at": "Updated At",
    },
    "Experts": {
        "expert_id": "Expert ID", "user_id": "User ID", "is_deleted": "Is Deleted",
        "area_of_expertise": "Area of Expertise", "bio": "Biography", "date_joined": "Date Joined",
        "profile_picture": "Profile Picture",
    },
}

# Columns that hold whole numbers.
INTEGER_FIELDS = ("theme_id", "document_id", "question_id", "answer_id", "vote_id", "expert_id", "user_id", "views",
                  "vote_value", "parent_id", "file_size")

# Accepted categories; any other text is the last one.
CATEGORIES: dict[str, tuple[str, ...]] = {
    "problem_category": ("AI BIAS", "PRIVACY", "TRANSPARENCY", "ACCOUNTABILITY", "FAIRNESS", "OTHER"),
    "model_category": ("Machine Learning", "Machine Vision", "LLM", "NLP", "Computer Vision", "Recommendation",
                       "Other"),
    "domain_category": ("Justice", "Health", "Finance", "Education", "Social", "Social Media", "Transport",
                        "Urban Planning", "Marketing & Sales", "Other"),
    "area_of_expertise": ("AI Expert", "AI Ethics Expert", "Research", "Legal Professional", "Policy", "NGO",
                          "Enterprise", "Citizen", "Other"),
}

# Key and fields of each entity of the bulk JSON, besides ``id``.
ENTITIES: dict[str, tuple[str, tuple[str, ...]]] = {
    "Expert": ("expert_id", ("user_id", "is_deleted", "area_of_expertise", "bio", "date_joined", "profile_picture")),
    "Theme": ("theme_id", ("name", "description", "views", "expert_id", "problem_category", "model_category",
                           "domain_category", "created_at")),
    "Document": ("document_id", ("title", "description", "file_path", "file_size", "content_type", "expert_id",
                                 "theme_id", "created_at")),
    "Question": ("question_id", ("title", "body", "created_at", "views", "expert_id", "theme_id")),
    "Answer": ("answer_id", ("description", "created_at", "question_id", "expert_id", "parent_id")),
    "Vote": ("vote_id", ("expert_id", "answer_id", "vote_value", "created_at", "updated_at")),
}
TIMES = ("created_at", "updated_at", "date_joined")


def category(value: Column, kind: str) -> Column:
    names = CATEGORIES[kind]
    return lookup(value, {n: n for n in names[:-1]}, F.lit(names[-1]))


def export_table(df: DataFrame, sheet: str) -> DataFrame:
    """Display names, times as text, nulls as empty text; the internal id stays behind.

    Votes get a ``Vote Type`` next to the value.
    """
    names: Mapping[str, str] = SHEETS[sheet]
    cells = []
    for f in df.schema.fields:
        if f.name == "_id":
            continue
        value = col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        cells.append(F.coalesce(value.cast("string"), F.lit("")).alias(names.get(f.name, f.name)))
        if sheet == "Votes" and f.name == "vote_value":
            kind = F.when(col("vote_value") == 1, "Upvote").when(col("vote_value") == -1, "Downvote").otherwise("")
            cells.append(kind.alias("Vote Type"))
    return df.select(*cells)


def write_sheets(tables: Mapping[str, DataFrame], path: str) -> None:
    """The display form of each table, as CSV files with a header in a folder of its own; sheet names as in ``SHEETS``."""
    for sheet, df in tables.items():
        export_table(df, sheet).write.csv(f"{path}/{sheet}", header=True, quoteAll=True, escape='"')


def read_sheets(spark: SparkSession, path: str, sheets: Sequence[str] = tuple(SHEETS)) -> dict[str, DataFrame]:
    """The tables back from their display form: times parsed, whole numbers as such; bad cells are listed in ``rejects``."""
    out = {}
    for sheet in sheets:
        shown = spark.read.csv(f"{path}/{sheet}", header=True, escape='"', multiLine=True)
        rows = import_table(shown, sheet)
        out[sheet] = rows.withColumns({c: F.try_to_timestamp(col(c)) for c in TIMES if c in rows.columns})
    return out


def import_table(df: DataFrame, sheet: str) -> DataFrame:
    """Display names back to columns. Blank cells are null, numbers are parsed, rows without content go.

    A cell that should be a whole number and is not becomes null and is listed in ``rejects``.
    """
    back = {shown: name for name, shown in SHEETS[sheet].items()}
    cells, rejects = [], []
    for shown in df.columns:
        name = back.get(shown)
        if name is None:
            continue
        raw = col(shown).cast("string")
        text = F.when(F.trim(raw) != "", raw)
        if name in INTEGER_FIELDS:
            number = F.coalesce(F.trim(text).try_cast("long"), F.trim(text).try_cast("double").try_cast("long"))
            cells.append(number.alias(name))
            rejects.append(F.when(text.isNotNull() & number.isNull(), F.concat(F.lit(name + "="), text)))
        elif name == "is_deleted":
            cells.append(F.lower(F.trim(text)).isin("true", "1", "yes").alias(name))
        else:
            cells.append(text.alias(name))
    bad = F.array_compact(F.array(*rejects)) if rejects else F.array().cast("array<string>")
    names = [back[c] for c in df.columns if c in back]
    out = df.select(*cells, bad.alias("rejects"))
    empty = F.size("rejects") == 0
    for n in names:
        empty = empty & col(n).isNull()
    return out.where(~empty)


def import_json_bulk(texts: DataFrame, column: str = "value", as_of: datetime | None = None) -> dict[str, DataFrame]:
    """Entity tables from JSON objects with arrays Expert, Theme, Document, Question, Answer and Vote.

    ``id`` stands for the entity's key; times fall back to ``as_of`` (now), views to 0, unknown categories to
    the last one. A text is parsed only for the entities whose names it holds, plainly or perhaps by escapes.
    """
    fallback = F.lit(as_of).cast("timestamp") if as_of is not None else F.current_timestamp()
    out = {}
    for entity, (key, fields) in ENTITIES.items():
        parts = ", ".join(f"{n}: string" for n in dict.fromkeys(("id", key, *fields)))
        named = F.contains(col(column), F.lit(entity)) | F.contains(col(column), F.lit("\\u"))
        rows = texts.where(named).select(F.from_json(column, f"struct<{entity}: array<struct<{parts}>>>")[entity].alias("a"))
        # explode would have Spark ask first whether the array is empty, which parses every text again
        rows = rows.select(F.posexplode_outer("a").alias("at", "x")).where("at is not null").select("x.*")
        cells = [F.coalesce("id", key).try_cast("long").alias(key)]
        for n in fields:
            value = F.col(n)
            if n in TIMES:
                value = F.coalesce(F.try_to_timestamp(value), fallback)
            elif n in CATEGORIES:
                value = category(value, n)
            elif n == "views":
                value = F.coalesce(value.try_cast("long"), F.lit(0))
            elif n in INTEGER_FIELDS:
                value = value.try_cast("long")
            elif n == "is_deleted":
                value = F.coalesce(value.try_cast("boolean"), F.lit(False))
            cells.append(value.alias(n))
        out[entity] = rows.select(*cells)
    return out
