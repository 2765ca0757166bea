"""Image folders with label tables: matching, checking and splitting them together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.functions.columns import base_name, column_for, extension, normalize_relpath
from shoal.operators.split import DRIFT, TEST, TRAIN, random_split_exact

# What counts as an image or a label table, and accepted column names in order of preference.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff", "tif")
ANNOTATION_EXTENSIONS = ("csv", "json")
FILENAME_COLUMNS = ("filename", "image_file_path", "file_path", "path", "filepath", "image_path", "image")
LABEL_COLUMNS = ("label", "class", "category", "target", "y")


def is_image(path: Column) -> Column:
    return extension(path).isin(*IMAGE_EXTENSIONS)


def is_annotation(path: Column) -> Column:
    return extension(path).isin(*ANNOTATION_EXTENSIONS)


def normalize_annotations(ann: DataFrame, filename: str = "filename", label: str = "label") -> DataFrame:
    """Adds or replaces ``filename`` and ``label`` from whichever accepted columns are present."""
    name = column_for(ann.columns, filename, *FILENAME_COLUMNS)
    kind = column_for(ann.columns, label, *LABEL_COLUMNS)
    if name is None or kind is None:
        raise ValueError("annotations need a file name column and a label column")
    return ann.withColumns({"filename": F.col(name).cast("string"), "label": F.col(kind).cast("string")})


def annotations_from_json(texts: DataFrame, column: str = "value") -> DataFrame:
    """Annotation rows from JSON documents: a list, or an object with the list under ``annotations``.

    ``fields`` keeps every key of a row as it is written.
    """
    row = "array<map<string,string>>"
    entries = F.coalesce(
        F.from_json(column, row), F.from_json(column, f"struct<annotations:{row}>")["annotations"]
    )
    cells = texts.select(F.explode(entries).alias("m"))

    def first_of(accepted: Sequence[str]) -> Column:
        lowered = F.transform_keys("m", lambda k, _: F.lower(F.trim(k)))
        return F.coalesce(*[F.element_at(lowered, n) for n in accepted])

    return cells.select(first_of(FILENAME_COLUMNS).alias("filename"), first_of(LABEL_COLUMNS).alias("label"),
                        F.col("m").alias("fields"))


def pick_annotation_file(files: DataFrame) -> DataFrame:
    """The label table among a folder's files: one named ``annotations``, else the first by path."""
    named = F.lower(F.regexp_replace(base_name(F.col("relative_path")), r"\.[^.]*$", "")) == "annotations"
    return files.where(is_annotation(F.col("relative_path"))).orderBy(F.desc(named), "relative_path").limit(1)


def match_annotations(files: DataFrame, ann: DataFrame) -> DataFrame:
    """Adds ``matched_path`` to annotation rows: by full relative path, else by a base name that is unique."""
    paths = files.where(is_image(F.col("relative_path"))).select(
        normalize_relpath(F.col("relative_path")).alias("full_path")
    ).distinct()
    unique = (
        paths.groupBy(F.lower(base_name(F.col("full_path"))).alias("short_name"))
        .agg(F.count(F.lit(1)).alias("n"), F.first("full_path").alias("only_path"))
        .where("n = 1").drop("n")
    )
    wanted = ann.withColumn("full_path", normalize_relpath(F.trim("filename")))
    wanted = wanted.withColumn("short_name", F.lower(base_name(F.col("full_path"))))
    hits = wanted.join(paths.withColumn("exact", F.lit(True)), "full_path", "left").join(unique, "short_name", "left")
    matched = F.when(F.col("exact"), F.col("full_path")).otherwise(F.col("only_path"))
    return hits.withColumn("matched_path", matched).select(*ann.columns, "matched_path")


def validate_annotations(files: DataFrame, ann: DataFrame | None) -> DataFrame:
    """One row: images, annotation rows, rows with a file, and the reason for refusal if any.

    All annotation rows are checked.
    """
    listed = files.agg(
        F.count_if(is_image(F.col("relative_path"))).alias("images"),
        F.count_if(is_annotation(F.col("relative_path"))).alias("annotation_files"),
    )
    named = ann is not None and column_for(ann.columns, *FILENAME_COLUMNS) and column_for(ann.columns, *LABEL_COLUMNS)
    if named:
        rows = normalize_annotations(ann)
        matched = match_annotations(files, rows.select("filename", "label"))
        counts = matched.agg(
            F.count(F.lit(1)).alias("rows"), F.count("filename").alias("named_rows"),
            F.count("matched_path").alias("matched_rows"),
        )
        listed = listed.join(F.broadcast(counts))
    else:
        listed = listed.withColumns({c: F.lit(0).cast("long") for c in ("rows", "named_rows", "matched_rows")})
    reason = (
        F.when(F.col("images") == 0, F.lit(None).cast("string"))
        .when(F.col("annotation_files") == 0, "missing annotations file")
        .when(F.lit(not named), "no file name or label column")
        .when(F.col("rows") == 0, "annotations have no rows")
        .when(F.col("named_rows") == 0, "annotations have no file names")
        .when(F.col("matched_rows") == 0, "no annotation row refers to an image in the folder")
    )
    return listed.withColumns({"reason": reason, "valid": reason.isNull()})


def split_images(files: DataFrame, seed: int = 42) -> DataFrame:
    """Files with their split: images exactly 70/15/15, other files in all three, label tables left out."""
    files = files.withColumn("relative_path", normalize_relpath(F.col("relative_path")))
    path = F.col("relative_path")
    images = random_split_exact(files.where(is_image(path)), ["relative_path"], seed, at_least_one=True)
    everywhere = F.explode(F.array(F.lit(TRAIN), F.lit(TEST), F.lit(DRIFT)))
    shared = files.where(~is_image(path) & ~is_annotation(path)).withColumn("split", everywhere)
    return images.unionByName(shared).withColumn("path_in_split", F.concat_ws("/", "split", "relative_path"))


def split_annotations(files: DataFrame, ann: DataFrame, seed: int = 42) -> DataFrame:
    """Annotation rows with the split of their image; rows without label or image are dropped."""
    placed = split_images(files, seed).where(is_image(F.col("relative_path")))
    placed = placed.select(F.col("relative_path").alias("matched_path"), "split")
    labelled = match_annotations(files, normalize_annotations(ann)).where("trim(label) <> ''")
    out = labelled.join(placed, "matched_path")
    return out.withColumn("filename", F.col("matched_path")).drop("matched_path")


def split_counts(placed: DataFrame) -> DataFrame:
    """Files per split of the new version; each split also gets its own label table."""
    return placed.groupBy("split").agg((F.count(F.lit(1)) + 1).alias("files"))
