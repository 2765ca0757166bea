"""Reading the files datasets come in: odd encodings, malformed lines, archives, missing headers."""

from __future__ import annotations

import codecs
import csv
import hashlib
import io
import os
import re
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoal.functions.columns import base_name, col, extension
from shoal.session import materialize

EXTRA = "__extra"
#: Characters of the rows that a task unpacks before it passes them on.
PIECE_BYTES = 1 << 20


KINDS = ("long", "double", "boolean")
# What each type looks like: a pattern is tested rather than a cast, as failing casts are slow.
PATTERNS = {
    "long": r"^\s*[+-]?\d{1,18}\s*$",
    "double": r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$",
    "boolean": r"^\s*([Tt]rue|[Ff]alse|TRUE|FALSE)\s*$",
}


def _narrowest(row, prefix: str = "") -> str | None:
    """The first type that fits every value of a column, from its test results."""
    return next((k for k in KINDS if row[f"{prefix}filled"] and row[f"{prefix}{k}"]), None)


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns as the narrowest of long, double, boolean and text that fits every value; one pass."""
    columns = [c for c in (columns or df.columns) if isinstance(df.schema[c].dataType, T.StringType)]
    if not columns:
        return df
    tests = []
    for i, c in enumerate(columns):
        tests.append(F.count(col(c)).alias(f"{i}_filled"))
        tests += [F.coalesce(F.bool_and(col(c).isNull() | col(c).rlike(PATTERNS[k])), F.lit(False))
                  .alias(f"{i}_{k}") for k in KINDS]
    got = df.agg(*tests).first()
    kinds = {c: _narrowest(got, f"{i}_") for i, c in enumerate(columns)}
    return df.select(*[
        F.trim(col(c)).try_cast(kinds[c]).alias(c) if kinds.get(c) else col(c) for c in df.columns])


def file_traits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, encoding, multi_line, header) per file, judged on every line of it by a split scan.

    A file that is UTF-8 throughout is read as such, any other as Latin-1, which accepts all bytes; the
    further encodings of the order utf-8, latin-1, cp1252, iso-8859-1, utf-16 are then never reached, save
    that a byte order mark still announces UTF-16. Only a file with a line of unbalanced quotes can hold a
    field with a line break; all others stay splittable.
    """
    lines = spark.read.text(path, recursiveFileLookup=True).select(
        F.input_file_name().alias("path"), "value", F.input_file_block_start().alias("start"),
        F.monotonically_increasing_id().alias("at"))
    mark = F.hex(F.substring(F.col("value").cast("binary"), 1, 2)).isin("FFFE", "FEFF")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    judged = lines.groupBy("path").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("valid"), F.bool_or(mark).alias("marked"),
        F.bool_or(quotes % 2 == 1).alias("open_quote"),
        F.min(F.when(F.col("start") == 0, F.struct("at", "value")))["value"].alias("header"))
    name = F.when(F.col("valid"), "UTF-8").when(F.col("marked"), "UTF-16").otherwise("ISO-8859-1")
    out = judged.select("path", name.alias("encoding"), "open_quote", "header")
    return out.select("path", "encoding", (F.col("open_quote") | (F.col("encoding") == "UTF-16")).alias("multi_line"), "header")


def _grouped(traits: DataFrame) -> list[tuple[str, bool, list[str]]]:
    """Files that one reader can take together: same encoding, line breaks and header line. A reader lays the names of
    one header over all its files, so files whose columns differ or stand in another order need readers of their own."""
    groups = traits.groupBy("encoding", "multi_line", "header").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return [(r["encoding"], r["multi_line"], r["paths"])
            for r in sorted(groups.collect(), key=lambda r: (r["encoding"], r["multi_line"], r["paths"]))]


def read_csv_robust(spark: SparkSession, path: str | list[str], sep: str = ",", infer: bool = True) -> DataFrame:
    """CSV with a header in whatever encoding; lines with too many fields are skipped, short ones filled."""
    out = None
    for encoding, multi_line, paths in _grouped(file_traits(spark, path)):
        options = dict(header=True, sep=sep, encoding=encoding, multiLine=multi_line, escape='"')
        names = spark.read.csv(paths, **options).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, EXTRA]])
        # one column more than the header: only a line that is too long puts something there
        rows = spark.read.csv(paths, schema=schema, mode="PERMISSIVE", enforceSchema=True, nullValue="\u0000", **options)
        rows = rows.where(col(EXTRA).isNull()).drop(EXTRA)
        rows = rows.select(*[F.nullif(col(c), F.lit("")).alias(c) for c in names])
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return infer_types(out) if infer else out


def read_tsv(spark: SparkSession, path: str | list[str], infer: bool = True) -> DataFrame:
    """Tab-separated text; bytes that are not UTF-8 become replacement characters."""
    out = None
    traits = file_traits(spark, path).withColumn("encoding", F.lit("UTF-8"))
    for _, multi_line, paths in _grouped(traits):
        rows = spark.read.csv(paths, sep="\t", header=True, quote='"', escape='"', multiLine=multi_line)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return infer_types(out) if infer else out


def listed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, length`` of all files below a folder. The content is never a cell: it is pruned, and read as a stream by the
    task that a file falls to; tasks are cut by file sizes as Spark cuts any scan."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path in it, for tasks that read or write bytes."""
    local = re.match("^(?:file:(?://[^/]*)?(?=/))?(/.*)$", path)
    return (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(path)


def opened(path: str):
    """A file as a seekable stream, by the path that ``listed`` gives."""
    files, inside = file_system(path)
    return files.open_input_file(inside)


def read_zipped_csv(spark: SparkSession, path: str | list[str], infer: bool = True) -> DataFrame:
    """CSV files that may be ZIP archives: of each archive the first ``.csv`` entry outside ``__`` folders.

    Columns are the union of all headers; a field is null where it is empty, its line too short or its file without the
    column; lines with too many fields are skipped; of two columns with one name the first counts. A file that is UTF-8
    throughout is read as such, any other as Latin-1. An archive without such an entry is an error.

    A task reads each of its files once, as a stream: fields are cut from the bytes as Latin-1, which loses nothing, while the
    bytes are tested for UTF-8. Rows are written once, with the name of their file; its header and encoding, known at its
    end, are a row of their own. The driver sees the different headers.
    """
    rows = materialize(listed(spark, path).mapInArrow(
        _unzipped, "path string, header array<string>, valid boolean, fields array<string>"), "unzipped")
    files = rows.where("header is not null").select("path", "header", "valid")
    headers = sorted(tuple(r["header"]) for r in files.select("header").distinct().collect())
    names = list(dict.fromkeys(c for h in headers for c in h))
    if not names:
        raise ValueError("no file with a header")
    known = spark.createDataFrame(list(enumerate(headers, 1)), "number int, header array<string>")
    cells = rows.where("fields is not null").select("path", "fields").join(files.join(known, "header").drop("header"), "path")
    columns = []
    for name in names:
        places = [h.index(name) if name in h else -1 for h in headers]
        at = F.lit(places[0]) if len(set(places)) == 1 else F.element_at(F.array(*map(F.lit, places)), F.col("number"))
        value = F.when(at >= 0, F.get("fields", at))
        columns.append(F.when(F.col("valid"), F.decode(F.encode(value, "ISO-8859-1"), "UTF-8")).otherwise(value).alias(name))
    out = cells.select(*columns)
    return infer_types(out) if infer else out


def _entry(name: str, file):
    """The CSV bytes of a file as a stream, from inside an archive if it is one."""
    begin = file.read(2)
    file.seek(0)
    if begin != b"PK":
        return file
    archive = zipfile.ZipFile(file)
    for entry in archive.namelist():
        if entry.lower().endswith(".csv") and not entry.startswith("__"):
            return archive.open(entry)
    raise ValueError(f"{name} holds no CSV file")


class _Tested(io.RawIOBase):
    """A stream that tests on the way whether all of it is UTF-8."""

    def __init__(self, stream):
        self.stream, self.valid = stream, True
        self.decoder = codecs.getincrementaldecoder("utf-8")()

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.stream.read(len(buffer))
        if self.valid:
            try:
                self.decoder.decode(data, final=not data)
            except UnicodeDecodeError:
                self.valid = False
        buffer[:len(data)] = data
        return len(data)


def _unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = pa.list_(pa.string())

    def told(path: str, rows: list, header=None, valid=None) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([header] * n, texts),
                                           pa.array([valid] * n, pa.bool_()), pa.array(rows, texts)], ["path", "header", "valid", "fields"])

    for batch in batches:
        for path in batch["path"].to_pylist():
            with opened(path) as file:
                tested = _Tested(_entry(path, file))
                reader = csv.reader(io.TextIOWrapper(io.BufferedReader(tested, 1 << 20), encoding="latin-1", newline=""))
                header, rows, size = next(reader, []), [], 0
                for row in reader:
                    if not row or len(row) > len(header):
                        continue
                    rows.append([v or None for v in row])
                    size += sum(map(len, row)) + 8 * len(row)
                    if size > PIECE_BYTES:
                        yield told(path, rows)
                        rows, size = [], 0
                if rows:
                    yield told(path, rows)
                yield told(path, [None], [c.encode("latin-1").decode("utf-8" if tested.valid else "latin-1") for c in header], tested.valid)


def read_headerless(
    spark: SparkSession, path: str | list[str], names: Sequence[str] | None = None, sep: str | None = None,
    target: str = "target", missing: str = "?",
) -> DataFrame:
    """Fields split on blanks (or ``sep``), ``?`` as null. Without names: f1, f2, ... and the target last."""
    text = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split(F.trim("value"), r"\s+") if sep is None else F.split("value", "\\" + sep)
    rows = text.select(parts.alias("x"))
    # one row per field, so that each line is split once for all tests
    field = F.nullif(F.trim("v"), F.lit(missing))
    fields = rows.select(F.posexplode("x").alias("i", "v")).select("i", field.alias("v"))
    tests = fields.groupBy("i").agg(F.count("v").alias("filled"), *[
        F.bool_and(F.col("v").isNull() | F.col("v").rlike(PATTERNS[k])).alias(k) for k in KINDS]).collect()
    kinds = {r["i"]: _narrowest(r) for r in tests}
    if names is None:
        if len(kinds) < 2:
            raise ValueError("expected at least two columns")
        names = [f"f{i}" for i in range(1, len(kinds))] + [target]
    cells = []
    for i, n in enumerate(names):
        value = F.nullif(F.trim(F.get("x", F.lit(i))), F.lit(missing))
        cells.append((value.try_cast(kinds[i]) if kinds.get(i) else value).alias(n))
    return rows.select(*cells)


def read_attribute_names(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """(position, name) of columns declared as ``name: values`` or ``@attribute name type`` lines."""
    text = spark.read.text(path, wholetext=True)  # a description file of some lines
    lines = text.select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    line = F.trim("line")
    declared = F.lower(line).startswith("@attribute")
    name = F.when(declared & (F.size(F.split(line, r"\s+")) >= 3), F.get(F.split(line, r"\s+"), F.lit(1))).when(
        ~declared & ~line.startswith("|") & line.contains(":"), F.trim(F.split_part(line, F.lit(":"), F.lit(1))))
    kept = lines.select("line_no", name.alias("name")).where("name is not null and name <> '' and not contains(name, ' ')")
    first = kept.groupBy("name").agg(F.min("line_no").alias("line_no"))
    ordered = first.agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "name"))), lambda s: s["name"])
                        .alias("names"))
    names = F.concat("names", F.array(F.lit(label))) if label else F.col("names")
    return ordered.select(F.posexplode(names).alias("position", "name"))


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder: relative path, name, size, extension and MD5; hidden ones are left out.

    Files are hashed as streams, a megabyte at a time. A relative folder is found in the part that all paths share.
    """
    files = listed(spark, path)
    full = F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?/*", "/")
    root = re.sub("^[a-z0-9]+:(//[^/]*)?/*", "/", path).rstrip("/") + "/"
    if not root.startswith("/"):
        ends = files.agg(F.min(full).alias("a"), F.max(full).alias("b")).first()
        shared = os.path.commonprefix([ends["a"] or "", ends["b"] or ""])
        root = shared[:shared.rfind("/" + root.removeprefix("./")) + 1] + root.removeprefix("./")
    relative = F.substr(full, F.lit(len(root) + 1))
    name = base_name(relative)
    kept = ~name.startswith(".") & ~relative.contains("__MACOSX")
    hashed = files.where(kept).mapInArrow(_hashed, "path string, length long, file_hash string")
    return hashed.select(relative.alias("relative_path"), name.alias("filename"), F.col("length").alias("file_size"),
                         extension(name).alias("file_type"), "file_hash")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, length in zip(batch["path"].to_pylist(), batch["length"].to_pylist()):
            state = hashlib.md5()
            with opened(path) as file:
                while piece := file.read(1 << 20):
                    state.update(piece)
            yield pa.RecordBatch.from_pydict({"path": [path], "length": [length], "file_hash": [state.hexdigest()]})
