"""Queries over the versioned catalog of datasets, models, files and reports.

The catalog is a table with one row per (user_id, dataset_id, version). Every function is a plan of
filters, partial aggregates and equi-joins; pages are a top-n over (newest first, then key).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.functions.columns import extension, lookup, matches_any, version_number

PUBLIC_OWNER = "public"

# Accepted uploads and their size limit.
ALLOWED_EXTENSIONS = ("txt", "md", "csv", "json", "xml", "pdf", "doc", "docx", "odt", "rtf")
MAX_FILE_BYTES = 20 * 1024 * 1024

# Framework by file extension, and extensions that mark the main file of a model.
FRAMEWORK_BY_EXTENSION = {
    "pkl": "sklearn", "joblib": "sklearn", "onnx": "onnx", "h5": "keras", "hdf5": "keras", "pb": "tensorflow",
    "pth": "pytorch", "pt": "pytorch", "bin": "huggingface", "safetensors": "huggingface",
}
PRIMARY_EXTENSIONS = ("pkl", "joblib", "onnx", "h5", "hdf5", "pb", "pth", "pt")

# Older spellings of task types; anything else passes through. A bare "classification" stays
# generic in model records, while "regression" becomes the tabular one.
TASK_TYPES = {
    "model": {
        "regression": "tabular_regression",
        "time_series": "tabular_time_series",
        "timeseries": "tabular_time_series",
    },
    "tabular": {
        "classification": "tabular_classification",
        "regression": "tabular_regression",
        "time_series": "tabular_time_series",
        "timeseries": "tabular_time_series",
    },
    "vision": {"classification": "image_classification"},
}

# Parts of leaderboard column names that hold each score.
SCORE_COLUMNS = {
    "test_accuracy": ("score_test", "test_score", "test_accuracy"),
    "validation_accuracy": ("score_val", "val_score", "validation_accuracy"),
    "training_accuracy": ("score_train", "train_score", "training_accuracy"),
}


def duplicate_keys(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def page(df: DataFrame, order: Sequence[Column], skip: int = 0, limit: int | None = 100) -> DataFrame:
    """One page under a total order (planned as a top-n when it has a limit)."""
    df = df.orderBy(*order)
    if skip:
        df = df.offset(skip)
    return df if limit is None else df.limit(limit)


def newest_first(*key: str) -> list[Column]:
    return [F.desc("created_at"), *[F.asc(k) for k in key]]


def latest_version(cat: DataFrame, keys: Sequence[str], at: str = "created_at") -> DataFrame:
    """The newest record per key; equal times go to the higher version number, then the later spelling."""
    age = F.struct(F.col(at), F.coalesce(version_number(F.col("version")), F.lit(-1)), F.col("version"))
    best = cat.groupBy(*keys).agg(F.max_by(F.struct(*cat.columns), age).alias("x"))
    return best.select("x.*")


def get_version(cat: DataFrame, user: object, dataset: str, version: str, public_only: bool = False) -> DataFrame:
    found = cat.where((F.col("user_id") == user) & (F.col("dataset_id") == dataset) & (F.col("version") == version))
    return found.where("is_public") if public_only else found


def list_for_user(cat: DataFrame, user: object, skip: int = 0, limit: int | None = 100) -> DataFrame:
    return page(cat.where(F.col("user_id") == user), newest_first("dataset_id", "version"), skip, limit)


def search_latest(
    cat: DataFrame,
    user: object | None = None,
    query: str | None = None,
    tags_any: Sequence[str] = (),
    file_type: str | None = None,
    skip: int = 0,
    limit: int | None = 100,
) -> DataFrame:
    """Newest *matching* version per dataset: the filter comes before the choice of version."""
    keys = ["dataset_id"]
    if user is not None:
        cat = cat.where(F.col("user_id") == user)
    else:
        keys = ["user_id", "dataset_id"]
    if query:
        cat = cat.where(matches_any(query, ["name", "description", "dataset_id"]))
    if tags_any:
        cat = cat.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags_any])))
    if file_type:
        cat = cat.where(F.col("file_type") == file_type)
    return page(latest_version(cat, keys), newest_first("user_id", "dataset_id"), skip, limit)


def search_public(
    cat: DataFrame,
    query: str | None = None,
    tags_all: Sequence[str] = (),
    catalog_only: bool = False,
    skip: int = 0,
    limit: int | None = 100,
) -> DataFrame:
    """Public versions that match the text and carry all tags; ``catalog_only`` keeps the originals (v1)."""
    cat = cat.where("is_public")
    if catalog_only:
        cat = cat.where(F.col("version") == "v1")
    if query:
        cat = cat.where(matches_any(query, ["dataset_id", "name", "description"]))
    if tags_all:
        cat = cat.where(F.size(F.array_except(F.array(*[F.lit(t) for t in tags_all]), F.col("tags"))) == 0)
    return page(cat, [F.desc("updated_at"), F.asc("user_id"), F.asc("dataset_id"), F.asc("version")], skip, limit)


def search_models(
    models: DataFrame,
    user: object | None = None,
    query: str | None = None,
    framework: str | None = None,
    model_type: str | None = None,
    tags_any: Sequence[str] = (),
    skip: int = 0,
    limit: int | None = 100,
) -> DataFrame:
    if user is not None:
        models = models.where(F.col("user_id") == user)
    if query:
        models = models.where(matches_any(query, ["name", "description", "algorithm", "model_id"]))
    if framework:
        models = models.where(F.col("framework") == framework)
    if model_type:
        models = models.where(F.col("model_type") == model_type)
    if tags_any:
        models = models.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags_any])))
    return page(models, newest_first("user_id", "model_id", "version"), skip, limit)


def list_versions(cat: DataFrame, user: object, dataset: str, prefix: bool = False) -> DataFrame:
    """All versions, newest first. ``prefix`` matches every id that starts with the part before ``_v``."""
    mine = cat.where(F.col("user_id") == user)
    if prefix:
        mine = mine.where(F.col("dataset_id").rlike("^" + dataset.split("_v")[0]))
    else:
        mine = mine.where(F.col("dataset_id") == dataset)
    return mine.orderBy(*newest_first("dataset_id", "version"))


def next_versions(cat: DataFrame, count: int = 2, keys: Sequence[str] = ("user_id", "dataset_id")) -> DataFrame:
    """The next ``count`` version names per dataset; versions without a number are ignored."""
    last = cat.groupBy(*keys).agg(F.coalesce(F.max(version_number(F.col("version"))), F.lit(0)).alias("last"))
    numbers = F.explode(F.sequence(F.col("last") + 1, F.col("last") + count)).alias("number")
    return last.select(*keys, numbers).select(*keys, F.concat(F.lit("v"), "number").alias("next_version"))


def next_auto_name(cat: DataFrame, stem: str = "user_uploaded_dataset") -> DataFrame:
    """``<stem>_<n>`` with n one above the highest in use, per user."""
    number = F.regexp_extract("name", rf"^{stem}_(\d+)$", 1).try_cast("long")
    last = cat.groupBy("user_id").agg(F.coalesce(F.max(number), F.lit(0)).alias("last"))
    return last.select("user_id", F.concat(F.lit(stem + "_"), F.col("last") + 1).alias("next_name"))


def linked_datasets(cat: DataFrame) -> DataFrame:
    """Keys of datasets that refer to the public catalog in any version."""
    return cat.where("public_link is not null").select("user_id", "dataset_id").distinct()


def update_all_versions(cat: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply the non-null fields of a patch to every version of its dataset.

    ``patches`` has user_id, dataset_id, updated_at and some catalog fields; the newest patch of a key
    counts. Datasets linked to the public catalog stay as they are. Adds ``patched``.
    """
    keys = ["user_id", "dataset_id"]
    fields = [c for c in patches.columns if c not in keys]
    newest = patches.groupBy(*keys).agg(
        F.max_by(F.struct(*fields), F.struct("updated_at", *[c for c in fields if c != "updated_at"])).alias("patch")
    )
    allowed = newest.join(linked_datasets(cat), keys, "left_anti")
    joined = cat.join(allowed, keys, "left")
    changed = [
        F.coalesce(F.col(f"patch.{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in cat.columns
    ]
    return joined.select(*changed, F.col("patch").isNotNull().alias("patched"))


def delete_versions(cat: DataFrame, doomed: DataFrame, mode: str = "version") -> DataFrame:
    """Rows that stay: ``version`` removes exact versions, ``latest`` the newest, ``all`` whole datasets."""
    keys = ["user_id", "dataset_id"]
    if mode == "version":
        return cat.join(doomed.select(*keys, "version"), [*keys, "version"], "left_anti")
    if mode == "all":
        return cat.join(doomed.select(*keys), keys, "left_anti")
    if mode == "latest":
        newest = latest_version(cat.join(doomed.select(*keys), keys, "left_semi"), keys)
        return cat.join(newest.select(*keys, "version"), [*keys, "version"], "left_anti")
    raise ValueError(f"unknown mode {mode!r}")


def deletion_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Deleted versions per dataset that lost any."""
    keys = ["user_id", "dataset_id"]
    both = before.select(*keys, F.lit(1).alias("d")).unionByName(after.select(*keys, F.lit(-1).alias("d")))
    return both.groupBy(*keys).agg(F.sum("d").alias("deleted")).where("deleted > 0")


def _prefix(user: Column, dataset: Column, version: Column) -> Column:
    return F.concat(F.lit("datasets/"), user, F.lit("/"), dataset, F.lit("/"), version, F.lit("/"))


def _swap_prefix(path: Column, old: Column, new: Column) -> Column:
    rest = F.substr(path, F.length(old) + 1)
    return F.when(F.startswith(path, old), F.concat(new, rest)).otherwise(path)


def link_public_import(cat: DataFrame, user: str) -> DataFrame:
    """Rows that put every public dataset version into a user's namespace, without copying data.

    A dataset id the user already has gets a suffix (eight hex digits of the id's MD5).
    """
    taken = cat.where(F.col("user_id") == user).select("dataset_id").distinct().withColumn("taken", F.lit(True))
    public = cat.where("is_public").join(taken, "dataset_id", "left")
    new_id = F.when(
        F.col("taken"), F.concat("dataset_id", F.lit("_"), F.substring(F.md5("dataset_id"), 1, 8))
    ).otherwise(F.col("dataset_id"))
    old = _prefix(F.col("user_id"), F.col("dataset_id"), F.col("version"))
    new = _prefix(F.lit(user), F.col("new_id"), F.col("version"))
    public = public.withColumn("new_id", new_id).withColumn("old_prefix", old).withColumn("new_prefix", new)
    files = F.transform(
        "files", lambda f: f.withField("file_path", _swap_prefix(f["file_path"], F.col("old_prefix"), F.col("new_prefix")))
    )
    changes = {
        "user_id": F.lit(user),
        "dataset_id": F.col("new_id"),
        "is_public": F.lit(False),
        "public_source": F.lit(None).cast("string"),
        "public_link": F.struct(F.col("dataset_id").alias("dataset_id"), F.col("version").alias("version")),
        "file_path": F.when(F.col("is_folder"), F.col("new_prefix")).otherwise(
            F.concat("new_prefix", "original_filename")
        ),
        "files": files,
        "tags": F.filter("tags", lambda t: F.lower(t) != "public"),
    }
    return public.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in cat.columns])


def resolve_paths(cat: DataFrame, path: str = "file_path", into: str = "storage_path") -> DataFrame:
    """Where the bytes are: linked imports live under the public owner's prefix."""
    p = F.col(path)
    own = _prefix(F.col("user_id"), F.col("dataset_id"), F.col("version"))
    shared = _prefix(F.lit(PUBLIC_OWNER), F.col("public_link.dataset_id"), F.col("public_link.version"))
    resolved = (
        F.when(F.col("public_link").isNull(), p)
        .when(F.startswith(p, own), F.concat(shared, F.substr(p, F.length(own) + 1)))
        .when(F.startswith(p, F.lit(f"datasets/{PUBLIC_OWNER}/")), p)
        .when(~F.startswith(p, F.lit("datasets/")), F.concat(shared, F.ltrim(p, F.lit("/"))))
        .otherwise(p)
    )
    return cat.withColumn(into, resolved)


def list_user_files(
    files: DataFrame, user: object, project: str | None = None, skip: int = 0, limit: int | None = 100
) -> DataFrame:
    """A page of a user's files, newest first, with the total beside each row."""
    mine = files.where(F.col("user_id") == user)
    if project is not None:
        mine = mine.where(F.col("project_id") == project)
    total = mine.agg(F.count(F.lit(1)).alias("total"))
    return page(mine, newest_first("file_id"), skip, limit).join(F.broadcast(total))


def validate_user_files(files: DataFrame) -> DataFrame:
    """Safe name and, for refused files, the reason."""
    name = F.col("original_filename")
    has_dot = F.contains(name, F.lit("."))
    ext = F.when(has_dot, F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")
    safe = F.regexp_replace(F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), "^/+", ""), r"[^\p{L}\p{N}_\s\-.]", "")
    safe = F.regexp_replace(safe, r"^\s+|\s+$", "")
    safe = F.substring(F.when(safe == "", "file").otherwise(safe), 1, 200)
    reason = (
        F.when(name.isNull() | (name == ""), "filename is required")
        .when(~ext.isin(*ALLOWED_EXTENSIONS), "file type not allowed")
        .when(F.col("size_bytes") > MAX_FILE_BYTES, "file too large")
    )
    return files.withColumns({"extension": ext, "safe_name": safe, "reason": reason, "accepted": reason.isNull()})


def model_files_summary(models: DataFrame, files: str = "model_files") -> DataFrame:
    """Framework, main file and total size (MiB) of each model from its file list.

    The main file is the first one flagged, else the first with a known extension, else the largest.
    """
    flagged = F.filter(files, lambda f: f["is_primary"])
    known = F.filter(files, lambda f: extension(f["filename"]).isin(*PRIMARY_EXTENSIONS))
    largest = F.array_max(F.transform(files, lambda f: f["file_size"]))
    biggest = F.filter(files, lambda f: f["file_size"] == largest)
    main = F.coalesce(F.get(flagged, F.lit(0)), F.get(known, F.lit(0)), F.get(biggest, F.lit(0)))
    size = F.aggregate(files, F.lit(0).cast("long"), lambda acc, f: acc + f["file_size"]) / (1024.0 * 1024.0)
    out = models.withColumn("primary_file", main["filename"]).withColumn("size_mib", size)
    return out.withColumn("framework", lookup(extension(F.col("primary_file")), FRAMEWORK_BY_EXTENSION))


def normalize_task_type(df: DataFrame, kind: str, column: str = "task_type", into: str = "task_type") -> DataFrame:
    """Current spelling of a task type; ``kind`` is model, tabular or vision."""
    slug = F.trim(F.col(column))
    if kind == "model":
        slug = F.trim(F.element_at(F.split(slug, r"\."), -1))
    slug = F.lower(slug)
    return df.withColumn(into, lookup(slug, TASK_TYPES[kind], slug))


def models_for_dataset(models: DataFrame, datasets: DataFrame, exact: bool = False) -> DataFrame:
    """Models whose training_dataset equals or contains a dataset id; order a page of them with ``newest_first``.

    Containment is an equi-join on one n-gram of each id, the one that the fewest ids have, followed by the test
    itself. The length of the n-gram is that of the shortest id, eight at most.
    """
    ids = datasets.where("length(dataset_id) > 0").select("dataset_id").distinct()
    if exact:
        return models.join(ids, models["training_dataset"] == ids["dataset_id"])
    size = ids.agg(F.least(F.min(F.length("dataset_id")), F.lit(8)).alias("n")).first()["n"] or 1

    def grams(column: str) -> Column:
        places = F.sequence(F.lit(1), F.length(column) - size + 1)
        return F.explode(F.array_distinct(F.transform(places, lambda i: F.substr(F.col(column), i, F.lit(size))))).alias("gram")

    of_ids = ids.select("dataset_id", grams("dataset_id"))
    common = of_ids.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rare = of_ids.join(common, "gram").groupBy("dataset_id").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    texts = models.select("training_dataset").where(F.length("training_dataset") >= size).distinct()
    found = texts.select("training_dataset", grams("training_dataset")).join(rare, "gram")
    pairs = found.where(F.contains("training_dataset", "dataset_id")).select("training_dataset", "dataset_id")
    return models.join(pairs, "training_dataset")


def leaderboard_scores(models: DataFrame, leaderboard: str = "leaderboard") -> DataFrame:
    """Scores from a pipe-table leaderboard; explicit metrics win, ``best_score`` backs up the test score.

    Optional input columns: test_accuracy, validation_accuracy, training_accuracy, best_score, score_test.
    """
    lines = F.transform(F.split(F.trim(F.col(leaderboard)), "\r?\n"), lambda x: F.trim(x))
    lines = F.filter(lines, lambda x: x.startswith("|") & ~x.rlike(r"^\|[\s\-:|]+\|$"))

    def cells(line: Column) -> Column:
        return F.transform(F.split(line, r"\|"), lambda x: F.trim(x))

    out = models.withColumn("__lines", lines)
    usable = F.size("__lines") >= 2
    out = out.withColumn("__head", F.when(usable, F.transform(
        cells(F.get("__lines", F.lit(0))), lambda x: F.regexp_replace(F.lower(x), r"\s+", "_")
    ))).withColumn("__best", F.when(usable, cells(F.get("__lines", F.lit(1)))))
    scores = {}
    for score, parts in SCORE_COLUMNS.items():
        wanted = F.transform("__head", lambda h: (h != "") & ~h.startswith("unnamed") & h.rlike("|".join(parts)))
        place = F.array_position(wanted, True)
        parsed = F.when(place > 0, F.get("__best", (place - 1).cast("int"))).try_cast("double")
        given = []
        if score in models.columns:
            given.append(F.col(score).try_cast("double"))
        if score == "test_accuracy":
            given += [F.col(c).try_cast("double") for c in ("best_score", "score_test") if c in models.columns]
        scores[score] = F.coalesce(*given, parsed)
    return out.withColumns(scores).drop("__lines", "__head", "__best")


def upsert(
    table: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    keep_if_null: Sequence[str] = (),
    created: str = "created_at",
    updated: str = "updated_at",
) -> DataFrame:
    """Newest update per key over the table: ``created`` only set on insert, ``keep_if_null`` fields kept
    where the update has none."""
    others = [c for c in table.columns if c not in keys]
    sent = [c for c in others if c in updates.columns]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*sent), F.col(updated)).alias("new"))
    old = table.select(*keys, F.struct(*others).alias("old"))
    both = old.join(newest, list(keys), "full_outer")
    fields = []
    for c in others:
        before = F.col(f"old.{c}")
        if c == created:
            first = F.coalesce(F.col(f"new.{c}"), F.col(f"new.{updated}")) if c in sent else F.col(f"new.{updated}")
            value = F.when(F.col("old").isNotNull(), before).otherwise(first)
        elif c not in sent:
            value = before
        elif c in keep_if_null:
            value = F.coalesce(F.col(f"new.{c}"), before)
        else:
            value = F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(before)
        fields.append(value.alias(c))
    return both.select(*keys, *fields).select(*table.columns)


def get_reports(
    table: DataFrame, key: Mapping[str, object], latest: bool = True, skip: int = 0, limit: int | None = 100
) -> DataFrame:
    """Reports with the given key fields: the newest one, or all of them newest first."""
    found = table.where(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in key.items() if v is not None]))
    tie = [c for c in ("user_id", "dataset_id", "dataset_version", "model_id", "model_version") if c in table.columns]
    if latest:
        skip, limit = 0, 1
    return page(found, [F.desc("created_at"), *[F.asc(c) for c in tie]], skip, limit)


def remove_users(table: DataFrame, users: DataFrame) -> DataFrame:
    """The table without the rows of the given users."""
    return table.join(users.select("user_id").distinct(), "user_id", "left_anti")


def removal_counts(tables: Mapping[str, DataFrame], users: DataFrame) -> DataFrame:
    """Rows each table loses per user, zeros included."""
    people = users.select("user_id").distinct()
    marks = [
        t.select("user_id").groupBy("user_id").count().withColumn("table_name", F.lit(name))
        for name, t in tables.items()
    ]
    counted = reduce(DataFrame.unionByName, marks)
    names = F.explode(F.array(*[F.lit(n) for n in tables])).alias("table_name")
    return (
        people.select("user_id", names)
        .join(counted, ["user_id", "table_name"], "left")
        .select("user_id", "table_name", F.coalesce("count", F.lit(0)).alias("deleted"))
    )


# The tables that hold rows of users.
USER_TABLES = ("datasets", "ai_models", "bias_reports", "transformation_reports", "concept_drift_reports", "xai_reports",
               "user_files", "users")


def delete_user_everything(tables: Mapping[str, DataFrame], users: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables of ``USER_TABLES`` without the users' rows, and how many rows each loses per user."""
    missing = set(USER_TABLES) - set(tables)
    if missing:
        raise ValueError(f"tables are missing: {sorted(missing)}")
    return {name: remove_users(t, users) for name, t in tables.items()}, removal_counts(tables, users)


def incremental_sync(source: DataFrame, target: DataFrame, since: object, keys: Sequence[str]) -> DataFrame:
    """Rows of ``source`` changed after the watermark, upserted into ``target``."""
    changed = source.where(F.col("updated_at") > F.lit(since))
    return upsert(target, changed, keys)
