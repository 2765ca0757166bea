"""Catalog queries. Orders stand for dataset versions, documents for searchable descriptions, parts for models."""

from pyspark.sql import functions as F

from shoal.operators import catalog, search
from shoal.plans.registry import query, table
from shoal.session import fresh_path
from shoal.sources.stored import Stored

CATALOG_SQL = """(SELECT concat('u', o_custkey) AS user_id, lower(o_orderpriority) AS dataset_id,
 concat(CASE WHEN o_orderstatus = 'P' THEN 'draft' ELSE 'v' END, o_orderkey) AS version, o_orderdate AS created_at,
 concat('user_uploaded_dataset_', o_orderkey) AS name, o_orderstatus = 'F' AS is_public,
 CASE o_orderstatus WHEN 'O' THEN 'csv' WHEN 'F' THEN 'json' ELSE 'zip' END AS file_type,
 o_totalprice AS size_kib, o_orderkey FROM orders)"""


def dataset_catalog(spark, sf):
    orders = table(spark, sf, "orders")
    user = F.concat(F.lit("u"), "o_custkey")
    dataset = F.lower("o_orderpriority")
    version = F.concat(F.when(F.col("o_orderstatus") == "P", "draft").otherwise("v"), F.col("o_orderkey"))
    status = F.col("o_orderstatus")
    base = orders.select(
        user.alias("user_id"), dataset.alias("dataset_id"), version.alias("version"),
        F.concat(F.lit("user_uploaded_dataset_"), "o_orderkey").alias("name"),
        (status == "F").alias("is_public"),
        F.when(status == "O", "csv").when(status == "F", "json").otherwise("zip").alias("file_type"),
        F.col("o_totalprice").alias("size_kib"),
        F.array(F.lit("Public"), dataset, status).alias("tags"),
        (status == "P").alias("is_folder"),
        F.concat(F.lit("part-"), "o_orderkey", F.lit(".csv")).alias("original_filename"),
        F.when(F.col("o_orderpriority").startswith("5"), F.struct(
            F.lit("shared").alias("dataset_id"), F.lit("v1").alias("version"))).alias("public_link"),
        F.lit("upload").alias("public_source"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"), "o_orderkey",
    )
    folder = F.concat(F.lit("datasets/"), "user_id", F.lit("/"), "dataset_id", F.lit("/"), "version", F.lit("/"))
    path = F.concat(folder, "original_filename")
    return base.withColumn("file_path", path).withColumn("files", F.array(
        F.struct(F.col("original_filename").alias("filename"), path.alias("file_path"))))


KEYS = ["user_id", "dataset_id"]
LATEST_ORDER = """created_at DESC, coalesce(TRY_CAST(CASE WHEN version LIKE 'v%' THEN substr(version, 2) END AS INT), -1)
 DESC, version DESC"""


@query("latest_version", f"""SELECT user_id, dataset_id, version, created_at, size_kib FROM {CATALOG_SQL}
 QUALIFY row_number() OVER (PARTITION BY user_id, dataset_id ORDER BY {LATEST_ORDER}) = 1""")
def latest_version(spark, sf):
    return catalog.latest_version(dataset_catalog(spark, sf), KEYS).select(*KEYS, "version", "created_at", "size_kib")


@query("get_version", f"""SELECT user_id, dataset_id, version, size_kib FROM {CATALOG_SQL}
 WHERE user_id = 'u899' AND dataset_id = '5-low' AND version = 'v0' OR user_id = 'u899' AND dataset_id = '5-low'
 AND version = 'draft0'""")
def get_version(spark, sf):
    cat = dataset_catalog(spark, sf)
    both = [catalog.get_version(cat, "u899", "5-low", v) for v in ("v0", "draft0")]
    return both[0].unionByName(both[1]).select(*KEYS, "version", "size_kib")


@query("list_for_user", f"""SELECT user_id, dataset_id, version, created_at FROM {CATALOG_SQL} WHERE user_id = 'u7'
 ORDER BY created_at DESC, dataset_id, version LIMIT 5 OFFSET 2""")
def list_for_user(spark, sf):
    cat = dataset_catalog(spark, sf).select(*KEYS, "version", "created_at")
    return catalog.list_for_user(cat, "u7", skip=2, limit=5)


TEXTS_SQL = """(SELECT source AS user_id, lang AS dataset_id, concat('v', doc_id) AS version, source AS name,
 text AS description, [lang, source] AS tags, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS file_type,
 TIMESTAMP '2024-01-01' + to_seconds(n_chars * 60) AS created_at, n_chars, doc_id FROM documents)"""


def text_catalog(spark, sf):
    docs = table(spark, sf, "documents")
    start = F.lit("2024-01-01").cast("timestamp")
    return docs.select(
        F.col("source").alias("user_id"), F.col("lang").alias("dataset_id"),
        F.concat(F.lit("v"), "doc_id").alias("version"), F.col("source").alias("name"),
        F.col("text").alias("description"), F.array("lang", "source").alias("tags"),
        F.when(F.col("n_chars") > 1000, "long").otherwise("short").alias("file_type"),
        F.timestamp_seconds(F.unix_timestamp(start) + F.col("n_chars") * 60).cast("timestamp_ntz").alias("created_at"),
        "n_chars", "doc_id",
    )


@query("search_latest", f"""SELECT user_id, dataset_id, version, file_type, created_at FROM (
 SELECT * FROM {TEXTS_SQL} WHERE (regexp_matches(name, 'er[aeiou]n', 'i') OR regexp_matches(description, 'er[aeiou]n',
 'i') OR regexp_matches(dataset_id, 'er[aeiou]n', 'i')) AND list_has_any(tags, ['en', 'fr']) AND file_type = 'long'
 QUALIFY row_number() OVER (PARTITION BY user_id, dataset_id ORDER BY {LATEST_ORDER}) = 1)
 ORDER BY created_at DESC, user_id, dataset_id LIMIT 100""")
def search_latest(spark, sf):
    found = catalog.search_latest(text_catalog(spark, sf), query="er[aeiou]n", tags_any=["en", "fr"], file_type="long")
    return found.select(*KEYS, "version", "file_type", "created_at")


@query("search_latest_indexed", f"""SELECT user_id, dataset_id, version, file_type, created_at FROM (
 SELECT * FROM {TEXTS_SQL} WHERE (regexp_matches(name, 'ertion [aeiou]n|mentoii?er', 'i') OR regexp_matches(description,
 'ertion [aeiou]n|mentoii?er', 'i') OR regexp_matches(dataset_id, 'ertion [aeiou]n|mentoii?er', 'i'))
 QUALIFY row_number() OVER (PARTITION BY user_id, dataset_id ORDER BY {LATEST_ORDER}) = 1)""")
def search_latest_indexed(spark, sf):
    cat, keys, columns = text_catalog(spark, sf), [*KEYS, "version"], ["name", "description", "dataset_id"]
    postings = search.trigram_postings(cat, keys, columns)
    found = search.search_postings(cat, postings, keys, "ertion [aeiou]n|mentoii?er", columns)
    return catalog.search_latest(found, limit=None).select(*KEYS, "version", "file_type", "created_at")


@query("search_public", f"""SELECT user_id, dataset_id, version, updated_at FROM (SELECT *, created_at AS updated_at
 FROM {CATALOG_SQL}) WHERE is_public AND (regexp_matches(dataset_id, '^[12]-', 'i') OR
 regexp_matches(name, '^[12]-', 'i')) ORDER BY updated_at DESC, user_id, dataset_id, version LIMIT 50""")
def search_public(spark, sf):
    cat = dataset_catalog(spark, sf).withColumn("description", F.lit(None).cast("string"))
    found = catalog.search_public(cat, query="^[12]-", tags_all=["F", "Public"], limit=50)
    return found.select(*KEYS, "version", "updated_at")


MODELS_SQL = """(SELECT concat('m', p_partkey) AS model_id, p_brand AS user_id, p_name AS name, p_type AS algorithm,
 concat(p_type, ' ', p_name) AS description, CASE WHEN p_size < 20 THEN 'sklearn' ELSE 'onnx' END AS framework,
 concat('v', p_size) AS version, p_retailprice, p_size, p_partkey,
 TIMESTAMP '2024-01-01' + to_days(p_size) AS created_at FROM part)"""


def model_catalog(spark, sf):
    part = table(spark, sf, "part")
    return part.select(
        F.concat(F.lit("m"), "p_partkey").alias("model_id"), F.col("p_brand").alias("user_id"),
        F.col("p_name").alias("name"), F.col("p_type").alias("algorithm"),
        F.concat_ws(" ", "p_type", "p_name").alias("description"),
        F.when(F.col("p_size") < 20, "sklearn").otherwise("onnx").alias("framework"),
        F.lit("classification").alias("model_type"), F.array("p_type").alias("tags"),
        F.concat(F.lit("v"), "p_size").alias("version"), "p_retailprice", "p_size", "p_partkey",
        F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, p_size)").alias("created_at"),
    )


@query("search_models", f"""SELECT model_id, user_id, name, framework, created_at FROM {MODELS_SQL}
 WHERE (regexp_matches(name, 'red|ring', 'i') OR regexp_matches(description, 'red|ring', 'i')
 OR regexp_matches(algorithm, 'red|ring', 'i') OR regexp_matches(model_id, 'red|ring', 'i'))
 AND framework = 'sklearn' AND algorithm IN ('ECONOMY', 'PROMO')
 ORDER BY created_at DESC, user_id, model_id, version LIMIT 40""")
def search_models(spark, sf):
    found = catalog.search_models(model_catalog(spark, sf), query="red|ring", framework="sklearn",
                                  model_type="classification", tags_any=["ECONOMY", "PROMO"], limit=40)
    return found.select("model_id", "user_id", "name", "framework", "created_at")


@query("list_versions", f"""SELECT dataset_id, version, created_at, 'exact' AS mode FROM {CATALOG_SQL}
 WHERE user_id = 'u7' AND dataset_id = '1-urgent' UNION ALL SELECT dataset_id, version, created_at, 'prefix'
 FROM {CATALOG_SQL} WHERE user_id = 'u7' AND regexp_matches(dataset_id, '^1')""")
def list_versions(spark, sf):
    cat = dataset_catalog(spark, sf)
    exact = catalog.list_versions(cat, "u7", "1-urgent").withColumn("mode", F.lit("exact"))
    loose = catalog.list_versions(cat, "u7", "1_v2", prefix=True).withColumn("mode", F.lit("prefix"))
    return exact.unionByName(loose).select("dataset_id", "version", "created_at", "mode")


@query("next_versions", f"""WITH m AS (SELECT user_id, dataset_id, coalesce(max(TRY_CAST(CASE WHEN version LIKE 'v%'
 THEN substr(version, 2) END AS INT)), 0) AS last FROM {CATALOG_SQL} GROUP BY ALL)
SELECT user_id, dataset_id, concat('v', last + i) AS next_version FROM m, (VALUES (1), (2)) t(i)""")
def next_versions(spark, sf):
    return catalog.next_versions(dataset_catalog(spark, sf), count=2)


@query("next_auto_name", f"""SELECT user_id, concat('user_uploaded_dataset_', coalesce(max(TRY_CAST(
 regexp_extract(name, '^user_uploaded_dataset_(\\d+)$', 1) AS BIGINT)), 0) + 1) AS next_name
 FROM {CATALOG_SQL} GROUP BY user_id""")
def next_auto_name(spark, sf):
    return catalog.next_auto_name(dataset_catalog(spark, sf))


@query("update_all_versions", f"""WITH patch AS (SELECT concat('u', c_custkey) AS user_id, '1-urgent' AS dataset_id,
 c_mktsegment AS name FROM customer UNION ALL SELECT concat('u', c_custkey), '5-low', c_mktsegment FROM customer)
SELECT c.user_id, c.dataset_id, c.version, CASE WHEN p.name IS NOT NULL AND c.dataset_id <> '5-low' THEN p.name
 ELSE c.name END AS name, c.file_type, p.name IS NOT NULL AND c.dataset_id <> '5-low' AS patched
 FROM {CATALOG_SQL} c LEFT JOIN patch p USING (user_id, dataset_id)""")
def update_all_versions(spark, sf):
    user = F.concat(F.lit("u"), "c_custkey").alias("user_id")
    ids = F.explode(F.array(F.lit("1-urgent"), F.lit("5-low"))).alias("dataset_id")
    patches = table(spark, sf, "customer").select(
        user, ids, F.col("c_mktsegment").alias("name"), F.lit(None).cast("string").alias("file_type"),
        F.lit("2024-06-01").cast("timestamp_ntz").alias("updated_at"))
    out = catalog.update_all_versions(dataset_catalog(spark, sf), patches)
    return out.select(*KEYS, "version", "name", "file_type", "patched")


@query("delete_versions", f"""WITH cat AS {CATALOG_SQL}, newest AS (SELECT user_id, dataset_id, version FROM cat
 QUALIFY row_number() OVER (PARTITION BY user_id, dataset_id ORDER BY {LATEST_ORDER}) = 1)
SELECT c.user_id, c.dataset_id, count(*) AS deleted FROM cat c JOIN newest n USING (user_id, dataset_id, version)
 WHERE c.dataset_id = '2-high' GROUP BY ALL UNION ALL SELECT user_id, dataset_id, count(*) FROM cat
 WHERE dataset_id = '3-medium' GROUP BY ALL UNION ALL SELECT user_id, dataset_id, count(*) FROM cat
 WHERE is_public AND dataset_id = '1-urgent' GROUP BY ALL""")
def delete_versions(spark, sf):
    cat = dataset_catalog(spark, sf).select(*KEYS, "version", "created_at", "is_public")
    kept = catalog.delete_versions(cat, cat.where("dataset_id = '2-high'").select(*KEYS).distinct(), "latest")
    kept = catalog.delete_versions(kept, cat.where("dataset_id = '3-medium'").select(*KEYS).distinct(), "all")
    kept = catalog.delete_versions(kept, cat.where("is_public and dataset_id = '1-urgent'"), "version")
    return catalog.deletion_counts(cat, kept)


@query("link_public_import", f"""WITH cat AS {CATALOG_SQL}, taken AS (SELECT DISTINCT dataset_id FROM cat
 WHERE user_id = 'u7'), p AS (SELECT *, CASE WHEN dataset_id IN (SELECT dataset_id FROM taken) THEN
 concat(dataset_id, '_', md5(dataset_id)[1:8]) ELSE dataset_id END AS new_id FROM cat WHERE is_public)
SELECT 'u7' AS user_id, new_id AS dataset_id, version, false AS is_public, dataset_id AS public_dataset,
 concat('datasets/u7/', new_id, '/', version, '/part-', o_orderkey, '.csv') AS file_path,
 concat('datasets/u7/', new_id, '/', version, '/part-', o_orderkey, '.csv') AS first_file,
 concat(dataset_id, ',F') AS tags, o_orderkey FROM p""")
def link_public_import(spark, sf):
    linked = catalog.link_public_import(dataset_catalog(spark, sf), "u7")
    return linked.select(*KEYS, "version", "is_public", F.col("public_link.dataset_id").alias("public_dataset"),
                         "file_path", F.col("files")[0]["file_path"].alias("first_file"),
                         F.array_join("tags", ",").alias("tags"), "o_orderkey")


@query("resolve_paths", f"""SELECT user_id, dataset_id, version, CASE WHEN dataset_id = '5-low' THEN
 concat('datasets/public/shared/v1/part-', o_orderkey, '.csv') ELSE
 concat('datasets/', user_id, '/', dataset_id, '/', version, '/part-', o_orderkey, '.csv') END AS storage_path,
 CASE WHEN dataset_id = '5-low' THEN concat('datasets/public/shared/v1/part-', o_orderkey, '.csv')
 ELSE concat('/part-', o_orderkey, '.csv') END AS from_relative FROM {CATALOG_SQL}""")
def resolve_paths(spark, sf):
    cat = dataset_catalog(spark, sf).withColumn("relative", F.concat(F.lit("/"), "original_filename"))
    out = catalog.resolve_paths(catalog.resolve_paths(cat), "relative", "from_relative")
    return out.select(*KEYS, "version", "storage_path", "from_relative")


REPORTS_SQL = """(SELECT o_custkey AS user_id, o_orderpriority AS dataset_id, max(o_orderkey) AS payload,
 min(o_orderdate) AS created_at, max(o_orderdate) AS updated_at, max(o_orderstatus) AS extra_id
 FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY ALL)"""


ALL_REPORTS_SQL = REPORTS_SQL.replace(" WHERE o_orderdate < TIMESTAMP '1998-01-01'", "")


def _reports(spark, sf, before="1998-01-01"):
    old = table(spark, sf, "orders")
    if before is not None:
        old = old.where(F.col("o_orderdate") < F.lit(before).cast("timestamp_ntz"))
    return old.groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("dataset_id")).agg(
        F.max("o_orderkey").alias("payload"), F.min("o_orderdate").alias("created_at"),
        F.max("o_orderdate").alias("updated_at"), F.max("o_orderstatus").alias("extra_id"))


UPSERT_SQL = f"""WITH t AS {REPORTS_SQL}, u AS (SELECT o_custkey AS user_id, o_orderpriority AS dataset_id,
 max(o_orderkey) AS payload, o_orderdate AS updated_at FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'
 GROUP BY o_custkey, o_orderpriority, o_orderdate), n AS (SELECT * FROM u QUALIFY row_number() OVER
 (PARTITION BY user_id, dataset_id ORDER BY updated_at DESC) = 1)
SELECT user_id, dataset_id, coalesce(u.payload, t.payload) AS payload,
 coalesce(t.created_at, u.updated_at) AS created_at, coalesce(u.updated_at, t.updated_at) AS updated_at,
 t.extra_id FROM t FULL JOIN n u USING (user_id, dataset_id)"""


@query("upsert_report", UPSERT_SQL)
def upsert_report(spark, sf):
    return catalog.upsert(_reports(spark, sf), _report_updates(spark, sf), ["user_id", "dataset_id"], keep_if_null=["extra_id"])


def _report_updates(spark, sf):
    recent = table(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    updates = recent.groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("dataset_id"),
                             F.col("o_orderdate").alias("updated_at")).agg(F.max("o_orderkey").alias("payload"))
    return updates.withColumn("extra_id", F.lit(None).cast("string"))


@query("stored_upsert", UPSERT_SQL)
def stored_upsert(spark, sf):
    """The same by versions of a stored table; a second writer's version comes between the first one's work and its commit."""
    store, updates = Stored(spark, fresh_path(spark, "stored")), _report_updates(spark, sf)
    store.create(_reports(spark, sf), ["user_id", "dataset_id"], buckets=16)
    rules = dict(keep_if_null=["extra_id"])
    faster = [lambda: store.upsert(updates.where("user_id % 2 = 0"), **rules)]
    store.upsert(updates.where("user_id % 2 = 1"), before_commit=lambda: faster and faster.pop()(), **rules)
    return store.read()


@query("incremental_sync", f"""WITH t AS {REPORTS_SQL}, u AS (SELECT o_custkey AS user_id,
 o_orderpriority AS dataset_id, max(o_orderkey) AS payload, min(o_orderdate) AS created_at,
 max(o_orderdate) AS updated_at, max(o_orderstatus) AS extra_id FROM orders GROUP BY ALL
 HAVING max(o_orderdate) > TIMESTAMP '1998-06-01')
SELECT user_id, dataset_id, coalesce(u.payload, t.payload) AS payload, coalesce(t.created_at, u.created_at)
 AS created_at, coalesce(u.updated_at, t.updated_at) AS updated_at, coalesce(u.extra_id, t.extra_id) AS extra_id
 FROM t FULL JOIN u USING (user_id, dataset_id)""")
def incremental_sync(spark, sf):
    source = table(spark, sf, "orders").groupBy(
        F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("dataset_id")).agg(
        F.max("o_orderkey").alias("payload"), F.min("o_orderdate").alias("created_at"),
        F.max("o_orderdate").alias("updated_at"), F.max("o_orderstatus").alias("extra_id"))
    since = F.lit("1998-06-01").cast("timestamp_ntz")
    return catalog.incremental_sync(source, _reports(spark, sf), since, ["user_id", "dataset_id"])


@query("get_reports", f"""(SELECT user_id, dataset_id, payload, created_at FROM {ALL_REPORTS_SQL} WHERE user_id = 7
 ORDER BY created_at DESC, user_id, dataset_id LIMIT 1) UNION ALL (SELECT user_id, dataset_id, payload, created_at
 FROM {ALL_REPORTS_SQL} WHERE dataset_id = '1-URGENT' ORDER BY created_at DESC, user_id, dataset_id LIMIT 100)""")
def get_reports(spark, sf, before=None):
    reports = _reports(spark, sf, before=None)
    one = catalog.get_reports(reports, {"user_id": 7, "dataset_id": None})
    many = catalog.get_reports(reports, {"dataset_id": "1-URGENT"}, latest=False)
    return one.unionByName(many).select("user_id", "dataset_id", "payload", "created_at")


FILES_SQL = """(SELECT conv_id, turn, role AS user_id, concat(conv_id, '-', turn) AS file_id,
 concat('../', replace(text, chr(10), ' '), CASE turn WHEN 0 THEN '.TXT' WHEN 1 THEN '.exe' ELSE '' END)
 AS original_filename, length(text) * 1000 AS size_bytes, TIMESTAMP '2024-01-01' + to_minutes(conv_id + turn)
 AS created_at FROM conversations)"""


def user_files(spark, sf):
    talks = table(spark, sf, "conversations")
    tail = F.when(F.col("turn") == 0, ".TXT").when(F.col("turn") == 1, ".exe").otherwise("")
    return talks.select(
        "conv_id", "turn", F.col("role").alias("user_id"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("file_id"),
        F.concat(F.lit("../"), F.replace("text", F.lit("\n"), F.lit(" ")), tail)
        .alias("original_filename"),
        (F.length("text") * 1000).cast("long").alias("size_bytes"),
        F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, conv_id + turn)").alias("created_at"),
        F.lit("p").alias("project_id"),
    )


@query("list_user_files", f"""SELECT file_id, size_bytes, created_at, (SELECT count(*) FROM {FILES_SQL}
 WHERE user_id = 'user') AS total FROM {FILES_SQL} WHERE user_id = 'user'
 ORDER BY created_at DESC, file_id LIMIT 20 OFFSET 10""")
def list_user_files(spark, sf):
    out = catalog.list_user_files(user_files(spark, sf), "user", project="p", skip=10, limit=20)
    return out.select("file_id", "size_bytes", "created_at", "total")


@query("validate_user_files", f"""WITH f AS (SELECT *, CASE WHEN contains(original_filename, '.') THEN
 lower(split(original_filename, '.')[-1]) ELSE '' END AS ext FROM {FILES_SQL})
SELECT conv_id, turn, ext AS extension, CASE WHEN ext NOT IN ('txt', 'md', 'csv', 'json', 'xml', 'pdf', 'doc', 'docx',
 'odt', 'rtf') THEN 'file type not allowed' WHEN size_bytes > 20971520 THEN 'file too large' ELSE 'none' END AS reason,
 trim(regexp_replace(regexp_replace(replace(original_filename, chr(92), '/'), '^/+', ''),
  '[^\\pL\\pN_\\s\\-.]', '', 'g'))[1:200]
  AS safe_name FROM f""")
def validate_user_files(spark, sf):
    out = catalog.validate_user_files(user_files(spark, sf))
    return out.select("conv_id", "turn", "extension", F.coalesce("reason", F.lit("none")).alias("reason"),
                      "safe_name")


@query("model_files_summary", f"""SELECT model_id, CASE WHEN p_size % 3 = 0 THEN 'weights.safetensors'
 WHEN p_size % 3 = 1 THEN 'model.pkl' WHEN length(name) > p_size THEN 'notes.md' ELSE 'data.bin' END AS primary_file,
 round((p_size + length(name)) / 1024.0 / 1024.0, 9) AS size_mib,
 CASE WHEN p_size % 3 = 0 THEN 'huggingface' WHEN p_size % 3 = 1 THEN 'sklearn' WHEN length(name) > p_size THEN 'none'
 ELSE 'huggingface' END AS framework FROM {MODELS_SQL}""")
def model_files_summary(spark, sf):
    turn = F.col("p_size") % 3

    def entry(name, size, primary):
        return F.struct(F.lit(name).alias("filename"), size.cast("long").alias("file_size"), primary.alias("is_primary"))

    small, big = F.col("p_size"), F.length("name")
    no = F.lit(False)
    models = model_catalog(spark, sf).withColumn("model_files", F.when(turn == 0, F.array(
        entry("model.pkl", small, no), entry("weights.safetensors", big, F.lit(True)))).when(turn == 1, F.array(
            entry("notes.md", small, no), entry("model.pkl", big, no))).otherwise(F.array(
                entry("data.bin", small, no), entry("notes.md", big, no))))
    out = catalog.model_files_summary(models)
    return out.select("model_id", "primary_file", F.round("size_mib", 9).alias("size_mib"),
                      F.coalesce("framework", F.lit("none")).alias("framework"))


@query("normalize_task_type", """WITH e AS (SELECT event_id, concat(' ModelType.', CASE event_type WHEN 'click' THEN
 'Regression' WHEN 'view' THEN 'TimeSeries' WHEN 'error' THEN 'classification' ELSE event_type END, ' ') AS task,
 CASE event_type WHEN 'click' THEN 'Regression' WHEN 'view' THEN 'TimeSeries' WHEN 'error' THEN 'classification'
 ELSE event_type END AS bare FROM events)
SELECT event_id, CASE lower(bare) WHEN 'regression' THEN 'tabular_regression' WHEN 'timeseries' THEN
 'tabular_time_series' ELSE lower(bare) END AS model_type, CASE lower(bare) WHEN 'regression' THEN 'tabular_regression'
 WHEN 'timeseries' THEN 'tabular_time_series' WHEN 'classification' THEN 'tabular_classification' ELSE lower(bare) END
 AS tabular_type, CASE lower(bare) WHEN 'classification' THEN 'image_classification' ELSE lower(bare) END AS vision_type
 FROM e""")
def normalize_task_type(spark, sf):
    kind = F.col("event_type")
    bare = F.when(kind == "click", "Regression").when(kind == "view", "TimeSeries").when(
        kind == "error", "classification").otherwise(kind)
    events = table(spark, sf, "events").select(
        "event_id", bare.alias("bare"), F.concat(F.lit(" ModelType."), bare, F.lit(" ")).alias("task"))
    events = catalog.normalize_task_type(events, "model", "task", "model_type")
    events = catalog.normalize_task_type(events, "tabular", "bare", "tabular_type")
    events = catalog.normalize_task_type(events, "vision", "bare", "vision_type")
    return events.select("event_id", "model_type", "tabular_type", "vision_type")


@query("models_for_dataset", """SELECT p.p_partkey AS model_id, d.n_name AS dataset_id FROM part p
 JOIN nation d ON contains(concat('train/NATION_', p.p_size, '/', p.p_name), d.n_name)""")
def models_for_dataset(spark, sf):
    part = table(spark, sf, "part")
    models = part.select(
        F.col("p_partkey").alias("model_id"), F.lit("v1").alias("version"), F.lit(0).alias("created_at"),
        F.concat(F.lit("train/NATION_"), "p_size", F.lit("/"), "p_name").alias("training_dataset"))
    datasets = table(spark, sf, "nation").select(F.col("n_name").alias("dataset_id"))
    return catalog.models_for_dataset(models, datasets).select("model_id", "dataset_id")


@query("leaderboard_scores", """SELECT p_partkey AS model_id, CASE WHEN p_size % 2 = 0 THEN 0.5 ELSE p_size / 100.0 END
 ::DOUBLE AS test_accuracy, p_retailprice / 10.0 AS validation_accuracy, p_partkey / 2.0 AS training_accuracy
 FROM part""")
def leaderboard_scores(spark, sf):
    part = table(spark, sf, "part")
    text = F.concat(
        F.lit("| model | Score_Test | score val | train score |\n|:---|---:|:-:|---|\n| "), "p_name", F.lit(" | "),
        (F.col("p_size") / 100.0).cast("string"), F.lit(" | "), (F.col("p_retailprice") / 10.0).cast("string"),
        F.lit(" | "), (F.col("p_partkey") / 2.0).cast("string"), F.lit(" |\n| other | 1 | 1 | 1 |\n"))
    models = part.select(F.col("p_partkey").alias("model_id"), text.alias("leaderboard"),
                         F.when(F.col("p_size") % 2 == 0, F.lit("0.5")).alias("best_score"))
    return catalog.leaderboard_scores(models).select(
        "model_id", "test_accuracy", "validation_accuracy", "training_accuracy")


USER_ROWS = {
    "datasets": ("orders", "o_custkey", "true"), "ai_models": ("orders", "o_custkey", "o_orderstatus = 'F'"),
    "bias_reports": ("orders", "o_custkey", "o_orderpriority = '1-URGENT'"),
    "transformation_reports": ("orders", "o_custkey", "o_orderpriority = '2-HIGH'"),
    "concept_drift_reports": ("events", "user_id", "event_type = 'error'"),
    "xai_reports": ("events", "user_id", "event_type = 'view'"), "user_files": ("events", "user_id", "true"),
    "users": ("customer", "c_custkey", "true")}
USER_ROWS_SQL = " UNION ALL ".join(f"SELECT {key} AS user_id, '{name}' AS table_name FROM {source} WHERE {test}"
                                   for name, (source, key, test) in USER_ROWS.items())


@query("delete_user_everything", f"""WITH u AS (SELECT o_custkey AS user_id FROM orders GROUP BY o_custkey
 HAVING count(*) >= 18), t AS ({USER_ROWS_SQL}), n AS (SELECT DISTINCT table_name FROM t)
SELECT u.user_id, n.table_name, count(t.user_id) AS deleted, 0::BIGINT AS remaining FROM u CROSS JOIN n
 LEFT JOIN t ON t.user_id = u.user_id AND t.table_name = n.table_name GROUP BY ALL
UNION ALL SELECT -1, table_name, 0, count(*) FILTER (user_id NOT IN (SELECT user_id FROM u)) FROM t GROUP BY table_name""")
def delete_user_everything(spark, sf):
    """Rows lost per user and table; rows that stay are listed under user -1."""
    tables = {name: table(spark, sf, source).where(test).select(F.col(key).alias("user_id"))
              for name, (source, key, test) in USER_ROWS.items()}
    users = tables["datasets"].groupBy("user_id").count().where("count >= 18").select("user_id")
    left, counts = catalog.delete_user_everything(tables, users)
    out = counts.withColumn("remaining", F.lit(0).cast("long"))
    for name, rows in left.items():
        out = out.unionByName(rows.groupBy().agg(F.count(F.lit(1)).alias("remaining")).select(
            F.lit(-1).cast("long").alias("user_id"), F.lit(name).alias("table_name"), F.lit(0).cast("long").alias("deleted"),
            "remaining"))
    return out


@query("remove_users", """SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders
 GROUP BY o_custkey HAVING count(*) >= 18)""")
def remove_users(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"))
    users = orders.groupBy("user_id").count().where("count >= 18")
    return catalog.remove_users(table(spark, sf, "events"), users).select("event_id", "user_id")
