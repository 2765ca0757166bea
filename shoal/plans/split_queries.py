"""Splits, samples and preparation of whole tables."""

from pyspark.sql import functions as F

from shoal.operators import annotations, prepare, split
from shoal.operators.ordering import row_index
from shoal.plans.registry import query, table

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
RANDOM_SQL = """CASE WHEN r <= floor(n * 0.7) THEN 'train' WHEN r <= floor(n * 0.7) + floor(n * 0.15) THEN 'test'
 ELSE 'drift' END"""


@query("should_split", """SELECT o_custkey AS user_id, count(*) AS row_count, count(*) > (2 + 1) * 10 AS should_split
 FROM orders GROUP BY o_custkey""")
def should_split(spark, sf):
    sizes = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.count(F.lit(1)).alias("row_count"))
    return split.should_split(sizes, features=F.lit(2))


@query("random_split_exact", f"""SELECT o_orderkey, {RANDOM_SQL} AS split FROM (SELECT o_orderkey,
 row_number() OVER (ORDER BY md5(concat('42|', o_orderkey))) AS r, count(*) OVER () AS n FROM orders)""")
def random_split_exact(spark, sf):
    return split.random_split_exact(table(spark, sf, "orders"), ["o_orderkey"]).select("o_orderkey", "split")


@query("prefix_split", f"""SELECT event_id, {RANDOM_SQL} AS split FROM (SELECT event_id,
 row_number() OVER (ORDER BY ts, event_id) AS r, count(*) OVER () AS n FROM events)""")
def prefix_split(spark, sf):
    return split.prefix_split(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"]).drop("ts")


@query("row_index", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_shipdate,
 l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS row_index FROM lineitem""")
def row_index_query(spark, sf):
    lines = table(spark, sf, "lineitem").select(*LINE_KEY, "l_shipdate", "l_extendedprice")
    return row_index(lines, ["l_shipdate", *LINE_KEY, "l_extendedprice"]).drop("l_shipdate", "l_extendedprice")


@query("row_index_per_key", """SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1
 AS row_index FROM events""")
def row_index_per_key(spark, sf):
    events = table(spark, sf, "events").select("event_type", "ts", "event_id")
    return row_index(events, ["ts", "event_id"], keys=["event_type"]).select("event_id", "row_index")


@query("systematic_sample", """WITH n AS (SELECT greatest(1, count(*) // 700) AS step FROM orders), k AS (
 SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders
 WHERE o_orderstatus <> 'P')
SELECT o_orderkey, o_totalprice FROM k, n WHERE i % step = 0 AND i < step * 700""")
def systematic_sample(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    out = split.systematic_sample(orders, 700, ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") != "P")
    return out.select("o_orderkey", "o_totalprice")


PATHS_SQL = """(SELECT page_id, concat('./', regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''),
 '-', page_id, CASE page_id % 5 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.tif' WHEN 3 THEN '.csv'
 ELSE '.txt' END) AS relative_path FROM pages)"""


def file_list(spark, sf):
    stem = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    ending = F.element_at(F.array(*[F.lit(x) for x in (".JPG", ".png", ".tif", ".csv", ".txt")]),
                          (F.col("page_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("./"), stem, F.lit("-"), F.col("page_id"), ending)
    return table(spark, sf, "pages").select("page_id", path.alias("relative_path"))


@query("split_files", f"""SELECT page_id, concat({RANDOM_SQL}, '/', relative_path) AS path_in_split FROM (SELECT *,
 row_number() OVER (ORDER BY md5(concat('42|', relative_path))) AS r, count(*) OVER () AS n FROM {PATHS_SQL})""")
def split_files(spark, sf):
    return split.split_files(file_list(spark, sf)).select("page_id", "path_in_split")


@query("detect_presplit", """SELECT p_brand AS dataset_id, count(*) FILTER (p_size < 10) AS train,
 count(*) FILTER (p_size BETWEEN 10 AND 20) AS test, count(*) FILTER (p_size > 20 AND p_type <> 'PROMO') AS drift,
 count(*) FILTER (p_size < 10) > 0 AND count(*) FILTER (p_size BETWEEN 10 AND 20) > 0
 AND count(*) FILTER (p_size > 20 AND p_type <> 'PROMO') > 0 AS presplit FROM part GROUP BY p_brand""")
def detect_presplit(spark, sf):
    folder = F.when(F.col("p_size") < 10, "train/").when(F.col("p_size") <= 20, "test/").when(
        F.col("p_type") != "PROMO", "drift/").otherwise("other/")
    files = table(spark, sf, "part").select(
        F.col("p_brand").alias("dataset_id"), F.concat(folder, "p_name", F.lit(".csv")).alias("relative_path"))
    return split.detect_presplit(files)


# Annotations: every page names a file, some by full path, some by base name only, some not at all.
ANN_SQL = f"""(SELECT page_id, CASE page_id % 4 WHEN 0 THEN relative_path WHEN 1 THEN
 upper(split_part(relative_path, '/', -1)) WHEN 2 THEN split_part(relative_path, '/', 2) ELSE 'gone.png' END AS image,
 CASE WHEN page_id % 7 = 0 THEN ' ' ELSE concat('c', page_id % 3) END AS class FROM {PATHS_SQL})"""


def annotation_rows(spark, sf):
    path = F.col("relative_path")
    turn = F.col("page_id") % 4
    name = F.when(turn == 0, path).when(turn == 1, F.upper(F.split_part(path, F.lit("/"), F.lit(-1)))).when(
        turn == 2, F.split_part(path, F.lit("/"), F.lit(2))).otherwise("gone.png")
    label = F.when(F.col("page_id") % 7 == 0, " ").otherwise(F.concat(F.lit("c"), F.col("page_id") % 3))
    return file_list(spark, sf).select("page_id", name.alias("image"), label.alias("class"))


MATCH_SQL = f"""files AS (SELECT DISTINCT regexp_replace(relative_path, '^[./]+', '') AS full_path FROM {PATHS_SQL}
 WHERE regexp_matches(lower(relative_path), '\\.(jpg|png|tif)$')), short AS (
 SELECT lower(split_part(full_path, '/', -1)) AS short_name, min(full_path) AS only_path FROM files GROUP BY ALL
 HAVING count(*) = 1), ann AS (SELECT *, regexp_replace(image, '^[./]+', '') AS wanted FROM {ANN_SQL}), hits AS (
 SELECT ann.page_id, image, class, coalesce(f.full_path, s.only_path) AS matched_path FROM ann
 LEFT JOIN files f ON f.full_path = wanted LEFT JOIN short s ON s.short_name = lower(split_part(wanted, '/', -1)))"""


@query("match_annotations", f"WITH {MATCH_SQL} SELECT page_id, coalesce(matched_path, 'none') AS matched_path FROM hits")
def match_annotations(spark, sf):
    ann = annotations.normalize_annotations(annotation_rows(spark, sf))
    out = annotations.match_annotations(file_list(spark, sf), ann)
    return out.select("page_id", F.coalesce("matched_path", F.lit("none")).alias("matched_path"))


@query("annotations_from_json", """SELECT concat('a/', doc_id, '.png') AS filename, CASE WHEN doc_id % 3 > 0 THEN lang END AS label,
 CASE WHEN doc_id % 3 > 0 THEN 3 ELSE 2 END AS n_fields, source FROM documents""")
def annotations_from_json(spark, sf):
    """Lists, and objects with a list; other keys stay."""
    docs = table(spark, sf, "documents")
    path = F.concat(F.lit("a/"), "doc_id", F.lit(".png"))
    full = F.struct(path.alias(" Image_Path"), F.col("lang").alias("CLASS"), "source")
    listed = F.to_json(F.struct(F.array(full).alias("annotations")))
    bare = F.to_json(F.array(F.struct(path.alias("filename"), F.col("source").alias("source"))))
    texts = docs.select(F.when(F.col("doc_id") % 3 > 0, listed).otherwise(bare).alias("value"))
    return annotations.annotations_from_json(texts).select(
        "filename", "label", F.size("fields").alias("n_fields"), F.col("fields")["source"].alias("source"))


@query("pick_annotation_file", """SELECT concat('x', page_id, '/annotations.json') AS relative_path FROM pages
 WHERE page_id % 5 = 3 ORDER BY 1 LIMIT 1""")
def pick_annotation_file(spark, sf):
    name = F.when(F.col("page_id") % 5 == 3, "/annotations.json").when(F.col("page_id") % 5 == 2, "/labels.csv").otherwise("/a.png")
    files = table(spark, sf, "pages").select(F.concat(F.lit("x"), "page_id", name).alias("relative_path"))
    return annotations.pick_annotation_file(files)


@query("validate_annotations", f"""WITH {MATCH_SQL} SELECT (SELECT count(*) FROM {PATHS_SQL}
 WHERE regexp_matches(lower(relative_path), '\\.(jpg|png|tif)$')) AS images, (SELECT count(*) FROM {PATHS_SQL}
 WHERE relative_path LIKE '%.csv') AS annotation_files, count(*) AS rows, count(image) AS named_rows,
 count(matched_path) AS matched_rows, true AS valid FROM hits""")
def validate_annotations(spark, sf):
    return annotations.validate_annotations(file_list(spark, sf), annotation_rows(spark, sf)).drop("reason")


IMAGE_SPLIT_SQL = f"""placed AS (SELECT relative_path, CASE WHEN r <= floor(n * 0.7) THEN 'train' WHEN r <=
 floor(n * 0.7) + floor(n * 0.15) THEN 'test' ELSE 'drift' END AS split FROM (SELECT relative_path, row_number() OVER
 (ORDER BY md5(concat('42|', relative_path))) AS r, count(*) OVER () AS n FROM (SELECT
 regexp_replace(relative_path, '^[./]+', '') AS relative_path FROM {PATHS_SQL}
 WHERE regexp_matches(lower(relative_path), '\\.(jpg|png|tif)$'))))"""


@query("split_images", f"""WITH {IMAGE_SPLIT_SQL} SELECT split, relative_path FROM placed UNION ALL
 SELECT split, regexp_replace(relative_path, '^[./]+', '') FROM {PATHS_SQL}, (VALUES ('train'), ('test'), ('drift'))
 s(split) WHERE relative_path LIKE '%.txt'""")
def split_images(spark, sf):
    return annotations.split_images(file_list(spark, sf)).select("split", "relative_path")


@query("split_annotations", f"""WITH {MATCH_SQL}, {IMAGE_SPLIT_SQL} SELECT page_id, matched_path AS filename,
 class AS label, split FROM hits JOIN placed ON matched_path = relative_path WHERE trim(class) <> ''""")
def split_annotations(spark, sf):
    out = annotations.split_annotations(file_list(spark, sf), annotation_rows(spark, sf))
    return out.select("page_id", "filename", "label", "split")


@query("split_counts", f"""WITH {IMAGE_SPLIT_SQL} SELECT split, count(*) + (SELECT count(*) FROM {PATHS_SQL}
 WHERE relative_path LIKE '%.txt') + 1 AS files FROM placed GROUP BY split""")
def split_counts(spark, sf):
    return annotations.split_counts(annotations.split_images(file_list(spark, sf)))


@query("drop_pattern_columns", "SELECT p_partkey, p_brand, p_type, p_retailprice FROM part")
def drop_pattern_columns(spark, sf):
    return prepare.drop_pattern_columns(table(spark, sf, "part"), "_name", ["p_size"])


@query("rename_and_require", """SELECT l_orderkey AS trip, l_extendedprice AS fare, nullif(l_discount, 0.0) AS payment
 FROM lineitem WHERE nullif(l_discount, 0.0) IS NOT NULL""")
def rename_and_require(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_extendedprice", "l_tax", F.expr("nullif(l_discount, 0.0)").alias("l_discount"))
    names = {"l_orderkey": "trip", "l_extendedprice": "fare", "l_discount": "payment"}
    return prepare.rename_and_require(lines, ["l_tax", "absent"], names, "payment")


@query("clean_census", """SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN NULL ELSE c_mktsegment END
 AS workclass, TRY_CAST(c_acctbal AS DOUBLE) AS fnlwgt, c_name AS income FROM customer UNION ALL
 SELECT s_suppkey, NULL, NULL, s_name FROM supplier""")
def clean_census(spark, sf):
    first = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") == "MACHINERY", " ? ").otherwise(
            F.concat(F.lit(" "), "c_mktsegment")).alias("workclass"),
        F.concat(F.col("c_acctbal").cast("string"), F.lit(" ")).alias("fnlwgt"), F.col("c_name").alias("income"))
    second = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"), F.lit("?").alias("workclass"), F.lit("n/a").alias("fnlwgt"),
        F.concat("s_name", F.lit(" .. ")).alias("income"))
    return prepare.clean_census(first, second)


@query("union_schema", """SELECT c_acctbal AS balance, c_custkey AS id, NULL::VARCHAR AS note, 'customer' AS split
 FROM customer UNION ALL SELECT NULL, s_suppkey, s_name, 'supplier' FROM supplier""")
def union_schema(spark, sf):
    return prepare.union_schema({
        "customer": table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_acctbal AS balance"),
        "supplier": table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_name AS note"),
    })


@query("join_labels", """SELECT doc_id AS id, text AS tweet, toxic AS label FROM documents JOIN labels
 USING (doc_id)""")
def join_labels(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias(" ID"), F.col("text").alias("Text"))
    return prepare.join_labels(texts, table(spark, sf, "labels").selectExpr("doc_id AS id", "toxic AS label"))


@query("normalize_headers", """SELECT c_custkey AS "id no", c_acctbal AS "limit bal", c_nationkey AS default_next_month
 FROM customer""")
def normalize_headers(spark, sf):
    odd = table(spark, sf, "customer").selectExpr(
        "c_custkey AS `  id   no`", "c_acctbal AS `limit\tbal`", "c_nationkey AS `default  payment next month `")
    return prepare.detect_target(prepare.normalize_headers(odd), "default_next_month")
