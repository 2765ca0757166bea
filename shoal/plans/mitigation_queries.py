"""Cleaning queries: line items with unknown values, events, documents with labels."""

from pyspark.sql import functions as F

from shoal.operators import mitigate
from shoal.operators.neighbors import exact_neighbors
from shoal.operators.split import random_split_exact
from shoal.plans.profile_queries import SPARSE_SQL, sparse_lines
from shoal.plans.registry import query, table
from shoal.session import fresh_path
from shoal.sources import versions

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _keyed_lines(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.select(
        *KEY, F.expr("nullif(l_quantity, 7.0)").alias("qty"), F.expr("nullif(l_linestatus, 'O')").alias("status"),
        F.when(F.col("l_returnflag") == "N", F.expr("nullif(l_discount, 0.02)")).otherwise(F.col("l_discount"))
        .alias("disc"), "l_returnflag")


KEYED_SQL = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(l_quantity, 7.0) AS qty,
 nullif(l_linestatus, 'O') AS status, CASE l_returnflag WHEN 'N' THEN nullif(l_discount, 0.02) ELSE l_discount END
 AS disc, l_returnflag FROM lineitem)"""


@query("fill_missing", f"""WITH r AS {KEYED_SQL}, t AS (SELECT median(qty) AS q, 'F' AS s FROM r
 WHERE l_returnflag <> 'N'), o AS (SELECT median(disc) AS d FROM r WHERE l_returnflag = 'N')
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(qty, q) AS qty, coalesce(status, s) AS status,
 coalesce(disc, d) AS disc, l_returnflag FROM r, t, o""")
def fill_missing(spark, sf):
    rows = _keyed_lines(spark, sf)
    state = mitigate.MitigationState()
    train = mitigate.fit_fill(rows.where("l_returnflag <> 'N'"), state)
    return train.unionByName(mitigate.apply_fill(rows.where("l_returnflag = 'N'"), state))


@query("drop_duplicates", f"SELECT DISTINCT * FROM {SPARSE_SQL}".replace("DISTINCT *", """DISTINCT
 coalesce(l_linenumber, -1) AS l_linenumber, l_quantity, l_discount, coalesce(l_tax, -1) AS l_tax, l_returnflag,
 coalesce(l_linestatus, '') AS l_linestatus"""))
def drop_duplicates(spark, sf):
    out = mitigate.drop_duplicates(sparse_lines(spark, sf))
    return out.na.fill(-1.0, ["l_linenumber", "l_tax"]).na.fill("", ["l_linestatus"])


FLAG_SQL = """CASE WHEN value > 250 THEN 'maybe' WHEN value > 60 THEN 'Yes' WHEN value > 2 THEN ' no ' END"""


def _flags(spark, sf):
    v = F.col("value")
    flag = F.when(v > 250, "maybe").when(v > 60, "Yes").when(v > 2, " no ")
    return table(spark, sf, "events").select("event_id", flag.alias("flag"), "event_type")


@query("detect_boolean_like", f"""WITH f AS (SELECT {FLAG_SQL} AS flag, event_type FROM events)
SELECT 'flag' AS column_name, count(*) FILTER (flag IN ('Yes', ' no ')) AS token_rows, count(*) FILTER (flag IS NULL
 OR flag = 'maybe') AS invalid_rows, count(*) FILTER (flag IN ('Yes', ' no ')) / count(flag) >= 0.95 AS boolean_like
 FROM f UNION ALL SELECT 'event_type', 0, count(*), false FROM f""")
def detect_boolean_like(spark, sf):
    return mitigate.detect_boolean_like(_flags(spark, sf), ["flag", "event_type"])


@query("coerce_boolean", f"""SELECT event_id, coalesce(CASE f WHEN 'Yes' THEN true WHEN ' no ' THEN false END,
 (SELECT count(*) FILTER ({FLAG_SQL} = 'Yes') > count(*) FILTER ({FLAG_SQL} = ' no ') FROM events)) AS flag
 FROM (SELECT event_id, {FLAG_SQL} AS f FROM events)""")
def coerce_boolean(spark, sf):
    rows = _flags(spark, sf)
    mode = mitigate.text_column_stats(rows, ["flag"]).first()["mode"]
    return rows.select("event_id", mitigate.coerce_boolean(F.col("flag"), mode).alias("flag"))


@query("detect_text_like", """SELECT c AS column_name, count(DISTINCT v) AS distinct_values, round(avg(length(v)), 6)
 AS average_length, avg(length(v)) >= 20 OR count(DISTINCT v) >= 50 AS text_like FROM (
 SELECT 'text' AS c, text AS v FROM documents UNION ALL SELECT 'lang', lang FROM documents UNION ALL
 SELECT 'source', source FROM documents) GROUP BY c""")
def detect_text_like(spark, sf):
    out = mitigate.detect_text_like(table(spark, sf, "documents"), ["text", "lang", "source"])
    return out.withColumn("average_length", F.round("average_length", 6))


@query("one_hot", """SELECT o_orderkey, o_orderstatus = 'F' AS "o_orderstatus_F", o_orderstatus = 'O'
 AS "o_orderstatus_O", o_orderpriority = '1-URGENT' AS "o_orderpriority_1-URGENT", o_orderpriority = '2-HIGH'
 AS "o_orderpriority_2-HIGH", o_orderpriority = '3-MEDIUM' AS "o_orderpriority_3-MEDIUM",
 o_orderpriority = '4-NOT SPECIFIED' AS "o_orderpriority_4-NOT SPECIFIED", o_orderpriority = '5-LOW'
 AS "o_orderpriority_5-LOW" FROM orders""")
def one_hot(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    state = mitigate.MitigationState()
    mitigate.fit_encode(orders.where("o_orderstatus <> 'P'"), state)
    return mitigate.apply_encode(orders, state)


@query("label_encode", """WITH c AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS i FROM (SELECT DISTINCT
 p_brand FROM part WHERE p_brand <> 'Brand#7'))
SELECT p_partkey, coalesce(i, -1)::INT AS p_brand FROM part LEFT JOIN c USING (p_brand)""")
def label_encode(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    state = mitigate.MitigationState()
    mitigate.fit_encode(part.where("p_brand <> 'Brand#7'"), state)
    return mitigate.apply_encode(part, state)


@query("infer_task", """SELECT 'l_returnflag' AS target, 'multiclass' AS target_type, 'classification' AS task
 UNION ALL SELECT 'l_linestatus', CASE WHEN (SELECT count(DISTINCT l_linestatus) FROM lineitem) <= 2 THEN 'binary' ELSE
 'multiclass' END, 'classification' UNION ALL SELECT 'l_quantity', CASE WHEN (SELECT count(*) FROM lineitem
 WHERE l_quantity <> floor(l_quantity)) > 0 THEN 'continuous' ELSE 'multiclass' END, CASE WHEN (SELECT count(*)
 FROM lineitem WHERE l_quantity <> floor(l_quantity)) > 0 THEN 'regression' ELSE 'classification' END UNION ALL
 SELECT 'l_extendedprice', 'continuous', 'regression'""")
def infer_task(spark, sf):
    lines = table(spark, sf, "lineitem")
    out = None
    for target in ("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice"):
        one = mitigate.infer_task(lines, target).withColumn("target", F.lit(target))
        out = one if out is None else out.unionByName(one)
    return out


@query("skew_correct", """WITH e AS (SELECT event_id, value - 5 AS shifted, event_id % 10 AS flat FROM events)
SELECT event_id, round((shifted - (SELECT avg(shifted) FROM e)) / (SELECT stddev_pop(shifted) FROM e), 6) + 0.0
 AS shifted, flat FROM e""")
def skew_correct(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", (F.col("value") - 5).alias("shifted"), (F.col("event_id") % 10).alias("flat"))
    out = mitigate.fit_skew(rows, mitigate.MitigationState())
    return out.withColumn("shifted", F.round("shifted", 6) + 0.0)


@query("standard_scale", """SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (
 SELECT stddev_pop(o_totalprice) FROM orders), 6) + 0.0 AS o_totalprice, 0.0::DOUBLE AS one FROM orders""")
def standard_scale(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.lit(1.0).alias("one"))
    params = mitigate.scale_params(orders, {c: F.col(c) for c in ("o_totalprice", "one")})
    out = mitigate.standard_scale(orders, params)
    return out.withColumn("o_totalprice", F.round("o_totalprice", 6) + 0.0)


@query("yeo_johnson")
def yeo_johnson(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "value", (F.col("value") - 5).alias("shifted"))
    powers = mitigate.yeo_johnson_fit(rows, ["value", "shifted"])
    return rows.select("event_id", *[mitigate.yeo_johnson(F.col(c), p).alias(c) for c, p in powers.items()])


@query("smote_gate", """WITH c AS (SELECT toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY toxic)
SELECT count(*) AS classes, min(n) AS smallest, max(n) AS largest, least(5, min(n) - 1)::INT AS k_neighbors,
 min(n) / max(n) < 0.5 AND min(n) >= 2 AS oversample FROM c""")
def smote_gate(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    rows = docs.join(table(spark, sf, "labels"), "doc_id")
    return mitigate.smote_gate(rows, "toxic").drop("reason")


@query("smote")
def smote(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"),
                                                F.length(F.regexp_replace("text", "[^.]", "")).alias("stops"))
    rows = docs.join(table(spark, sf, "labels"), "doc_id").drop("doc_id")
    return mitigate.smote(rows, "toxic")


@query("nearest_neighbors", """WITH p AS (SELECT o_orderpriority AS g, o_orderkey AS id, o_totalprice / 1000.0 AS x, o_custkey::DOUBLE AS y FROM orders)
SELECT g, id, neighbor, round(d, 6) AS distance, rank::INT AS rank FROM (SELECT a.g, a.id, b.id AS neighbor,
 sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, row_number() OVER (PARTITION BY a.g, a.id ORDER BY
 sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) AS rank
 FROM p a JOIN p b ON a.g = b.g AND a.id <> b.id WHERE a.id % 100 = 0) WHERE rank <= 5""")
def nearest_neighbors(spark, sf):
    """The five nearest orders of the same priority, for every order whose key is divisible by 100, against all orders."""
    points = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("g"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000.0).alias("x"),
        F.col("o_custkey").cast("double").alias("y"))
    found = exact_neighbors(points, "g", "id", ["x", "y"], 5, points.where("id % 100 = 0").select("g", "id"), part_rows=256)
    return found.withColumn("distance", F.round("distance", 6))


@query("smote_counts", """WITH c AS (SELECT toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY toxic)
SELECT toxic, max(n) OVER () AS rows, 0::BIGINT AS outside FROM c""")
def smote_counts(spark, sf):
    """All classes as large as the largest; no made row outside the range of its class."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    rows = docs.join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").drop("doc_id")
    bounds = rows.groupBy("toxic").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))
    made = mitigate.smote(rows, "toxic").join(F.broadcast(bounds), "toxic")
    return made.groupBy("toxic").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if((F.col("n_chars") < F.col("least") - 1e-9) | (F.col("n_chars") > F.col("most") + 1e-9)).alias("outside"))


@query("ks_normality")
def ks_normality(spark, sf):
    return mitigate.ks_normality(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"])


@query("drift_scale", """SELECT event_id, round((value - (SELECT avg(value) FROM events
 WHERE event_type <> 'view')) / (SELECT stddev_pop(value) FROM events WHERE event_type <> 'view'), 6) + 0.0
 AS value FROM events""")
def drift_scale(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value", "event_type")
    state = mitigate.MitigationState()
    mitigate.fit_drift_scale(events.where("event_type <> 'view'"), state, ["value"])
    out = mitigate.standard_scale(events, state.scale)
    return out.select("event_id", (F.round("value", 6) + 0.0).alias("value"))


@query("align_schema", "SELECT p_size, false AS absent, p_partkey FROM part UNION ALL SELECT p_size, true, p_partkey FROM part")
def align_schema(spark, sf):
    part = table(spark, sf, "part").withColumn("absent", F.lit(True)).select("p_size", "absent", "p_partkey")
    return mitigate.align_schema(table(spark, sf, "part"), part.schema).unionByName(part)


def mitigated(spark, sf):
    """Line items split 70/15/15 and written as a version, then cleaned split by split."""
    lines = table(spark, sf, "lineitem").select(
        *KEY, F.expr("nullif(l_quantity, 7.0)").alias("qty"), "l_extendedprice", "l_discount",
        F.expr("nullif(l_linestatus, 'O')").alias("status"), "l_returnflag")
    placed = random_split_exact(lines.withColumn("copy", F.hash(*lines.columns)), [*KEY, "copy"])
    root = fresh_path(spark, "versions")
    versions.write_version(placed.drop("copy", *KEY), root, "u1", "lines", "v2")
    train, test, drift = [versions.read_split(spark, root, "u1", "lines", "v2", s).drop("split")
                          for s in ("train", "test", "drift")]
    return mitigate.mitigate(train, test, drift, target="l_returnflag")


@query("mitigate")
def mitigate_query(spark, sf):
    return mitigated(spark, sf)[0].groupBy("split", "l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("qty").alias("qty"), F.avg("l_extendedprice").alias("price"))


@query("mitigation_log")
def mitigation_log(spark, sf):
    return mitigated(spark, sf)[1]


@query("publish_mitigated", """SELECT 'u1' AS user_id, 'lines' AS dataset_id, 'v3' AS version, 'Lines (Mitigated)' AS name,
 'raw,mitigated,bias-corrected' AS tags, true AS has_changes, true AS has_report, true AS repeated_is_skipped,
 count(*) - floor(count(*) * 0.7)::BIGINT AS other_rows FROM lineitem""")
def publish_mitigated(spark, sf):
    lines = table(spark, sf, "lineitem").select(*KEY, F.expr("nullif(l_quantity, 7.0)").alias("qty"), "l_returnflag")
    root = fresh_path(spark, "versions")
    placed = random_split_exact(lines.withColumn("copy", F.hash(*lines.columns)), [*KEY, "copy"]).drop("copy")
    versions.write_version(placed, root, "u1", "lines", "v2")
    when = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    catalog = spark.range(1).select(
        F.lit("u1").alias("user_id"), F.lit("lines").alias("dataset_id"), F.lit("v2").alias("version"), F.lit("Lines").alias("name"),
        F.array(F.lit("raw")).alias("tags"), when.alias("created_at"))
    later = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    record, changes, report = mitigate.publish_mitigated(catalog, root, "u1", "lines", target="l_returnflag", now=later)
    again = mitigate.publish_mitigated(catalog.unionByName(record.drop("row_count")), root, "u1", "lines", target="l_returnflag")
    other = versions.read_split(spark, root, "u1", "lines", "v3").where("split <> 'train'").groupBy().agg(F.count(F.lit(1)).alias("other_rows"))
    return (record.select("user_id", "dataset_id", "version", "name", F.array_join("tags", ",").alias("tags"))
            .join(changes.select("version", (F.length("report") > 2).alias("has_changes")), "version")
            .join(report.select("version", (F.length("report") > 2).alias("has_report")), "version")
            .withColumn("repeated_is_skipped", F.lit(again is None)).join(F.broadcast(other)))
