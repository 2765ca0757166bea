"""Drift and evaluation queries. Events in time order are the prediction stream: the truth is whether an
event is an error, the guess is whether the value is high."""

from pyspark.sql import functions as F

from shoal.operators import drift, metrics
from shoal.plans.registry import query, table

STREAM_SQL = """(SELECT event_id, ts, user_id, event_type, value, CASE event_type WHEN 'error' THEN 1.0 WHEN 'view'
 THEN 2.0 ELSE 0.0 END AS y_true, CASE WHEN value > 60 THEN '1' WHEN value > 20 THEN ' 2' WHEN value > 1 THEN '0' END
 AS y_pred FROM events)"""


def stream(spark, sf):
    v = F.col("value")
    truth = F.when(F.col("event_type") == "error", 1.0).when(F.col("event_type") == "view", 2.0).otherwise(0.0)
    guess = F.when(v > 60, "1").when(v > 20, " 2").when(v > 1, "0")
    share = F.least(v / 500.0, F.lit(1.0))
    return table(spark, sf, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", truth.alias("y_true"), guess.alias("y_pred"),
        F.create_map(F.lit("1"), share, F.lit("0"), 1.0 - share).alias("proba"))


LABELS = """CASE WHEN y_true = floor(y_true) THEN (y_true::BIGINT)::VARCHAR ELSE y_true::VARCHAR END AS t,
 coalesce(trim(y_pred), 'NA') AS p"""


@query("error_signal", f"""SELECT event_id, CASE t WHEN '1' THEN 1.0 - least(value / 500.0, 1.0) WHEN '0' THEN
 1.0 - (1.0 - least(value / 500.0, 1.0)) ELSE (t <> p)::INT::DOUBLE END AS error, (t <> p)::INT::DOUBLE AS missed,
 coalesce(abs(TRY_CAST(y_pred AS DOUBLE) - y_true), 0.0) AS gap FROM (SELECT *, {LABELS} FROM {STREAM_SQL})""")
def error_signal(spark, sf):
    out = metrics.error_signal(stream(spark, sf), "y_true", "y_pred", "classification", "proba")
    out = metrics.error_signal(out, "y_true", "y_pred", "classification", into="missed")
    out = metrics.error_signal(out, "y_true", "y_pred", "regression", into="gap")
    return out.select("event_id", "error", "missed", "gap")


@query("normalize_label", f"SELECT event_id, t, p FROM (SELECT *, {LABELS} FROM {STREAM_SQL})")
def normalize_label(spark, sf):
    rows = stream(spark, sf)
    return rows.select("event_id", metrics.normalize_label(rows, "y_true").alias("t"),
                       metrics.normalize_label(rows, "y_pred").alias("p"))


@query("nearest_class_label", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (SELECT arg_min(c, (abs(c - g), c))
 FROM (SELECT DISTINCT l_linenumber AS c FROM lineitem))::VARCHAR AS y_pred_label
 FROM (SELECT *, l_quantity / 7.0 AS g FROM lineitem)""")
def nearest_class_label(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") / 7.0).alias("g"))
    return metrics.nearest_class_label(rows, "l_linenumber", "g").drop("g")


@query("classification_metrics", f"""WITH s AS (SELECT user_id, {LABELS} FROM {STREAM_SQL}), c AS (SELECT user_id,
 label, sum(support) AS support, sum(predicted) AS predicted, sum(hits) AS hits FROM (
 SELECT user_id, t AS label, 1 AS support, 0 AS predicted, (t = p)::INT AS hits FROM s UNION ALL
 SELECT user_id, p, 0, 1, 0 FROM s) GROUP BY ALL), m AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted
 ELSE 0 END AS pr, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS re FROM c)
SELECT user_id, sum(support)::BIGINT AS rows, round(sum(hits) / sum(support), 9) AS accuracy,
 round(sum(support * pr) / sum(support), 9) AS precision, round(sum(support * re) / sum(support), 9) AS recall,
 round(sum(support * CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END) / sum(support), 9) AS f1_score
 FROM m GROUP BY user_id""")
def classification_metrics(spark, sf):
    out = metrics.classification_metrics(stream(spark, sf), "y_true", "y_pred", ["user_id"])
    return out.select("user_id", "rows", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1_score")])


@query("regression_metrics", f"""WITH s AS (SELECT event_type, y_true + value AS y, TRY_CAST(y_pred AS DOUBLE) * 30 AS p
 FROM {STREAM_SQL}), v AS (SELECT * FROM s WHERE p IS NOT NULL)
SELECT event_type, count(*) AS rows, round(avg(abs(y - p)), 6) AS mae, round(avg((y - p) ** 2), 5) AS mse,
 round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(1 - avg((y - p) ** 2) / var_pop(y), 6) AS r2
 FROM v GROUP BY event_type""")
def regression_metrics(spark, sf):
    rows = stream(spark, sf).select("event_type", (F.col("y_true") + F.col("value")).alias("y"),
                                    (F.col("y_pred").try_cast("double") * 30).alias("p"))
    out = metrics.regression_metrics(rows, "y", "p", ["event_type"])
    return out.select("event_type", "rows", *[F.round(c, 5 if c == "mse" else 6).alias(c)
                                              for c in ("mae", "mse", "rmse", "r2")])


@query("window_accuracy", f"""WITH s AS (SELECT *, (t = p)::INT AS ok FROM (SELECT *, {LABELS} FROM {STREAM_SQL}))
SELECT event_id, row_number() OVER w - 1 AS row_index, round(avg(ok) OVER (PARTITION BY event_type
 ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 9) AS window_accuracy,
 round(avg(ok) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 9)
 AS cumulative_accuracy FROM s WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def window_accuracy(spark, sf):
    out = metrics.window_accuracy(stream(spark, sf), "y_true", "y_pred", ["ts", "event_id"], 50, ["event_type"])
    return out.select("event_id", "row_index", F.round("window_accuracy", 9).alias("window_accuracy"),
                      F.round("cumulative_accuracy", 9).alias("cumulative_accuracy"))


@query("final_window_score", f"""SELECT user_id, round(avg((t = p)::INT), 9) AS final_window_accuracy FROM (SELECT *,
 {LABELS} FROM {STREAM_SQL} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20)
 GROUP BY user_id""")
def final_window_score(spark, sf):
    out = metrics.final_window_score(stream(spark, sf), "y_true", "y_pred", ["ts", "event_id"], 20, ["user_id"])
    return out.withColumn("final_window_accuracy", F.round("final_window_accuracy", 9))


@query("holdout_accuracy", f"""SELECT round(avg((t = p)::INT), 9) AS accuracy FROM (SELECT *, {LABELS}
 FROM {STREAM_SQL}) WHERE event_type IN ('click', 'view')""")
def holdout_accuracy(spark, sf):
    split = F.when(F.col("event_type").isin("click", "view"), "test").otherwise("train")
    out = metrics.holdout_accuracy(stream(spark, sf).withColumn("split", split), "y_true", "y_pred")
    return out.select(F.round("accuracy", 9).alias("accuracy"))


@query("infer_problem_type", """SELECT 'l_quantity' AS target, count(DISTINCT l_quantity) AS distinct_values,
 count(*) AS rows, CASE WHEN count(DISTINCT l_quantity) <= 20 OR count(DISTINCT l_quantity) / count(*) < 0.05
 THEN 'multiclass' ELSE 'regression' END AS problem_type FROM lineitem UNION ALL SELECT 'l_extendedprice',
 count(DISTINCT l_extendedprice), count(*), CASE WHEN count(DISTINCT l_extendedprice) <= 20 THEN 'classification'
 ELSE 'regression' END FROM lineitem""")
def infer_problem_type(spark, sf):
    lines = table(spark, sf, "lineitem")
    full = metrics.infer_problem_type(lines, "l_quantity").withColumn("target", F.lit("l_quantity"))
    simple = metrics.infer_problem_type(lines, "l_extendedprice", simple=True)
    return full.unionByName(simple.withColumn("target", F.lit("l_extendedprice")))


@query("drift_params", """WITH d AS (SELECT o_custkey, count(*) * 13 AS row_count, CASE WHEN max(o_orderstatus) = 'P'
 THEN 'classification' ELSE 'regression' END AS task FROM orders GROUP BY o_custkey)
SELECT *, CASE WHEN task = 'classification' AND row_count < 500 THEN 150 WHEN task = 'classification' THEN 200
 WHEN row_count < 100 THEN greatest(20, row_count // 4) ELSE least(200, greatest(50, row_count // 10)) END::BIGINT
 AS window_size, CASE WHEN task = 'classification' AND row_count < 500 THEN 1.5 WHEN task = 'classification' THEN 0.8
 WHEN row_count < 100 THEN 0.08 ELSE 0.05 END::DOUBLE AS drift_strength FROM d""")
def drift_params(spark, sf):
    sizes = table(spark, sf, "orders").groupBy("o_custkey").agg(
        (F.count(F.lit(1)) * 13).alias("row_count"),
        F.when(F.max("o_orderstatus") == "P", "classification").otherwise("regression").alias("task"))
    return metrics.drift_params(sizes)


def changing_prices(spark, sf):
    """Orders in time order whose prices jump four times."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    return drift.induce_drift(orders, ["o_orderdate", "o_orderkey"], n_drifts=4,
                              strength=0.3, ignore=["o_orderkey", "o_orderpriority"])


@query("adwin")
def adwin(spark, sf):
    return drift.adwin(changing_prices(spark, sf), "o_totalprice", ["row_index"], ["o_orderpriority"], delta=0.01)


@query("adwin_blocks")
def adwin_blocks(spark, sf):
    return drift.adwin(changing_prices(spark, sf), "o_totalprice", ["row_index"], ["o_orderpriority"], delta=0.01,
                       block=16)


@query("column_drift_scan")
def column_drift_scan(spark, sf):
    return drift.column_drift_scan(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], "o_totalprice", delta=0.2,
                                   block=16)


@query("monitor_drift")
def monitor_drift(spark, sf):
    drifted = drift.induce_drift(
        stream(spark, sf).select("event_id", "ts", "user_id", "event_type", "value", "y_true"), ["ts", "event_id"],
        n_drifts=4, strength=200.0, target="y_true", ignore=["event_id", "user_id"])
    guess = F.when(F.col("value") > 60, 1.0).otherwise(0.0)
    rows = metrics.error_signal(drifted.withColumn("y_pred", guess), "y_true", "y_pred", "classification")
    return drift.monitor_drift(rows, "error", ["row_index"], ["user_id"], window=150, delta=0.9, min_samples=30)


DRIFT_SQL = """WITH r AS (SELECT o_orderkey, o_totalprice, o_custkey, row_number() OVER (ORDER BY o_orderdate,
 o_orderkey) - 1 AS row_index, count(*) OVER () AS n FROM orders), s AS (SELECT *, (SELECT count(*)
 FROM range(1, 5) e(k) WHERE row_index >= k * n // 5)::INT AS segment FROM r)"""


@query("induce_drift", DRIFT_SQL + """ SELECT o_orderkey, row_index, segment, round(CASE WHEN segment = 0 THEN
 o_totalprice ELSE o_totalprice * CASE WHEN segment % 3 = 0 THEN 1.8 ELSE 0.5 END + segment * 0.3 *
 CASE WHEN segment % 2 = 1 THEN 1 ELSE -1 END END, 4) AS o_totalprice, round(CASE WHEN segment = 0 THEN o_custkey
 ELSE o_custkey + 0.75 * segment * 0.3 * CASE WHEN segment % 2 = 1 THEN 1 ELSE -1 END END::DOUBLE, 4)
 AS o_custkey FROM s""")
def induce_drift(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderdate")
    out = drift.induce_drift(orders, ["o_orderdate", "o_orderkey"], n_drifts=4, strength=0.3, noise=0.0,
                             target="o_custkey", task="regression", ignore=["o_orderkey"])
    return out.select("o_orderkey", "row_index", "segment", F.round("o_totalprice", 4).alias("o_totalprice"),
                      F.round("o_custkey", 4).alias("o_custkey"))


UNIT_SQL = "((('0x' || substr(md5(concat({}, '|', row_index)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


def swap_sql(column, rows, within, shares, seed, pick_seed):
    """Other values of the group for the rows of smallest hash in each segment."""
    u, same = UNIT_SQL.format(f"'{pick_seed}'"), "v.segment = r.segment" if within else "true"
    share = "CASE segment " + " ".join(f"WHEN {k} THEN floor(size * {share})" for k, share in shares.items()) + " ELSE 0 END"
    part = "PARTITION BY segment" if within else ""
    return f"""SELECT r.* EXCLUDE (h, size) REPLACE (CASE WHEN m > 1 AND r.h <= {share.replace("segment", "r.segment").replace("size", "r.size")}
 THEN n.v ELSE r.{column} END AS {column}) FROM (SELECT *, row_number() OVER (PARTITION BY segment
 ORDER BY md5(concat('{seed}|', row_index))) AS h, count(*) OVER (PARTITION BY segment) AS size FROM ({rows})) r
 JOIN (SELECT *, row_number() OVER ({part} ORDER BY v) - 1 AS j, count(*) OVER ({part}) AS m FROM (SELECT DISTINCT
 {"segment, " if within else ""}{column} AS v FROM ({rows}))) v ON v.v = r.{column} AND {same}
 JOIN (SELECT *, row_number() OVER ({part} ORDER BY v) - 1 AS j FROM (SELECT DISTINCT
 {"segment, " if within else ""}{column} AS v FROM ({rows}))) n ON {same.replace("v.", "n.")}
 AND n.j = CASE WHEN m = 1 THEN v.j ELSE floor({u.replace("row_index", "r.row_index")} * (m - 1))
  + CASE WHEN floor({u.replace("row_index", "r.row_index")} * (m - 1)) >= v.j THEN 1 ELSE 0 END END"""


LABEL_ROWS = """SELECT o_orderkey, o_orderpriority, o_orderstatus, row_index, (SELECT count(*) FROM range(1, 5) e(k)
 WHERE row_index >= k * n // 5)::INT AS segment FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1
 AS row_index, count(*) OVER () AS n FROM orders)"""
LABELS_SQL = swap_sql("o_orderstatus", swap_sql("o_orderpriority", LABEL_ROWS, True, {
    k: min(0.6, 0.15 + 0.05 * k) for k in range(1, 5)}, 43, 143), False, {k: min(0.7, 0.20 + 0.05 * k) for k in range(1, 5)}, 44, 144)


@query("induce_drift_labels", f"SELECT o_orderkey, segment, o_orderpriority, o_orderstatus FROM ({LABELS_SQL})")
def induce_drift_labels(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    out = drift.induce_drift(orders, ["o_orderdate", "o_orderkey"], n_drifts=4, strength=0.3,
                             target="o_orderstatus", ignore=["o_orderkey"])
    return out.select("o_orderkey", "segment", "o_orderpriority", "o_orderstatus")


NORMAL_SQL = f"""(sqrt(-2.0 * ln({UNIT_SQL.format("'42|r|0'")})) * cos(2.0 * pi() * {UNIT_SQL.format("'42|a|0'")}))"""


@query("induce_noise_ramp", f"""SELECT o_orderkey, row_index, round(o_totalprice + (least(row_index // (n // 10), 9) + 1) * 0.1
 * {NORMAL_SQL}, 5) AS o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_index,
 count(*) OVER () AS n FROM orders)""")
def induce_noise_ramp(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    out = drift.induce_noise_ramp(orders, ["o_orderdate", "o_orderkey"], ignore=["o_orderkey"])
    return out.select("o_orderkey", "row_index", F.round("o_totalprice", 5).alias("o_totalprice"))


@query("training_windows", """WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type
 ORDER BY ts, event_id) - 1 AS row_index FROM events), e AS (SELECT DISTINCT event_type, row_index AS event_index
 FROM r JOIN (SELECT event_id FROM events WHERE value > 250) USING (event_id))
SELECT event_id, event_type, row_index, event_index FROM r JOIN e USING (event_type)
 WHERE row_index <= event_index AND row_index > event_index - 40""")
def training_windows(spark, sf):
    from shoal.operators.ordering import row_index

    events = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    indexed = row_index(events, ["ts", "event_id"], "row_index", ["event_type"])
    log = indexed.where("value > 250").select("event_type", "row_index")
    out = drift.training_windows(indexed, log, 40, ["event_type"])
    return out.select("event_id", "event_type", "row_index", "event_index")


def _retrained(spark, sf):
    rows = stream(spark, sf).select("event_id", "ts", "user_id", "event_type", "value", "y_true")
    drifted = drift.induce_drift(rows, ["ts", "event_id"], n_drifts=2, strength=200.0, target="y_true",
                                 ignore=["event_id", "user_id"]).drop("row_index", "segment")
    guess = F.when(F.col("value") > 60, "1").otherwise("0")
    return drift.monitor_and_retrain(
        drifted.withColumn("y_pred", guess), ["ts", "event_id"], ["value"], "y_true", "y_pred",
        keys=["user_id"], window=150, delta=0.9, min_samples=30, cooldown=50, batch=64)


@query("retrain_on_window")
def retrain_on_window(spark, sf):
    return _retrained(spark, sf)[1]


@query("drift_report")
def drift_report(spark, sf):
    rows = metrics.error_signal(stream(spark, sf), "y_true", "y_pred", "classification")
    log = drift.monitor_drift(rows, "error", ["ts", "event_id"], ["event_type"], delta=0.2, min_samples=30)
    scores = metrics.classification_metrics(rows, "y_true", "y_pred", ["event_type"])
    return drift.drift_report(log, scores, ["event_type"])


@query("publish_drift_report", """WITH f AS (SELECT user_id, max(event_type) AS model_id, max(value) > 250 AS hit, count(*) AS n
 FROM events GROUP BY user_id), m AS (SELECT user_id, 2 AS last FROM f WHERE user_id % 2 = 0),
r AS (SELECT f.user_id, f.model_id, concat('v', greatest(coalesce(last, 0) + hit::INT, 1)) AS model_version, n::VARCHAR AS report,
 TIMESTAMP '2024-02-01' AS updated_at FROM f LEFT JOIN m USING (user_id)),
o AS (SELECT user_id, model_id, 'v1' AS model_version, 'old' AS report, TIMESTAMP '2024-01-01' AS at FROM f WHERE user_id % 3 = 0)
SELECT user_id, model_id, model_version, coalesce(r.report, o.report) AS report, coalesce(o.at, r.updated_at) AS created_at,
 coalesce(r.updated_at, o.at) AS updated_at FROM r FULL JOIN o USING (user_id, model_id, model_version)""")
def publish_drift_report(spark, sf):
    def at(day):
        return F.lit(f"2024-{day} 00:00:00").cast("timestamp_ntz")

    found = table(spark, sf, "events").groupBy("user_id").agg(
        F.max("event_type").alias("model_id"), (F.max("value") > 250).alias("drift_detected"),
        F.count(F.lit(1)).cast("string").alias("report")).withColumns({"dataset_id": F.lit("d"), "dataset_version": F.lit("v1")})
    models = found.where("user_id % 2 = 0").select("user_id", "model_id", F.explode(F.array(F.lit("v1"), F.lit("v2"))).alias("version"))
    old = found.where("user_id % 3 = 0").select(
        "user_id", "dataset_id", "dataset_version", "model_id", F.lit("v1").alias("model_version"), F.lit("old").alias("report"),
        at("01-01").alias("created_at"), at("01-01").alias("updated_at"))
    reports, _ = drift.publish_drift_report(old, found, models, at("02-01"))
    return reports.select("user_id", "model_id", "model_version", "report", "created_at", "updated_at")
