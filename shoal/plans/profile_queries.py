"""Profile queries over lineitem, orders, events, documents and part."""

from pyspark.sql import functions as F

from shoal.functions.columns import json_clean
from shoal.operators import profile, sketches
from shoal.plans.registry import query, table
from shoal.session import materialize

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(columns, template, sep=" UNION ALL "):
    return sep.join(template.format(c=c) for c in columns)


def _rounded(df, names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def sparse_lines(spark, sf):
    """lineitem with nulls: line number 3 and zero tax are taken as unknown."""
    return table(spark, sf, "lineitem").select(
        F.expr("cast(nullif(l_linenumber, 3) as double)").alias("l_linenumber"),
        "l_quantity", "l_discount", F.expr("nullif(l_tax, 0.0)").alias("l_tax"), "l_returnflag",
        F.expr("nullif(l_linestatus, 'O')").alias("l_linestatus"),
    )


SPARSE_SQL = """(SELECT nullif(l_linenumber, 3)::DOUBLE AS l_linenumber, l_quantity, l_discount, nullif(l_tax, 0.0) AS l_tax,
 l_returnflag, nullif(l_linestatus, 'O') AS l_linestatus FROM lineitem)"""
SPARSE_COLUMNS = ["l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
SPARSE_NUMBERS = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]


@query("profile_numeric", _union(LINE_NUMBERS, """
SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
 min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
 round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max, round(skewness({c}), 5) AS skew,
 round(kurtosis({c}), 5) AS kurtosis, count(*) - count({c}) AS missing FROM lineitem"""))
def profile_numeric(spark, sf):
    lines = table(spark, sf, "lineitem").select(*LINE_NUMBERS)
    stats = profile.column_moments(lines, LINE_NUMBERS)
    quart = profile.exact_quantiles(lines, LINE_NUMBERS, [0.25, 0.5, 0.75])
    rows = [
        (c, s["count"], s["mean"], s["std"], s["min"], *quart[c], s["max"], s["skew"], s["kurtosis"],
         s["rows"] - s["count"])
        for c, s in stats.items()
    ]
    out = spark.createDataFrame(
        rows, "column_name string, count long, mean double, std double, min double, p25 double, p50 double, "
        "p75 double, max double, skew double, kurtosis double, missing long",
    )
    return _rounded(_rounded(out, ["mean", "std", "p25", "p50", "p75"]), ["skew", "kurtosis"], 5)


@query("profile_shape", """SELECT count(*) AS row_count, 6 AS column_count,
 'l_linenumber,l_quantity,l_discount,l_tax,l_returnflag,l_linestatus' AS columns,
 'double,double,double,double,string,string' AS dtypes FROM lineitem""")
def profile_shape(spark, sf):
    shape = profile.profile_shape(sparse_lines(spark, sf))
    return shape.withColumns({c: F.array_join(c, ",") for c in ("columns", "dtypes")})


@query("schema_profile", """SELECT * FROM (VALUES (0, 'event_id', 'bigint'), (1, 'user_id', 'bigint'),
 (2, 'event_type', 'string'), (3, 'value', 'double')) t(position, column_name, data_type),
 (SELECT count(*) AS row_count FROM events)""")
def schema_profile(spark, sf):
    return profile.schema_profile(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"))


@query("describe_numeric", _union(SPARSE_NUMBERS, """
SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
 min({c})::DOUBLE AS min, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS p25,
 round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50,
 round(quantile_cont({c}::DOUBLE, 0.75), 6) AS p75, max({c})::DOUBLE AS max FROM """ + SPARSE_SQL))
def describe_numeric(spark, sf):
    out = profile.describe_numeric(sparse_lines(spark, sf))
    return _rounded(out, ["mean", "std", "p25", "p50", "p75"])


@query("missing_values", "SELECT * FROM (" + _union(SPARSE_COLUMNS, """
SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count,
 round((count(*) - count({c}))::DOUBLE / count(*), 9) AS missing_fraction FROM """ + SPARSE_SQL)
       + ") WHERE missing_count > 0")
def missing_values(spark, sf):
    return _rounded(profile.missing_values(sparse_lines(spark, sf)), ["missing_fraction"], 9)


@query("unique_values", _union(SPARSE_COLUMNS, """
SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count FROM """ + SPARSE_SQL))
def unique_values(spark, sf):
    return profile.unique_values(sparse_lines(spark, sf))


@query("sketched_profile", _union(SPARSE_COLUMNS, """
SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS missing_count,
 true AS within_bounds FROM """ + SPARSE_SQL))
def sketched_profile(spark, sf):
    """Sketches kept per return flag and merged: whether their figures are as close to the exact ones as stated."""
    lines = sparse_lines(spark, sf).withColumn("part", F.col("l_returnflag"))
    kept = materialize(sketches.version_sketches(lines, by=["part"]), "sketches")
    about = sketches.sketched_profile(sketches.merge_sketches(kept), [0.5])
    middle = {r["column_name"]: r["quantiles"][0] for r in about.collect() if r["quantiles"]}  # a row per column
    ranks = lines.agg(*[F.count(c).alias(f"{c}_n") for c in middle], *[
        F.count_if(F.col(c) < v).alias(f"{c}_below") for c, v in middle.items()], *[
        F.count_if(F.col(c) <= v).alias(f"{c}_upto") for c, v in middle.items()]).first()
    close = [(c, ranks[f"{c}_below"] <= 0.52 * ranks[f"{c}_n"] and ranks[f"{c}_upto"] >= 0.48 * ranks[f"{c}_n"])
             for c in middle]
    exact = profile.unique_values(lines.drop("part")).withColumnRenamed("distinct_count", "exact")
    medians = spark.createDataFrame(close, "column_name string, close boolean")  # text columns have none
    distinct_close = F.abs(F.col("distinct_count") - F.col("exact")) <= 0.04 * F.col("exact")
    return about.join(exact, "column_name").join(medians, "column_name", "left").select(
        "column_name", "row_count", "missing_count",
        (distinct_close & F.coalesce("close", F.lit(True))).alias("within_bounds"))


DUPLICATES_SQL = """SELECT l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, count(*) AS copies
 FROM """ + SPARSE_SQL + """ GROUP BY ALL HAVING count(*) > 1"""


@query("duplicate_rows", f"SELECT coalesce(sum(copies - 1), 0)::BIGINT AS duplicate_rows FROM ({DUPLICATES_SQL})")
def duplicate_rows(spark, sf):
    return profile.duplicate_rows(sparse_lines(spark, sf))


@query("duplicate_sample", DUPLICATES_SQL + " ORDER BY " + ", ".join(
    f"{c} ASC NULLS FIRST" for c in SPARSE_COLUMNS) + " LIMIT 5")
def duplicate_sample(spark, sf):
    return profile.duplicate_sample(sparse_lines(spark, sf))


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 3) + 0.0 AS correlation FROM {SPARSE_SQL}"
    for a in SPARSE_NUMBERS for b in SPARSE_NUMBERS))
def correlation_matrix(spark, sf):
    out = profile.correlation_matrix(sparse_lines(spark, sf))
    return out.withColumn("correlation", F.col("correlation") + 0.0)


@query("distribution_stats", _union(["value", "doubled"], """
SELECT '{c}' AS column_name, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median,
 round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max, round(skewness({c}), 5) AS skew,
 round(kurtosis({c}), 5) AS kurtosis FROM (SELECT value, value * value AS doubled FROM events)"""))
def distribution_stats(spark, sf):
    events = table(spark, sf, "events").select("value", (F.col("value") * F.col("value")).alias("doubled"))
    out = profile.distribution_stats(events)
    return _rounded(_rounded(out, ["mean", "median", "std"]), ["skew", "kurtosis"], 5)


@query("outliers_iqr", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT 'value' AS column_name, count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))
 AS outlier_count, round(100.0 * count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))
 / count(*), 9) AS outlier_percent FROM events, q""")
def outliers_iqr(spark, sf):
    return _rounded(profile.outliers_iqr(table(spark, sf, "events"), ["value"]), ["outlier_percent"], 9)


@query("top_values", """WITH v AS (
 SELECT 'p_brand' AS column_name, p_brand AS value FROM part UNION ALL SELECT 'p_type', nullif(p_type, 'ECONOMY')
 FROM part), c AS (SELECT column_name, value, count(*) AS n FROM v GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value ASC NULLS LAST)::INT
 AS rank FROM c) WHERE rank <= 5""")
def top_values(spark, sf):
    part = table(spark, sf, "part").select("p_brand", F.expr("nullif(p_type, 'ECONOMY')").alias("p_type"))
    return profile.top_values(part)


@query("needs_mitigation", f"""SELECT
 (SELECT count(*) > 0 FROM {SPARSE_SQL} WHERE l_linenumber IS NULL OR l_tax IS NULL OR l_linestatus IS NULL)
  AS has_missing,
 (SELECT count(*) > 0 FROM ({DUPLICATES_SQL})) AS has_duplicates,
 (SELECT greatest(abs(skewness(l_linenumber)), abs(skewness(l_quantity)), abs(skewness(l_discount)),
  abs(skewness(l_tax))) > 0.75 FROM {SPARSE_SQL}) AS has_skew,
 ((SELECT count(*) > 0 FROM {SPARSE_SQL} WHERE l_linenumber IS NULL OR l_tax IS NULL OR l_linestatus IS NULL)
 OR (SELECT count(*) > 0 FROM ({DUPLICATES_SQL}))) AS needs_mitigation""")
def needs_mitigation(spark, sf):
    return profile.needs_mitigation(sparse_lines(spark, sf), tags=["tabular"])


@query("json_clean", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 CASE WHEN l_discount > 0 THEN l_tax / l_discount END AS ratio,
 CASE WHEN l_tax > 0 AND l_discount > 0 THEN ln(l_tax) END AS first_log FROM lineitem""")
def json_clean_query(spark, sf):
    # division by zero gives an infinity (or NaN for 0/0) in floating point; made here without ANSI errors
    lines = table(spark, sf, "lineitem")
    ratio = F.when(F.col("l_discount") > 0, F.col("l_tax") / F.col("l_discount")).when(
        F.col("l_tax") > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    logs = F.array(F.when((F.col("l_tax") > 0) & (F.col("l_discount") > 0), F.log("l_tax"))
                   .otherwise(F.lit(float("-inf"))))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    clean = json_clean(lines.select(*keys, ratio.alias("ratio"), logs.alias("logs")))
    return clean.select(*keys, "ratio", F.col("logs")[0].alias("first_log"))


@query("profile_report")
def profile_report(spark, sf):
    return profile.profile_report(sparse_lines(spark, sf), target="l_returnflag")
