"""Readers and writers. The files are first written by Spark from the standard tables, then read back."""

from pyspark.sql import functions as F

from shoal.operators.split import random_split_exact
from shoal.plans import forum_queries as forum
from shoal.plans.registry import query, table
from shoal.plans.split_queries import RANDOM_SQL
from shoal.session import fresh_path, materialize
from shoal.sources import events as event_source
from shoal.sources import files, forum_tables, versions


@query("read_csv_robust", "SELECT doc_id, lang, n_chars, text FROM documents")
def read_csv_robust(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "text")
    root = fresh_path(spark, "csv")
    options = dict(header=True, escape='"', quoteAll=True)
    docs.where("lang <> 'fr'").write.csv(root + "/new", **options)
    docs.where("lang = 'fr'").select("text", "n_chars", "lang", "doc_id").write.csv(  # columns in another order
        root + "/old", encoding="ISO-8859-1", **options)
    # a file of lines with one field too many
    broken = table(spark, sf, "nation").agg(F.concat_ws("\n", F.lit("doc_id,lang,n_chars,text"), F.collect_list(
        F.concat_ws(",", F.lit("1"), "n_name", F.lit("2"), F.lit("x"), F.lit("y")))))
    broken.write.text(root + "/broken")
    return files.read_csv_robust(spark, [root + "/new", root + "/old", root + "/broken"])


@query("read_zipped_csv", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal FROM customer")
def read_zipped_csv(spark, sf):
    """One archive per nation, written as a file by the task that holds its customers."""
    root = fresh_path(spark, "archives")

    def pack(rows):
        import io
        import zipfile

        import pandas as pd

        blob, name = io.BytesIO(), f"{rows['c_nationkey'].iloc[0]}.zip"
        with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("__MACOSX/data.csv", "nothing")
            archive.writestr("readme.txt", "nothing")
            archive.writestr("Data.CSV", rows.to_csv(index=False) + "1,2,3,4,5\n")
        system, folder = files.file_system(root)
        system.create_dir(folder)
        with system.open_output_stream(f"{folder}/{name}") as out:
            out.write(blob.getvalue())
        return pd.DataFrame({"path": [name]})

    customers = table(spark, sf, "customer").drop("c_mktsegment")
    customers.groupBy("c_nationkey").applyInPandas(pack, "path string").write.format("noop").mode("overwrite").save()
    return files.read_zipped_csv(spark, root)


@query("read_tsv", "SELECT doc_id, text, CASE WHEN lang <> 'fr' THEN n_chars ELSE -1 END AS n_chars FROM documents")
def read_tsv(spark, sf):
    root = fresh_path(spark, "tsv")
    docs, options = table(spark, sf, "documents"), dict(sep="\t", header=True, escape='"', quoteAll=True)
    docs.where("lang <> 'fr'").select("doc_id", "text", "n_chars").write.csv(root + "/new", **options)
    docs.where("lang = 'fr'").select("text", "doc_id").write.csv(root + "/old", **options)  # fewer columns, another order
    out = files.read_tsv(spark, [root + "/new", root + "/old"])
    return out.withColumn("n_chars", F.coalesce("n_chars", F.lit(-1).cast("long")))


@query("read_headerless", """SELECT l_orderkey AS f1, l_quantity AS f2, CASE WHEN l_discount > 0 THEN l_discount END
 AS f3, l_returnflag AS target FROM lineitem""")
def read_headerless(spark, sf):
    path = fresh_path(spark, "headerless")
    discount = F.when(F.col("l_discount") > 0, F.col("l_discount").cast("string")).otherwise("?")
    table(spark, sf, "lineitem").select(F.concat_ws(
        "  ", F.lit(""), F.col("l_orderkey").cast("string"), F.col("l_quantity").cast("string"), discount,
        "l_returnflag")).write.text(path)
    return files.read_headerless(spark, path)


@query("read_attribute_names", """SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS position, n_name AS name
 FROM nation UNION ALL SELECT (SELECT count(*) FROM nation)::INT, 'income'""")
def read_attribute_names(spark, sf):
    path = fresh_path(spark, "names")
    line = F.concat("n_name", F.lit(": a, b."))
    lines = table(spark, sf, "nation").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", line.alias("l")))),
                                                       lambda s: s["l"]).alias("l"))
    lines.select(F.concat_ws("\n", F.lit("| comment: no"), F.lit("two words: no"), "l", F.col("l")[0])).write.text(path)
    return files.read_attribute_names(spark, path, label="income")


@query("file_inventory", """SELECT concat('n_regionkey=', n_regionkey) AS folder, 'txt' AS file_type,
 (sum(length(n_name) + 1))::BIGINT AS file_size, md5(concat(string_agg(n_name, chr(10) ORDER BY n_nationkey), chr(10)))
 AS file_hash FROM nation GROUP BY n_regionkey""")
def file_inventory(spark, sf):
    path = fresh_path(spark, "files")
    nation = table(spark, sf, "nation")
    nation.repartition(1).sortWithinPartitions("n_regionkey", "n_nationkey").select("n_regionkey", "n_name") \
        .write.partitionBy("n_regionkey").text(path)
    found = files.file_inventory(spark, path)
    return found.select(F.split_part("relative_path", F.lit("/"), F.lit(1)).alias("folder"), "file_type", "file_size",
                        "file_hash")


@query("read_split", f"""SELECT o_orderkey, split FROM (SELECT o_orderkey, {RANDOM_SQL} AS split FROM (SELECT o_orderkey,
 row_number() OVER (ORDER BY md5(concat('42|', o_orderkey))) AS r, count(*) OVER () AS n FROM orders))
 WHERE split = 'test'""")
def read_split(spark, sf):
    placed = random_split_exact(table(spark, sf, "orders"), ["o_orderkey"])
    root = fresh_path(spark, "versions")
    versions.write_version(placed, root, "u1", "orders", "v2")
    return versions.read_split(spark, root, "u1", "orders", "v2", "test").select("o_orderkey", "split")


@query("write_version", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")
def write_version(spark, sf):
    root = fresh_path(spark, "versions")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    versions.write_version(lines, root, "u1", "lines", "v1")
    return versions.read_split(spark, root, "u1", "lines", "v1", "drift")


@query("read_events", """SELECT event_id, CASE WHEN event_type = 'error' THEN -1 ELSE user_id END AS user_id,
 event_type = 'error' AS quarantined FROM events""")
def read_events(spark, sf):
    events = table(spark, sf, "events")
    messages = event_source.to_messages(events.select("event_id", "user_id", "event_type"), "event_id")
    cut = F.expr("substring(value, 1, length(value) - 3)")
    messages = messages.withColumn("value", F.when(F.col("value").contains('"error"'), cut).otherwise(F.col("value")))
    out = event_source.read_events(messages, "event_id long, user_id long, event_type string")
    return out.select(F.col("key").cast("long").alias("event_id"),
                      F.coalesce("event.user_id", F.lit(-1)).alias("user_id"),
                      F.col("quarantine").isNotNull().alias("quarantined"))


@query("export_table", f"""SELECT vote_id AS "Vote ID", expert_id::VARCHAR AS "Expert ID", answer_id::VARCHAR
 AS "Answer ID", vote_value::VARCHAR AS "Vote Value", CASE vote_value WHEN 1 THEN 'Upvote' ELSE 'Downvote' END
 AS "Vote Type", strftime(created_at, '%Y-%m-%d %H:%M:%S') AS "Created At", '' AS "Updated At"
 FROM {forum.VOTES_SQL}""")
def export_table(spark, sf):
    votes = forum.votes(spark, sf).withColumn("updated_at", F.lit(None).cast("timestamp"))
    return forum_tables.export_table(votes.withColumn("_id", F.monotonically_increasing_id()), "Votes")


@query("import_table", """SELECT CASE WHEN c_nationkey = 3 THEN NULL ELSE c_custkey END::DOUBLE AS expert_id,
 c_mktsegment = 'MACHINERY' AS is_deleted, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS bio,
 CASE WHEN c_nationkey = 3 THEN concat('expert_id=no ', c_custkey) ELSE '' END AS rejects FROM customer""")
def import_table(spark, sf):
    sheet = table(spark, sf, "customer").select(
        F.when(F.col("c_nationkey") == 3, F.concat(F.lit("no "), "c_custkey")).otherwise(
            F.concat(F.lit(" "), F.col("c_custkey").cast("double").cast("string"))).alias("Expert ID"),
        F.when(F.col("c_mktsegment") == "MACHINERY", " Yes").otherwise("off").alias("Is Deleted"),
        F.when(F.col("c_acctbal") < 0, "  ").otherwise(F.col("c_name")).alias("Biography"),
        F.lit("x").alias("Unknown"))
    out = forum_tables.import_table(sheet, "Experts")
    return out.select(F.col("expert_id").cast("double").alias("expert_id"), "is_deleted", "bio",
                      F.array_join("rejects", ";").alias("rejects"))


BULK = "concat('2024-0', c_nationkey % 9 + 1, '-05T10:00:00Z')"


@query("import_json_bulk", """SELECT c_custkey AS theme_id, c_name AS name, 0::BIGINT AS views,
 CASE WHEN c_mktsegment = 'MACHINERY' THEN 'PRIVACY' ELSE 'OTHER' END AS problem_category,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 'NLP' ELSE 'Other' END AS model_category,
 CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2020-01-01' ELSE make_timestamp(2024, c_nationkey % 9 + 1, 5, 10, 0, 0) END
 AS created_at, c_nationkey::BIGINT AS expert_id FROM customer""")
def import_json_bulk(spark, sf):
    from datetime import datetime

    c = table(spark, sf, "customer")
    theme = F.struct(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("expert_id"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "PRIVACY").otherwise("privacy?").alias("problem_category"),
        F.when(F.col("c_mktsegment") == "BUILDING", "NLP").alias("model_category"),
        F.when(F.col("c_acctbal") < 0, "soon").otherwise(F.expr(BULK)).alias("created_at"))
    texts = c.select(F.to_json(F.struct(F.array(theme).alias("Theme"))).alias("value"))
    themes = forum_tables.import_json_bulk(texts, as_of=datetime(2020, 1, 1))["Theme"]
    return themes.select("theme_id", "name", "views", "problem_category", "model_category",
                         F.col("created_at").cast("timestamp_ntz").alias("created_at"), "expert_id")


#: The whole forum: source table and columns of each sheet, in expressions that Spark and DuckDB both read.
WHOLE = {
    "Themes": ("nation", {
        "theme_id": "n_nationkey", "name": "n_name", "description": "concat('on \"', n_name, '\", at length')", "views": "n_regionkey * 7",
        "expert_id": "n_regionkey * 30", "problem_category": "CASE WHEN n_regionkey = 1 THEN 'PRIVACY' ELSE 'OTHER' END",
        "model_category": "CASE WHEN n_regionkey > 2 THEN 'NLP' ELSE 'Other' END", "domain_category": "'Health'",
        "created_at": "TIMESTAMP '2024-03-01 10:00:00'"}),
    "Documents": ("part", {
        "document_id": "p_partkey", "title": "p_name", "description": "CASE WHEN p_size > 25 THEN p_type END", "file_path": "concat('/', p_brand)",
        "file_size": "p_size * 1000", "content_type": "p_type", "expert_id": "p_partkey % 100", "theme_id": "p_size % 25",
        "created_at": "TIMESTAMP '2024-03-02 11:30:00'"}),
    "Questions": ("customer", {
        "question_id": "c_custkey", "title": "c_name", "body": "concat(c_mktsegment, '?')", "created_at": "TIMESTAMP '2024-03-03 00:00:01'",
        "views": "c_nationkey * 3", "expert_id": "c_custkey % 100", "theme_id": "c_nationkey"}),
    "Answers": ("orders", {
        "answer_id": "o_orderkey", "description": "o_orderpriority", "created_at": "o_orderdate", "question_id": "o_custkey",
        "expert_id": "o_custkey % 90", "parent_id": "CASE WHEN o_orderstatus = 'O' THEN o_orderkey - 1 END"}),
    "Votes": ("lineitem", {
        "vote_id": "l_orderkey * 100 + l_linenumber", "expert_id": "l_suppkey", "answer_id": "l_orderkey",
        "vote_value": "CASE l_returnflag WHEN 'R' THEN -1 ELSE 1 END", "created_at": "l_shipdate",
        "updated_at": "CASE WHEN l_linenumber > 3 THEN l_shipdate END"}),
    "Experts": ("supplier", {
        "expert_id": "s_suppkey", "user_id": "s_suppkey + 7", "is_deleted": "s_acctbal < 0",
        "area_of_expertise": "CASE WHEN s_nationkey < 5 THEN 'Policy' ELSE 'Other' END", "bio": "concat(s_name, chr(10), 'lives on')",
        "date_joined": "TIMESTAMP '2023-05-06 07:08:09'", "profile_picture": "CAST(NULL AS VARCHAR(9))"}),
}
ENTITY_OF = {"Themes": "Theme", "Documents": "Document", "Questions": "Question", "Answers": "Answer", "Votes": "Vote",
             "Experts": "Expert"}


def whole_forum(spark, sf):
    return {sheet: table(spark, sf, source).select(*[F.expr(e).alias(c) for c, e in columns.items()])
            for sheet, (source, columns) in WHOLE.items()}


def _whole_sql(vote_type=False):
    parts = []
    for sheet, (source, columns) in WHOLE.items():
        cells = []
        for c, e in columns.items():
            shown = f"strftime({e}, '%Y-%m-%d %H:%M:%S')" if c in forum_tables.TIMES else f"({e})::VARCHAR"
            cells.append(f"coalesce({shown}, '')")
            if c == "vote_value" and vote_type:
                cells.append(f"CASE {e} WHEN 1 THEN 'Upvote' ELSE 'Downvote' END")
        parts.append(f"SELECT '{sheet}' AS sheet, concat_ws('|', {', '.join(cells)}) AS cells FROM {source}")
    return " UNION ALL ".join(parts)


def _cells(sheet, df):
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss") if t.startswith("timestamp") else F.col(f"`{c}`").cast("string")
             for c, t in df.dtypes]
    return df.select(F.lit(sheet).alias("sheet"), F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in shown]).alias("cells"))


def _union(frames):
    out = None
    for one in frames:
        out = one if out is None else out.unionByName(one)
    return out


@query("export_sheets", _whole_sql(vote_type=True))
def export_sheets(spark, sf):
    """All six sheets in their display form."""
    return _union(_cells(s, forum_tables.export_table(df, s)) for s, df in whole_forum(spark, sf).items())


@query("import_sheets", _whole_sql())
def import_sheets(spark, sf):
    """All six tables written as sheets and read back."""
    path = fresh_path(spark, "sheets")
    forum_tables.write_sheets(whole_forum(spark, sf), path)
    back = forum_tables.read_sheets(spark, path)
    return _union(_cells(s, df.where("size(rejects) = 0").drop("rejects")) for s, df in back.items())


@query("import_entities", _whole_sql())
def import_entities(spark, sf):
    """All six entities from one table of JSON objects, one object per row of the forum."""
    texts = []
    for sheet, df in whole_forum(spark, sf).items():
        key = df.columns[0]
        fields = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c) if c in forum_tables.TIMES else
                  F.col(c).alias("id" if c == key else c) for c in df.columns]
        texts.append(df.select(F.to_json(F.struct(F.array(F.struct(*fields)).alias(ENTITY_OF[sheet]))).alias("value")))
    made = forum_tables.import_json_bulk(materialize(_union(texts), "bulk"), as_of=None)
    out = []
    for sheet, df in whole_forum(spark, sf).items():
        rows = made[ENTITY_OF[sheet]].select(*df.columns)
        if sheet == "Votes":  # a vote that was not changed has the time of the import
            rows = rows.withColumn("updated_at", F.when(F.col("vote_id") % 100 > 3, F.col("updated_at")))
        out.append(_cells(sheet, rows))
    return _union(out)
