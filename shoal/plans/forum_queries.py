"""Forum queries: suppliers as experts, nations as themes, customers as questions, orders as answers,
line items as votes, parts as documents."""

from pyspark.sql import functions as F

from shoal.operators import forum, graph
from shoal.plans.registry import query, table

EXPERTS_SQL = """(SELECT s_suppkey AS expert_id, s_name AS name, s_acctbal < 0 AS is_deleted,
 concat('area ', s_nationkey) AS area_of_expertise FROM supplier)"""
THEMES_SQL = """(SELECT n_nationkey AS theme_id, n_name AS name, n_regionkey * 30 AS expert_id,
 concat('category ', n_regionkey) AS problem_category FROM nation WHERE true)"""
QUESTIONS_SQL = """(SELECT c_custkey AS question_id, c_name AS title, c_mktsegment AS body, c_nationkey AS theme_id,
 c_custkey // 20 AS expert_id, TIMESTAMP '2024-01-01' + to_seconds((c_acctbal * 100)::BIGINT) AS created_at
 FROM customer)"""
ANSWERS_SQL = """(SELECT o_orderkey AS answer_id, o_orderpriority AS description, o_custkey AS question_id,
 o_custkey // 10 AS expert_id, CASE WHEN o_orderstatus = 'P' THEN o_orderkey // 2 WHEN o_orderstatus = 'O'
 THEN o_orderkey - 1 END AS parent_id, o_orderdate AS created_at FROM orders)"""
VOTES_SQL = """(SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
 strftime(l_shipdate, '%Y%m%d')) AS vote_id,
 l_suppkey AS expert_id, l_orderkey AS answer_id, CASE l_returnflag WHEN 'R' THEN -1 ELSE 1 END AS vote_value,
 l_shipdate AS created_at FROM lineitem)"""


def experts(spark, sf):
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("expert_id"), F.col("s_name").alias("name"),
        (F.col("s_acctbal") < 0).alias("is_deleted"),
        F.concat(F.lit("area "), "s_nationkey").alias("area_of_expertise"), F.col("s_acctbal").alias("date_joined"))


def themes(spark, sf):
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("theme_id"), F.col("n_name").alias("name"),
        (F.col("n_regionkey") * 30).cast("long").alias("expert_id"),
        F.concat(F.lit("category "), "n_regionkey").alias("problem_category"))


def questions(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("question_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("body"),
        F.col("c_nationkey").alias("theme_id"), F.floor(F.col("c_custkey") / 20).alias("expert_id"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, cast(round(c_acctbal * 100) as bigint))")
        .alias("created_at"), F.lit(0).cast("long").alias("views"))


def answers(spark, sf):
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    parent = F.when(status == "P", F.floor(key / 2)).when(status == "O", key - 1)
    return table(spark, sf, "orders").select(
        key.alias("answer_id"), F.col("o_orderpriority").alias("description"), F.col("o_custkey").alias("question_id"),
        F.floor(F.col("o_custkey") / 10).alias("expert_id"), parent.alias("parent_id"),
        F.col("o_orderdate").alias("created_at"))


def votes(spark, sf):
    ids = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    ids.append(F.date_format("l_shipdate", "yyyyMMdd"))
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", *ids).alias("vote_id"), F.col("l_suppkey").alias("expert_id"),
        F.col("l_orderkey").alias("answer_id"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("vote_value"),
        F.col("l_shipdate").alias("created_at"), F.col("l_shipdate").alias("updated_at"))


def triples(spark, sf, one_scan=False):
    return graph.to_triples({
        "theme": themes(spark, sf), "question": questions(spark, sf), "answer": answers(spark, sf),
        "vote": votes(spark, sf), "expert": experts(spark, sf)}, one_scan=one_scan)


def _part(kind, cls, key, source, fields):
    rows = [f"SELECT concat('forum:{kind}-', {key}) AS s, 'rdf:type' AS p, 'forum:{cls}' AS o FROM {source}"]
    for column, predicate, target in fields:
        value = f"concat('forum:{target}-', {column})" if target else f"{column}::VARCHAR"
        rows.append(f"SELECT concat('forum:{kind}-', {key}), '{predicate}', {value} FROM {source}")
    return " UNION ALL ".join(rows)


TRIPLES_SQL = "(" + " UNION ALL ".join([
    _part("theme", "Theme", "theme_id", THEMES_SQL, [
        ("name", "dc:title", None), ("expert_id", "forum:hasExpert", "expert"),
        ("problem_category", "forum:problemCategory", None)]),
    _part("question", "Question", "question_id", QUESTIONS_SQL, [
        ("title", "dc:title", None), ("body", "dc:description", None),
        ("theme_id", "forum:belongsToTheme", "theme"), ("expert_id", "forum:askedBy", "expert")]),
    _part("answer", "Answer", "answer_id", ANSWERS_SQL, [
        ("description", "dc:description", None), ("question_id", "forum:answersQuestion", "question"),
        ("expert_id", "forum:providedBy", "expert")]),
    _part("vote", "Vote", "vote_id", VOTES_SQL, [
        ("answer_id", "forum:votedOn", "answer"), ("vote_value", "forum:voteValue", None)]),
    _part("expert", "Expert", "expert_id", EXPERTS_SQL, [
        ("name", "foaf:name", None), ("area_of_expertise", "forum:areaOfExpertise", None)]),
]) + ")"


@query("list_entities", f"""(SELECT question_id AS id, created_at FROM {QUESTIONS_SQL} WHERE theme_id = 0
 ORDER BY created_at DESC, question_id LIMIT 30) UNION ALL (SELECT answer_id, created_at FROM {ANSWERS_SQL}
 WHERE expert_id = 7 ORDER BY created_at DESC, answer_id LIMIT 100 OFFSET 5)""")
def list_entities(spark, sf):
    asked = forum.list_entities(questions(spark, sf), "question_id", {"theme_id": 0, "expert_id": None}, limit=30)
    given = forum.list_entities(answers(spark, sf), "answer_id", {"expert_id": 7}, skip=5)
    return asked.selectExpr("question_id AS id", "created_at").unionByName(
        given.selectExpr("answer_id AS id", "created_at"))


@query("list_experts", f"""SELECT expert_id, s_acctbal AS date_joined FROM {EXPERTS_SQL} JOIN supplier
 ON s_suppkey = expert_id WHERE NOT is_deleted ORDER BY s_acctbal DESC, expert_id LIMIT 100""")
def list_experts(spark, sf):
    return forum.list_entities(experts(spark, sf), "expert_id", with_deleted=False).select("expert_id", "date_joined")


STATS_SQL = f"""(SELECT a.*, coalesce(v.total_votes, 0)::BIGINT AS total_votes, coalesce(v.upvotes, 0) AS upvotes,
 coalesce(v.downvotes, 0) AS downvotes FROM {ANSWERS_SQL} a LEFT JOIN (SELECT answer_id, sum(vote_value) AS total_votes,
 count(*) FILTER (vote_value > 0) AS upvotes, count(*) FILTER (vote_value < 0) AS downvotes FROM {VOTES_SQL}
 GROUP BY answer_id) v USING (answer_id))"""


@query("answer_vote_stats", f"SELECT answer_id, total_votes, upvotes, downvotes FROM {STATS_SQL}")
def answer_vote_stats(spark, sf):
    out = forum.answer_vote_stats(answers(spark, sf), votes(spark, sf))
    return out.select("answer_id", "total_votes", "upvotes", "downvotes")


@query("question_with_answers", f"""WITH s AS {STATS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id
 ORDER BY created_at DESC, answer_id) AS rank FROM s), n AS (SELECT question_id, count(*) AS answers_count,
 string_agg(concat(answer_id, ':', total_votes), ',' ORDER BY rank) FILTER (rank <= 100) AS answers FROM r
 GROUP BY question_id)
SELECT question_id, title, coalesce(answers_count, 0) AS answers_count, coalesce(answers, '') AS answers
 FROM {QUESTIONS_SQL} LEFT JOIN n USING (question_id)""")
def question_with_answers(spark, sf):
    out = forum.question_with_answers(questions(spark, sf), answers(spark, sf), votes(spark, sf))
    shown = F.transform("answers", lambda a: F.concat(a["answer_id"], F.lit(":"), a["total_votes"]))
    return out.select("question_id", "title", "answers_count",
                      F.coalesce(F.array_join(shown, ","), F.lit("")).alias("answers"))


@query("question_answer_rows", f"""SELECT q.question_id, q.title, coalesce(s.answer_id, -1) AS answer_id,
 coalesce(s.total_votes, 0) AS total_votes FROM {QUESTIONS_SQL} q LEFT JOIN {STATS_SQL} s USING (question_id)""")
def question_answer_rows(spark, sf):
    out = forum.question_answer_rows(questions(spark, sf), answers(spark, sf), votes(spark, sf))
    return out.select("question_id", "title", F.coalesce("answer_id", F.lit(-1)).alias("answer_id"),
                      F.coalesce("total_votes", F.lit(0)).alias("total_votes"))


@query("theme_with_questions", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY theme_id
 ORDER BY created_at DESC, question_id) AS rank FROM {QUESTIONS_SQL})
SELECT t.theme_id, name, count(question_id) AS questions_count, coalesce(string_agg(question_id::VARCHAR, ','
 ORDER BY rank) FILTER (rank <= 100), '') AS questions FROM {THEMES_SQL} t LEFT JOIN r USING (theme_id) GROUP BY ALL""")
def theme_with_questions(spark, sf):
    out = forum.theme_with_questions(themes(spark, sf).drop("expert_id"), questions(spark, sf))
    shown = F.array_join(F.transform("questions", lambda q: q["question_id"].cast("string")), ",")
    return out.select("theme_id", "name", "questions_count", F.coalesce(shown, F.lit("")).alias("questions"))


@query("theme_question_rows", f"""SELECT t.theme_id, name, coalesce(question_id, -1) AS question_id FROM {THEMES_SQL} t
 LEFT JOIN {QUESTIONS_SQL} q USING (theme_id)""")
def theme_question_rows(spark, sf):
    out = forum.theme_question_rows(themes(spark, sf).drop("expert_id"), questions(spark, sf))
    return out.select("theme_id", "name", F.coalesce("question_id", F.lit(-1)).alias("question_id"))


@query("expert_stats", f"""SELECT expert_id, (SELECT count(*) FROM {QUESTIONS_SQL} x WHERE x.expert_id = e.expert_id)
 AS questions_asked, (SELECT count(*) FROM {ANSWERS_SQL} x WHERE x.expert_id = e.expert_id) AS answers_provided,
 (SELECT count(*) FROM {THEMES_SQL} x WHERE x.expert_id = e.expert_id) AS themes_created,
 (SELECT coalesce(sum(total_votes), 0)::BIGINT FROM {STATS_SQL} x WHERE x.expert_id = e.expert_id)
 AS total_votes_received FROM {EXPERTS_SQL} e""")
def expert_stats(spark, sf):
    out = forum.expert_stats(experts(spark, sf), questions(spark, sf), answers(spark, sf), themes(spark, sf),
                             votes(spark, sf))
    return out.select("expert_id", "questions_asked", "answers_provided", "themes_created", "total_votes_received")


@query("overview_counts", f"""SELECT 'experts' AS metric, count(*) AS count FROM {EXPERTS_SQL} WHERE NOT is_deleted
 UNION ALL SELECT 'themes', count(*) FROM nation UNION ALL SELECT 'questions', count(*) FROM customer
 UNION ALL SELECT 'answers', count(*) FROM orders UNION ALL SELECT 'votes', count(*) FROM lineitem""")
def overview_counts(spark, sf):
    return forum.overview_counts(
        experts=experts(spark, sf), themes=themes(spark, sf), questions=questions(spark, sf),
        answers=answers(spark, sf), votes=votes(spark, sf))


@query("export_summary", f"""SELECT 'Total Themes' AS metric, count(*) AS count FROM nation UNION ALL
 SELECT 'Total Documents', count(*) FROM part UNION ALL SELECT 'Total Questions', count(*) FROM customer UNION ALL
 SELECT 'Total Answers', count(*) FROM orders UNION ALL SELECT 'Total Votes', count(*) FROM lineitem UNION ALL
 SELECT 'Upvotes', count(*) FILTER (vote_value = 1) FROM {VOTES_SQL} UNION ALL
 SELECT 'Downvotes', count(*) FILTER (vote_value = -1) FROM {VOTES_SQL} UNION ALL
 SELECT 'Total Experts', count(*) FROM {EXPERTS_SQL} UNION ALL
 SELECT 'Active Experts', count(*) FROM {EXPERTS_SQL} WHERE NOT is_deleted""")
def export_summary(spark, sf):
    return forum.export_summary(themes(spark, sf), table(spark, sf, "part"), questions(spark, sf), answers(spark, sf),
                                votes(spark, sf), experts(spark, sf))


# Votes so far: one per expert and answer, the earliest; all line items then arrive as votes.
OLD_VOTES_SQL = f"""(SELECT expert_id, answer_id, min(vote_id) AS vote_id, min(vote_value) AS vote_value,
 min(created_at) AS created_at FROM {VOTES_SQL} WHERE created_at < TIMESTAMP '1998-01-01' GROUP BY ALL)"""


@query("upsert_votes", f"""WITH valid AS (SELECT * FROM (SELECT * REPLACE (expert_id + 3 AS expert_id) FROM {VOTES_SQL})
 WHERE expert_id IN (SELECT s_suppkey FROM supplier) AND answer_id IN (SELECT o_orderkey FROM orders)),
 last AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY expert_id, answer_id
 ORDER BY created_at DESC, vote_id DESC) = 1)
SELECT expert_id, answer_id, coalesce(o.vote_id, n.vote_id) AS vote_id, coalesce(n.vote_value, o.vote_value)
 AS vote_value, coalesce(o.created_at, n.created_at) AS created_at FROM {OLD_VOTES_SQL} o FULL JOIN last n
 USING (expert_id, answer_id)""")
def upsert_votes(spark, sf):
    incoming = votes(spark, sf)
    old = incoming.where(F.col("created_at") < F.lit("1998-01-01").cast("timestamp_ntz")).groupBy(
        "expert_id", "answer_id").agg(*[F.min(c).alias(c) for c in ("vote_id", "vote_value", "created_at", "updated_at")])
    shifted = incoming.withColumn("expert_id", F.col("expert_id") + 3)
    out = forum.upsert_votes(old, shifted, experts(spark, sf), answers(spark, sf))
    return out.select("expert_id", "answer_id", "vote_id", "vote_value", "created_at")


@query("check_references", f"""SELECT 'question' AS entity, question_id::VARCHAR AS entity_id, 'theme_id' AS reference,
 theme_id::VARCHAR AS missing_id FROM {QUESTIONS_SQL} WHERE theme_id NOT IN (SELECT theme_id FROM {THEMES_SQL})
UNION ALL SELECT 'theme', theme_id::VARCHAR, 'expert_id', expert_id::VARCHAR FROM {THEMES_SQL}
 WHERE expert_id NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'answer', answer_id::VARCHAR, 'question_id', question_id::VARCHAR FROM {ANSWERS_SQL}
 WHERE question_id NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'answer', answer_id::VARCHAR, 'parent_id', parent_id::VARCHAR FROM {ANSWERS_SQL}
 WHERE parent_id NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'vote', vote_id, 'expert_id', expert_id::VARCHAR FROM {VOTES_SQL}
 WHERE expert_id NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'vote', vote_id, 'answer_id', answer_id::VARCHAR FROM {VOTES_SQL}
 WHERE answer_id NOT IN (SELECT o_orderkey FROM orders)""")
def check_references(spark, sf):
    return forum.check_references(themes(spark, sf), questions(spark, sf), answers(spark, sf), votes(spark, sf),
                                  experts(spark, sf))


@query("increment_views", """SELECT c_custkey AS question_id, count(user_id) AS views FROM customer
 LEFT JOIN (SELECT user_id FROM events WHERE event_type = 'view') ON user_id = c_custkey GROUP BY c_custkey""")
def increment_views(spark, sf):
    seen = table(spark, sf, "events").where("event_type = 'view'").select(F.col("user_id").alias("question_id"))
    return forum.increment_views(questions(spark, sf), seen, "question_id").select("question_id", "views")


@query("answer_threads", f"""WITH RECURSIVE a AS {ANSWERS_SQL}, t AS (SELECT answer_id, answer_id AS root_id, 0 AS depth
 FROM a WHERE parent_id IS NULL OR parent_id NOT IN (SELECT answer_id FROM a) OR parent_id = answer_id UNION ALL
 SELECT a.answer_id, t.root_id, t.depth + 1 FROM a JOIN t ON a.parent_id = t.answer_id AND a.parent_id <> a.answer_id)
SELECT answer_id, root_id, depth::BIGINT AS depth FROM t""")
def answer_threads(spark, sf):
    rows = answers(spark, sf).withColumn("parent_id", F.nullif("parent_id", "answer_id"))
    return forum.answer_threads(rows).select("answer_id", "root_id", "depth")


@query("to_triples", f"SELECT s, p, o FROM {TRIPLES_SQL} WHERE o IS NOT NULL")
def to_triples(spark, sf):
    return triples(spark, sf, one_scan=True)


@query("match_pattern", f"""SELECT concat('forum:vote-', vote_id) AS vote, concat('forum:question-', question_id)
 AS question, concat('forum:theme-', theme_id) AS theme FROM {VOTES_SQL} v JOIN {ANSWERS_SQL} a USING (answer_id)
 JOIN {QUESTIONS_SQL} q USING (question_id)
 WHERE q.expert_id = a.expert_id AND vote_value = -1""")
def match_pattern(spark, sf):
    out = graph.match_pattern(triples(spark, sf), [
        ("?vote", "forum:voteValue", "-1"), ("?answer", "forum:answersQuestion", "?question"),
        ("?vote", "forum:votedOn", "?answer"), ("?question", "forum:askedBy", "?expert"),
        ("?answer", "forum:providedBy", "?expert"), ("?question", "forum:belongsToTheme", "?theme"),
        ("?question", graph.TYPE, "forum:Question")])
    return out.select("vote", "question", "theme")


@query("kg_theme_categories", f"""SELECT concat('forum:theme-', theme_id) AS theme, name AS title,
 problem_category AS category FROM {THEMES_SQL}""")
def kg_theme_categories(spark, sf):
    return graph.kg_theme_categories(triples(spark, sf))


@query("kg_question_answers", f"""SELECT concat('forum:question-', question_id) AS question,
 concat('forum:answer-', answer_id) AS answer, title AS question_title, description AS answer_text
 FROM {QUESTIONS_SQL} JOIN {ANSWERS_SQL} USING (question_id)""")
def kg_question_answers(spark, sf):
    return graph.kg_question_answers(triples(spark, sf))


@query("kg_answers_per_expert", f"""SELECT concat('forum:expert-', e.expert_id) AS expert, name,
 area_of_expertise AS expertise, count(*) AS answer_count FROM {EXPERTS_SQL} e JOIN {ANSWERS_SQL} USING (expert_id)
 GROUP BY ALL""")
def kg_answers_per_expert(spark, sf):
    return graph.kg_answers_per_expert(triples(spark, sf))


@query("kg_avg_vote", f"""SELECT concat('forum:answer-', answer_id) AS answer, round(avg(vote_value), 9) + 0.0
 AS avg_vote, count(*) AS vote_count FROM {VOTES_SQL} GROUP BY answer_id""")
def kg_avg_vote(spark, sf):
    out = graph.kg_avg_vote(triples(spark, sf))
    return out.withColumn("avg_vote", F.round("avg_vote", 9) + 0.0)


@query("kg_questions_per_theme", f"""SELECT concat('forum:theme-', t.theme_id) AS theme, name AS title, count(*)
 AS question_count FROM {THEMES_SQL} t JOIN {QUESTIONS_SQL} USING (theme_id) GROUP BY ALL""")
def kg_questions_per_theme(spark, sf):
    return graph.kg_questions_per_theme(triples(spark, sf))


@query("graph_stats", f"""WITH t AS (SELECT * FROM {TRIPLES_SQL} WHERE o IS NOT NULL), k AS (SELECT s,
 count(DISTINCT o) AS types FROM t WHERE p = 'rdf:type' GROUP BY s)
SELECT (SELECT count(*) FROM t) AS triples, (SELECT count(DISTINCT s) FROM t) AS subjects,
 (SELECT count(DISTINCT p) FROM t) AS predicates, (SELECT count(*) FROM t WHERE p <> 'rdf:type' AND o LIKE 'forum:%')
 AS entity_links, (SELECT count(*) FROM k) AS entities, (SELECT count(*) FROM k WHERE types > 1) AS multi_typed""")
def graph_stats(spark, sf):
    return graph.graph_stats(triples(spark, sf, one_scan=True))


@query("entities_per_type", f"""SELECT o AS type, count(DISTINCT s) AS entities FROM {TRIPLES_SQL} WHERE p = 'rdf:type'
 GROUP BY o""")
def entities_per_type(spark, sf):
    return graph.entities_per_type(triples(spark, sf))
