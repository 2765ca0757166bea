"""Forum of themes, questions, answers, votes and experts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.operators.catalog import page
from shoal.session import materialize

def list_entities(
    table: DataFrame, key: str, filters: Mapping[str, object] | None = None, skip: int = 0, limit: int | None = 100,
    with_deleted: bool = True,
) -> DataFrame:
    """Equality filters, newest first, one page. A filter value of 0 counts; ``None`` is no filter."""
    for name, value in (filters or {}).items():
        if value is not None:
            table = table.where(F.col(name) == value)
    if not with_deleted:
        table = table.where(~F.col("is_deleted"))
    order = "date_joined" if "date_joined" in table.columns else "created_at"
    return page(table, [F.desc(order), F.asc(key)], skip, limit)


def _vote_totals(votes: DataFrame) -> DataFrame:
    value = F.col("vote_value")
    return votes.groupBy("answer_id").agg(
        F.sum(value).alias("total_votes"), F.count_if(value > 0).alias("upvotes"),
        F.count_if(value < 0).alias("downvotes"),
    )


def answer_vote_stats(answers: DataFrame, votes: DataFrame) -> DataFrame:
    """Answers with vote sum, upvotes and downvotes; zeros where nobody voted."""
    names = ("total_votes", "upvotes", "downvotes")
    joined = answers.join(_vote_totals(votes), "answer_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in names})


def _first_children(children: DataFrame, parent: str, key: str, size: int) -> DataFrame:
    """Up to ``size`` newest children per parent as an array; the rank limit works before the shuffle."""
    order = Window.partitionBy(parent).orderBy(F.desc("created_at"), F.asc(key))
    kept = children.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    fields = [c for c in children.columns if c != parent]
    return kept.groupBy(parent).agg(F.sort_array(F.collect_list(F.struct("rank", *fields))).alias("children"))


def _with_children(parents: DataFrame, children: DataFrame, parent: str, key: str, size: int, name: str) -> DataFrame:
    counts = children.groupBy(parent).agg(F.count(F.lit(1)).alias(f"{name}_count"))
    nested = _first_children(children, parent, key, size).withColumnRenamed("children", name)
    out = parents.join(counts, parent, "left").join(nested, parent, "left")
    return out.withColumn(f"{name}_count", F.coalesce(f"{name}_count", F.lit(0)))


def question_with_answers(questions: DataFrame, answers: DataFrame, votes: DataFrame, size: int = 100) -> DataFrame:
    """Questions with their newest answers (one page, with votes) and the exact number of answers."""
    return _with_children(questions, answer_vote_stats(answers, votes), "question_id", "answer_id", size, "answers")


def question_answer_rows(questions: DataFrame, answers: DataFrame, votes: DataFrame) -> DataFrame:
    """Every answer of every question as a row of its own, for questions with more than a page of them."""
    stats = answer_vote_stats(answers, votes).withColumnsRenamed(
        {"expert_id": "answer_expert_id", "created_at": "answered_at", "description": "answer"})
    return questions.join(stats, "question_id", "left")


def theme_with_questions(themes: DataFrame, questions: DataFrame, size: int = 100) -> DataFrame:
    """Themes with their newest questions (one page) and the exact number of questions."""
    return _with_children(themes, questions, "theme_id", "question_id", size, "questions")


def theme_question_rows(themes: DataFrame, questions: DataFrame) -> DataFrame:
    """Every question of every theme as a row of its own, for themes with more than a page of them."""
    asked = questions.withColumnsRenamed({"expert_id": "question_expert_id", "created_at": "asked_at",
                                          "description": "question_description"})
    return themes.join(asked, "theme_id", "left")


def expert_stats(
    experts: DataFrame, questions: DataFrame, answers: DataFrame, themes: DataFrame, votes: DataFrame
) -> DataFrame:
    """Questions, answers and themes of each expert, and the sum of votes on their answers."""

    def counted(table: DataFrame, name: str) -> DataFrame:
        return table.groupBy("expert_id").agg(F.count(F.lit(1)).alias(name))

    received = answers.select("answer_id", "expert_id").join(_vote_totals(votes), "answer_id")
    received = received.groupBy("expert_id").agg(F.sum("total_votes").alias("total_votes_received"))
    out = experts
    for part in (counted(questions, "questions_asked"), counted(answers, "answers_provided"),
                 counted(themes, "themes_created"), received):
        out = out.join(part, "expert_id", "left")
    names = ("questions_asked", "answers_provided", "themes_created", "total_votes_received")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in names})


def _counts(tables: Mapping[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    parts = [
        (df if test is None else df.where(test)).agg(F.count(F.lit(1)).alias("count"))
        .select(F.lit(name).alias("metric"), "count")
        for name, (df, test) in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def overview_counts(**tables: DataFrame) -> DataFrame:
    """Rows per table; experts without the deleted ones."""
    return _counts({n: (t, ~F.col("is_deleted") if n == "experts" else None) for n, t in tables.items()})


def export_summary(
    themes: DataFrame, documents: DataFrame, questions: DataFrame, answers: DataFrame, votes: DataFrame,
    experts: DataFrame,
) -> DataFrame:
    """The summary sheet: totals, active experts, up- and downvotes."""
    votes_once = votes.agg(
        F.count(F.lit(1)).alias("Total Votes"), F.count_if(F.col("vote_value") == 1).alias("Upvotes"),
        F.count_if(F.col("vote_value") == -1).alias("Downvotes"),
    )
    experts_once = experts.agg(
        F.count(F.lit(1)).alias("Total Experts"), F.count_if(~F.col("is_deleted")).alias("Active Experts"))
    totals = _counts({
        "Total Themes": (themes, None), "Total Documents": (documents, None),
        "Total Questions": (questions, None), "Total Answers": (answers, None),
    })
    for once in (votes_once, experts_once):
        cells = F.explode(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("count")) for c in once.columns
        ]))
        totals = totals.unionByName(once.select(cells.alias("x")).select("x.*"))
    return totals


def upsert_votes(votes: DataFrame, incoming: DataFrame, experts: DataFrame, answers: DataFrame) -> DataFrame:
    """One vote per expert and answer, the last value wins; both must exist. A changed vote keeps its
    id and both its times."""
    keys = ["expert_id", "answer_id"]
    valid = incoming.join(experts.select("expert_id"), "expert_id", "left_semi")
    valid = valid.join(answers.select("answer_id"), "answer_id", "left_semi")
    fields = ["vote_id", "vote_value", "created_at", "updated_at"]
    last = valid.groupBy(*keys).agg(
        F.max_by(F.struct(*fields), F.struct("created_at", "vote_id")).alias("new"))
    both = votes.select(*keys, F.struct(*fields).alias("old")).join(last, keys, "full_outer")
    value = F.coalesce(F.col("new.vote_value"), F.col("old.vote_value"))
    kept = [F.coalesce(F.col(f"old.{c}"), F.when(F.col("old").isNull(), F.col(f"new.{c}"))).alias(c)
            for c in fields if c != "vote_value"]
    return both.select(*keys, *kept, value.alias("vote_value")).select(*votes.columns)


def check_references(
    themes: DataFrame, questions: DataFrame, answers: DataFrame, votes: DataFrame, experts: DataFrame
) -> DataFrame:
    """References to rows that do not exist: (entity, entity_id, reference, missing_id).

    A task holds the ids of its share of the parents and lets the children pass by unsorted, however many refer to one
    id. Themes are a short list, which Spark may broadcast.
    """

    def dangling(child: DataFrame, entity: str, key: str, field: str, parent: DataFrame, parent_key: str) -> DataFrame:
        ids = parent.select(F.col(parent_key).alias("missing_id"))
        if parent is not themes:
            ids = ids.hint("shuffle_hash")
        wanted = child.where(F.col(field).isNotNull()).select(
            F.lit(entity).alias("entity"), F.col(key).cast("string").alias("entity_id"),
            F.lit(field).alias("reference"), F.col(field).alias("missing_id"))
        return wanted.join(ids, "missing_id", "left_anti").withColumn("missing_id", F.col("missing_id").cast("string"))

    rows = [
        dangling(questions, "question", "question_id", "theme_id", themes, "theme_id"),
        dangling(themes, "theme", "theme_id", "expert_id", experts, "expert_id"),
        dangling(answers, "answer", "answer_id", "question_id", questions, "question_id"),
        dangling(answers, "answer", "answer_id", "parent_id", answers, "answer_id"),
        dangling(votes, "vote", "vote_id", "expert_id", experts, "expert_id"),
        dangling(votes, "vote", "vote_id", "answer_id", answers, "answer_id"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("entity", "entity_id", "reference", "missing_id")


def increment_views(entities: DataFrame, views: DataFrame, key: str) -> DataFrame:
    """One more view per view event."""
    seen = views.groupBy(key).agg(F.count(F.lit(1)).alias("__seen"))
    out = entities.join(seen, key, "left")
    return out.withColumn("views", F.col("views") + F.coalesce("__seen", F.lit(0))).select(*entities.columns)


def answer_threads(answers: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Adds ``root_id`` and ``depth`` of each answer in its reply thread.

    Each round doubles the distance a row looks up, so a chain of depth d takes log2(d) equi-joins.
    A reply to an answer that does not exist is a root.
    """
    ids = answers.select(F.col("answer_id").alias("parent_id"), F.lit(True).alias("found"))
    nodes = answers.select("answer_id", "parent_id").join(ids, "parent_id", "left")
    nodes = materialize(nodes.select(
        "answer_id", F.when(F.col("found"), F.col("parent_id")).alias("up"),
        F.when(F.col("found"), 1).otherwise(0).cast("long").alias("depth"),
        F.when(F.col("found"), F.col("parent_id")).otherwise(F.col("answer_id")).alias("root_id"),
    ), "threads")
    for _ in range(max_rounds):
        if nodes.where("up is not null").isEmpty():
            return answers.join(nodes.select("answer_id", "root_id", "depth"), "answer_id")
        above = nodes.select(
            F.col("answer_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"),
            F.col("root_id").alias("root2"))
        moving = nodes.where("up is not null").join(above, "up").select(
            "answer_id", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"),
            F.col("root2").alias("root_id"))
        nodes = materialize(nodes.where("up is null").unionByName(moving), "threads")
    raise ValueError("reply chains form a cycle")
