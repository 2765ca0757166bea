"""The forum as triples (s, p, o), conjunctive patterns over them, and the documented analyses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPE = "rdf:type"

# Per entity the class, the key, and (column, predicate, kind of object) in order.
# A kind names the entity the object refers to; None means a literal.
VOCABULARY: dict[str, tuple[str, str, list[tuple[str, str, str | None]]]] = {
    "theme": ("Theme", "theme_id", [
        ("name", "dc:title", None), ("description", "dc:description", None),
        ("expert_id", "hasExpert", "expert"), ("problem_category", "problemCategory", None)]),
    "question": ("Question", "question_id", [
        ("title", "dc:title", None), ("body", "dc:description", None),
        ("theme_id", "belongsToTheme", "theme"), ("expert_id", "askedBy", "expert")]),
    "answer": ("Answer", "answer_id", [
        ("description", "dc:description", None), ("question_id", "answersQuestion", "question"),
        ("expert_id", "providedBy", "expert")]),
    "vote": ("Vote", "vote_id", [("answer_id", "votedOn", "answer"), ("vote_value", "voteValue", None)]),
    "expert": ("Expert", "expert_id", [("name", "foaf:name", None), ("area_of_expertise", "areaOfExpertise", None)]),
}


def node(kind: str, key: Column, namespace: str = "forum") -> Column:
    return F.concat(F.lit(f"{namespace}:{kind}-"), key.cast("string"))


def to_triples(tables: Mapping[str, DataFrame], namespace: str = "forum", one_scan: bool = False) -> DataFrame:
    """Triples of each entity table; null values give no triple. No shuffle.

    By default each predicate is a branch of its own with a constant ``p``: a filter on ``p`` then removes
    the other branches while planning, and a pattern reads only the columns it names. ``one_scan`` emits
    all triples of a row together, for writing the whole graph out.
    """
    branches = []
    for kind, df in tables.items():
        cls, key, fields = VOCABULARY[kind]
        cells = [(TYPE, F.lit(f"{namespace}:{cls}"))]
        for column, name, target in fields:
            if column in df.columns:
                value = node(target, F.col(column), namespace) if target else F.col(column).cast("string")
                cells.append((name if ":" in name else f"{namespace}:{name}", value))
        subject = node(kind, F.col(key), namespace).alias("s")
        if one_scan:
            pairs = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in cells])
            branches.append(df.select(subject, F.explode(pairs).alias("x")).select("s", "x.p", "x.o"))
        else:
            branches += [df.select(subject, F.lit(p).alias("p"), o.alias("o")) for p, o in cells]
    return reduce(DataFrame.unionByName, branches).where("o is not null")


def match_pattern(triples: DataFrame, patterns: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rows of variable bindings for patterns of constants and ``?variables``.

    Each pattern is a filtered slice; slices are joined on the variables they share. Patterns are taken in
    an order in which each one shares a variable with those before it.
    """

    def names(pattern):
        return [t[1:] for t in pattern if t.startswith("?")]

    def bindings(pattern) -> DataFrame:
        rows, seen = triples, {}
        for place, term in zip("spo", pattern):
            if not term.startswith("?"):
                rows = rows.where(F.col(place) == term)
            elif term[1:] in seen:
                rows = rows.where(F.col(place) == F.col(seen[term[1:]]))
            else:
                seen[term[1:]] = place
        return rows.select(*[F.col(place).alias(v) for v, place in seen.items()])

    left = list(patterns)
    out = bindings(left.pop(0))
    while left:
        position = next((i for i, p in enumerate(left) if set(names(p)) & set(out.columns)), None)
        if position is None:
            raise ValueError("patterns must be connected by shared variables")
        pattern = left.pop(position)
        shared = [v for v in dict.fromkeys(names(pattern)) if v in out.columns]
        part = bindings(pattern)
        how = "left_semi" if set(part.columns) <= set(shared) else "inner"
        out = out.join(part, shared, how)
    return out


def kg_theme_categories(triples: DataFrame, ns: str = "forum") -> DataFrame:
    return match_pattern(triples, [
        ("?theme", TYPE, f"{ns}:Theme"), ("?theme", "dc:title", "?title"),
        ("?theme", f"{ns}:problemCategory", "?category")])


def kg_question_answers(triples: DataFrame, ns: str = "forum") -> DataFrame:
    return match_pattern(triples, [
        ("?question", TYPE, f"{ns}:Question"), ("?question", "dc:title", "?question_title"),
        ("?answer", f"{ns}:answersQuestion", "?question"), ("?answer", TYPE, f"{ns}:Answer"),
        ("?answer", "dc:description", "?answer_text")])


def kg_answers_per_expert(triples: DataFrame, ns: str = "forum") -> DataFrame:
    """Answers are counted per expert before the names are joined."""
    answers = match_pattern(triples, [("?answer", f"{ns}:providedBy", "?expert")])
    counts = answers.groupBy("expert").agg(F.count("answer").alias("answer_count"))
    experts = match_pattern(triples, [
        ("?expert", TYPE, f"{ns}:Expert"), ("?expert", "foaf:name", "?name"),
        ("?expert", f"{ns}:areaOfExpertise", "?expertise")])
    return experts.join(counts, "expert").orderBy(F.desc("answer_count"), "expert")


def kg_avg_vote(triples: DataFrame, ns: str = "forum") -> DataFrame:
    votes = match_pattern(triples, [
        ("?vote", TYPE, f"{ns}:Vote"), ("?vote", f"{ns}:votedOn", "?answer"),
        ("?vote", f"{ns}:voteValue", "?vote_value")])
    out = votes.groupBy("answer").agg(
        F.avg(F.col("vote_value").cast("double")).alias("avg_vote"), F.count("vote").alias("vote_count"))
    return out.orderBy(F.desc("avg_vote"), "answer")


def kg_questions_per_theme(triples: DataFrame, ns: str = "forum") -> DataFrame:
    """Questions are counted per theme before the titles are joined."""
    asked = match_pattern(triples, [("?question", f"{ns}:belongsToTheme", "?theme")])
    counts = asked.groupBy("theme").agg(F.count("question").alias("question_count"))
    themes = match_pattern(triples, [("?theme", TYPE, f"{ns}:Theme"), ("?theme", "dc:title", "?title")])
    return themes.join(counts, "theme").orderBy(F.desc("question_count"), "theme")


def graph_stats(triples: DataFrame, ns: str = "forum", approx: bool = False) -> DataFrame:
    """Triples, distinct subjects and predicates, entities with several types, links between entities."""
    distinct = F.approx_count_distinct if approx else F.count_distinct
    typed = triples.where(F.col("p") == TYPE).groupBy("s").agg(F.count_distinct("o").alias("types"))
    several = typed.agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("types") > 1).alias("multi_typed"))
    link = (F.col("p") != TYPE) & F.col("o").startswith(f"{ns}:")
    totals = triples.agg(
        F.count(F.lit(1)).alias("triples"), distinct("s").alias("subjects"), distinct("p").alias("predicates"),
        F.count_if(link).alias("entity_links"),
    )
    return totals.join(F.broadcast(several))


def entities_per_type(triples: DataFrame) -> DataFrame:
    typed = triples.where(F.col("p") == TYPE)
    return typed.groupBy(F.col("o").alias("type")).agg(F.count_distinct("s").alias("entities"))
