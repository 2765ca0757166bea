import re

import numpy as np
import pandas as pd
import pytest

from shoal.functions.columns import matches_any
from shoal.operators import metrics, search
from shoal.operators.search import required_trigrams, search_postings, trigram_postings
from shoal.operators.sketches import merge_sketches, sketched_profile, version_sketches


@pytest.mark.parametrize("pattern, want", [
    ("Data", [["ata", "dat"]]), ("colou?r", [["col", "olo"]]), ("ab+cde", [["cde"]]), ("abc{0,2}def", [["def"]]),
    ("red|blue", [["red"], ["blu", "lue"]]), ("red|bl", None), ("x[abc]yzw", [["yzw"]]), ("(abc)", None),
    (r"abc\d", None), ("", None), ("ab", None), ("^abc$", [["abc"]]), ("é" + "abc", [["abc"]]), ("a[bcd", None),
    ("abc*?", None), ("abc.def", [["abc", "def"]]), ("a[^]x]bcd", None)])
def test_required_trigrams(pattern, want):
    assert required_trigrams(pattern) == want


PATTERNS = ["data", "DATA se", "colou?r", "red|blue|vio", "a.c def", "zzz", "ta[ -]se", "é data", "da", "(red|set)", "data|colour",
            "a long text with many different trigrams that go beyond one bit each of the number of them"]


def test_search_equals_a_scan(spark):
    rows = [("u1", "a", "Data set", None), ("u1", "b", "colour", "red"), (None, "c", "Color é DATA-set", ""), ("u2", None, None, None),
            ("u1", "a", "Data set", None), ("u3", "d", "abc def", "violet " * 500 + "data set"), ("u4", "e", "", "BLUE"),
            ("u5", "f", "a long text with many different trigrams that go beyond one bit each of the number of them", "x")]
    df = spark.createDataFrame(rows, "owner string, id string, `the name` string, text string")
    keys, columns = ["owner", "id"], ["the name", "text"]
    postings = trigram_postings(df, keys, columns)
    for pattern in PATTERNS:
        got = search_postings(df, postings, keys, pattern, columns).collect()
        want = [r for r in rows if any(t is not None and re.search(pattern, t, re.I) for t in r[2:])]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)), pattern
        assert len(want) == df.where(matches_any(pattern, columns)).count()
    assert search_postings(df.limit(0), trigram_postings(df.limit(0), keys, columns), keys, "data", columns).count() == 0


def test_a_search_reads_the_postings_it_needs(spark):
    df = spark.range(200).selectExpr("id", "concat('text number ', id) as text")
    postings = trigram_postings(df, ["id"], ["text"])
    plan = search_postings(df, postings, ["id"], "number 17", ["text"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan
    regex = [line for line in plan.splitlines() if "RLIKE" in line or "rlike" in line.lower()]
    assert regex and all("Join" in line for line in regex)  # no record but a candidate meets it


def test_merged_sketches_hold_their_bounds(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"part": rng.integers(0, 5, 20_000), "v": rng.exponential(size=20_000), "hot": np.where(
        rng.random(20_000) < 0.4, 3.0, rng.normal(size=20_000)), "t": rng.integers(0, 700, 20_000).astype(str), "none": np.nan})
    pdf.loc[::9, "v"] = np.nan
    df = spark.createDataFrame(pdf)
    merged = merge_sketches(version_sketches(df, by=["part"]))
    whole = version_sketches(df.drop("part"))
    probs = [0.01, 0.25, 0.5, 0.9]
    for sketches in (merged, whole):
        got = {r["column_name"]: r for r in sketched_profile(sketches, probs).collect()}
        assert set(got) == {"v", "hot", "t", "none"}
        for c, r in got.items():
            present = pdf[c].dropna()
            assert (r["row_count"], r["missing_count"]) == (len(pdf), len(pdf) - len(present))
            assert abs(r["distinct_count"] - present.nunique()) <= 0.04 * present.nunique()
            if c in ("t", "none"):
                assert r["quantiles"] is None
                continue
            for p, q in zip(probs, r["quantiles"]):
                assert (present < q).mean() <= p + 0.02 and (present <= q).mean() >= p - 0.02
    empty = sketched_profile(merge_sketches(version_sketches(df.limit(0)))).collect()
    assert all((r["row_count"], r["distinct_count"], r["quantiles"]) == (0, 0, None) for r in empty) and len(empty) == 5


def test_two_classes_and_many_guesses(spark):
    guesses = np.random.default_rng(2).random(5000)
    df = spark.createDataFrame([(float(i % 2), float(g)) for i, g in enumerate(guesses)], "t double, p double")
    got = metrics.nearest_class_label(df, "t", "p").toPandas()
    assert ((got["p"] > 0.5).astype(int).astype(str) == got["y_pred_label"]).all() and len(got) == 5000


def test_postings_are_sorted_by_a_number_and_made_without_lambdas(spark, monkeypatch):
    made = []
    monkeypatch.setattr(search, "materialize", lambda df, label: made.append(df) or df)
    texts = ["Ab\ncab", "ab", None, "zzzzz", "x\U0001f600yÄ€bc", "a|中文字"]
    records = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    rows = search.trigram_postings(records, ["id"], ["text"]).collect()
    plan = made[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "[gram" not in plan[: plan.index("Project")]
    assert [r["gram"].encode() for r in rows] == sorted(r["gram"].encode() for r in rows)
    got = {(r["id"], r["gram"]) for r in rows}
    want = {(i, t.lower()[j:j + 3]) for i, t in enumerate(texts) if t for j in range(len(t) - 2)}
    assert want <= got and all("?" in g for _, g in got - want)  # pieces of a surrogate pair, which no pattern asks for
