import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shoal.operators import mitigate, profile
from shoal.operators import neighbors
from shoal.operators.neighbors import exact_neighbors
from shoal.operators.ordering import row_index


@pytest.fixture(scope="module")
def dirty(spark):
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({
        "num": rng.normal(size=n).round(3), "skewed_pos": rng.lognormal(sigma=1.0, size=n),
        "skewed_neg": rng.exponential(size=n) ** 2 - 0.5, "constant": 2.0,
        "cat": rng.choice(["a", "b", "c"], n), "cat_many": rng.choice([f"m{i:02d}" for i in range(20)], n),
        "flag_text": np.where(np.arange(n) % 40 == 0, "maybe", rng.choice(["yes", "No"], n)),
        "prose": [f"a long sentence about row {i}" for i in range(n)],
        "target": np.where(rng.random(n) < 0.1, "x", "y")})
    pdf.loc[::9, "num"] = np.nan
    pdf.loc[::11, "cat"] = None
    pdf = pd.concat([pdf, pdf.iloc[:30]], ignore_index=True)
    df = spark.createDataFrame(pdf).withColumn("num", F.when(~F.isnan("num"), F.col("num")))
    return pdf, df


def test_profile_equals_pandas(dirty):
    pdf, df = dirty
    stats = profile.distribution_stats(df).toPandas().set_index("column_name")
    for c in ("num", "skewed_pos", "skewed_neg"):
        assert math.isclose(stats.loc[c, "skew"], pdf[c].skew(), rel_tol=1e-9)
        assert math.isclose(stats.loc[c, "kurtosis"], pdf[c].kurt(), rel_tol=1e-9)
        assert math.isclose(stats.loc[c, "median"], pdf[c].median(), rel_tol=1e-12)
    assert profile.duplicate_rows(df).first()[0] == int(pdf.duplicated().sum())
    missing = profile.missing_values(df).toPandas().set_index("column_name")["missing_count"].to_dict()
    assert missing == {c: int(n) for c, n in pdf.isna().sum().items() if n}
    corr = profile.correlation_matrix(df, ["num", "skewed_pos"]).toPandas()
    want = pdf[["num", "skewed_pos"]].corr().round(3)
    for r in corr.itertuples():
        assert r.correlation == want.loc[r.column_a, r.column_b]
    clean = df.na.drop().dropDuplicates().select("constant")
    assert not profile.needs_mitigation(clean.limit(1)).first()["needs_mitigation"]
    assert profile.needs_mitigation(df, tags=["Mitigated"]).first()["needs_mitigation"] is False


def test_fit_and_apply(dirty):
    pdf, df = dirty
    out, state = mitigate.fit(df, "target", seed=1)
    assert state.fill == {"num": pytest.approx(pdf["num"].median()), "cat": pdf["cat"].mode().iloc[0]}
    assert state.kinds == {"cat": "one-hot", "cat_many": "label", "flag_text": "boolean", "prose": "text"}
    assert state.skew["skewed_pos"][0] == "yeo-johnson" and state.skew["skewed_neg"][0] == "standard_scaler"
    assert {"cat_a", "cat_b", "cat_c"} <= set(out.columns) and "cat" not in out.columns
    reasons = [r for r in state.log if r[1] == "oversampling_skipped"]
    assert reasons and "prose" in reasons[0][4]
    seen = mitigate.apply(df.limit(5).withColumn("cat", F.lit("new")).withColumn("cat_many", F.lit("new")), state, False)
    assert seen.where("cat_a or cat_b or cat_c").count() == 0
    assert {r["cat_many"] for r in seen.collect()} == {-1}
    assert out.count() == len(pdf.drop_duplicates())


def test_yeo_johnson_is_the_likelihood_maximum(dirty, spark):
    pdf, df = dirty
    powers = mitigate.yeo_johnson_fit(df, ["skewed_pos", "skewed_neg"])

    def transform(x, p):
        size = np.log1p(np.abs(x))
        high = size if abs(p) < 1e-12 else np.expm1(p * size) / p
        low = size if abs(p - 2) < 1e-12 else np.expm1((2 - p) * size) / (2 - p)
        return np.where(x >= 0, high, -low)

    for c, p in powers.items():
        x = pdf[c].to_numpy()

        def fit(q):
            return -0.5 * len(x) * math.log(transform(x, q).var()) + (q - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

        grid = np.linspace(p - 0.5, p + 0.5, 2001)
        assert abs(grid[np.argmax([fit(q) for q in grid])] - p) < 2e-3
        got = df.select(mitigate.yeo_johnson(F.col(c), p).alias("t")).toPandas()["t"]
        np.testing.assert_allclose(np.sort(got), np.sort(transform(x, p)), rtol=1e-9, atol=1e-12)


def brute_force(pdf, k, features):
    out = {}
    for g, rows in pdf.groupby("g"):
        x, ids = rows[features].to_numpy(dtype=float), rows["id"].to_numpy()
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        for i in range(len(ids)):
            order = np.lexsort((ids, d[i]))[:k]
            out[(g, ids[i])] = [(int(ids[j]), round(float(d[i, j]), 9)) for j in order if np.isfinite(d[i, j])]
    return out


@pytest.mark.parametrize("part_rows,fan", [(2000, 64), (15, 6), (40, 1), (3, 2)])
def test_neighbors_equal_brute_force(spark, part_rows, fan):
    rng = np.random.default_rng(11)
    n = 300
    pdf = pd.DataFrame({"g": np.where(rng.random(n) < 0.7, "a", "b"), "id": np.arange(n),
                        "x": rng.normal(size=n), "y": rng.normal(size=n) * 3})
    pdf.loc[pdf["g"] == "a", "x"] += np.where(rng.random((pdf["g"] == "a").sum()) < 0.5, 20, 0)
    got = exact_neighbors(spark.createDataFrame(pdf), "g", "id", ["x", "y"], 4, part_rows=part_rows,
                          fan=fan).toPandas()
    found = {}
    for r in got.sort_values("rank").itertuples():
        found.setdefault((r.g, r.id), []).append((r.neighbor, round(r.distance, 9)))
    assert found == brute_force(pdf, 4, ["x", "y"])


def test_neighbors_of_tiny_groups(spark):
    rows = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 1.0), ("b", 1, 5.0)], "g string, id long, x double")
    got = {tuple(r) for r in exact_neighbors(rows, "g", "id", ["x"], 3).select("g", "id", "neighbor").collect()}
    assert got == {("a", 1, 2), ("a", 2, 1)}


def test_neighbors_among_equal_points_and_keys(spark, monkeypatch):
    """Cells that no border can cut are dealt to slices; copies of a key are no neighbours of each other."""
    monkeypatch.setattr(neighbors, "CELL_ROWS", 8)
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": "a", "id": np.arange(160), "x": np.where(np.arange(160) < 90, 1.0, rng.normal(size=160) * 4),
                        "y": np.where(np.arange(160) < 90, 2.0, rng.normal(size=160))})
    odd = pd.DataFrame({"g": "a", "id": [200, 201], "x": [np.nan, np.inf], "y": [0.0, 0.0]})
    got = exact_neighbors(spark.createDataFrame(pd.concat([pdf, odd])), "g", "id", ["x", "y"], 4, part_rows=5).toPandas()
    found = {}
    for r in got.sort_values("rank").itertuples():
        found.setdefault((r.g, r.id), []).append((r.neighbor, round(r.distance, 9)))
    assert found == brute_force(pdf, 4, ["x", "y"])
    twice = pd.concat([pdf, pdf])
    asked = spark.createDataFrame(pdf.loc[[0, 3, 120], ["g", "id"]])
    got = exact_neighbors(spark.createDataFrame(twice), "g", "id", ["x", "y"], 4, asked, part_rows=5).toPandas()
    assert got.sort_values(["id", "rank"]).groupby("id")["neighbor"].agg(list).to_dict()[0] == [1, 1, 1, 1]
    assert got.sort_values(["id", "rank"]).groupby("id")["neighbor"].agg(list).to_dict()[3] == [0, 0, 0, 0]
    assert set(got["id"]) == {0, 3, 120}


def test_neighbors_place_points_in_one_pass(spark, monkeypatch):
    """More points make more cells, not more passes."""
    written = []
    write = neighbors.materialize
    monkeypatch.setattr(neighbors, "materialize", lambda df, label="rows": written.append(label) or write(df, label))
    tables = {}
    for n in (60, 1200):
        x = np.random.default_rng(n).normal(size=n)
        written.clear()
        rows = spark.createDataFrame(pd.DataFrame({"g": "a", "id": np.arange(n), "x": x}))
        assert exact_neighbors(rows, "g", "id", ["x"], 2, part_rows=4, fan=3).count() == 2 * n
        tables[n] = len(written)
    assert tables[60] == tables[1200]


def test_smote(spark):
    rng = np.random.default_rng(5)
    major = pd.DataFrame({"x": rng.normal(size=300), "y": rng.normal(size=300), "t": 0})
    # a third of the small class is one repeated point
    minor = pd.DataFrame({"x": np.r_[rng.normal(5, 1, 40), np.full(20, 7.0)],
                          "y": np.r_[rng.normal(5, 1, 40), np.full(20, 7.0)], "t": 1})
    pdf = pd.concat([major, minor], ignore_index=True)
    df = spark.createDataFrame(pdf)
    k = 5
    out = mitigate.smote(df, "t", k, part_rows=10).toPandas()
    assert out["t"].value_counts().to_dict() == {0: 300, 1: 300}
    again = mitigate.smote(df.repartition(3), "t", k, part_rows=25).toPandas()
    for frame in (out, again):
        frame.sort_values(list(frame.columns), inplace=True, ignore_index=True)
    pd.testing.assert_frame_equal(out, again)
    originals = {tuple(r) for r in minor[["x", "y"]].to_numpy()}
    made = [r for r in out[out["t"] == 1][["x", "y"]].to_numpy() if tuple(r) not in originals]
    assert len(made) > 100
    points = minor[["x", "y"]].to_numpy()
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    kth = np.sort(d, axis=1)[:, k - 1]
    for p in made:  # on a segment between a row and one of its k nearest
        ok = False
        for i in range(len(points)):
            for j in np.nonzero(d[i] <= kth[i] + 1e-12)[0]:
                a, b = points[i], points[j]
                if abs(np.linalg.norm(p - a) + np.linalg.norm(p - b) - np.linalg.norm(a - b)) < 1e-9:
                    ok = True
        assert ok


def test_moments_equal_sparks_and_take_plain_sums(spark, monkeypatch):
    rng = np.random.default_rng(2)
    n = 500
    pdf = pd.DataFrame({"far": 1e6 + rng.exponential(size=n), "gaps": np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n)),
                        "same": 0.1, "none": np.nan, "one": [3.0] + [np.nan] * (n - 1), "whole": rng.integers(0, 9, n)})
    df = profile.nan_to_null(spark.createDataFrame(pdf)).repartition(3)
    odd = df.withColumn("nan", F.when(F.col("whole") > 3, F.lit(np.nan)).otherwise(1.0)).withColumn("huge", F.when(
        F.col("whole") > 3, F.lit(np.inf)).otherwise(1.0))
    asked = []
    once = profile.aggregate_once
    monkeypatch.setattr(profile, "aggregate_once", lambda d, m: asked.extend(map(str, m.values())) or once(d, m))
    got = profile.column_moments(odd, odd.columns)
    assert not [a for a in asked if "std" in a or "skew" in a or "kurt" in a]
    for c in odd.columns:
        names = {"count": F.count(c), "mean": F.avg(c), "std": F.stddev_samp(c), "std_pop": F.stddev_pop(c), "min": F.min(c),
                 "max": F.max(c), "skew_pop": F.skewness(c)}
        want = odd.agg(*[e.alias(k) for k, e in names.items()]).first().asDict()
        for k, value in want.items():
            assert (got[c][k] is None) == (value is None), (c, k)
            assert value is None or np.isclose(got[c][k], value, rtol=1e-9, atol=1e-12, equal_nan=True), (c, k)


def test_ks_and_gate(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"normal": rng.normal(size=800), "uniform": rng.random(800), "same": 1.0})
    got = mitigate.ks_normality(spark.createDataFrame(pdf), list(pdf.columns)).toPandas().set_index("column_name")
    assert got["differs"].to_dict() == {"normal": False, "uniform": True, "same": False} or got.loc["normal", "p_value"] > 0.01
    assert math.isclose(mitigate.kolmogorov_p(1.3580986), 0.05, abs_tol=1e-4)
    few = spark.createDataFrame([(1.0, i % 10) for i in range(40)], "x double, t int")
    assert "too many classes" in mitigate.smote_gate(few, "t").first()["reason"]
    even = spark.createDataFrame([(1.0, i % 2) for i in range(40)], "x double, t int")
    assert "imbalance_ratio" in mitigate.smote_gate(even, "t").first()["reason"]


def test_ks_orders_equal_values_once(spark, monkeypatch):
    """No task sorts the rows of a frequent value: the order is taken over different values with their counts."""
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"coarse": rng.integers(0, 11, 6000) / 100.0, "fine": rng.normal(size=6000)})
    pdf.loc[::13, "coarse"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("coarse", F.when(~F.isnan("coarse"), F.col("coarse")))
    asked = []

    def spy(rows, *args, **more):
        asked.append((rows.where("c = 0").count(), more.get("partitions")))
        return row_index(rows, *args, **more)

    monkeypatch.setattr(mitigate, "row_index", spy)
    monkeypatch.setattr(mitigate, "KS_ROWS", 500)
    got = mitigate.ks_normality(df, ["coarse", "fine"]).toPandas().set_index("column_name")["statistic"]
    assert asked == [(11, 13)]
    for c in pdf.columns:
        x = np.sort(pdf[c].dropna().to_numpy())
        below = np.array([0.5 * (1 + math.erf(z / math.sqrt(2))) for z in (x - x.mean()) / x.std(ddof=1)])
        i = np.arange(len(x))
        want = max(np.abs((i + 1) / len(x) - below).max(), np.abs(i / len(x) - below).max())
        assert math.isclose(got[c], want, rel_tol=1e-9)
