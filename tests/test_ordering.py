import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shoal.operators.ordering import block_totals, exact_quantiles, hash_cutoffs, hash_key, row_index
from shoal.plans.stream_queries import NO_TASK, leases_of_stream
from shoal.streaming import leases, ordered
from shoal.operators.split import prefix_split, random_split_exact, split_sizes, systematic_sample


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    n = 5000
    pdf = pd.DataFrame({
        "id": np.arange(n), "v": rng.normal(size=n).round(2), "hot": np.where(rng.random(n) < 0.4, 3.0, rng.exponential(size=n)),
        "k": np.where(rng.random(n) < 0.5, "hot", rng.integers(0, 50, n).astype(str))})
    pdf.loc[::17, "v"] = np.nan
    return pdf, spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_row_index_does_not_depend_on_partitions(frame, parts):
    pdf, df = frame
    got = row_index(df.repartition(parts), ["hot", "id"]).toPandas().sort_values("row_index")
    want = pdf.sort_values(["hot", "id"])
    assert got["id"].tolist() == want["id"].tolist()
    assert got["row_index"].tolist() == list(range(len(pdf)))


def test_row_index_per_key(frame):
    pdf, df = frame
    got = row_index(df, ["id"], keys=["k"]).toPandas().set_index("id")["row_index"]
    want = pdf.sort_values("id").groupby("k").cumcount()
    assert (got.sort_index().to_numpy() == want.sort_index().to_numpy()).all()


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_row_index_of_runs_over_partitions(spark, parts):
    rng = np.random.default_rng(parts)
    keys = [None, 0.5, float("nan"), 7.0]
    rows = [(keys[k], None if k == 2 else str(k % 2), int(i)) for i, k in enumerate(rng.choice(4, 400, p=[0.1, 0.7, 0.15, 0.05]))]
    df = spark.createDataFrame(rows, "a double, b string, id long")
    got = {r["id"]: r["i"] for r in row_index(df, ["id"], "i", keys=["a", "b"], partitions=parts).collect()}
    seen = {}
    for a, b, i in rows:
        assert got[i] == seen.setdefault((str(a), b), 0)
        seen[str(a), b] += 1
    assert row_index(df.limit(0), ["id"], "i", keys=["a"]).count() == 0


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_row_index_of_rows_that_stand_for_copies(spark, parts):
    rng = np.random.default_rng(parts)
    pdf = pd.DataFrame({"k": rng.choice(3, 300, p=[0.1, 0.8, 0.1]), "id": np.arange(300), "n": rng.integers(1, 9, 300)})
    got = row_index(spark.createDataFrame(pdf), ["id"], "i", keys=["k"], partitions=parts, copies="n").toPandas().set_index("id")["i"]
    want = pdf.groupby("k")["n"].cumsum() - pdf["n"]
    assert (got.sort_index().to_numpy() == want.to_numpy()).all()


def test_exact_quantiles_by_sketch(frame):
    pdf, df = frame
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    direct = exact_quantiles(df, ["v", "hot"], probs)
    narrowed = exact_quantiles(df, ["v", "hot"], probs, keep=20, accuracy=50)
    for c in ("v", "hot"):
        want = pdf[c].dropna().quantile(probs).to_numpy()
        np.testing.assert_allclose(narrowed[c], want, rtol=1e-12)
        np.testing.assert_allclose(direct[c], want, rtol=1e-12)


def test_exact_quantiles_of_many_columns(spark):
    """Shares of one hot value, nothing but nulls, one value, infinities, names with dots, in every way of narrowing."""
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({f"x.{i}": np.where(rng.random(3000) < i / 30, 2.0, rng.normal(size=3000)) for i in range(30)})
    pdf["none"], pdf["one"] = np.nan, 1.5
    pdf["wide"] = np.where(rng.random(3000) < 0.1, np.inf, rng.normal(size=3000))
    df, probs = spark.createDataFrame(pdf).repartition(3), [0.0, 0.25, 0.5, 0.75]
    for narrow in ({}, {"keep": 100, "accuracy": 200}):
        got = exact_quantiles(df, list(pdf.columns), probs, **narrow)
        for c in pdf.columns.drop("none"):
            np.testing.assert_allclose(got[c], pdf[c].quantile(probs), rtol=1e-12)
        assert got["none"] == [None] * 4
    assert exact_quantiles(df.limit(0), ["one"], probs) == {"one": [None] * 4}
    assert exact_quantiles(df, [], probs) == {}


def test_hash_cutoffs_small_fetches(frame):
    pdf, df = frame
    hashes = sorted(hashlib.md5(f"5|{i}".encode()).hexdigest() for i in pdf["id"])
    cuts = hash_cutoffs(df, hash_key(5, "id"), {None: [0, 1, 1234, 4999, 5000]}, keep=2)[None]
    assert cuts == [hashes[0], hashes[1], hashes[1234], hashes[4999], None]


def test_split_is_exact_and_stable(frame):
    pdf, df = frame
    first = random_split_exact(df, ["id"], seed=1).select("id", "split").toPandas()
    again = random_split_exact(df.repartition(7), ["id"], seed=1, keep=1).select("id", "split").toPandas()
    assert first["split"].value_counts().to_dict() == {"train": 3500, "test": 750, "drift": 750}
    assert dict(zip(first["id"], first["split"])) == dict(zip(again["id"], again["split"]))
    other = random_split_exact(df, ["id"], seed=2).select("id", "split").toPandas()
    assert dict(zip(first["id"], first["split"])) != dict(zip(other["id"], other["split"]))


def test_small_splits():
    assert split_sizes(1, True) == (1, 0)
    assert split_sizes(2, True) == (1, 0)
    assert split_sizes(3, True) == (2, 1)
    assert split_sizes(0, True) == (0, 0)


def test_prefix_split_and_sample(frame):
    pdf, df = frame
    got = prefix_split(df, ["id"]).toPandas().sort_values("id")["split"].tolist()
    assert got == ["train"] * 3500 + ["test"] * 750 + ["drift"] * 750
    taken = systematic_sample(df, 300, ["id"]).toPandas()["id"]
    assert sorted(taken) == list(range(0, 5000, 16))[:300]


def test_block_totals(frame):
    pdf, df = frame
    indexed = row_index(df, ["k", "id"], "i")
    got = block_totals(indexed, ["k"], "i", {"run": F.col("hot"), "n": F.lit(1)}, {"last": F.col("hot")}, 7, block=64)
    got = got.toPandas().sort_values(["k", "id"]).reset_index(drop=True)
    want = pdf.sort_values(["k", "id"]).reset_index(drop=True)
    np.testing.assert_allclose(got["run"], want.groupby("k")["hot"].cumsum())
    assert (got["n"] == want.groupby("k").cumcount() + 1).all()
    rolled = want.groupby("k")["hot"].rolling(7, min_periods=1).sum().reset_index(drop=True)
    np.testing.assert_allclose(got["last"], rolled)


@pytest.mark.parametrize("rows", [[("a", 1)] * 100, [("a", 1)] * 60 + [("b", 2)] * 60, [(None, 1)] * 30 + [("c", 3)] * 9 + [(None, 4)] * 31])
def test_split_of_equal_rows_is_exact(spark, rows):
    df = spark.createDataFrame(rows, "k string, v long")
    for key in (["k"], ["k", "v"]):
        got = random_split_exact(df, key, seed=3).toPandas()
        n = len(rows)
        assert got["split"].value_counts().to_dict() == {"train": n * 70 // 100, "test": n * 15 // 100,
                                                         "drift": n - n * 70 // 100 - n * 15 // 100}
        assert len(got) == n and got["v"].sum() == sum(v for _, v in rows)


def test_hash_key_marks_nulls(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    assert df.select(hash_key(1, "x", "y").alias("h")).distinct().count() == 2


def test_untimed_rows_of_a_batch_need_no_buffer(monkeypatch):
    """A key's rows in a micro-batch are ordered without the state store, unless they are many; the outcome is the same."""
    class Store(dict):
        calls = 0

        def get(self, *key):
            return super().get("value")

        def exists(self):
            return "value" in self

        def update(self, value):
            self["value"] = value

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

        def getValue(self, key):
            return self[key]

        def removeKey(self, key):
            del self[key]

    class Handle:
        def __init__(self):
            self.stores = {}

        def getMapState(self, name, *schema):
            return self.stores.setdefault(name, Store())

        getValueState = getMapState

    def told(piece):
        monkeypatch.setattr(ordered, "PIECE", piece)
        processor, handle = ordered.InOrder(["at", "seq", "op", "task"], "", "", ["key", "seq", "task", "op", "outcome"], leases.Claims, 10**9, False), Handle()
        processor.init(handle)
        out = [processor.handleInputRows(("k",), iter([part.iloc[:40], part.iloc[40:]]), None) for part in (pdf.iloc[:100], pdf.iloc[100:])]
        return pd.concat([x for one in out for x in one], ignore_index=True), handle.stores["waiting"].calls

    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"at": [*rng.permutation(100), *(100 + rng.permutation(60))], "seq": np.arange(160),
                        "op": rng.choice(["claim", "release", "heartbeat", "complete"], 160, p=[0.5, 0.2, 0.29, 0.01]), "task": rng.choice(["a", "b"], 160)})
    pdf["at"] = pdf["at"] * 40_000_000
    few, none = told(10_000)
    many, some = told(30)
    lease, want = leases.Lease(), []
    for r in pdf.sort_values("at").itertuples():
        want.append(lease.apply(r.op, r.task, r.at / 1e6))
    assert none == 0 and some > 0
    assert few["outcome"].tolist() == want == many["outcome"].tolist()


class Calls:
    """A state store that counts its calls, and timers."""

    def __init__(self):
        self.stores, self.calls, self.timers = {}, 0, set()

    def getMapState(self, name, *schema):
        return self.stores.setdefault(name, Counted(self))

    getValueState = getMapState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class Counted:
    def __init__(self, handle):
        self.handle, self.kept = handle, {}

    def __getattr__(self, name):
        plain = {"get": lambda: self.kept.get(None), "update": lambda value: self.kept.update({None: value}),
                 "getValue": self.kept.get, "updateValue": lambda key, value: self.kept.update({key: value}),
                 "removeKey": self.kept.pop, "keys": lambda: list(self.kept), "clear": self.kept.clear}[name]

        def call(*args):
            self.handle.calls += 1
            return plain(*args)
        return call


class At(int):
    getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: int(self)


def test_keys_of_a_bucket_share_its_state(monkeypatch):
    """Rows of many keys that come out of order, in few groups: each key's outcome is that of its own rows in order, the calls of
    the state store do not follow the keys, and no timer is left behind."""
    def told(pdf, marks, full, together):
        monkeypatch.setattr(ordered, "FULL", full)
        monkeypatch.setattr(ordered, "TOGETHER", together)
        out = ["key", "at", "seq", "task_id", "op", "outcome"]
        processor, handle, found = ordered.InOrder(["at", "seq", "op", "task", "refused", "key"], "", "", out, leases.ExpiringLease, 60_000, True), Calls(), []
        processor.init(handle)
        for mark, past in zip(marks, [0, *marks]):
            part = pdf[(pdf["seen"] < mark) & (pdf["seen"] >= past)]
            frames = [part.iloc[i:i + 2 * together] for i in range(0, len(part), 2 * together)]
            if frames:
                assert not list(processor.handleInputRows((0,), iter(frames), None))
            for at in sorted(t for t in handle.timers if t <= mark - 600_000):
                found += processor.handleExpiredTimer((0,), At(mark - 600_000), At(at))
                handle.timers.discard(at)
        return [tuple(r) for r in pd.concat(found)[out].itertuples(index=False)], handle

    rng = np.random.default_rng(11)
    n, keys = 3000, 400
    pdf = pd.DataFrame({"at": rng.integers(0, 7_200_000, n), "seq": np.arange(n), "task": rng.choice(["a", "b"], n), "refused": rng.random(n) < 0.1,
                        "op": rng.choice(["claim", "release", "heartbeat", "complete"], n, p=[0.6, 0.1, 0.29, 0.01]), "key": [f"k{i}" for i in rng.integers(0, keys, n)]})
    pdf["seen"] = pdf["at"] + rng.integers(0, 600_000, n)
    want = []
    for name, rows in pdf.sort_values(["at", "seq"]).groupby("key"):
        lease = leases.ExpiringLease()
        for r in rows.itertuples():
            want += [(name, *x) for x in (*lease.until(r.at), *lease.feed(r.at, r.seq, r.op, r.task, r.refused))]
        want += [(name, *x) for x in lease.end()]
    end = 1 << 40
    steps = [*range(300_000, 8_400_000, 300_000), end, end + 1]
    for marks, full, together in ((steps, 16, 20), (steps, 256, 2000), ([end], 256, 2000), ([end], 3, 20)):
        got, handle = told(pdf, marks, full, together)
        assert sorted(got, key=str) == sorted(want, key=str)
        by_key = [r[:2] for r in sorted(got, key=lambda r: r[0])]
        assert by_key == sorted(by_key)
        assert not handle.timers and not handle.stores["waiting"].kept
        if full == 256:
            assert handle.calls < 20 * len(marks)


def test_state_of_a_stream_in_order_follows_buckets(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKETS", 3, raising=False)
    rows = spark.range(900).select(F.concat(F.lit("j"), F.col("id") % 400).alias("job_key"), F.col("id").alias("seq"),
                                   F.timestamp_seconds(F.col("id") * 7 % 900 + 1_700_000_000).alias("ts"),
                                   F.lit("claim").alias("op"), F.concat(F.lit("t"), F.col("id") % 600).alias("task_id"))
    progress = []
    got = leases_of_stream(rows, files=100, progress=progress)
    columns = ["job_key", "at", "seq", "task_id", "op", "outcome"]
    want = leases.lease_log(rows)
    assert sorted(map(str, got.select(columns).where(~F.col("job_key").startswith(NO_TASK)).collect())) == sorted(map(str, want.select(columns).collect()))
    assert max(op.numRowsTotal for p in progress for op in p.stateOperators) < 100
    assert ordered.late_rows(progress) == 0
