import json
import os
import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from shoal.functions.adwin import Adwin, DriftMonitor
from shoal.operators import drift, metrics
from shoal.plans.stream_queries import leases_of_stream, status_of_streams
from shoal.session import fresh_path
from shoal.sources import message_log
from shoal.streaming import events as flow
from shoal.streaming import leases, monitor, ordered
from shoal.streaming.outputs import outputs, split_triggers
from shoal.streaming.run import as_stream, run_available


def series(seed=0):
    rng = np.random.default_rng(seed)
    return np.r_[(rng.random(600) < 0.1), (rng.random(600) < 0.7), (rng.random(600) < 0.7)].astype(float)


def test_kernel():
    flat = Adwin(0.002)
    assert not any(flat.add(0.3) for _ in range(3000))
    step = Adwin(0.01)
    hits = [i for i, v in enumerate(series()) if step.add(v)]
    assert hits and 600 <= hits[0] < 680
    assert step.n < 1300 and abs(step.total / step.n - 0.7) < 0.1
    values = series(1)
    window = Adwin(1e-300)
    for v in values:
        window.add(v)
    assert window.n == len(values)
    assert np.isclose(window.total, values.sum()) and np.isclose(window.spread, values.var() * len(values))
    copy = Adwin.load(0.01, json.loads(json.dumps(step.dump())))
    tail = series(2)
    assert [step.add(v) for v in tail] == [copy.add(v) for v in tail]


def test_monitor_gates():
    closed = DriftMonitor(window=20, delta=0.2, min_samples=30)
    assert not any(closed.add(v) for v in series())
    open_gate = DriftMonitor(window=100, delta=0.2, min_samples=30, cooldown=400)
    hits = [h for h in (open_gate.add(v) for v in series()) if h]
    assert hits and all(b[0] - a[0] > 400 for a, b in zip(hits, hits[1:]))
    assert hits[0][1] == min(hits[0][0] + 1, 100)


@pytest.fixture(scope="module")
def errors(spark):
    parts = [pd.DataFrame({"k": k, "seq": np.arange(1800), "e": series(i)}) for i, k in enumerate("abc")]
    pdf = pd.concat(parts, ignore_index=True)
    return pdf, spark.createDataFrame(pdf.sample(frac=1, random_state=3))


def reference_alarms(pdf, **settings):
    out = set()
    for k, rows in pdf.sort_values("seq").groupby("k"):
        m = DriftMonitor(**settings)
        out |= {(k, h[0]) for h in (m.add(v) for v in rows["e"]) if h}
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_batch_equals_kernel(errors, parts):
    pdf, df = errors
    got = drift.monitor_drift(df.repartition(parts), "e", ["seq"], ["k"], window=150, delta=0.1).toPandas()
    assert set(zip(got["k"], got["row_index"])) == reference_alarms(pdf, window=150, delta=0.1)
    alone = drift.adwin(df, "e", ["seq"], ["k"], delta=0.05).toPandas()
    for k, rows in pdf.groupby("k"):
        a = Adwin(0.05)
        want = [i for i, v in enumerate(rows.sort_values("seq")["e"]) if a.add(v)]
        assert alone[alone["k"] == k]["row_index"].tolist() == want
    coarse = drift.adwin(df, "e", ["seq"], ["k"], delta=0.05, block=8).toPandas()
    assert set(coarse["k"]) == set("abc") and ((coarse["row_index"] + 1) % 8 == 0).all()


def test_a_block_means_the_same_for_any_number_of_rows(spark):
    """Rows after a detection, in its own or another series, do not change it."""
    rng = np.random.default_rng(6)
    values = np.concatenate([rng.normal(0, 1, 2000), rng.normal(3, 1, 2000)])
    found = []
    for n in (3000, 4000):
        pdf = pd.DataFrame({"k": 1, "i": np.arange(n), "e": values[:n]})
        got = drift.adwin(spark.createDataFrame(pdf), "e", ["i"], ["k"], delta=0.01, block=8).toPandas()
        found.append(sorted(got[got["row_index"] < 2960]["row_index"]))
    assert found[0] and found[0] == found[1]


def test_monitor_blocks_count_rows(spark):
    pdf = pd.DataFrame({"i": np.arange(2000), "e": np.r_[np.zeros(1000), np.ones(1000)]})
    got = drift.monitor_drift(spark.createDataFrame(pdf), "e", ["i"], block=10, delta=0.01).toPandas()
    assert len(got) and got["row_index"].min() > 1000 and ((got["row_index"] + 1) % 10 == 0).all()


@pytest.mark.parametrize("cuts", [[1800], [1, 2, 700, 1800], list(range(100, 1900, 300))])
def test_stream_equals_batch(spark, errors, cuts):
    pdf, df = errors
    from shoal.session import fresh_path

    path, low = fresh_path(spark, "cuts"), 0
    for number, high in enumerate(cuts):
        part = df.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1)
        part.write.mode("append").parquet(f"{path}/batch={number:03d}")
        low = high
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/batch=*")
    got = run_available(monitor.stream_drift_monitor(stream, "k", "seq", "e", window=150, delta=0.1)).toPandas()
    assert set(zip(got["key"], got["row_index"])) == reference_alarms(pdf[pdf["seq"] < low], window=150, delta=0.1)
    assert (got["late_rows"] == 0).all()


def test_induced_drift_counts(spark):
    n = 1100
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": np.arange(n), "x": rng.normal(size=n), "c": rng.choice(list("pqrs"), n),
                        "only": "one", "y": rng.integers(0, 3, n)})
    df = spark.createDataFrame(pdf)
    a = drift.induce_drift(df, ["id"], n_drifts=10, strength=0.3, target="y", ignore=["id"], noise=0.0).toPandas()
    b = drift.induce_drift(df.repartition(5), ["id"], n_drifts=10, strength=0.3, target="y", ignore=["id"],
                           noise=0.0).toPandas()
    a, b = a.sort_values("id", ignore_index=True), b.sort_values("id", ignore_index=True)
    pd.testing.assert_frame_equal(a, b)
    assert (a["segment"] == np.arange(n) // 100).all()
    for s in range(11):
        here = a["segment"] == s
        changed = (a.loc[here, "c"] != pdf.loc[here, "c"]).sum()
        flipped = (a.loc[here, "y"] != pdf.loc[here, "y"]).sum()
        assert changed == (0 if s == 0 else int(100 * min(0.6, 0.15 + 0.05 * s)))
        assert flipped == (0 if s == 0 else int(100 * min(0.7, 0.20 + 0.05 * s)))
        scale, shift = (1.8 if s % 3 == 0 else 0.5), s * 0.3 * (1 if s % 2 else -1)
        want = pdf.loc[here, "x"] * scale + shift if s else pdf.loc[here, "x"]
        np.testing.assert_allclose(a.loc[here, "x"], want)
    assert set(a["only"]) == {"one"} and set(a["c"]) <= set("pqrs") and set(a["y"]) <= {0, 1, 2}
    with pytest.raises(ValueError):
        drift.induce_drift(df.limit(5), ["id"], n_drifts=10)


def test_noise_ramp_grows(spark):
    df = spark.range(2000).select("id", F.lit(1.0).alias("x"))
    out = drift.induce_noise_ramp(df, ["id"], strength=1.0, ignore=["id"]).toPandas().sort_values("id")
    spread = (out["x"] - 1.0).groupby(out["row_index"] // 200).std()
    assert all(abs(s / (i + 1) - 1) < 0.25 for i, s in enumerate(spread))


def test_retraining_follows_the_change(spark):
    rng = np.random.default_rng(4)
    n = 3000
    x = rng.normal(size=n)
    y = np.where(np.arange(n) < 1500, x > 0, x < 0).astype(int).astype(str)
    pdf = pd.DataFrame({"i": np.arange(n), "x": x, "y": y, "p": np.where(x > 0, "1", "0")})
    final, log = drift.monitor_and_retrain(spark.createDataFrame(pdf), ["i"], ["x"], "y", "p", window=20, delta=1e-9,
                                           min_samples=20, cooldown=100)
    alarms = sorted(r["row_index"] for r in log.collect())
    assert alarms and 1500 <= alarms[0] < 1600
    late = final.where("i >= 2600")
    assert metrics.classification_metrics(late, "y", "p").first()["accuracy"] > 0.9
    early = final.where(F.col("i") <= alarms[0]).toPandas()
    assert (early["p"] == np.where(early["x"] > 0, "1", "0")).all()  # the old model until the next batch


def test_training_window_rows(spark):
    rows = spark.range(1000).select(F.col("id").alias("row_index"))
    log = spark.createDataFrame([(5,), (499,), (500,)], "row_index long")
    got = drift.training_windows(rows, log, 100).groupBy("event_index").agg(
        F.min("row_index").alias("a"), F.max("row_index").alias("b"), F.count("*").alias("n")).collect()
    assert {tuple(r) for r in got} == {(5, 0, 5, 6), (499, 400, 499, 100), (500, 401, 500, 100)}


def test_leases(spark):
    start = datetime.fromisoformat("2024-01-01")
    plan = [  # seconds, op, task, outcome
        (0, "claim", "a", "granted"), (119, "claim", "a", "rejected_in_progress"), (120, "claim", "a", "reclaimed"),
        (419, "claim", "b", "rejected_claimed"), (420, "claim", "b", "reclaimed"), (430, "heartbeat", "a", "not_found"),
        (600, "heartbeat", "b", "alive"), (899, "claim", "c", "rejected_claimed"), (899, "complete", "b", "completed"),
        (5000, "claim", "c", "rejected_completed"), (5001, "heartbeat", "b", "not_found"),
        (5002, "release", "b", "released"), (5003, "claim", "c", "granted")]
    rows = [("j1", i, start + timedelta(seconds=s), op, t) for i, (s, op, t, _) in enumerate(plan)]
    rows += [("j2", 0, start, "claim", "z")]
    df = spark.createDataFrame(rows, "job_key string, seq long, ts timestamp, op string, task_id string")
    got = leases.lease_claims(df.repartition(3)).toPandas().sort_values(["job_key", "seq"])
    assert got[got["job_key"] == "j1"]["outcome"].tolist() == [p[3] for p in plan]
    streamed = run_available(leases.stream_lease_claims(as_stream(df.coalesce(1)))).toPandas()
    assert streamed.sort_values(["job_key", "seq"])["outcome"].tolist() == got["outcome"].tolist()


def test_error_signal_and_metrics(spark):
    rows = spark.createDataFrame(
        [("1.0", "1", {"1": 0.9}), ("2", "1", {"1": 0.9}), (None, "NA", None), ("3", " 3 ", {"3": 0.5})],
        "t string, p string, q map<string,double>")
    got = [r["error"] for r in metrics.error_signal(rows, "t", "p", "classification", "q").collect()]
    assert got == [1.0, 1.0, 0.0, 0.5]
    bad = spark.createDataFrame([("a", "b"), ("1", "3")], "t string, p string")
    assert [r["error"] for r in metrics.error_signal(bad, "t", "p", "regression").collect()] == [0.0, 2.0]
    floats = spark.createDataFrame([(1.0,), (1.5,), (None,)], "y double")
    assert [r[0] for r in floats.select(metrics.normalize_label(floats, "y")).collect()] == ["1", "1.5", "NA"]


def test_events(spark):
    good = json.dumps({"task_id": "t1", "input": {"user_id": "u", "dataset_id": "d", "target_column": "y"}})
    flat = json.dumps({"event_id": "e1", "user_id": "u", "dataset_id": "d", "task_category": " Vision "})
    rows = spark.createDataFrame([("a", good), ("b", flat), ("c", "{broken"), ("d", "not json")], "key string, value string")
    got = {r["task_id"]: r for r in flow.parse_events(rows).collect()}
    assert got["t1"]["target_column"] == "y" and got["t1"]["dataset_version"] == "v1"
    assert got["e1"]["task_category"] == "vision" and got["e1"]["user_id"] == "u"
    assert flow.parse_events(rows).where("quarantine is not null").count() == 2
    checked = flow.validate_triggers(flow.parse_events(rows).where("quarantine is null"), "drift")
    assert checked.where("failure_reason is null").count() == 0
    assert flow.accepted(flow.validate_triggers(flow.parse_events(rows).where("quarantine is null"), "bias")).count() == 2


def test_open_tasks_of_the_last_hours(spark):
    """A task that was triggered just before the last event is open, not lost."""
    start = datetime(2024, 1, 1)
    hours = [(f"t{i}", "d", start + timedelta(hours=i)) for i in range(30)]
    triggers = spark.createDataFrame(hours, "task_id string, dataset_id string, timestamp timestamp")
    done = spark.createDataFrame([(t, True, at + timedelta(minutes=5)) for t, _, at in hours[:-4:2]],
                                 "task_id string, success boolean, timestamp timestamp")
    got = {r["task_id"]: r["status"] for r in status_of_streams(triggers, done).collect()}
    assert got == {t: "success" if t in {x for x, _, _ in hours[:-4:2]} else "open" for t, _, _ in hours}


PLAN = [  # seconds, job, op, task, outcome
    (0, "j", "claim", "a", "granted"), (119, "j", "claim", "a", "rejected_in_progress"), (120, "j", "claim", "a", "reclaimed"),
    (121, "k", "claim", "a", "rejected_other_job"), (419, "j", "claim", "b", "rejected_claimed"), (420, "j", "claim", "b", "reclaimed"),
    (430, "j", "release", "a", "not_found"), (431, "k", "claim", "a", "granted"), (600, "j", "heartbeat", "b", "alive"),
    (719, "j", "heartbeat", "b", "alive"), (839, "j", "heartbeat", "b", "alive"), (840, "j", "complete", "b", "completed"),
    (5000, "j", "claim", "c", "rejected_completed")]
RAN_OUT = [(120, "j", "a", "idle"), (240, "j", "a", "idle"), (420, "j", "a", "stale"), (540, "j", "b", "idle"), (551, "k", "a", "idle"), (731, "k", "a", "stale"),
           (839, "j", "b", "idle")]


@pytest.mark.parametrize("streamed,order", [(False, 1), (True, 1), (True, -1)])
def test_lease_protocol(spark, streamed, order):
    """Leases at 119, 120, 299 and 300 seconds; tasks of another job; leases that end by a timer. Streams in either order."""
    start = datetime(2024, 1, 1)
    rows = [(job, i, start + timedelta(seconds=s), op, task) for i, (s, job, op, task, _) in enumerate(PLAN)]
    df = spark.createDataFrame(rows[::order], "job_key string, seq long, ts timestamp, op string, task_id string").repartition(4)
    log = leases_of_stream(df, delay="3 hours") if streamed else leases.lease_log(df)
    zero = int(start.timestamp() * 1000)
    got = sorted(((r["at"] - zero) // 1000, r["job_key"], r["op"], r["task_id"], r["outcome"]) for r in log.collect())
    assert got == sorted(PLAN + [(s, job, "expire", task, what) for s, job, task, what in RAN_OUT])
    assert leases.lease_log(df.limit(0)).count() == 0


def test_order_of_a_stream(spark):
    """Rows that arrive out of order give the alarms of ordered ones; only rows behind the watermark are late."""
    start = datetime(2024, 1, 1)
    rows = [(k, i, start + timedelta(seconds=i), float(v)) for n, k in enumerate("ab") for i, v in enumerate(series(n))]
    want = reference_alarms(pd.DataFrame(rows, columns=["k", "seq", "ts", "e"]), window=150, delta=0.1)
    assert want
    schema = "k string, seq long, ts timestamp, e double"
    folder = fresh_path(spark, "unordered")
    for number, part in enumerate((rows[1::3], rows[0::3], rows[2::3], [("z", 0, start + timedelta(days=1), 0.0)],
                                   [("z", 1, start + timedelta(days=1, seconds=1), 0.0)], [("b", 8, start, 1.0)])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/part={number}")
        time.sleep(0.05)  # files are read in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")
    told = []
    got = run_available(monitor.ordered_drift_monitor(stream, "k", "ts", "seq", "e", delay="1 hour"), progress=told).collect()
    assert {(r["key"], r["row_index"]) for r in got} == want
    assert ordered.late_rows(told) == 1


def test_message_log_after_failures(spark, tmp_path):
    """A writer that fails and starts again, and a reader that goes on where it was: each message once, in order."""
    rows = spark.createDataFrame([(f"k{i % 7}", f"line\n{i} é") for i in range(300)] + [(None, None)], "key string, value string")
    source = as_stream(rows.repartition(5), files_per_trigger=1)
    log, folder = f"{tmp_path}/log", fresh_path(spark, "log-check")
    schema = "partition int, offset long, key string, value string"

    def fail(value):
        raise ValueError(value)

    broken = source.withColumn("value", F.udf(lambda v: fail(v) if v and "\n77 " in v and not os.path.exists(f"{tmp_path}/go") else v)("value"))
    with pytest.raises(StreamingQueryException):
        message_log.append_log(broken, log, f"{folder}/sent").awaitTermination()
    before = sum(n for _, files in message_log.Log(log).commits() for _, _, n in files)
    assert before < 301
    reader = message_log.read_log(spark, log).writeStream.format("parquet").option("path", f"{folder}/got").option(
        "checkpointLocation", f"{folder}/read").trigger(availableNow=True)
    reader.start().awaitTermination()
    assert spark.read.schema(schema).parquet(f"{folder}/got").count() == before
    (tmp_path / "go").write_text("")
    message_log.append_log(broken, log, f"{folder}/sent").awaitTermination()
    message_log.append_log(broken, log, f"{folder}/sent").awaitTermination()
    reader.start().awaitTermination()
    got = spark.read.schema(schema).parquet(f"{folder}/got").collect()
    assert sorted((r["key"], r["value"]) for r in got if r["key"]) == sorted((r["key"], r["value"]) for r in rows.collect() if r["key"])
    assert len(got) == 301
    for p in range(4):
        assert sorted(r["offset"] for r in got if r["partition"] == p) == list(range(sum(r["partition"] == p for r in got)))
    whole = spark.read.format("message_log").options(path=log).load()
    assert sorted(map(str, whole.collect())) == sorted(map(str, got))


@pytest.mark.parametrize("where", [(0, "accepted"), (0, "rejected"), (1, "accepted"), None])
def test_two_outputs_after_a_failure(spark, tmp_path, where):
    rows = spark.createDataFrame([(f"t{i}", "u" if i % 3 else None, "d", "m", "y", datetime(2024, 1, 1)) for i in range(40)],
                                 "task_id string, user_id string, dataset_id string, model_id string, target_column string, timestamp timestamp")
    stream = as_stream(rows.repartition(4), files_per_trigger=2)
    failed = []

    def written(number, name):
        if (number, name) == where and not failed:
            failed.append(1)
            raise ValueError("interrupted")

    for _ in range(2):
        try:
            split_triggers(stream, "drift", str(tmp_path), written).awaitTermination()
        except StreamingQueryException:
            assert failed
    good, bad = outputs(spark, str(tmp_path))
    assert sorted(r["task_id"] for r in good.collect()) == sorted(f"t{i}" for i in range(40) if i % 3)
    assert sorted(r["key"] for r in bad.collect()) == sorted(f"t{i}" for i in range(0, 40, 3))
    assert {r["batch"] for r in good.collect()} == {0, 1}
