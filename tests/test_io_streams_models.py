"""Sources, sinks, streams and models."""

import json
import os
import random
from datetime import datetime
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators import models
from tidewater.plans import jobs
from tidewater.sources import io
from tidewater.streaming import session_state, streams


def test_csv(spark, tmp_path):
    (tmp_path / "h.csv").write_text('﻿id,t\n1,"a ""q"", b"\n2,\n', encoding="utf-8")
    got = io.read_csv(spark, str(tmp_path / "h.csv"), "id int, t string").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 'a "q", b'), (2, None)]
    (tmp_path / "b.csv").write_text("1,2,3,pv,1511544070\n1,x,3,pv,5\n")
    assert [r["item_id"] for r in io.read_behavior_csv(spark, str(tmp_path / "b.csv")).orderBy("timestamp").collect()] == [None, 2]


def test_partitioned_files_are_pruned(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") % 4 == 0, "buy").otherwise("pv").alias("behavior_type"))
    io.write_partitioned(df, f"{tmp_path}/p", ["behavior_type"])
    back = io.read_partitioned(spark, f"{tmp_path}/p").filter("behavior_type = 'buy'")
    assert back.count() == 25
    assert "PartitionFilters: [isnotnull(behavior_type" in back._jdf.queryExecution().toString()
    assert {r["n_rows"] for r in io.layout_report(io.read_table(spark, f"{tmp_path}/p"), ["behavior_type"]).collect()} == {25, 75}
    assert io.storage_report(spark, f"{tmp_path}/p", f"{tmp_path}/p").first()["ratio"] == 1.0


def test_fallbacks_and_cache(spark, tmp_path):
    path = f"{tmp_path}/c"
    assert io.cached_result(spark, path, lambda: spark.range(3)).count() == 3
    assert io.cached_result(spark, path, lambda: spark.range(9)).count() == 3
    found = io.load_first_available([lambda: io.read_table(spark, f"{tmp_path}/none"), lambda: io.read_table(spark, path)])
    assert found.count() == 3
    assert io.require_files(spark, path) >= 1
    with pytest.raises(FileNotFoundError):
        io.require_files(spark, f"{tmp_path}/none")


def lines(path, rows):
    with open(path, "w") as f:
        f.writelines((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows)


def event(k, second, kind="view", user=1):
    return {"event_id": str(k), "event_time": f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}+00:00", "user_id": user, "item_id": 1, "behavior_type": kind, "session_id": "s"}


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return q


def test_tumbling_stream_equals_batch_for_closed_windows(spark, tmp_path):
    rows = [event(i, i * 3, "purchase" if i % 4 == 0 else "view") for i in range(20)]
    os.makedirs(tmp_path / "in")
    lines(tmp_path / "in/a.json", [*rows[:10], "{broken"])
    lines(tmp_path / "in/b.json", [*rows[10:], event(99, 1200)])
    with streams.watching(spark) as log:
        q = drained(streams.tumbling_counts(streams.stream_events(spark, str(tmp_path / "in"), 1)), "tumbling")
        log.wait(q)
    batch = spark.createDataFrame([(datetime.fromisoformat(r["event_time"]).replace(tzinfo=None), r["behavior_type"]) for r in rows], "event_time timestamp, behavior_type string")
    want = {(r["n"], r["n_view"], r["n_purchase"], r["window_start"]) for r in streams.tumbling_counts(batch).collect()}
    got = {(r["n"], r["n_view"], r["n_purchase"], r["window_start"]) for r in spark.table("tumbling").collect()}
    assert got == want
    assert streams.progress_frame(log, q, 100).agg(F.sum("rows")).first()[0] >= 21


def test_session_stream(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    lines(tmp_path / "in/a.json", [event(1, 0), event(2, 1800), event(3, 10, user=2)])
    closing = event(9, 0, user=3) | {"event_time": "2024-01-02T00:00:00+00:00"}
    lines(tmp_path / "in/b.json", [closing])
    drained(streams.stream_sessions(streams.stream_events(spark, str(tmp_path / "in"), 1)), "sessions")
    assert {(r["user_id"], r["n"]) for r in spark.table("sessions").collect()} == {(1, 2), (2, 1)}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i % 9, i, i % 5, "buy" if i % 5 == 0 else "pv", 1700000000 + i * 977) for i in range(400)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, category_id long, behavior_type string, timestamp long")
    return models.train_purchase_model(models.purchase_features(df), trees=5, depth=4)


DIRTY = [("1", "2", "0", "pv", "1700000000"), ("1", "2", "not_a_number", "pv", "1700000000"), ("1", "2", None, "pv", "1700000000"), (None, "2", "3", "pv", "-999999999"), ("1", "2", "3", "pv", None)]
RAW = "user_id string, item_id string, category_id string, behavior_type string, timestamp string"


def test_scores_and_row_errors(spark, tmp_path, model):
    df = spark.createDataFrame(DIRTY, RAW)
    got = models.score(df, model, 4).collect()
    assert sorted(r["predicted_label"] for r in got)[:3] == [-1, -1, -1] and len(got) == 5
    assert all((r["error"] is None) == (r["predicted_label"] >= 0) for r in got)
    assert models.split_dead_letters(df, strict=True)[1].count() == 4
    models.save_model(model, f"{tmp_path}/m")
    again = models.score(df, models.load_model(f"{tmp_path}/m"), 4).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(again, key=key) == sorted(got, key=key)


def test_scoring_stream(spark, tmp_path, model):
    os.makedirs(tmp_path / "in")
    (tmp_path / "in/a.csv").write_text("".join(",".join(x or "" for x in r) + "\n" for r in DIRTY))
    q = streams.stream_score(streams.stream_behavior(spark, str(tmp_path / "in")), model, f"{tmp_path}/good", f"{tmp_path}/dead", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert q.exception() is None
    assert spark.read.parquet(f"{tmp_path}/good").count() == 2
    dead = spark.read.json(f"{tmp_path}/dead")
    assert dead.count() == 3 and {"timestamp", "error", "original_data"} <= set(dead.columns)


def test_jobs(spark, tmp_path):
    rows = [(u, i, i % 3, "pv" if i % 2 else "cart", 1700000000 + i * 60) for u in range(5) for i in range(20)] + [(99, i, 1, "pv", 1700000000 + i) for i in range(200)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, category_id long, behavior_type string, timestamp long")
    back = jobs.clean_to_partitions(spark, df, f"{tmp_path}/in")
    assert back.count() == 300
    got = jobs.elt_to(spark, f"{tmp_path}/in", f"{tmp_path}/out", jobs.EltConfig()).first()
    assert got["step1_users"] == got["step2_users"] == 5
    kept = spark.read.parquet(f"{tmp_path}/out")
    assert kept.filter("user_id = 99").count() == 0 and kept.filter("session_id is null").count() == 0


def test_suspects_are_left_out_before_sessions(spark):
    df = spark.createDataFrame([(1, 1, 1, "pv", 5)], "user_id long, item_id long, category_id long, behavior_type string, timestamp long")
    plan = jobs.elt(df, jobs.EltConfig())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("LeftAnti")


def test_registered_models_are_whole(spark, sf, monkeypatch):
    from tidewater.plans import registry

    seen = []
    train = models.train_purchase_model

    def small(df, trees=100, depth=10, seed=42):
        seen.append((trees, depth))
        return train(df, 2, 2, seed)

    monkeypatch.setattr(models, "train_purchase_model", small)
    registry.queries()["m15_feature_ranking"](spark, sf)
    assert seen == [(100, 10)]
    assert registry.queries()["m7_cross_validate"](spark, sf).count() == 7  # five folds, mean and deviation
    assert seen == [(100, 10)] * 6


def test_trees_train_on_partitions_that_go_by_size(spark, monkeypatch):
    """Not on those of the shuffle before it: every round of every tree is a job over them."""
    seen = []
    fit = models.Pipeline.fit

    def spied(self, df, params=None):
        seen.append(df.rdd.getNumPartitions())
        return fit(self, df, params)

    monkeypatch.setattr(models.Pipeline, "fit", spied)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = spark.createDataFrame([(i, float(i % 7), float(i % 3), float(i % 2)) for i in range(300)], "id long, x double, y double, label double")
        got = models.ablation(rows, {"A": ["x"], "B": ["x", "y"]}, "id", rounds=2, depth=2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [g[0] for g in got] == ["A", "B"]
    assert len(seen) == 2 and max(seen) <= 16


def test_a_forest_grows_over_groups_of_equal_rows(spark, monkeypatch):
    """What a tree is fitted on doesn't grow with the rows, and a thousand copies of rows make the same shares."""
    few = spark.createDataFrame([(i, i % 4, "buy" if i % 4 == 1 or i % 24 == 0 else "pv", 1700000000 + (i % 24) * 3600) for i in range(480)], "user_id long, category_id long, behavior_type string, timestamp long")
    rows = models.purchase_features(few.crossJoin(spark.range(100).select("id")))
    seen = []
    fit = models.RandomForestClassifier.fit

    def spied(self, df, params=None):
        seen.append(df.count())
        return fit(self, df, params)

    monkeypatch.setattr(models.RandomForestClassifier, "fit", spied)
    model = models.train_purchase_model(rows, trees=6, depth=6)
    assert len(seen) == 6 and max(seen) <= 48  # 24 hours, each with one category, and two labels
    assert model.stages[-1].getNumTrees == 6 and len(model.stages[-1].trees) == 6
    wrong = model.transform(rows).filter("prediction != label").count()
    assert wrong == 0


def test_folders_are_written_without_a_sort(spark, tmp_path):
    """A sort before the write holds all rows of a task in memory."""
    sorts = []
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("flag"))
    for i, write in enumerate((io.write_partitioned, io.write_file_a_folder)):
        write(df, f"{tmp_path}/{i}", ["flag"])
        back = io.read_partitioned(spark, f"{tmp_path}/{i}")
        assert {(r["flag"], r["n_files"], r["n_rows"]) for r in io.layout_report(back, ["flag"]).collect()} == {(0, 1, 334), (1, 1, 333), (2, 1, 333)}
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    for k in range(runs.size()):
        run = runs.apply(k)
        if f"{tmp_path}/" in run.physicalPlanDescription() and "InsertIntoHadoopFsRelationCommand" in run.physicalPlanDescription():
            sorts.append("Sort " in run.physicalPlanDescription())
    assert len(sorts) == 2 and not any(sorts)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0") == "0"


def test_a_row_group_is_read_once_for_its_batches(spark, tmp_path, monkeypatch):
    from tidewater.streaming import row_batches

    spark.range(500).repartition(1).write.parquet(f"{tmp_path}/in")
    reads = []
    read = row_batches.pq.ParquetFile.read_row_group
    monkeypatch.setattr(row_batches.pq.ParquetFile, "read_row_group", lambda self, *a, **k: reads.append(a) or read(self, *a, **k))
    reader, at, got = row_batches.RowReader(f"{tmp_path}/in", 50, ["id"]), {"row": 0}, []
    for _ in range(11):
        rows, at = reader.read(at)
        got += rows
    assert sorted(got) == [(i,) for i in range(500)] and len(reads) == 1


def test_batches_of_rows_do_not_each_cost_a_round(spark, sf):
    from tidewater.plans import registry

    with streams.watching(spark) as log:
        got = registry.queries()["st6_row_batches"](spark, sf)
        n = got.count()
    rounds = [r["rows"] for r in log.table().collect() if r["rows"]]
    assert n == sum(rounds) == spark.read.parquet(f"{sf}/events.parquet").count() and got.filter("not bounded").count() == 0
    assert len(rounds) == 2  # one for each half, however many batches


def test_a_call_gets_a_batch_whole_and_nothing_else(spark, tmp_path):
    """Over row groups that aren't multiples of a batch, Arrow parts smaller and larger than one, and a stop."""
    import uuid

    import pyarrow as pa
    import pyarrow.parquet as pq

    from tidewater.streaming import row_batches

    def named(batch):
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([uuid.uuid4().hex] * batch.num_rows)], names=[*batch.schema.names, "call"])

    (tmp_path / "in").mkdir()
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for i, part in enumerate((3, 10_000)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", part)
            pq.write_table(pa.table({"id": pa.array(range(i * 1000, i * 1000 + 1000), pa.int64()), "at": pa.array(range(1000), pa.timestamp("ms"))}), f"{tmp_path}/in/{i}.parquet", row_group_size=330)
            stream = row_batches.by_batch(row_batches.stream_batches(spark, f"{tmp_path}/in", 7), named, "id long, at timestamp_ntz, row_batch long, call string")
            query = stream.writeStream.format("parquet").options(path=f"{tmp_path}/out", checkpointLocation=f"{tmp_path}/cp").start()
            query.processAllAvailable()
            query.stop()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r["id"] for r in rows) == list(range(2000))
    calls = {}
    for r in rows:
        calls.setdefault(r["call"], []).append((r["row_batch"], r["id"]))
    first = sorted(min(i for _, i in c) for c in calls.values())
    # groups of 330 rows: 47 batches of 7 and one of 1, and 1 batch of 7 and one of 3 for the last 10
    assert first == [f * 1000 + g * 330 + k for f in range(2) for g in range(4) for k in range(0, min(330, 1000 - g * 330), 7)]
    assert all({b for b, _ in c} == {min(i for _, i in c)} and len(c) <= 7 for c in calls.values())


def _sessions(events, gap):
    out = []
    for user, t in sorted(events):
        if out and out[-1][0] == user and t - out[-1][2] <= gap:
            out[-1][2:] = [t, out[-1][3] + 1]
        else:
            out.append([user, t, t, 1])
    return out


class _Bucket:
    """State and timers of one key, which count what is asked of them."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        raise AssertionError("an entry a session")

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


def test_session_state_is_called_by_bucket():
    rng, gap = random.Random(5), 60
    big = 1 << 60  # beyond what a double holds
    events = [(big + rng.randint(0, 300), rng.randint(0, 4000)) for _ in range(5000)]
    early, late = [e for e in events if e[1] < 2000 or e[1] % 7 == 0], [e for e in events if e[1] >= 2000 and e[1] % 7]
    bucket = _Bucket()
    machine = session_state.SessionMachine(gap)
    machine.init(bucket)
    frames = lambda rows: iter([pd.DataFrame(rows[k::3], columns=["user_id", "timestamp"]) for k in range(3)])
    sent = []
    for rows, passed in ((early, 1500), (late, 3000), ([], 10**6)):
        if rows:
            assert not list(machine.handleInputRows((0,), frames(rows), None))
        assert bucket.timers and min(bucket.timers) <= (min(bucket.value[2]) + gap) * 1000 + 1
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda passed=passed: passed * 1000)
        for frame in machine.handleExpiredTimer((0,), now, None):
            assert (frame["last"] + gap < passed).all()
            sent += frame.values.tolist()
    assert sorted(sent) == _sessions(events, gap) and bucket.value is None
    assert bucket.calls <= 15  # for thousands of sessions


def test_open_sessions_are_told_by_user(spark, tmp_path):
    """Two runs of one stream: a session goes on in the second, late events join two, and a bucket of users is one row of the state."""
    gap, first, second = 100, [(1, 1000), (1, 1090), (2, 1500), (2, 1700), (3, 1900), (4, 2000)], [(2, 1600), (4, 2100), (5, 5000)]
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, session_state.PROVIDER)
    try:
        for rows in (first, second):
            spark.createDataFrame(rows, "user_id long, timestamp long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            source = spark.readStream.schema("user_id long, timestamp long").parquet(f"{tmp_path}/in")
            stream = session_state.session_machine(source, gap, delay="600 seconds", buckets=1)
            stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(conf, before)
    ended, still = (sorted(map(tuple, df.collect())) for df in (io.read_table(spark, f"{tmp_path}/out"), session_state.open_sessions(spark, f"{tmp_path}/cp")))
    assert still == [(5, 5000, 5000, 1)]
    assert ended == [(1, 1000, 1090, 2), (2, 1500, 1700, 3), (3, 1900, 1900, 1), (4, 2000, 2100, 2)]
    assert spark.read.format("statestore").option("stateVarName", "open").load(f"{tmp_path}/cp").count() == 1
