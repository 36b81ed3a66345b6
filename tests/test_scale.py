"""What must hold for hot users, skewed values and long runs: results as before, tasks even, few exchanges."""

import json
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators import attributions, bots, clean, extract, features, models, profile, ranks, sessions
from tidewater.plans import jobs, registry
from tidewater.sources import io
from tidewater.streaming import row_batches, streams

EVENTS = "event_id long, user_id long, item_id long, category_id long, behavior_type string, timestamp long"


@pytest.fixture(scope="module")
def events(spark):
    """One user has a third of the rows; times repeat, and some rows are without time or user."""
    rng = random.Random(1)
    rows = [(i, 1 if i % 3 == 0 else rng.randrange(2, 60), rng.randrange(30), rng.randrange(5), rng.choice(["pv", "pv", "pv", "cart", "fav", "buy"]), 1_700_000_000 + rng.randrange(40 * 86400)) for i in range(6000)]
    rows += [(10_000 + i, 1, 1, 1, "pv", 1_700_000_000) for i in range(50)]
    rows += [(20_000 + i, 1 if i % 2 else None, 1, 1, "pv", None if i < 6 else 1_700_000_000 + i) for i in range(12)]
    return spark.createDataFrame(rows, EVENTS).repartition(5).persist()


@pytest.mark.parametrize("block", [600, 3600, 86400, 400 * 86400])
def test_sessions_in_blocks_are_the_sessions(events, block):
    cols = ["event_id", "prev_timestamp", "time_diff_seconds", "is_new_session", "session_group", "session_id"]
    plain = sessions.sessionize(events, timeout=1800, tiebreak=["event_id"], first_ordinal=3)
    split = sessions.sessionize(events, timeout=1800, tiebreak=["event_id"], first_ordinal=3, block=block)
    assert split.columns == plain.columns
    key = lambda r: r["event_id"]
    assert sorted(split.select(*cols).collect(), key=key) == sorted(plain.select(*cols).collect(), key=key)


def test_no_window_task_has_more_than_a_block(events):
    marks = sessions.marked(sessions.in_blocks(events, "user_id", "timestamp", 86400), "timestamp", 1800)
    assert marks.groupBy("_user", "_block").count().agg(F.max("count")).first()[0] < events.count() / 30


ELT = jobs.EltConfig(bucket_seconds=86400, threshold=9, block_seconds=5 * 86400, tiebreak=["event_id"])


def test_elt_is_that_of_its_steps(spark, events):
    unique = clean.dedup(events, ELT.dedup_keys, ELT.tiebreak)
    bad = bots.bots_combined(bots.user_activity(bots.hourly_activity(unique, seconds=ELT.bucket_seconds)), ELT.threshold, ELT.min_hours, ELT.high, ELT.medium)
    kept = unique.join(bad.select("user_id"), "user_id", "left_anti")
    want = sessions.sessionize(kept, timeout=ELT.timeout, tiebreak=["event_id"])
    assert 0 < bad.count() < 60
    pick = lambda df: sorted(map(str, df.select("event_id", "session_id").collect()))
    got = jobs.elt(events, ELT)
    assert got.columns == [*events.columns, "session_id"]
    assert pick(got) == pick(want)
    assert sorted(r[0] for r in jobs.export(events, ELT).select("event_id").collect()) == sorted(r[0] for r in kept.select("event_id").collect())
    row = jobs.elt_funnel(events, ELT).first()
    assert row["n_rows"] == want.count() and row["n_sessions"] == want.select("session_id", "user_id").distinct().count()
    other = jobs.EltConfig(dedup_keys=["event_id"], bucket_seconds=86400, threshold=9)
    assert jobs.elt(events, other).count() == jobs.export(events, other).count()


def exchanges(df):
    """What each hash exchange of the plan deals, without adaptive re-planning; reused ones are not told again."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [x.strip(" +-:*()0123456789") for x in lines if "Exchange hashpartitioning" in x and "ReusedExchange" not in x]


def test_elt_deals_the_events_by_user_and_block_only(spark, events, tmp_path):
    events.withColumn("more", F.lit("x")).write.parquet(path := f"{tmp_path}/events")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # the summary needs no column but those that decide, so both its uses of the events are one exchange
        for job, n in ((jobs.elt, 2), (jobs.elt_funnel, 1), (jobs.export, 2)):
            found = exchanges(job(spark.read.parquet(path), ELT))
            assert sum("REPARTITION_BY_COL" in x for x in found) == n, found
            # the others deal sums by user or block
            assert not [x for x in found if "item_id" in x or "timestamp" in x]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_table_in_buckets_needs_no_exchange_by_user(spark, events):
    table = io.write_bucketed(events, "events_in_buckets", "user_id", ["timestamp"], 4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = jobs.elt_by_user(table, ELT)
        assert not exchanges(got)
        assert sorted(map(str, got.select("event_id", "session_id").collect())) == sorted(map(str, jobs.elt(events, ELT).select("event_id", "session_id").collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sql("DROP TABLE events_in_buckets")


def test_in_order_is_even_for_skewed_values(spark):
    values = [1.0 + i * 1e-9 for i in range(4000)] + [1e18, -1e18, None]
    df = spark.createDataFrame([(v, i % 7, -i) for i, v in enumerate(values)], "v double, w long, number long")
    got = ranks.in_order(df.drop("number"), [F.col("v").asc_nulls_first()], {"before": "w"}).orderBy("number").collect()
    assert [r["number"] for r in got] == list(range(len(values)))
    assert [r["v"] for r in got] == sorted(values, key=lambda v: (v is not None, v))
    total = 0
    for r in got:
        assert r["before"] == total
        total += r["w"]
    dealt = df.repartitionByRange(8, F.col("v").asc_nulls_first()).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in dealt) < 3 * len(values) / 8
    assert ranks.in_order(df.limit(0), ["v"], {"before": "w"}, "no").count() == 0


@pytest.mark.parametrize("accuracy", [3, 50, 10_000])
def test_quantiles_are_exact(spark, accuracy):
    rng = random.Random(2)
    columns = {"even": [float(rng.randrange(1000)) for _ in range(801)], "skewed": [rng.random() ** 40 for _ in range(800)] + [1e300], "same": [2.5] * 801, "gaps": [None if i % 3 else float(i) for i in range(801)], "none": [None] * 801, "one": [None] * 800 + [7.0]}
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(5)
    cols, ps = {c: F.col(c) for c in columns}, [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    row = df.agg(*ranks.sketches(cols, ps, accuracy)).first()
    got = ranks.exact_quantiles(df, cols, ps, row, accuracy)
    for c, values in columns.items():
        kept = sorted(v for v in values if v is not None)
        for p, found in zip(ps, got[c]):
            if not kept:
                assert found is None
                continue
            at = (len(kept) - 1) * p
            low, high = kept[int(at)], kept[min(int(at) + 1, len(kept) - 1)]
            assert found == pytest.approx(low + (high - low) * (at - int(at)), rel=1e-12)


def test_describe_and_scaler(spark):
    df = spark.createDataFrame([("1",), ("2",), ("x",), (None,), ("10",), ("3",)], "c string")
    median, mean, std = features.fit_scaler(df, ["c"])["c"]
    filled = [1, 2, 2.5, 2.5, 10, 3]
    assert (median, mean, std) == pytest.approx((2.5, statistics.fmean(filled), statistics.pstdev(filled)))
    assert features.fit_scaler(df.limit(0), ["c"])["c"] == (None, None, 1.0)
    empty = profile.describe_numeric(spark.createDataFrame([], "a double"), ["a"]).first()
    assert empty["n"] == 0 and empty["p50"] is None


def test_codes_and_areas_of_crowded_values(spark):
    df = spark.createDataFrame([(i, f"prefix-{i % 500:04d}" if i % 11 else None) for i in range(2000)], "id long, c string")
    got = {r["c"]: r["c_code"] for r in features.ordinal_encode(df, ["c"]).collect()}
    names = sorted({"Unknown" if c is None else c for c in got})
    assert all(names[code] == ("Unknown" if c is None else c) for c, code in got.items())
    rng = random.Random(5)
    rows = [(rng.randrange(2), rng.choice([0.5, 0.5 + 1e-12, 0.5 + 2e-12, 1e9])) for _ in range(600)]
    pairs = [(a > b) + 0.5 * (a == b) for la, a in rows if la for lb, b in rows if not lb]
    assert features.binary_metrics(spark.createDataFrame(rows, "label int, s double"), "label", "s").first()["auc"] == pytest.approx(sum(pairs) / len(pairs), abs=1e-6)


def test_tallies_of_more_batches_than_spark_remembers(spark, tmp_path):
    spark.range(0, 130, 1, 130).select(F.col("id").cast("string").alias("user_id")).write.csv(f"{tmp_path}/in")
    stream = spark.readStream.schema("user_id string").option("maxFilesPerTrigger", 1).csv(f"{tmp_path}/in")
    with streams.watching(spark, f"{tmp_path}/log") as log:
        query = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        told = streams.run_for(query, 300, log, every=2)
    assert told["total_rows"] == 130 and len(query.recentProgress) <= 100
    frame = streams.progress_frame(log, query, 2)
    assert frame.count() >= 130 and frame.agg(F.max("load")).first()[0] <= 1
    assert spark.read.parquet(f"{tmp_path}/log").agg(F.sum("rows")).first()[0] == 130


def test_row_batches_go_on_after_a_stop(spark, tmp_path):
    def add(first, n):
        spark.range(first, first + n).selectExpr("id", "string(id) as s").coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")

    def run(log):
        query = row_batches.stream_rows(spark, f"{tmp_path}/in", 7).writeStream.format("parquet").options(path=f"{tmp_path}/out", checkpointLocation=f"{tmp_path}/cp").start()
        query.processAllAvailable()
        query.stop()
        log.wait(query)

    add(0, 40)
    with streams.watching(spark) as log:
        run(log)
        run(log)  # nothing new
        add(40, 33)
        run(log)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r["id"] for r in got.collect()) == list(range(73)) and got.filter("s != string(id)").count() == 0
    sizes = [r["rows"] for r in log.table().filter("rows > 0").collect()]
    assert max(sizes) == 7 and sum(sizes) == 73


def test_stored_replies_are_not_asked_again(spark, tmp_path):
    calls, mark = str(tmp_path / "calls"), str(tmp_path / "died")

    def client(text):
        if text == "p5" and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)  # the worker dies half-way
        with open(calls, "a") as f:
            f.write(text + "\n")
        if text == "p9":
            raise ValueError("always")
        return text.upper()

    df = spark.createDataFrame([(i, f"p{i % 10}" if i else None) for i in range(40)], "id long, t string").coalesce(1)
    store = f"{tmp_path}/store"
    ask = lambda: extract.extract_stored(df, "t", client, store, parallel=1, size=1, wait=0.0, retries=2)
    with pytest.raises(Exception, match="."):
        ask().collect()
    first = open(calls).read().split("\n") if os.path.exists(calls) else []
    got = {r["id"]: r["reply"] for r in ask().collect()}
    assert got == {i: "" if i == 0 else extract.ERROR_WORDS[2] if i % 10 == 9 else f"P{i % 10}" for i in range(40)}
    ask().collect()
    asked = [x for x in open(calls).read().split("\n")]
    good = [x for x in asked if x and x != "p9"]
    assert len(good) == len(set(good)) == 9, first


def test_parts_sum_to_the_margin_and_are_those_of_all_subsets(spark):
    rng = random.Random(8)
    rows = [(i, [float(rng.randrange(4)), rng.random(), rng.random()]) for i in range(300)]
    rows = [(i, x, float(x[0] > 1 and x[1] < 0.6 or x[2] > 0.9)) for i, x in rows]
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    df = spark.createDataFrame(rows, "id long, x array<double>, label double").withColumn("features", array_to_vector("x"))
    model = GBTClassifier(maxIter=6, maxDepth=3, seed=1).fit(df)
    got = {r["id"]: r for r in attributions.attributions(df, model, "id").collect()}
    margins = {r["id"]: r["m"] for r in model.transform(df).select("id", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    leaves = attributions.paths(model)

    def value(x, known):
        """The margin if only the features ``known`` are, from the leaves' own shares."""
        return sum(p.value * _product(float(attributions._taken(_array([x[f]]), s)[0]) if f in known else p.share[f] for f, s in p.steps.items()) for p in leaves)

    for i, x, _ in rows[:25]:
        r = got[i]
        assert r["margin"] == pytest.approx(margins[i], abs=1e-9)
        parts = dict(zip(r["places"], r["parts"]))
        for f in range(3):
            a, b = [g for g in range(3) if g != f]
            gain = lambda known: value(x, known | {f}) - value(x, known)  # noqa: B023, E731
            want = gain(set()) / 3 + gain({a}) / 6 + gain({b}) / 6 + gain({a, b}) / 3
            assert parts.get(f, 0.0) == pytest.approx(want, abs=1e-9)
    top = attributions.strongest(attributions.attributions(df, model, "id"), ["a", "b", "c"], 2).collect()
    assert len(top) == 2 and top[0]["weight"] >= top[1]["weight"] > 0


def _product(values):
    out = 1.0
    for v in values:
        out *= v
    return out


def _array(values):
    import numpy as np

    return np.array(values)


def test_text_vectors_are_sparse_and_the_entries(spark):
    rows = [(1, "Abba ab"), (2, ""), (3, None), (4, "zz Zé\n"), (5, "q")]
    df = spark.createDataFrame(rows, "id long, t string")
    vectors, terms = features.tfidf_vectors(df, "id", "t", 4)
    entries = {(r["id"], r["term"]): r["weight"] for r in features.char_tfidf(df, "id", "t", 4).collect()}
    for r in vectors.collect():
        assert type(r["text_vector"]).__name__ == "SparseVector" and r["text_vector"].size == len(terms) == 4
        got = {(r["id"], terms[i]): v for i, v in zip(r["text_vector"].indices, r["text_vector"].values)}
        want = {k: v for k, v in entries.items() if k[0] == r["id"]}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    fused = models.fuse(vectors.withColumn("code", F.lit(0)), ["text_vector", "code"]).first()["features"]
    assert fused.size == 5
