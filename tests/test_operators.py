"""Operators on small frames: boundaries, ties, nulls and empty input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewater.operators import bots, clean, extract, features, funnel, profile, report, sessions, validate


@pytest.fixture
def events(spark):
    def make(rows):
        return spark.createDataFrame(rows, "user_id long, timestamp long, behavior_type string")

    return make


def test_session_gap_is_inclusive(events):
    got = sessions.sessionize(events([(1, 0, "pv"), (1, 1799, "pv"), (1, 3599, "pv"), (1, 5400, "pv"), (2, 9, "pv")])).orderBy("user_id", "timestamp").collect()
    assert [r["session_id"] for r in got] == ["1_1", "1_1", "1_1", "1_2", "2_1"]


def test_session_order_is_that_of_time(events):
    got = sessions.sessionize(events([(1, 9000, "pv"), (1, 0, "pv"), (1, 0, "buy")]), first_ordinal=2).orderBy("timestamp").collect()
    assert [r["session_id"] for r in got] == ["1_2", "1_2", "1_3"]


def test_sessions_partition_the_rows(events):
    e = events([(i % 7, (i * 7919) % 50000, "pv") for i in range(500)])
    got = sessions.sessionize(e, tiebreak=["behavior_type"])
    assert got.count() == 500
    assert validate.check_sessions(got).first()["passed"]


def test_hysteresis(spark):
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate((0.5, 0.9, 0.5, 0.2, 0.5))], "s string, t int, x double")
    assert [r["is_on"] for r in sessions.hysteresis(df, "s", ["t"], "x").orderBy("t").collect()] == [False, True, True, False, False]


def test_bot_tiers(spark):
    row = lambda u, peak, pv, buy, total: (u, total, 1, 1.0, peak, 1, None, 1.0, pv, 0, 0, buy)
    names = "user_id long, total_actions long, active_hours long, avg_actions_per_hour double, max_actions_per_hour long, min_actions_per_hour long, std_actions_per_hour double, avg_behavior_type_count double, total_pv_count long, total_cart_count long, total_fav_count long, total_buy_count long"
    users = spark.createDataFrame([row(1, 99, 9, 0, 9), row(2, 100, 9, 0, 9), row(3, 300, 9, 0, 9), row(4, 301, 9, 0, 9), row(5, 501, 9, 0, 9), row(6, 501, 99, 1, 100), row(7, 501, 99, 0, 100)], names)
    got = {r["user_id"]: (r["suspect_level"], r["is_pv_dominant"]) for r in bots.bots_combined(users).collect()}
    assert got == {2: ("low", True), 3: ("low", True), 4: ("medium", True), 5: ("high", True), 6: ("low", False), 7: ("high", False)}
    assert {r["user_id"]: r["suspect_level"] for r in bots.bots_by_frequency(users).collect()}[6] == "high"


def test_threshold_grid_keeps_zero_cells(spark, events):
    users = bots.user_activity(bots.hourly_activity(events([(1, 0, "pv"), (1, 1, "pv")])))
    assert {tuple(r) for r in bots.threshold_grid(users, [2, 3], [1]).collect()} == {(2, 1, 1), (3, 1, 0)}


def test_funnel_cases(events):
    got = funnel.funnel(funnel.behavior_matrix(events([(1, 0, "buy"), (2, 0, "pv"), (2, 1, "buy"), (3, 0, "pv"), (3, 1, "fav"), (3, 2, "buy")]))).first()
    assert (got["step1_users"], got["step2_users"], got["step3_users"], got["overall_conversion_rate"]) == (2, 1, 1, 50.0)
    none = funnel.funnel(funnel.behavior_matrix(events([]))).first()
    assert none["step1_users"] == 0 and none["overall_conversion_rate"] == 0.0


def test_dedup_is_idempotent(events):
    e = events([(1, 0, "pv"), (1, 0, "pv"), (1, 1, "pv")])
    once = clean.dedup(e, ["user_id", "timestamp"], ["behavior_type"])
    assert once.count() == clean.dedup(once, ["user_id", "timestamp"], ["behavior_type"]).count() == 2


def test_exclude_and_keep_make_all(events):
    e = events([(i, 0, "pv") for i in range(10)])
    keys = e.filter("user_id < 3").select(F.col("user_id").cast("string"))
    assert clean.exclude_keys(e, keys, "user_id").count() == 7
    assert clean.exclude_keys(e, keys.limit(0), "user_id").count() == 10


def test_mask_keeps_place_and_blank(spark):
    df = spark.createDataFrame([(1, "u", 2), (2, "", 3), (3, None, 4)], "a int, user string, b int")
    got = clean.mask_sha256(df, "user", "masked")
    assert got.columns == ["a", "masked", "b"]
    assert [len(r["masked"]) if r["masked"] is not None else None for r in got.orderBy("a").collect()] == [64, 0, None]


def test_blank_and_typos(spark):
    df = spark.createDataFrame([("1", "logn"), (" ", "click"), (None, "click"), ("2", "other")], "event_id string, event_type string")
    got = clean.remap(clean.drop_blank(df, "event_id"), "event_type", clean.EVENT_TYPOS).collect()
    assert {tuple(r) for r in got} == {("1", "login"), ("2", "other")}
    assert len(clean.EVENT_TYPOS) == 16


@pytest.mark.parametrize("query,want", [("GO+D", {1, 2}), ("(", {3}), ("", {1, 2, 3, 4})])
def test_search(spark, query, want):
    df = spark.createDataFrame([(1, "good"), (2, "GOOOD"), (3, "a (b"), (4, None)], "id int, t string")
    assert {r["id"] for r in clean.search_text(df, "t", query).collect()} == want


@pytest.mark.parametrize("keys,n", [("3,7", 2), ("", 9), ("3,x", 9), (" 1 ", 1)])
def test_subset(spark, keys, n):
    assert clean.subset_rows(spark.range(9), "id", keys).count() == n


def test_null_report_and_json(spark):
    df = spark.createDataFrame([(None, '{"os": "a"}'), ("", "{broken"), ("x", '{"no": 1}')], "c string, j string")
    assert tuple(profile.null_report(df.select("c")).first()) == ("c", 1, 2, 66.6667)
    assert {(r["value"], r["n"]) for r in profile.json_field_distribution(df, "j", "$.os").collect()} == {("a", 1), ("unknown", 2)}


def test_shares_sum_to_100(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"))
    assert abs(profile.value_shares(df, "k", 6).agg(F.sum("pct")).first()[0] - 100) < 1e-3


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(21)], "x double")
    got = {r["bin"]: r["n"] for r in profile.histogram(df, "x", 20).collect()}
    assert got[19] == 2 and sum(got.values()) == 21 and set(got) == set(range(20))


def test_scaler_fills_and_keeps_constant_columns(spark):
    df = spark.createDataFrame([("1", 5), ("2", 5), ("3", 5), ("10", 5), ("bad", 5)], "a string, b int")
    params = features.fit_scaler(df, ["a", "b"])
    assert params["a"][0] == 2.5 and params["b"] == (5.0, 5.0, 1.0)
    got = features.apply_scaler(df, params).agg(F.avg("a_scaled"), F.stddev_pop("a_scaled"), F.max("b_scaled")).first()
    assert abs(got[0]) < 1e-9 and abs(got[1] - 1) < 1e-9 and got[2] == 0


def test_samples_and_splits_are_stable(spark):
    df = spark.range(5000).select("id", (F.col("id") % 5 == 0).cast("int").alias("y"))
    s = features.stratified_sample(df, "y", 1000, "id")
    assert 850 < s.count() < 1150 and abs(s.agg(F.avg("y")).first()[0] - 0.2) < 0.05
    assert s.count() == 1000 and s.agg(F.sum("y")).first()[0] == 200
    train, test = features.split_stratified(df, "y", "id")
    assert test.count() == 1000 and test.agg(F.sum("y")).first()[0] == 200
    folds = features.stratified_folds(df, "y", "id").groupBy("fold").agg(F.count("*"), F.sum("y")).collect()
    assert sorted(map(tuple, folds)) == [(i, 1000, 200) for i in range(5)]
    assert train.count() + test.count() == 5000 and train.join(test, "id").count() == 0
    assert features.sample_n(df, 10, "id").collect() == features.sample_n(df.repartition(7), 10, "id").collect()


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1)], "y int, s double")
    assert features.binary_metrics(df, "y", "s").first()["auc"] == 0.875


def test_reply_cases(spark):
    good = '{"sentiment": "正面", "category": "质量", "summary": "ok"}'
    rows = [good, "no json", '{"sentiment": "正面"}', good.replace("正面", "bad"), good.replace("ok", "x" * 16), good + " more", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, reply string")
    got = {r["id"]: r["format_valid"] for r in extract.validate_reply(df, "reply").collect()}
    assert got == {0: True, **{i: False for i in range(1, 7)}}


def test_extract_retries_and_reports_failures(spark, tmp_path):
    def client(text):
        if text == "bad":
            raise ValueError("down")
        return text.upper()

    df = spark.createDataFrame([(1, "a"), (2, "bad")], "id int, t string")
    got = {r["id"]: r["reply"] for r in extract.extract(df, "t", client, wait=0.01).collect()}
    assert got[1] == "A" and got[2].startswith("调用失败") and df.columns == ["id", "t"]


def test_reports(spark):
    df = spark.createDataFrame([(1, "en", "pos and neg", "positive"), (2, "en", None, None)], "id int, cat string, review string, sentiment string")
    assert report.drilldown(df, None).count() == 0 and report.drilldown(df, "en").first()["n"] == 1
    assert report.word_counts(df, ["review"], stopwords=("and",)).count() == 2
    scored = spark.createDataFrame([(1, 0.8), (0, 0.2), (-1, -1.0)], "predicted_label int, buy_probability double")
    assert tuple(report.scoring_summary(scored).first()) == (3, 1, 50.0, 0.5)


def test_checks(events):
    assert validate.check_columns(events([])) == ["item_id", "session_id"]
    assert not validate.check_funnel(events([(1, 0, "buy")])).first()["passed"]


def test_every_typo_is_mended(spark):
    from tidewater.operators import clean

    rows = [(k,) for k in clean.EVENT_TYPOS]
    got = clean.remap(spark.createDataFrame(rows, "event_type string"), "event_type", clean.EVENT_TYPOS).groupBy("event_type").count().collect()
    assert {tuple(r) for r in got} == {(k, 4) for k in ("click", "login", "logout", "payment")}


def test_the_elt_summary_sums_users_once(spark, sf):
    """One deduplicated branch for the rows, one for the suspects; none is repeated for the statistics."""
    import contextlib
    import io

    from tidewater.plans import jobs, registry
    from tidewater.plans.shapes import behavior

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        jobs.elt_funnel(behavior(spark, sf), registry.ELT).explain()
    plan = out.getvalue().split("Initial Plan")[0]
    assert plan.count("FileScan") <= 2 and plan.count("CartesianProduct") == 0 and "BroadcastNestedLoopJoin" not in plan


def test_characters_are_counted_without_lambdas(spark):
    """Lambdas over every character of a text are interpreted; code points beyond 16 bits, line ends and empty texts count as before."""
    texts = ["aAb\n", "", None, "\U0001f600x\U0001f600", " é é", "z" * 3000]
    got = features.char_counts(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t")
    want = {(k, c, n) for k, t in enumerate(texts) if t for c, n in Counter(t.lower()).items()}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert got.columns == ["k", "term", "tf"] and "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_extraction_holds_few_texts_at_a_time(spark, tmp_path):
    """However many rows a batch from Spark has, ``SLICE`` of them are asked and passed on before the next."""
    rows = spark.range(3 * extract.SLICE + 1).repartition(1).select("id", F.concat(F.lit("t"), "id").alias("t"), F.array(F.lit("x")).alias("tags"))
    got = extract.extract(rows.withColumn("t", F.when(F.col("id") > 0, F.col("t"))), "t", lambda t: "none" if t is None else t.upper())
    assert {(r["id"], r["reply"], *r["tags"]) for r in got.collect()} == {(i, f"T{i}" if i else "none", "x") for i in range(3 * extract.SLICE + 1)}
    node = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in node and "MapInPandas" not in node
