"""Queries and SQL oracles of the behaviour-analytics operators.

``QUERIES`` holds (function, SQL) by name; the SQL's views ``b`` (behaviour events) and
``r`` (reviews) are put before it.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import bots, clean, extract, features, funnel, models, profile, report, sessions, validate
from tidewater.plans import jobs, registry_stored
from tidewater.plans.shapes import BEHAVIOR_SQL, REVIEWS_SQL, behavior, reviews
from tidewater.session import scratch
from tidewater.sources import io
from tidewater.streaming import streams

KINDS = ["pv", "cart", "fav", "buy"]
TIMEOUT = 43200
ELT = jobs.EltConfig(timeout=TIMEOUT, bucket_seconds=86400, threshold=7, high=9, medium=8, tiebreak=["event_id"])
QUERIES: dict = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def _on(shape, name: str, f, sql: str | None) -> None:
    QUERIES[name] = (lambda spark, d: f(shape(spark, d)), sql)


def on_b(name: str, f, sql: str | None = None) -> None:
    _on(behavior, name, f, sql)


def on_r(name: str, f, sql: str | None = None) -> None:
    _on(reviews, name, f, sql)


EVENT = ["event_id", "user_id", "item_id", "behavior_type", "timestamp"]
E = ", ".join(EVENT)

# sources and sinks
_query("s4_read_table", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")(lambda s, d: io.table(s, d, "lineitem").filter("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity"))


@_query("k4_register_view", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def _view(spark: SparkSession, d: str) -> DataFrame:
    io.register(io.table(spark, d, "orders"), "tidewater_orders")
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM tidewater_orders GROUP BY o_orderstatus")



# filters and projections
on_r("p1_drop_blank", lambda r: clean.drop_blank(r.withColumn("sentiment", F.coalesce("sentiment", F.lit(" "))), "sentiment").select("doc_id"), "SELECT doc_id FROM r WHERE trim(coalesce(sentiment, ' ')) <> ''")
on_b("p2_keep_valid_events", lambda b: clean.keep_valid_events(b).select(*EVENT), f"SELECT {E} FROM b WHERE behavior_type IS NOT NULL AND behavior_type <> '' AND timestamp > 0")
on_r("p3_drop_nulls", lambda r: clean.drop_nulls(r, ["label", "cat"]).select("doc_id", "label"), "SELECT doc_id, label FROM r WHERE label IS NOT NULL AND cat IS NOT NULL")
on_b("p4_keep_allowed", lambda b: clean.keep_allowed(b, "behavior_type", KINDS).select(*EVENT), f"SELECT {E} FROM b WHERE behavior_type IN ('pv','cart','fav','buy')")
on_b("p4_invalid_values", lambda b: clean.invalid_values(b, "behavior_type", KINDS), "SELECT DISTINCT behavior_type FROM b WHERE behavior_type NOT IN ('pv','cart','fav','buy')")
on_b("p5_keep_between", lambda b: clean.keep_between(b, "timestamp", 1704100000, 1706000000).select(*EVENT), f"SELECT {E} FROM b WHERE timestamp BETWEEN 1704100000 AND 1706000000")
on_b("p6_keep_past", lambda b: clean.keep_past(b, "timestamp", 1705500000).select(*EVENT), f"SELECT {E} FROM b WHERE timestamp BETWEEN 0 AND 1705500000")
on_b("p6_past_report", lambda b: clean.past_report(b, "timestamp", 1705500000), "SELECT count(*) FILTER (timestamp < 0) AS n_negative, count(*) FILTER (timestamp > 1705500000) AS n_future, count(*) FILTER (timestamp BETWEEN 0 AND 1705500000) AS n_kept FROM b")
on_b("p7_keep_positive", lambda b: clean.keep_positive(b, ["user_id", "item_id", "category_id"]).select(*EVENT), f"SELECT {E} FROM b WHERE user_id > 0 AND item_id > 0 AND category_id > 0")
_query("p8_remap", "SELECT event_id, CASE event_type WHEN 'signup' THEN 'register' WHEN 'error' THEN 'failure' ELSE event_type END AS event_type FROM events")(lambda s, d: clean.remap(io.table(s, d, "events").select("event_id", "event_type"), "event_type", {"signup": "register", "error": "failure"}))
on_b("p9_mask", lambda b: clean.mask_sha256(b.select("event_id", "user_id"), "user_id", "masked_user_id"), "SELECT event_id, sha256(CAST(user_id AS VARCHAR)) AS masked_user_id FROM b")
on_r("p10_map_label", lambda r: r.select("doc_id", "sentiment"), "SELECT doc_id, sentiment FROM r")
on_b("p11_binary_label", lambda b: clean.binary_label(b, "behavior_type", "buy").select("event_id", "label"), "SELECT event_id, CAST(behavior_type = 'buy' AS INTEGER) AS label FROM b")
on_b("p12_flag_unexpected", lambda b: clean.flag_unexpected(b, "behavior_type", KINDS).select("event_id", "is_anomaly"), "SELECT event_id, behavior_type NOT IN ('pv','cart','fav','buy') AS is_anomaly FROM b")
on_r("p13_filter_reviews", lambda r: clean.filter_reviews(r, cat="en", sentiment="positive", category="").select("doc_id"), "SELECT doc_id FROM r WHERE cat = 'en' AND sentiment = 'positive'")
on_r("p14_search_pattern", lambda r: clean.search_text(r, "review", "toKEN\\s*=").select("doc_id"), r"SELECT doc_id FROM r WHERE regexp_matches(review, '(?i)token\s*=')")
on_r("p14_search_literal", lambda r: clean.search_text(r, "review", "+1 (").select("doc_id"), "SELECT doc_id FROM r WHERE contains(lower(review), '+1 (')")
on_r("p15_subset_rows", lambda r: clean.subset_rows(r, "doc_id", "3,7,9").select("doc_id", "cat"), "SELECT doc_id, cat FROM r WHERE doc_id IN (3, 7, 9)")
on_r("p16_row_range", lambda r: clean.row_range(r.select("doc_id", "cat"), "doc_id", 20, 50), "SELECT doc_id, cat FROM r ORDER BY doc_id LIMIT 30 OFFSET 20")
on_r("p17_preview", lambda r: r.select("doc_id", clean.preview("review", 40).alias("preview")), "SELECT doc_id, CASE WHEN length(review) > 40 THEN substring(review, 1, 40) || '...' ELSE review END AS preview FROM r")
on_b("p18_select", lambda b: b.drop("value", "props", "category_id"), f"SELECT {E} FROM b")
on_b("p19_time_columns", lambda b: clean.add_time_columns(b.select("event_id", "timestamp")), "SELECT event_id, timestamp, CAST(make_timestamp(timestamp * 1000000) AS DATE) AS date, CAST(hour(make_timestamp(timestamp * 1000000)) AS INTEGER) AS hour FROM b")

# joins
on_b("j1_exclude_keys", lambda b: clean.exclude_keys(b, b.filter("behavior_type = 'error'").groupBy("user_id").count().filter("count > 14"), "user_id").select(*EVENT), f"SELECT {E} FROM b WHERE user_id NOT IN (SELECT user_id FROM b WHERE behavior_type = 'error' GROUP BY user_id HAVING count(*) > 14)")
_query("j2_augment", "SELECT o_orderkey, o_totalprice, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")(lambda s, d: clean.augment(io.table(s, d, "orders").withColumnRenamed("o_custkey", "k"), io.table(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_name"), "k").select("o_orderkey", "o_totalprice", "c_name"))


def _runs(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two runs over the labelled reviews: their sentiment, and a guess by length."""
    known = r.filter("label is not null")
    guess = F.when(F.length("review") > 1000, "positive").otherwise("negative")
    return known.select("doc_id", "sentiment", "cat"), known.select("doc_id", guess.alias("sentiment"), "cat")


on_r("j3_compare_runs", lambda r: report.compare_runs(*_runs(r), "doc_id", ["sentiment"]), "SELECT doc_id, sentiment AS sentiment_a, CASE WHEN length(review) > 1000 THEN 'positive' ELSE 'negative' END AS sentiment_b, sentiment = CASE WHEN length(review) > 1000 THEN 'positive' ELSE 'negative' END AS sentiment_same FROM r WHERE label IS NOT NULL")
on_r("a27_agreement", lambda r: report.agreement_report(report.compare_runs(*_runs(r), "doc_id", ["sentiment", "cat"]), ["sentiment", "cat"]), "SELECT count(*) AS n, round(avg(CAST(sentiment = CASE WHEN length(review) > 1000 THEN 'positive' ELSE 'negative' END AS INTEGER)), 6) AS sentiment_agreement, CAST(1 AS DOUBLE) AS cat_agreement FROM r WHERE label IS NOT NULL")

# counts and profiles
on_b("a1_value_counts", lambda b: profile.value_counts(b, "behavior_type"), "SELECT behavior_type, count(*) AS n FROM b GROUP BY behavior_type")
on_b("a2_value_shares", lambda b: profile.value_shares(b, "behavior_type"), "SELECT behavior_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM b GROUP BY behavior_type")
on_b("a3_anomaly_summary", lambda b: profile.anomaly_summary(b, "behavior_type", KINDS[:3]), "SELECT count(*) AS n, count(*) FILTER (behavior_type NOT IN ('pv','cart','fav')) AS n_anomaly, round(count(*) FILTER (behavior_type NOT IN ('pv','cart','fav')) / count(*), 6) AS anomaly_ratio, string_agg(DISTINCT CASE WHEN behavior_type NOT IN ('pv','cart','fav') THEN behavior_type END, ',' ORDER BY CASE WHEN behavior_type NOT IN ('pv','cart','fav') THEN behavior_type END) AS anomalies FROM b")
on_b("a4_sentinels", lambda b: profile.sentinel_report(b, "user_id", ["1", "2", "-1"]), "SELECT s AS sentinel, count(*) FILTER (CAST(user_id AS VARCHAR) = s) AS n, round(count(*) FILTER (CAST(user_id AS VARCHAR) = s) / count(*), 6) AS ratio FROM b, (VALUES ('1'), ('2'), ('-1')) v(s) GROUP BY s")
on_b("a5_json_distribution", lambda b: profile.json_field_distribution(b, "props", "$.k"), "SELECT coalesce(json_extract_string(props, '$.k'), 'unknown') AS value, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM b GROUP BY 1")
on_b("a5_json_missing", lambda b: profile.json_field_distribution(b, "props", "$.os"), "SELECT 'unknown' AS value, count(*) AS n, CAST(100 AS DOUBLE) AS pct FROM b")
on_b("a5_version_distribution", lambda b: profile.json_version_distribution(b, "props", r"(\d)\}"), r"SELECT CASE regexp_extract(props, '(\d)\}', 1) WHEN '' THEN 'unknown' ELSE regexp_extract(props, '(\d)\}', 1) END AS value, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM b GROUP BY 1")
on_r("a6_null_report", lambda r: profile.null_report(r.select("cat", "label", "sentiment")), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_null, count(*) FILTER ({c} IS NULL OR CAST({c} AS VARCHAR) = '') AS n_blank, round(count(*) FILTER ({c} IS NULL OR CAST({c} AS VARCHAR) = '') * 100.0 / count(*), 4) AS pct_blank FROM r" for c in ("cat", "label", "sentiment")))
on_b("a7_time_extent", lambda b: profile.time_extent(b), "SELECT min(timestamp) AS min_epoch, max(timestamp) AS max_epoch, strftime(make_timestamp(min(timestamp) * 1000000), '%Y-%m-%d %H:%M:%S') AS min_at, strftime(make_timestamp(max(timestamp) * 1000000), '%Y-%m-%d %H:%M:%S') AS max_at, year(make_timestamp(min(timestamp) * 1000000)) < 1971 AS has_early FROM b")
on_b("a8_cardinalities", lambda b: profile.cardinalities(b, ["user_id", "item_id", "category_id"]), "SELECT count(DISTINCT user_id) AS n_user_id, count(DISTINCT item_id) AS n_item_id, count(DISTINCT category_id) AS n_category_id FROM b")
HOURLY = "SELECT CAST(hour(make_timestamp(timestamp * 1000000)) AS INTEGER) AS hour, count(*) AS n, " + ", ".join(f"count(*) FILTER (behavior_type = '{k}') AS n_{k}" for k in KINDS) + " FROM b GROUP BY 1"
on_b("a9_hourly_profile", lambda b: profile.hourly_profile(b, KINDS), HOURLY)
on_b("a10_peak_hour", lambda b: profile.peak_hour(profile.hourly_profile(b, KINDS), "n_buy"), f"SELECT hour, n_buy FROM ({HOURLY}) ORDER BY n_buy DESC, hour LIMIT 1")
_query("a11_describe", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS low, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, CAST(max({c}) AS DOUBLE) AS high FROM lineitem" for c in ("l_quantity", "l_discount")))(lambda s, d: profile.describe_numeric(io.table(s, d, "lineitem"), ["l_quantity", "l_discount"]))
DUPES = "SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n_duplicates, count(*) FILTER (c > 1) AS n_keys FROM (SELECT count(*) AS c FROM {} GROUP BY {})"
_query("a12_duplicate_rows", DUPES.format("documents", "text"))(lambda s, d: profile.duplicate_count(io.table(s, d, "documents").select("text")))
_query("a13_duplicate_keys", DUPES.format("lineitem", "l_orderkey, l_partkey"))(lambda s, d: profile.duplicate_count(io.table(s, d, "lineitem"), ["l_orderkey", "l_partkey"]))

# bots
HOURS = "h AS (SELECT user_id, floor(timestamp / {s}) AS bucket, count(*) AS actions, count(DISTINCT behavior_type) AS kinds, " + ", ".join(f"count(*) FILTER (behavior_type = '{k}') AS {k}_count" for k in KINDS) + " FROM {b} GROUP BY 1, 2)"
USERS = "u AS (SELECT user_id, CAST(sum(actions) AS BIGINT) AS total_actions, count(*) AS active_hours, avg(actions) AS avg_actions_per_hour, max(actions) AS max_actions_per_hour, min(actions) AS min_actions_per_hour, stddev_samp(actions) AS std_actions_per_hour, avg(kinds) AS avg_behavior_type_count, " + ", ".join(f"CAST(sum({k}_count) AS BIGINT) AS total_{k}_count" for k in KINDS) + " FROM h GROUP BY 1)"
DAILY = f"WITH {HOURS.format(s=86400, b='b')}, {USERS} "


def rounded(*cols: str) -> list:
    return [F.round(c, 6).alias(c) for c in cols]


def daily(b: DataFrame) -> DataFrame:
    return bots.user_activity(bots.hourly_activity(b, seconds=86400))


on_b("a14_hourly_activity", lambda b: bots.hourly_activity(b), f"WITH {HOURS.format(s=3600, b='b')} SELECT user_id, CAST(bucket AS BIGINT) AS bucket, actions, kinds, pv_count, cart_count, fav_count, buy_count FROM h")
on_b("a15_user_activity", lambda b: daily(b).select("user_id", "total_actions", "active_hours", "max_actions_per_hour", "min_actions_per_hour", "total_pv_count", "total_buy_count", *rounded("avg_actions_per_hour", "std_actions_per_hour", "avg_behavior_type_count")), DAILY + "SELECT user_id, total_actions, active_hours, max_actions_per_hour, min_actions_per_hour, total_pv_count, total_buy_count, round(avg_actions_per_hour, 6) AS avg_actions_per_hour, round(std_actions_per_hour, 6) AS std_actions_per_hour, round(avg_behavior_type_count, 6) AS avg_behavior_type_count FROM u")
on_b("a16_threshold_grid", lambda b: bots.threshold_grid(daily(b), [5, 6, 7, 8, 100], [1, 20, 27]), DAILY + "SELECT t AS threshold, m AS min_hours, count(*) FILTER (max_actions_per_hour >= t AND active_hours >= m) AS n_users FROM u, (VALUES (5),(6),(7),(8),(100)) a(t), (VALUES (1),(20),(27)) c(m) GROUP BY 1, 2")
TIER = "CASE WHEN {} THEN 'high' WHEN {} THEN 'medium' ELSE 'low' END AS suspect_level"
on_b("a17_bots_by_frequency", lambda b: bots.bots_by_frequency(daily(b), 7, 1, 8, 7).select("user_id", "max_actions_per_hour", "suspect_level"), DAILY + "SELECT user_id, max_actions_per_hour, " + TIER.format("max_actions_per_hour > 8 OR avg_actions_per_hour > 4", "max_actions_per_hour > 7 OR avg_actions_per_hour > 3.5") + " FROM u WHERE max_actions_per_hour >= 7 AND active_hours >= 1")
COMBINED = (
    "SELECT user_id, total_actions, max_actions_per_hour, is_single_behavior, is_no_purchase, is_pv_only, is_pv_dominant, " + TIER.format("max_actions_per_hour > 9 AND is_no_purchase AND (is_pv_only OR is_pv_dominant OR is_single_behavior)", "max_actions_per_hour > 8 AND is_no_purchase")
    + " FROM (SELECT *, CAST(total_pv_count > 0 AS INT) + CAST(total_cart_count > 0 AS INT) + CAST(total_fav_count > 0 AS INT) + CAST(total_buy_count > 0 AS INT) = 1 AS is_single_behavior, total_buy_count = 0 AS is_no_purchase, total_pv_count = total_actions AS is_pv_only, total_pv_count / total_actions > 0.99 AS is_pv_dominant FROM u WHERE max_actions_per_hour >= 7 AND active_hours >= 1)"
)
on_b("a18_bots_combined", lambda b: jobs.suspects(b, ELT).select("user_id", "total_actions", "max_actions_per_hour", "is_single_behavior", "is_no_purchase", "is_pv_only", "is_pv_dominant", "suspect_level"), DAILY + COMBINED)
on_b("a19_bot_summary", lambda b: bots.bot_summary(jobs.suspects(b, ELT)), DAILY + f"SELECT suspect_level, count(*) AS n_users, CAST(sum(total_actions) AS BIGINT) AS n_actions, round(avg(max_actions_per_hour), 6) AS mean_peak FROM ({COMBINED}) GROUP BY 1")
on_b("t3_top_users", lambda b: bots.top_users(daily(b)).select("user_id", "max_actions_per_hour", "total_actions"), DAILY + "SELECT user_id, max_actions_per_hour, total_actions FROM u WHERE active_hours >= 3 ORDER BY max_actions_per_hour DESC, total_actions DESC, user_id LIMIT 20")

# funnel
MATRIX = "SELECT {k}, " + ", ".join(f"count(*) FILTER (behavior_type = '{k}') AS {k}_count" for k in KINDS) + ", " + ", ".join(f"count(*) FILTER (behavior_type = '{k}') > 0 AS has_{k}" for k in KINDS) + " FROM {b} GROUP BY {k}"
FUNNEL = "SELECT *, CASE WHEN step1_users > 0 THEN round(step2_users * 100.0 / step1_users, 4) ELSE 0 END AS step1_to_step2_rate, CASE WHEN step2_users > 0 THEN round(step3_users * 100.0 / step2_users, 4) ELSE 0 END AS step2_to_step3_rate, CASE WHEN step1_users > 0 THEN round(step3_users * 100.0 / step1_users, 4) ELSE 0 END AS overall_conversion_rate, step1_users - step2_users AS drop1_users, step2_users - step3_users AS drop2_users FROM (SELECT count(*) FILTER (has_pv) AS step1_users, count(*) FILTER (has_pv AND (has_cart OR has_fav)) AS step2_users, count(*) FILTER (has_pv AND (has_cart OR has_fav) AND has_buy) AS step3_users FROM ({m}))"
DAY = "(SELECT *, timestamp // 86400 AS day FROM b)"
on_b("a20_behavior_matrix", lambda b: funnel.behavior_matrix(b), MATRIX.format(k="user_id", b="b"))
on_b("a21_funnel", lambda b: funnel.funnel(funnel.behavior_matrix(b)), FUNNEL.format(m=MATRIX.format(k="user_id", b="b")))
on_b("a21_funnel_by_day", lambda b: funnel.funnel(funnel.behavior_matrix(b.withColumn("day", F.floor(F.col("timestamp") / 86400)), ["user_id", "day"])), FUNNEL.format(m=MATRIX.format(k="user_id, day", b=DAY)))

# sessions
SESSIONS = "s AS (SELECT *, CAST(sum(is_new_session) OVER (PARTITION BY user_id ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_group FROM (SELECT *, timestamp - prev_timestamp AS time_diff_seconds, CASE WHEN prev_timestamp IS NULL OR timestamp - prev_timestamp > {t} THEN 1 ELSE 0 END AS is_new_session FROM (SELECT *, lag(timestamp) OVER (PARTITION BY user_id ORDER BY timestamp, event_id) AS prev_timestamp FROM {b})))"
SESSION_COLS = ["event_id", "prev_timestamp", "time_diff_seconds", "is_new_session", "session_group", "session_id"]


def in_sessions(b: DataFrame) -> DataFrame:
    return sessions.sessionize(b, timeout=TIMEOUT, tiebreak=["event_id"])


on_b("w5_sessionize", lambda b: in_sessions(b).select(*SESSION_COLS), f"WITH {SESSIONS.format(t=TIMEOUT, b='b')} SELECT event_id, prev_timestamp, time_diff_seconds, is_new_session, session_group, user_id || '_' || session_group AS session_id FROM s")
HEAVY_SQL = "heavy AS (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id) FROM b)"


def heavy(b: DataFrame) -> DataFrame:
    """The events as if one user had a third of them."""
    return b.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 1).otherwise(F.col("user_id")))


on_b("w5_sessionize_blocks", lambda b: sessions.sessionize(heavy(b), timeout=600, tiebreak=["event_id"], block=21600).select(*SESSION_COLS), f"WITH {HEAVY_SQL}, {SESSIONS.format(t=600, b='heavy')} SELECT event_id, prev_timestamp, time_diff_seconds, is_new_session, session_group, user_id || '_' || session_group AS session_id FROM s")
on_b("a22_session_stats", lambda b: sessions.session_stats(in_sessions(b)), f"WITH {SESSIONS.format(t=TIMEOUT, b='b')} SELECT count(*) AS n_users, CAST(sum(n) AS BIGINT) AS n_sessions, round(avg(n), 6) AS mean_sessions, max(n) AS max_sessions FROM (SELECT user_id, max(session_group) AS n FROM s GROUP BY 1)")
on_b("a22_session_distribution", lambda b: sessions.session_distribution(in_sessions(b)), f"WITH {SESSIONS.format(t=TIMEOUT, b='b')} SELECT n AS n_sessions, count(*) AS n_users FROM (SELECT user_id, max(session_group) AS n FROM s GROUP BY 1) GROUP BY 1")
on_b("w7_hysteresis", lambda b: sessions.hysteresis(b.withColumn("x", F.col("value") / 100), "user_id", ["timestamp", "event_id"], "x").select("event_id", "is_on"), "SELECT event_id, coalesce(last_value(CASE WHEN value / 100 >= 0.85 THEN true WHEN value / 100 <= 0.30 THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING), false) AS is_on FROM b")
on_b("w8_rebase_time", lambda b: sessions.rebase_time(b, "user_id", "timestamp").select("event_id", "elapsed"), "SELECT event_id, timestamp - min(timestamp) OVER (PARTITION BY user_id) AS elapsed FROM b")

# reports
PIVOT = "SELECT {c}, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'neutral') AS neutral FROM r GROUP BY {c}"
on_r("a23_sentiment_pivot", lambda r: report.sentiment_pivot(r, "cat"), PIVOT.format(c="cat"))
on_r("a24_drilldown", lambda r: report.drilldown(r, "en"), "SELECT category, count(*) AS n FROM r WHERE cat = 'en' AND category IS NOT NULL GROUP BY 1")
on_r("a25_word_counts", lambda r: report.word_counts(r, ["review"], stopwords=("the", "of"), cat="en"), r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(review), '\p{L}{2,}')) AS word FROM r WHERE cat = 'en') WHERE word NOT IN ('the', 'of') GROUP BY 1 ORDER BY n DESC, word LIMIT 50")
on_r("a29_class_balance", lambda r: profile.class_balance(r, "label"), "SELECT label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM r GROUP BY 1")
on_b("a31_histogram", lambda b: profile.histogram(b, "value", 20, "behavior_type"), "SELECT behavior_type, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) / ((hi - lo) / 20)), 19) END AS INTEGER) AS bin, count(*) AS n FROM b JOIN (SELECT behavior_type, min(value) AS lo, max(value) AS hi FROM b GROUP BY 1) USING (behavior_type) WHERE value IS NOT NULL GROUP BY 1, 2")
on_b("a32_cleaning_report", profile.cleaning_report, "SELECT count(*) AS n_rows, CAST(8 AS INTEGER) AS n_columns, count(*) FILTER (behavior_type = 'pv') AS n_pv, count(*) FILTER (behavior_type = 'cart') AS n_cart, count(*) FILTER (behavior_type = 'fav') AS n_fav, count(*) FILTER (behavior_type = 'buy') AS n_buy, min(timestamp) AS min_epoch, max(timestamp) AS max_epoch, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(DISTINCT category_id) AS n_categories FROM b")
on_b("t2_head", lambda b: b.orderBy("timestamp", "event_id").limit(10).select(*EVENT), f"SELECT {E} FROM b ORDER BY timestamp, event_id LIMIT 10")
on_r("t4_review_page", lambda r: report.review_page(r, "doc_id", "review", 20, "token", cat="en")[0].select("doc_id"), "SELECT doc_id FROM r WHERE cat = 'en' AND regexp_matches(review, '(?i)token') ORDER BY doc_id LIMIT 20")
on_r("t4_review_total", lambda r: report.review_page(r, "doc_id", "review", 20, "token", cat="en")[1], "SELECT count(*) AS total FROM r WHERE cat = 'en' AND regexp_matches(review, '(?i)token')")
on_b("d1_dedup", lambda b: clean.dedup(b.withColumn("hour", F.floor(F.col("timestamp") / 3600)), ["user_id", "behavior_type", "hour"], ["event_id"]).select("event_id"), "SELECT min(event_id) AS event_id FROM b GROUP BY user_id, behavior_type, timestamp // 3600")
_query("d2_distinct", "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem")(lambda s, d: clean.distinct_rows(io.table(s, d, "lineitem").select("l_orderkey", "l_partkey")))
on_b("d3_union", lambda b: b.filter("behavior_type = 'pv'").select("event_id").unionByName(b.filter("behavior_type = 'buy'").select("event_id")), "SELECT event_id FROM b WHERE behavior_type IN ('pv', 'buy')")

# features
SCALED = "SELECT event_id, round((item_id - m) / s, 6) AS item_id_scaled FROM b, (SELECT avg(item_id) AS m, stddev_pop(item_id) AS s FROM b)"


def scaled(b: DataFrame) -> DataFrame:
    return features.apply_scaler(b, features.fit_scaler(b, ["item_id"]))


on_b("m2_scale", lambda b: scaled(b).select("event_id", F.round("item_id_scaled", 6).alias("item_id_scaled")), SCALED)
on_b("a30_drift", lambda b: features.drift_report(b.select((F.col("value") / 50 - 1).alias("x")), ["x"]), "SELECT 'x' AS \"column\", round(avg(value / 50 - 1), 6) AS mean, round(stddev_pop(value / 50 - 1), 6) AS std, round(abs(avg(value / 50 - 1)), 6) AS mean_shift, round(abs(stddev_pop(value / 50 - 1) - 1), 6) AS std_shift FROM b")
on_b("m3_time_features", lambda b: features.time_features(b).select("event_id", "hour", "dayofweek"), "SELECT event_id, CAST(hour(make_timestamp(timestamp * 1000000)) AS INTEGER) AS hour, CAST(isodow(make_timestamp(timestamp * 1000000)) - 1 AS INTEGER) AS dayofweek FROM b")
TFIDF = "c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(string_split(lower(review), '')) AS term FROM r WHERE review IS NOT NULL) WHERE term <> '' GROUP BY 1, 2), st AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM c GROUP BY 1 ORDER BY cf DESC, term LIMIT 500), w AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM r WHERE review IS NOT NULL)) / (1 + df)) + 1) AS w FROM c JOIN st USING (term))"
on_r("m10_char_tfidf", lambda r: features.char_tfidf(r, "doc_id", "review", 500).withColumn("weight", F.round("weight", 6)), f"WITH {TFIDF} SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w")
on_r("a33_density", lambda r: features.vector_density(features.char_tfidf(r, "doc_id", "review", 500), "doc_id", 500), f"WITH {TFIDF} SELECT round(sum(n) / (count(*) * 500), 6) AS density FROM (SELECT doc_id, count(*) AS n FROM w GROUP BY 1)")
on_r("m11_ordinal_encode", lambda r: features.ordinal_encode(r.select("doc_id", "sentiment"), ["sentiment"]).select("doc_id", "sentiment_code"), "SELECT doc_id, CAST(dense_rank() OVER (ORDER BY coalesce(sentiment, 'Unknown')) - 1 AS INTEGER) AS sentiment_code FROM r")
on_r("m16_binary_metrics", lambda r: features.binary_metrics(r.filter("label is not null").withColumn("score", F.least(F.round(F.length("review") / 2000, 2), F.lit(1.0))), "label", "score"), "SELECT round(avg(CAST(CAST(s >= 0.5 AS INT) = label AS INT)), 6) AS accuracy, round((sum(CASE WHEN label = 1 THEN rk END) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auc FROM (SELECT label, s, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rk FROM (SELECT label, least(round(length(review) / 2000, 2), 1) AS s FROM r WHERE label IS NOT NULL))")


def _model(spark: SparkSession, d: str):
    events = behavior(spark, d)
    return events, models.train_purchase_model(models.purchase_features(events))


#: A label that SQL can tell as well: an event's behaviour by its hour. A tenth of the rows can't be scored.
LATE = 12
LATE_SQL = f"l AS (SELECT event_id, CASE WHEN event_id % 10 = 3 THEN NULL ELSE category_id END AS category_id, CAST(hour(make_timestamp(timestamp * 1000000)) >= {LATE} AS INTEGER) AS late FROM b)"


def _by_hour(spark: SparkSession, d: str) -> tuple[DataFrame, PipelineModel]:
    """Events whose purchases are those of the day's second half, and a model of them; trained once a session and folder."""
    events = behavior(spark, d)
    late = F.hour(F.timestamp_seconds("timestamp")) >= LATE
    events = events.withColumn("behavior_type", F.when(late, "buy").otherwise("pv"))
    key = (spark.sparkContext.applicationId, d)
    if key not in _HOURS:
        _HOURS[key] = models.train_purchase_model(models.purchase_features(events))
    dirty = F.when(F.col("event_id") % 10 != 3, F.col("category_id"))
    return events.select(*EVENT, dirty.alias("category_id")), _HOURS[key]


_HOURS: dict = {}


@_query("m6_train_forest", f"WITH {LATE_SQL} SELECT event_id, late AS predicted_label, CASE WHEN category_id IS NULL THEN 'missing category_id' END AS error FROM l WHERE category_id IS NOT NULL UNION ALL SELECT event_id, -1, 'missing category_id' FROM l WHERE category_id IS NULL")
def _forest(spark: SparkSession, d: str) -> DataFrame:
    """The forest tells the label of every event that can be scored."""
    events, model = _by_hour(spark, d)
    return models.score(events, model, 4).select("event_id", "predicted_label", "error")


@_query("a26_scores_by_hour", f"WITH {LATE_SQL} SELECT count(*) AS n, count(*) FILTER (category_id IS NULL) AS n_failed, round(count(*) FILTER (category_id IS NOT NULL AND late = 1) * 100.0 / count(*) FILTER (category_id IS NOT NULL), 4) AS pct_positive FROM l")
def _hour_summary(spark: SparkSession, d: str) -> DataFrame:
    events, model = _by_hour(spark, d)
    return report.scoring_summary(models.score(events, model, 4)).drop("mean_probability")


@_query("m16_metrics_by_hour", "SELECT CAST(1 AS DOUBLE) AS accuracy, CAST(1 AS DOUBLE) AS auc FROM b HAVING count(*) > 0")
def _hour_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and area of the forest's scores, by the library's own metrics: whole, as every label is told."""
    events, model = _by_hour(spark, d)
    scored = models.score(events, model).filter("error is null")
    return features.binary_metrics(scored.withColumn("label", (F.col("behavior_type") == "buy").cast("int")), "label", "buy_probability")


@_query("m9_score")
def _score(spark: SparkSession, d: str) -> DataFrame:
    events, model = _model(spark, d)
    return models.score(events.select(*EVENT, "category_id"), model, 4)


@_query("a26_scoring_summary")
def _scoring(spark: SparkSession, d: str) -> DataFrame:
    return report.scoring_summary(_score(spark, d))


@_query("m7_cross_validate")
def _folds(spark: SparkSession, d: str) -> DataFrame:
    folds = models.cross_validate(models.purchase_features(behavior(spark, d)), "event_id")
    return spark.createDataFrame(folds, "fold string, accuracy double, auc double")


_STUDIES: dict = {}


def _study(spark: SparkSession, d: str) -> tuple[list, list]:
    """The study over one folder, done once a session: two queries show parts of its few rows."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STUDIES:
        _STUDIES[key] = jobs.classification_study(reviews(spark, d), "doc_id", "review", ["cat", "category"])
    return _STUDIES[key]


@_query("m14_ablation")
def _ablation(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_study(spark, d)[0], "arm string, accuracy double, auc double, delta double")


@_query("c9_classification_study")
def _strongest(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_study(spark, d)[1], "feature string, weight double")


@_query("m15_feature_ranking")
def _ranking(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(models.feature_ranking(_model(spark, d)[1], list(models.FEATURES)), "feature string, weight double")


# extraction
on_r("l1_prompt", lambda r: r.select("doc_id", F.sha2(extract.render_prompt("Rate: {review_text} End.", "review"), 256).alias("prompt")), "SELECT doc_id, sha256(replace('Rate: {review_text} End.', '{review_text}', coalesce(review, ''))) AS prompt FROM r")


def reply(text: str) -> str:
    """A local stand-in for an extraction service: fields by rule, and now and then a bad reply."""
    import json

    if len(text or "") % 11 == 0:
        return "no json"
    return json.dumps({"sentiment": ("正面", "负面", "中性", "?")[len(text) % 4], "category": "质量", "summary": text[: len(text) % 20]}, ensure_ascii=False)


def replied(r: DataFrame) -> DataFrame:
    return extract.validate_reply(extract.extract(r.select("doc_id", F.col("review")), "review", reply), "reply")


BAD = "length(review) % 11 = 0"
on_r("l3_validate_reply", lambda r: replied(r).select("doc_id", "format_valid", "sentiment"), f"SELECT doc_id, NOT ({BAD}) AND length(review) % 4 <> 3 AND least(length(review) % 20, length(review)) <= 15 AS format_valid, CASE WHEN NOT ({BAD}) THEN ['正面', '负面', '中性', '?'][CAST(length(review) % 4 AS INTEGER) + 1] END AS sentiment FROM r")
on_r("a28_extraction_success", lambda r: report.extraction_success(replied(r)), f"SELECT count(*) AS n, count(*) FILTER (NOT ({BAD}) AND length(review) % 4 <> 3 AND least(length(review) % 20, length(review)) <= 15) AS n_ok, round(count(*) FILTER (NOT ({BAD}) AND length(review) % 4 <> 3 AND least(length(review) % 20, length(review)) <= 15) / count(*), 6) AS rate FROM r")
on_r("l4_quality_gate", lambda r: extract.quality_gate(r, ["cat", "sentiment", "nothing"], {"cat": ["en", "de"]}), "SELECT 'row_count' AS rule, CAST(0 AS BIGINT) AS n_violations, true AS passed UNION ALL SELECT 'required_columns', 1, false UNION ALL SELECT 'null_cat', count(*) FILTER (cat IS NULL), count(*) FILTER (cat IS NULL) = 0 FROM r UNION ALL SELECT 'null_sentiment', count(*) FILTER (sentiment IS NULL), count(*) FILTER (sentiment IS NULL) = 0 FROM r UNION ALL SELECT 'domain_cat', count(*) FILTER (cat NOT IN ('en','de')), count(*) FILTER (cat NOT IN ('en','de')) = 0 FROM r")
OK = f"NOT ({BAD}) AND length(review) % 4 <> 3 AND least(length(review) % 20, length(review)) <= 15"
PICKED = "(SELECT * FROM r ORDER BY md5('42|' || doc_id), doc_id LIMIT 200)"


def enriched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = reviews(spark, d).select("doc_id", "cat", "review")
    return jobs.enrichment_job(spark, r, "doc_id", "review", reply, 200, scratch(spark))


_query("c8_enrich_reviews", f"SELECT doc_id, cat, CASE WHEN NOT ({BAD}) THEN ['正面', '负面', '中性', '?'][CAST(length(review) % 4 AS INTEGER) + 1] END AS sentiment, {OK} AS format_valid FROM {PICKED}")(lambda s, d: enriched(s, d)[0].select(F.col("doc_id").cast("long"), "cat", "sentiment", F.col("format_valid").cast("boolean")))
_query("c8_enrichment_success", f"SELECT count(*) AS n, round(avg(CAST(({OK}) AS INTEGER)), 6) AS success FROM {PICKED}")(lambda s, d: enriched(s, d)[2])
on_r("l5_ab_test", lambda r: extract.ab_test(r, "doc_id", "review", {"a": reply, "b": lambda t: reply(t + " "), "c": reply}).groupBy("model_id").agg(F.count_if("format_valid").alias("n_ok")), f"SELECT 'a' AS model_id, count(*) FILTER ({OK}) AS n_ok FROM r UNION ALL SELECT 'c', count(*) FILTER ({OK}) FROM r UNION ALL SELECT 'b', count(*) FILTER ((length(review) + 1) % 11 <> 0 AND (length(review) + 1) % 4 <> 3 AND least((length(review) + 1) % 20, length(review) + 1) <= 15) FROM r")

# streams, by their batch twins
on_b("st2_tumbling", lambda b: streams.tumbling_counts(b.withColumn("at", F.timestamp_seconds("timestamp")), "6 hours", "at", ("pv", "buy")).select(F.unix_seconds("window_start").alias("start"), "n", "n_pv", "n_buy"), "SELECT timestamp // 21600 * 21600 AS start, count(*) AS n, count(*) FILTER (behavior_type = 'pv') AS n_pv, count(*) FILTER (behavior_type = 'buy') AS n_buy FROM b GROUP BY 1")
on_b("st3_sessions", lambda b: streams.stream_sessions(b.withColumn("at", F.timestamp_seconds("timestamp")), "12 hours", "at").select("user_id", F.unix_seconds("session_start").alias("start"), F.unix_seconds("session_end").alias("stop"), "n"), f"WITH {SESSIONS.format(t=TIMEOUT, b='b')} SELECT user_id, min(timestamp) AS start, max(timestamp) + {TIMEOUT} AS stop, count(*) AS n FROM s GROUP BY user_id, session_group")
on_b("st7_online_scaling", lambda b: scaled(b.withColumn("item_id", F.col("item_id").cast("string"))).select("event_id", F.round("item_id_scaled", 6).alias("item_id_scaled")), SCALED)


def dirty(b: DataFrame) -> DataFrame:
    k = F.col("event_id") % 50
    return b.select("event_id", "user_id", "item_id", F.when(k == 3, "not_a_number").when(k == 4, None).otherwise(F.col("category_id").cast("string")).alias("category_id"), "behavior_type", F.when(k == 5, -999999999).otherwise(F.col("timestamp")).alias("timestamp"))


on_b("st9_dead_letters", lambda b: models.split_dead_letters(dirty(b))[1].groupBy("error").agg(F.count("*").alias("n")), "SELECT CASE event_id % 50 WHEN 3 THEN 'invalid category_id: not_a_number' ELSE 'missing category_id' END AS error, count(*) AS n FROM b WHERE event_id % 50 IN (3, 4) GROUP BY 1")

# checks
on_b("v2_check_funnel", lambda b: validate.check_funnel(b), "SELECT count(*) FILTER (behavior_type = 'pv') AS n_views, count(*) FILTER (behavior_type = 'buy') AS n_buys, count(*) FILTER (behavior_type = 'buy') <= count(*) FILTER (behavior_type = 'pv') AS passed FROM b")
on_b("v3_check_sessions", lambda b: validate.check_sessions(in_sessions(b), timeout=TIMEOUT), f"WITH {SESSIONS.format(t=TIMEOUT, b='b')} SELECT CAST(0 AS BIGINT) AS n_null_ids, coalesce(max(CASE WHEN is_new_session = 0 THEN time_diff_seconds END), 0) AS max_gap, true AS passed FROM s")

# jobs
_query("c1_clean_logs", "SELECT event_id, sha256(CAST(user_id AS VARCHAR)) AS masked_user_id, event_type FROM events")(lambda s, d: jobs.clean_logs(io.table(s, d, "events").select(F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type")).withColumn("event_id", F.col("event_id").cast("long")))
CLEAN = "SELECT DISTINCT event_id, user_id, item_id, behavior_type, timestamp, CAST(make_timestamp(timestamp * 1000000) AS DATE) AS date, CAST(hour(make_timestamp(timestamp * 1000000)) AS INTEGER) AS hour FROM b WHERE item_id IS NOT NULL AND behavior_type IN ('pv','cart','fav','buy') AND timestamp BETWEEN {} AND {} AND user_id > 0 AND item_id > 0"
on_b("c3_clean_fixed_range", lambda b: jobs.clean_behavior(b.select(*EVENT), 1262304000, 1706000000), CLEAN.format(1262304000, 1706000000))
on_b("c4_clean_past", lambda b: jobs.clean_behavior(b.select(*EVENT), 0, 1705500000), CLEAN.format(0, 1705500000))
UNIQUE = "d AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY user_id, item_id, behavior_type, timestamp ORDER BY event_id) = 1)"
KEPT = f"{UNIQUE}, {HOURS.format(s=86400, b='d')}, {USERS}, kept AS (SELECT * FROM d WHERE user_id NOT IN (SELECT user_id FROM u WHERE max_actions_per_hour >= 7 AND active_hours >= 1))"
on_b("c5_elt", lambda b: jobs.elt(b, ELT).select(*EVENT, "session_id"), f"WITH {KEPT}, {SESSIONS.format(t=TIMEOUT, b='kept')} SELECT {E}, user_id || '_' || session_group AS session_id FROM s")
on_b("c5_elt_funnel", lambda b: jobs.elt_funnel(b, ELT), f"WITH {KEPT}, {SESSIONS.format(t=TIMEOUT, b='kept')} SELECT (SELECT count(*) FROM s) AS n_rows, (SELECT count(DISTINCT user_id) FROM s) AS n_users, (SELECT count(DISTINCT (user_id, session_group)) FROM s) AS n_sessions, f.* FROM ({FUNNEL.format(m=MATRIX.format(k='user_id', b='kept'))}) f")
def _over_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The job over a table stored in buckets by user."""
    table = io.write_bucketed(behavior(spark, d), f"events_{uuid.uuid4().hex}", "user_id", ["timestamp"], 8)
    return jobs.elt_by_user(table, ELT).select(*EVENT, "session_id")


QUERIES["c5_elt_bucketed"] = (_over_buckets, QUERIES["c5_elt"][1])
on_b("c6_export", lambda b: jobs.export(b, ELT).select(*EVENT), f"WITH {KEPT} SELECT {E} FROM kept")
on_r("c10_dashboard_sentiment", lambda r: jobs.dashboard(r)["sentiment"], "SELECT sentiment, count(*) AS n FROM r GROUP BY 1")
on_r("c10_dashboard_words", lambda r: jobs.dashboard(r)["words"], r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(review), '\p{L}{2,}')) AS word FROM r) GROUP BY 1 ORDER BY n DESC, word LIMIT 50")
on_r("c10_dashboard_page", lambda r: jobs.dashboard(r)["page"].select("doc_id"), "SELECT doc_id FROM r ORDER BY doc_id LIMIT 20")
on_r("c10_dashboard_pivot", lambda r: jobs.dashboard(r)["by_category"], PIVOT.format(c="cat"))


def queries() -> dict:
    return {name: f for name, (f, _) in (QUERIES | registry_stored.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    out = {name: sql for name, (_, sql) in registry_stored.QUERIES.items() if sql}
    for name, (_, sql) in QUERIES.items():
        if sql:
            # only the views that the SQL reads
            views = [v for v, mark in ((BEHAVIOR_SQL, " b"), (REVIEWS_SQL, " r")) if any(f"{w}{mark}{e}" in sql + " " for w in ("FROM", "JOIN") for e in (" ", ")", ",", "\n"))]
            out[name] = (f"WITH {', '.join(views)}{',' if sql.startswith('WITH ') else ''} {sql.removeprefix('WITH ')}") if views else sql
    return out
