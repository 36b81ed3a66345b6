"""The behaviour and review shapes over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.clean import map_label
from tidewater.sources.io import table

#: Event types of the stream and the behaviours they stand for.
BEHAVIORS = {"view": "pv", "click": "cart", "signup": "fav", "purchase": "buy"}


def behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, item_id, category_id, behavior_type, timestamp (epoch seconds), value, props."""
    e = table(spark, sf_dir, "events")
    item = F.get_json_object("props", "$.k").cast("long")
    kind = F.coalesce(map_label("event_type", BEHAVIORS), F.col("event_type"))
    return e.select("event_id", "user_id", item.alias("item_id"), (item % 10).alias("category_id"), kind.alias("behavior_type"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"), "value", "props")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, cat, label, review, category, sentiment."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")  # noqa: E741
    joined = d.join(l, "doc_id", "left")
    return joined.select("doc_id", F.col("lang").alias("cat"), F.col("quality").alias("label"), F.col("text").alias("review"), F.col("source").alias("category"), map_label("quality", {1: "positive", 0: "negative"}).alias("sentiment"))


BEHAVIOR_SQL = """b AS (
  SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
    CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS category_id,
    CASE event_type WHEN 'view' THEN 'pv' WHEN 'click' THEN 'cart' WHEN 'signup' THEN 'fav' WHEN 'purchase' THEN 'buy' ELSE event_type END AS behavior_type,
    CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, value, props
  FROM events)"""

REVIEWS_SQL = """r AS (
  SELECT d.doc_id, d.lang AS cat, l.quality AS label, d.text AS review, d.source AS category,
    CASE l.quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' END AS sentiment
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
