"""Checks of what jobs put out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = ("user_id", "item_id", "behavior_type", "timestamp", "session_id")


def check_columns(df: DataFrame, required: tuple = REQUIRED) -> list[str]:
    return [c for c in required if c not in df.columns]


def check_funnel(df: DataFrame, view: str = "pv", buy: str = "buy", kind: str = "behavior_type") -> DataFrame:
    v, b = F.count_if(F.col(kind) == view), F.count_if(F.col(kind) == buy)
    return df.agg(v.alias("n_views"), b.alias("n_buys"), (b <= v).alias("passed"))


def check_sessions(df: DataFrame, ts: str = "timestamp", timeout: int = 1800) -> DataFrame:
    """Null session ids, and the largest gap inside a session, which must not be over the timeout."""
    gap = F.col(ts) - F.lag(ts).over(Window.partitionBy("session_id").orderBy(ts))
    checked = df.withColumn("gap", gap)
    nulls, most = F.count_if(F.col("session_id").isNull()), F.coalesce(F.max("gap"), F.lit(0))
    return checked.agg(nulls.alias("n_null_ids"), most.alias("max_gap"), ((nulls == 0) & (most <= timeout)).alias("passed"))
