"""Bot suspects from hourly action rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("pv", "cart", "fav", "buy")


def hourly_activity(df: DataFrame, user: str = "user_id", ts: str = "timestamp", kind: str = "behavior_type", seconds: int = 3600) -> DataFrame:
    """Actions of each user in each hour (or other bucket), by kind."""
    return df.groupBy(user, F.floor(F.col(ts) / seconds).alias("bucket")).agg(F.count("*").alias("actions"), F.count_distinct(kind).alias("kinds"), *[F.count_if(F.col(kind) == k).alias(f"{k}_count") for k in KINDS])


def user_activity(hourly: DataFrame, user: str = "user_id") -> DataFrame:
    return hourly.groupBy(user).agg(
        F.sum("actions").alias("total_actions"), F.count("*").alias("active_hours"), F.avg("actions").alias("avg_actions_per_hour"), F.max("actions").alias("max_actions_per_hour"), F.min("actions").alias("min_actions_per_hour"),
        F.stddev_samp("actions").alias("std_actions_per_hour"), F.avg("kinds").alias("avg_behavior_type_count"), *[F.sum(f"{k}_count").alias(f"total_{k}_count") for k in KINDS],
    )


def threshold_grid(users: DataFrame, thresholds: list[int], hours: list[int]) -> DataFrame:
    """Suspects for each pair of threshold and least active hours, also where there are none; one pass, no join."""
    pairs = [(t, h) for t in thresholds for h in hours]
    row = users.agg(*[F.count_if((F.col("max_actions_per_hour") >= t) & (F.col("active_hours") >= h)).alias(f"c{i}") for i, (t, h) in enumerate(pairs)])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(h).alias("min_hours"), F.col(f"c{i}").alias("n_users")) for i, (t, h) in enumerate(pairs)]))
    return row.select(each.alias("e")).select("e.*")


def _tier(high: Column, medium: Column) -> Column:
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def is_suspect(threshold: int, min_hours: int) -> Column:
    """A user with a busy hour; over columns of ``user_activity``."""
    return (F.col("max_actions_per_hour") >= threshold) & (F.col("active_hours") >= min_hours)


def bots_by_frequency(users: DataFrame, threshold: int = 100, min_hours: int = 1, high: int = 500, medium: int = 300) -> DataFrame:
    """Users with a busy hour, in tiers by the busiest hour or by the average."""
    m, a = F.col("max_actions_per_hour"), F.col("avg_actions_per_hour")
    return users.filter(is_suspect(threshold, min_hours)).withColumn("suspect_level", _tier((m > high) | (a > high / 2), (m > medium) | (a > medium / 2)))


def bots_combined(users: DataFrame, threshold: int = 100, min_hours: int = 1, high: int = 500, medium: int = 300, dominant: float = 0.99) -> DataFrame:
    """Users with a busy hour, with flags for one-sided behaviour; tiers need rate and flags."""
    m, total = F.col("max_actions_per_hour"), F.col("total_actions")
    kinds = sum((F.col(f"total_{k}_count") > 0).cast("int") for k in KINDS)
    flagged = (
        users.filter(is_suspect(threshold, min_hours))
        .withColumn("is_single_behavior", kinds == 1)
        .withColumn("is_no_purchase", F.col("total_buy_count") == 0)
        .withColumn("is_pv_only", F.col("total_pv_count") == total)
        .withColumn("is_pv_dominant", F.when(total > 0, F.col("total_pv_count") / total).otherwise(0.0) > dominant)
    )
    odd = F.col("is_pv_only") | F.col("is_pv_dominant") | F.col("is_single_behavior")
    return flagged.withColumn("suspect_level", _tier((m > high) & F.col("is_no_purchase") & odd, (m > medium) & F.col("is_no_purchase")))


def bot_summary(suspects: DataFrame) -> DataFrame:
    return suspects.groupBy("suspect_level").agg(F.count("*").alias("n_users"), F.sum("total_actions").alias("n_actions"), F.round(F.avg("max_actions_per_hour"), 6).alias("mean_peak"))


def top_users(users: DataFrame, n: int = 20, min_hours: int = 3, user: str = "user_id") -> DataFrame:
    return users.filter(F.col("active_hours") >= min_hours).orderBy(F.desc("max_actions_per_hour"), F.desc("total_actions"), user).limit(n)
