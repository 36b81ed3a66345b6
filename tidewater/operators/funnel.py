"""Conversion funnels: view, then cart or favourite, then buy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = {"pv": "pv", "cart": "cart", "fav": "fav", "buy": "buy"}


def behavior_matrix(df: DataFrame, keys: list[str] | None = None, kind: str = "behavior_type", roles: dict[str, str] = ROLES, extra: list[Column] = ()) -> DataFrame:
    """Counts and flags of each role for each user (or other grain), with more aggregates if wanted."""
    counts = df.groupBy(*(keys or ["user_id"])).agg(*[F.count_if(F.col(kind) == v).alias(f"{r}_count") for r, v in roles.items()], *extra)
    return counts.select("*", *[(F.col(f"{r}_count") > 0).alias(f"has_{r}") for r in roles])


def _rate(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(F.when(whole > 0, part * 100.0 / whole).otherwise(0.0), digits)


def funnel(matrix: DataFrame, extra: list[Column] = ()) -> DataFrame:
    """One row: users in each step, step rates and the overall rate in per cent (0 where nobody comes)."""
    one, mid = F.col("has_pv"), F.col("has_cart") | F.col("has_fav")
    s1, s2, s3 = (F.col(f"step{i}_users") for i in (1, 2, 3))
    return matrix.agg(F.count_if(one).alias("step1_users"), F.count_if(one & mid).alias("step2_users"), F.count_if(one & mid & F.col("has_buy")).alias("step3_users"), *extra).select(
        "*", _rate(s2, s1).alias("step1_to_step2_rate"), _rate(s3, s2).alias("step2_to_step3_rate"), _rate(s3, s1).alias("overall_conversion_rate"), (s1 - s2).alias("drop1_users"), (s2 - s3).alias("drop2_users")
    )
