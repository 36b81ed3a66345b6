"""Sessions by inactivity gap, and other ordered windows over a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIMEOUT = 1800


def sessionize(df: DataFrame, user: str = "user_id", ts: str = "timestamp", timeout: int = TIMEOUT, tiebreak: list[str] | None = None, first_ordinal: int = 1, block: int | None = None) -> DataFrame:
    """Adds prev_timestamp, time_diff_seconds, is_new_session, session_group and session_id.

    A session ends where the gap to the user's previous event is over ``timeout``
    seconds. Lag and running sum share one order, so they share one sort. A user's rows
    are one task; with ``block`` (seconds) only those of a user and block of time are, and
    the blocks are stitched from one row each, so users of any number of rows can be taken.
    """
    if block:
        marks = marked(in_blocks(df, user, ts, block), ts, timeout, tiebreak)
        out = marks.join(stitched(marks, ts, timeout), ["_user", "_block"])
        out = out.withColumn("prev_timestamp", F.when(F.col("_before").isNull(), F.col("_last_before")).otherwise(F.col("_before.t")))
        group = F.col("_base") + F.col("_breaks")
    else:
        w = Window.partitionBy(user).orderBy(ts, *(tiebreak or []))
        out = df.withColumn("prev_timestamp", F.lag(ts).over(w))
        group = F.sum("is_new_session").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("time_diff_seconds", F.col(ts) - F.col("prev_timestamp"))
    out = out.withColumn("is_new_session", F.when(F.col("time_diff_seconds").isNull() | (F.col("time_diff_seconds") > timeout), 1).otherwise(0))
    out = out.withColumn("session_group", group + (first_ordinal - 1))
    out = out.withColumn("session_id", F.concat_ws("_", F.col(user).cast("string"), F.col("session_group").cast("string")))
    return out.drop("_user", "_block", "_before", "_breaks", "_last_before", "_base")


def in_blocks(df: DataFrame, user: str, ts: str, seconds: int) -> DataFrame:
    """Adds _user (the user as a key that is never null) and _block (times without a value are in a block before all others).

    The least 64-bit number stands for no user where users are numbers, which sort fast.
    """
    whole = isinstance(df.schema[user].dataType, T.IntegralType)
    key = F.coalesce(F.col(user).cast("long"), F.lit(-(1 << 63))) if whole else F.struct(F.col(user).alias("u"))
    return df.withColumns({"_user": key, "_block": F.coalesce(F.floor(F.col(ts) / F.lit(seconds)).cast("long"), F.lit(-(1 << 62)))})


def marked(df: DataFrame, ts: str, timeout: int, tiebreak: list[str] | None = None) -> DataFrame:
    """Adds _before (the event before, within the user's block) and _breaks (sessions that have begun in the block since its first event)."""
    w = Window.partitionBy("_user", "_block").orderBy(ts, *(tiebreak or []))
    is_break = F.col("_before").isNotNull() & F.coalesce(F.col(ts) - F.col("_before.t") > timeout, F.lit(True))
    return df.withColumn("_before", F.lag(F.struct(F.col(ts).alias("t"))).over(w)).withColumn("_breaks", F.sum(F.when(is_break, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def block_ends(ts: str) -> list[Column]:
    """Aggregates of a block that stitching needs."""
    return [F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.max("_breaks").alias("_inner")]


def with_bases(blocks: DataFrame, timeout: int) -> DataFrame:
    """Adds to blocks, of which each is a row, _last_before (the last time before the block) and _base (the number of the session of its first event)."""
    w = Window.partitionBy("_user").orderBy("_block")
    opens = F.when(F.coalesce(F.col("_first") - F.col("_last_before") > timeout, F.lit(True)), 1).otherwise(0)
    base = F.sum(opens + F.col("_inner")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_inner")
    return blocks.withColumn("_last_before", F.lag("_last").over(w)).withColumn("_base", base)


def stitched(marks: DataFrame, ts: str, timeout: int) -> DataFrame:
    """(_user, _block, _last_before, _base) of the blocks of ``marked`` events."""
    return with_bases(marks.groupBy("_user", "_block").agg(*block_ends(ts)), timeout).select("_user", "_block", "_last_before", "_base")


def session_stats(sessions: DataFrame, user: str = "user_id") -> DataFrame:
    per_user = sessions.groupBy(user).agg(F.count_distinct("session_id").alias("n"))
    return per_user.agg(F.count("*").alias("n_users"), F.sum("n").alias("n_sessions"), F.round(F.avg("n"), 6).alias("mean_sessions"), F.max("n").alias("max_sessions"))


def session_distribution(sessions: DataFrame, user: str = "user_id") -> DataFrame:
    return sessions.groupBy(user).agg(F.count_distinct("session_id").alias("n_sessions")).groupBy("n_sessions").agg(F.count("*").alias("n_users"))


def hysteresis(df: DataFrame, series: str, t: list[str], x: str, high: float = 0.85, low: float = 0.30) -> DataFrame:
    """Adds is_on: on from ``high``, off down to ``low``, else as before (off at first)."""
    w = Window.partitionBy(series).orderBy(*t).rowsBetween(Window.unboundedPreceding, 0)
    switch = F.when(F.col(x) >= high, True).when(F.col(x) <= low, False)
    return df.withColumn("is_on", F.coalesce(F.last(switch, ignorenulls=True).over(w), F.lit(False)))


def rebase_time(df: DataFrame, series: str, t: str, out: str = "elapsed") -> DataFrame:
    start = df.groupBy(series).agg(F.min(t).alias("_start"))
    return df.join(start, series).withColumn(out, F.col(t) - F.col("_start")).drop("_start")
