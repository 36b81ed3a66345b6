"""Filters, remaps, masks and row selection over raw logs and behaviour events."""

from __future__ import annotations

import re
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Misspelt event types of raw logs and what they stand for.
EVENT_TYPOS = {
    "clik": "click", "clic": "click", "clcik": "click", "clikc": "click",
    "loign": "login", "logn": "login", "logi": "login", "lgoin": "login",
    "logut": "logout", "lgout": "logout", "logot": "logout", "loout": "logout",
    "paymet": "payment", "payent": "payment", "pymt": "payment", "paymant": "payment",
}


def drop_blank(df: DataFrame, col: str) -> DataFrame:
    """Rows whose ``col`` is neither null nor blank."""
    return df.filter(F.trim(F.col(col)) != "")


def keep_valid_events(df: DataFrame, kind: str = "behavior_type", ts: str = "timestamp") -> DataFrame:
    return df.filter(F.col(kind).isNotNull() & (F.col(kind) != "") & (F.col(ts) > 0))


def drop_nulls(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=cols)


def keep_allowed(df: DataFrame, col: str, values: list) -> DataFrame:
    return df.filter(F.col(col).isin(values))


def invalid_values(df: DataFrame, col: str, values: list) -> DataFrame:
    """The distinct values of ``col`` outside ``values``."""
    return df.select(col).distinct().filter(~F.col(col).isin(values))


def keep_between(df: DataFrame, col: str, low: int, high: int) -> DataFrame:
    return df.filter(F.col(col).between(low, high))


def keep_past(df: DataFrame, col: str, now: int) -> DataFrame:
    """Epochs from 0 to ``now``; the clock is an argument, so reruns agree."""
    return df.filter(F.col(col).between(0, now))


def past_report(df: DataFrame, col: str, now: int) -> DataFrame:
    return df.agg(F.count_if(F.col(col) < 0).alias("n_negative"), F.count_if(F.col(col) > now).alias("n_future"), F.count_if(F.col(col).between(0, now)).alias("n_kept"))


def keep_positive(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [F.col(c) > 0 for c in cols]))


def remap(df: DataFrame, col: str, mapping: dict[str, str]) -> DataFrame:
    """Known values of ``col`` replaced; all others stay."""
    return df.na.replace(mapping, subset=[col])


def mask_sha256(df: DataFrame, col: str, out: str) -> DataFrame:
    """``col`` replaced in place by its SHA-256 as ``out``; the empty string stays empty, null stays null."""
    masked = F.when(F.col(col).cast("string") == "", "").otherwise(F.sha2(F.col(col).cast("string"), 256)).alias(out)
    return df.select(*[masked if c == col else F.col(c) for c in df.columns])


def map_label(col: str, mapping: dict) -> Column:
    return reduce(lambda c, kv: c.when(F.col(col) == kv[0], kv[1]), mapping.items(), F.when(F.lit(False), F.lit(None).cast("string")))


def binary_label(df: DataFrame, col: str, value: str, out: str = "label") -> DataFrame:
    return df.withColumn(out, (F.col(col) == value).cast("int"))


def flag_unexpected(df: DataFrame, col: str, expected: list[str]) -> DataFrame:
    return df.withColumn("is_anomaly", ~F.col(col).isin(expected))


def filter_reviews(df: DataFrame, **equals: str | None) -> DataFrame:
    """Equality filters by column; an empty or missing value is no filter."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == kv[1]) if kv[1] else d, equals.items(), df)


def search_text(df: DataFrame, col: str, query: str) -> DataFrame:
    """Case-insensitive search by pattern, or for the literal where it is no valid pattern; nulls never match."""
    if not query:
        return df
    try:
        df.sparkSession._jvm.java.util.regex.Pattern.compile(query)
        valid = True
    except (IllegalArgumentException, Py4JJavaError):
        valid = False
    return df.filter(F.col(col).rlike(f"(?i){query}") if valid else F.lower(F.col(col)).contains(query.lower()))


def subset_rows(df: DataFrame, key: str, keys: str) -> DataFrame:
    """Rows whose key is in a list such as "3,7,9"; a list that isn't one keeps everything."""
    if not re.fullmatch(r"\s*-?\d+\s*(,\s*-?\d+\s*)*", keys or ""):
        return df
    return df.filter(F.col(key).isin([int(k) for k in keys.split(",")]))


def row_range(df: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    """Rows start..stop-1 in the order of ``key``; only the first ``stop`` rows leave their tasks."""
    return df.orderBy(key).offset(start).limit(max(stop - start, 0))


def preview(col: str, n: int) -> Column:
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(F.col(col))


def add_time_columns(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    at = F.timestamp_seconds(F.col(ts))
    return df.withColumn("date", F.to_date(at)).withColumn("hour", F.hour(at))


def exclude_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key isn't in ``keys`` (cast to the key's own type); Spark picks broadcast or shuffle by size."""
    return df.join(keys.select(F.col(on).cast(df.schema[on].dataType)).distinct(), on, "left_anti")


def augment(df: DataFrame, features: DataFrame, key: str, how: str = "left") -> DataFrame:
    return df.join(features, key, how)


def dedup(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row a key: any, or the first by ``order``."""
    if not order:
        return df.dropDuplicates(keys)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]
