"""Counts, shares, distributions and quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.ranks import exact_quantiles, sketches

QUARTILES = [0.25, 0.5, 0.75]


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)


def value_shares(df: DataFrame, col: str, digits: int = 4) -> DataFrame:
    """Counts with their share of all rows in per cent; the window runs over the counts only."""
    total = F.sum("n").over(Window.partitionBy())
    return df.groupBy(col).agg(F.count("*").alias("n")).withColumn("pct", F.round(F.col("n") * 100.0 / total, digits))


def anomaly_summary(df: DataFrame, col: str, expected: list[str]) -> DataFrame:
    odd = ~F.col(col).isin(expected)
    return df.agg(
        F.count("*").alias("n"), F.count_if(odd).alias("n_anomaly"), F.round(F.count_if(odd) / F.count("*"), 6).alias("anomaly_ratio"), F.array_join(F.array_sort(F.collect_set(F.when(odd, F.col(col)))), ",").alias("anomalies")
    )


def sentinel_report(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """One row a sentinel with count and ratio, all from one pass."""
    text = F.col(col).cast("string")
    row = df.agg(F.count("*").alias("total"), *[F.count_if(text == v).alias(f"s{i}") for i, v in enumerate(values)])
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("sentinel"), F.col(f"s{i}").alias("n")) for i, v in enumerate(values)]))
    return row.select("total", each.alias("e")).select("e.sentinel", "e.n", F.round(F.when(F.col("total") > 0, F.col("e.n") / F.col("total")).otherwise(0.0), 6).alias("ratio"))


def json_field_distribution(df: DataFrame, col: str, path: str) -> DataFrame:
    value = F.coalesce(F.get_json_object(F.col(col), path), F.lit("unknown"))
    return value_shares(df.select(value.alias("value")), "value")


def json_version_distribution(df: DataFrame, col: str, pattern: str) -> DataFrame:
    found = F.regexp_extract(F.coalesce(F.col(col), F.lit("")), pattern, 1)
    return value_shares(df.select(F.when(found == "", "unknown").otherwise(found).alias("value")), "value")


def null_report(df: DataFrame) -> DataFrame:
    """One row a column: nulls, nulls or empty strings, and the share of the latter in per cent."""
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    cols = df.columns
    row = df.agg(F.count("*").alias("total"), *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)], *[F.count_if(blank(c)).alias(f"b{i}") for i, c in enumerate(cols)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_null"), F.col(f"b{i}").alias("n_blank")) for i, c in enumerate(cols)]))
    return row.select("total", each.alias("e")).select("e.*", F.round(F.when(F.col("total") > 0, F.col("e.n_blank") * 100.0 / F.col("total")).otherwise(0.0), 4).alias("pct_blank"))


def time_extent(df: DataFrame, col: str = "timestamp", early: int = 1971) -> DataFrame:
    return df.agg(F.min(col).alias("min_epoch"), F.max(col).alias("max_epoch")).select("min_epoch", "max_epoch", F.timestamp_seconds("min_epoch").cast("string").alias("min_at"), F.timestamp_seconds("max_epoch").cast("string").alias("max_at"), (F.year(F.timestamp_seconds("min_epoch")) < early).alias("has_early"))


def cardinalities(df: DataFrame, cols: list[str], approximate: bool = False) -> DataFrame:
    """Distinct values of each column; approximate ones need no expansion of rows."""
    f = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[f(c).alias(f"n_{c}") for c in cols])


def daily_sketches(df: DataFrame, cols: list[str], ts: str = "timestamp", bits: int = 14) -> DataFrame:
    """(day, a sketch of each column's distinct values): stored once a day, any days can be united later.

    The standard error is about 1.04 / sqrt(2 ** bits), 0.8 % by default.
    """
    return df.groupBy(F.floor(F.col(ts) / 86400).alias("day")).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), bits).alias(f"hll_{c}") for c in cols])


def united_cardinalities(sketches: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct values over all days of a table of ``daily_sketches``, as estimated; no event is read again."""
    return sketches.agg(*[F.hll_sketch_estimate(F.hll_union_agg(f"hll_{c}")).alias(f"n_{c}") for c in cols])


def hourly_profile(df: DataFrame, types: list[str], kind: str = "behavior_type", ts: str = "timestamp") -> DataFrame:
    return df.groupBy(F.hour(F.timestamp_seconds(F.col(ts))).alias("hour")).agg(F.count("*").alias("n"), *[F.count_if(F.col(kind) == t).alias(f"n_{t}") for t in types])


def peak_hour(profile: DataFrame, metric: str = "n") -> DataFrame:
    return profile.orderBy(F.desc(metric), "hour").limit(1).select("hour", metric)


def describe_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row a column, from two scans for all of them; the quartiles are exact."""
    value = {c: F.col(c).cast("double") for c in cols}
    parts = {"mean": F.avg, "std": F.stddev_samp}
    row = df.agg(*sketches(value, QUARTILES), *[f(v).alias(f"{name}{i}") for i, v in enumerate(value.values()) for name, f in parts.items()]).first()
    found = exact_quantiles(df, value, QUARTILES, row)
    rows = [(c, row[f"_n{i}"], row[f"mean{i}"], row[f"std{i}"], row[f"_min{i}"], *found[c], row[f"_max{i}"]) for i, c in enumerate(cols)]
    names = ["mean", "std", "low", "p25", "p50", "p75", "high"]
    out = df.sparkSession.createDataFrame(rows, "column string, n long, " + ", ".join(f"{x} double" for x in names))  # a row a column
    return out.withColumns({x: F.round(x, 6) for x in names if x not in ("low", "high")})


def duplicate_count(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows beyond the first of each key (of all columns by default)."""
    return df.groupBy(*(keys or df.columns)).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_duplicates"), F.count_if(F.col("c") > 1).alias("n_keys"))


def duplicate_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows before and after deduplication by ``keys``, how many go, and both shares in per cent."""
    by = df.groupBy(*keys).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_before"), F.count("*").alias("n_after"))
    share = lambda part: F.round(F.when(F.col("n_before") > 0, part * 100.0 / F.col("n_before")), 4)
    gone = F.col("n_before") - F.col("n_after")
    return by.select("n_before", "n_after", gone.alias("n_duplicates"), share(gone).alias("duplicate_rate"), share(F.col("n_after")).alias("kept_rate"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return value_shares(df, label, 6)


def histogram(df: DataFrame, col: str, bins: int = 20, by: str | None = None) -> DataFrame:
    """Counts in equal bins between a group's least and largest value; the last bin is closed."""
    keys = [by] if by else []
    span = df.groupBy(*keys).agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    joined = df.join(span, keys) if keys else df.crossJoin(F.broadcast(span))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(col) - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    return joined.filter(F.col(col).isNotNull()).groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"))


def cleaning_report(df: DataFrame, kinds: tuple = ("pv", "cart", "fav", "buy")) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"), F.max(F.lit(len(df.columns))).alias("n_columns"), *[F.count_if(F.col("behavior_type") == k).alias(f"n_{k}") for k in kinds], F.min("timestamp").alias("min_epoch"), F.max("timestamp").alias("max_epoch"),
        F.count_distinct("user_id").alias("n_users"), F.count_distinct("item_id").alias("n_items"), F.count_distinct("category_id").alias("n_categories"),
    )
