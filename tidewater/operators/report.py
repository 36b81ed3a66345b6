"""Aggregates that dashboards show over reviews and scored events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.clean import filter_reviews, search_text, subset_rows
from tidewater.operators.profile import value_counts

#: The fixed values of a sentiment column, so a pivot needs no pass to find them.
SENTIMENTS = ("positive", "negative", "neutral")
WORDS = r"\p{L}{2,}"


def sentiment_pivot(df: DataFrame, by: str = "category", sentiment: str = "sentiment", values: tuple = SENTIMENTS) -> DataFrame:
    return df.groupBy(by).pivot(sentiment, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def drilldown(df: DataFrame, cat: str | None, dimensions: tuple = ("category", "issue_type", "sentiment")) -> DataFrame:
    """Counts of the first dimension the table has, within one category; without a category, none."""
    dim = next(d for d in dimensions if d in df.columns)
    kept = df.filter((F.col("cat") == cat) & F.col(dim).isNotNull()) if cat else df.limit(0)
    return value_counts(kept, dim)


def word_counts(df: DataFrame, cols: list[str], top: int = 50, pattern: str = WORDS, stopwords: tuple = (), **equals) -> DataFrame:
    """The most frequent words of the given columns; counts are combined before they meet."""
    text = F.lower(F.concat_ws(" ", *cols))
    words = filter_reviews(df, **equals).select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("word"))
    kept = words.filter(~F.col("word").isin(list(stopwords))) if stopwords else words
    return kept.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)


def review_page(df: DataFrame, key: str, text: str, limit: int = 20, query: str = "", keys: str = "", **equals) -> tuple[DataFrame, DataFrame]:
    """One page of reviews, and the number of all that match."""
    found = subset_rows(search_text(filter_reviews(df, **equals), text, query), key, keys)
    return found.orderBy(key).limit(limit), found.agg(F.count("*").alias("total"))


def scoring_summary(df: DataFrame) -> DataFrame:
    ok = F.col("predicted_label") >= 0
    return df.agg(
        F.count("*").alias("n"), F.count_if(~ok).alias("n_failed"), F.round(F.when(F.count_if(ok) > 0, F.count_if(F.col("predicted_label") == 1) * 100.0 / F.count_if(ok)).otherwise(0.0), 4).alias("pct_positive"), F.round(F.avg(F.when(ok, F.col("buy_probability"))), 6).alias("mean_probability")
    )


def compare_runs(a: DataFrame, b: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Rows of two runs side by side, with one flag a column for agreement (nulls agree)."""
    joined = a.select(key, *[F.col(c).alias(f"{c}_a") for c in cols]).join(b.select(key, *[F.col(c).alias(f"{c}_b") for c in cols]), key)
    return joined.select("*", *[F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")).alias(f"{c}_same") for c in cols])


def agreement_report(compared: DataFrame, cols: list[str]) -> DataFrame:
    return compared.agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(f"{c}_same").cast("int")), 6).alias(f"{c}_agreement") for c in cols])


def extraction_success(df: DataFrame, ok: str = "format_valid") -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.round(F.when(F.count("*") > 0, F.count_if(ok) / F.count("*")).otherwise(0.0), 6).alias("rate"))
