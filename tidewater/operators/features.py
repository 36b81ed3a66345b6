"""Scaling, time and text features, samples and metrics."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators.ranks import exact_quantiles, in_order, sketches
from tidewater.session import stored

#: Texts whose characters are counted at a time.
TEXT_ROWS = 500


def fit_scaler(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float, float]]:
    """Median, mean and population deviation of each column after filling with the median.

    Two scans; three numbers a column come back to the caller. The moments of the filled
    column are those of its values and of the median, as often as that fills.
    """
    value = {c: F.expr(f"try_cast({c} as double)") for c in cols}
    row = df.agg(F.count("*").alias("rows"), *sketches(value, [0.5]), *[f(v).alias(f"{n}_{c}") for c, v in value.items() for n, f in (("m", F.avg), ("v", F.var_pop))]).first()
    medians = exact_quantiles(df, value, [0.5], row)
    out = {}
    for i, c in enumerate(cols):
        median, n = medians[c][0], row[f"_n{i}"]
        if not n:
            out[c] = (None, None, 1.0)
            continue
        k = row["rows"] - n
        mean = (n * row[f"m_{c}"] + k * median) / (n + k)
        spread = (n * (row[f"v_{c}"] + (row[f"m_{c}"] - mean) ** 2) + k * (median - mean) ** 2) / (n + k)
        out[c] = (median, mean, spread**0.5 or 1.0)
    return out


def apply_scaler(df: DataFrame, params: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Scaled columns; what doesn't parse is filled. Works on batches and streams alike."""
    return df.withColumns({f"{c}_scaled": (F.coalesce(F.expr(f"try_cast({c} as double)"), F.lit(m)) - F.lit(mean)) / F.lit(std) for c, (m, mean, std) in params.items()})


def drift_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row a column, all from one pass."""
    by = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("m"), F.col(f"s{i}").alias("s")) for i, c in enumerate(cols)]))
    return by.select(each.alias("e")).select("e.column", F.round("e.m", 6).alias("mean"), F.round("e.s", 6).alias("std"), F.round(F.abs("e.m"), 6).alias("mean_shift"), F.round(F.abs(F.col("e.s") - 1), 6).alias("std_shift"))


def time_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """hour and dayofweek (Monday 0) of an epoch; null where it doesn't parse."""
    at = F.timestamp_seconds(F.expr(f"try_cast({ts} as long)"))
    return df.withColumn("hour", F.hour(at)).withColumn("dayofweek", F.weekday(at))


def _hashed(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def class_ranks(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Adds _rank (from 1, in the order of a digest of key and seed) within the class and _class, the size of it.

    Ranks come in two levels, blocks of the digest first, so no task sorts a class. Rows
    of one key are in the order of their class only, so keys should be unique.
    """
    based = df.withColumn("_hash", _hashed(key, seed)).withColumn("_block", F.substring("_hash", 1, 3)).withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("")))
    counts = based.groupBy("_label", "_block").agg(F.count("*").alias("_n"))
    along = Window.partitionBy("_label").orderBy("_block")  # at most 4096 rows a class
    before = counts.select("_label", "_block", (F.sum("_n").over(along) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("_label")).alias("_class"))
    inside = Window.partitionBy("_label", "_block").orderBy("_hash")
    return based.join(before, ["_label", "_block"]).withColumn("_rank", F.col("_before") + F.row_number().over(inside)).drop("_hash", "_block", "_before")


def stratified_sample(df: DataFrame, label: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows (all, if there are fewer) in the classes' own proportions; the choice hangs on key and seed only.

    A class gives the whole part of its share, the largest class also what is then left.
    """
    ranked = class_ranks(df, label, key, seed)
    sizes = df.groupBy(F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("")).alias("_label")).agg(F.count("*").alias("c"))
    every = Window.partitionBy()  # one row a class
    part = F.floor(F.least(F.lit(n), F.sum("c").over(every)) * F.col("c") / F.sum("c").over(every))
    quotas = sizes.select("_label", "c", part.alias("q"), F.least(F.lit(n), F.sum("c").over(every)).alias("n"))
    first = F.row_number().over(Window.orderBy(F.desc("c"), "_label")) == 1
    quotas = quotas.select("_label", (F.col("q") + F.when(first, F.col("n") - F.sum("q").over(every)).otherwise(0)).alias("_quota"))
    return ranked.join(quotas, "_label").filter("_rank <= _quota").select(*df.columns)


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(_hashed(key, seed), key).limit(n)


def split_stratified(df: DataFrame, label: str, key: str, test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; of each class the rounded share ``test`` is for the test."""
    ranked = class_ranks(df, label, key, seed)
    side = F.col("_rank") <= F.floor(F.col("_class") * F.lit(test) + 0.5)
    return ranked.filter(~side).select(*df.columns), ranked.filter(side).select(*df.columns)


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` (from 0): each class is dealt evenly to the folds."""
    return class_ranks(df, label, key, seed).withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).select(*df.columns, "fold")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Characters of column ``_s`` by row, ``TEXT_ROWS`` rows at a time: one sort of (row, code point) for all of them."""
    for whole in batches:
        for at in range(0, whole.num_rows, TEXT_ROWS):
            batch = whole.slice(at, TEXT_ROWS)
            texts = batch.column(1).to_pylist()
            points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            rows = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in texts])
            pairs, tf = np.unique(rows << 21 | points, return_counts=True)
            terms = [chr(c) for c in (pairs & 0x1FFFFF).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs >> 21)), pa.array(terms, pa.string()), pa.array(tf, pa.int64())], names=[batch.schema.names[0], "term", "tf"])


def char_counts(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, term, tf): how often each lower-cased character occurs in a row; counted within the row, so nothing is shuffled."""
    texts = df.filter(F.col(col).isNotNull()).select(F.col(key).alias("_key"), F.lower(col).alias("_s"))
    kind = T.StructType([T.StructField("_key", df.schema[key].dataType), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    return texts.mapInArrow(_counted, kind).withColumnRenamed("_key", key)


def _kept_terms(each: DataFrame, k: int) -> DataFrame:
    """(term, df) of the ``k`` most frequent terms."""
    stats = each.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
    return stats.orderBy(F.desc("cf"), "term").limit(k).select("term", "df")


def _rarity(n: Column | float, df: Column | float) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def char_tfidf(df: DataFrame, key: str, col: str, k: int = 500) -> DataFrame:
    """(key, term, weight): characters weighted by count and smoothed rarity, of length 1 a row."""
    each = stored(char_counts(df, key, col))  # read three times
    n = df.agg(F.count(col).alias("n"))
    weighed = each.join(F.broadcast(_kept_terms(each, k)), "term").crossJoin(F.broadcast(n))  # at most k rows, and one row
    raw = weighed.withColumn("w", F.col("tf") * _rarity(F.col("n"), F.col("df")))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"))


def tfidf_vectors(df: DataFrame, key: str, col: str, k: int = 500, out: str = "text_vector") -> tuple[DataFrame, list[str]]:
    """``df`` with the weights of ``char_tfidf`` as a sparse vector, and the terms by place (sorted, at most ``k``).

    Characters are counted, weighted and scaled in the row, so nothing is shuffled but the
    terms' counts. A null text has no entries.
    """
    kept = _kept_terms(char_counts(df, key, col), k).orderBy("term").collect()  # at most k rows
    n = df.agg(F.count(col)).first()[0]
    terms = [r["term"] for r in kept]
    # there is a place at least, so that vectors have one
    model = CountVectorizerModel.from_vocabulary(terms or [" "], inputCol="_chars", outputCol="_counts")
    weights = [log((1 + n) / (1 + r["df"])) + 1 for r in kept] or [1.0]
    counted = model.transform(df.withColumn("_chars", F.split(F.lower(F.coalesce(F.col(col), F.lit(""))), "")))
    weighed = ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="_counts", outputCol="_weighed").transform(counted)
    return Normalizer(p=2.0, inputCol="_weighed", outputCol=out).transform(weighed).drop("_chars", "_counts", "_weighed"), terms


def vector_density(entries: DataFrame, key: str, k: int) -> DataFrame:
    return entries.groupBy(key).agg(F.count("*").alias("c")).agg(F.round(F.sum("c") / (F.count("*") * k), 6).alias("density"))


def ordinal_encode(df: DataFrame, cols: list[str]) -> DataFrame:
    """Codes from 0 by sorted category, null as "Unknown"; joined from the table of categories, which is numbered in ranges."""
    for c in cols:
        value = F.coalesce(F.col(c).cast("string"), F.lit("Unknown"))
        codes = in_order(df.select(value.alias("_v")).distinct(), ["_v"], number="_code").select("_v", F.col("_code").cast("int").alias(f"{c}_code"))
        df = df.withColumn("_v", value).join(codes, "_v").drop("_v")
    return df


def binary_metrics(df: DataFrame, label: str, score: str, cut: float = 0.5) -> DataFrame:
    """Accuracy and the area under the curve with ties averaged.

    Scores are grouped first; how many negatives stand below each comes from running sums
    over sampled ranges, so scores that crowd make no long task.
    """
    by = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    area = in_order(by, [F.col("s").asc_nulls_first()], {"below": "q"}).withColumn("u", F.col("p") * (F.col("below") + F.col("q") / 2.0)).agg(F.sum("u").alias("u"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    hit = df.agg(F.round(F.avg(((F.col(score) >= cut).cast("int") == F.col(label)).cast("int")), 6).alias("accuracy"))
    return hit.crossJoin(area.select(F.round(F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("u") / (F.col("p") * F.col("q"))), 6).alias("auc")))
