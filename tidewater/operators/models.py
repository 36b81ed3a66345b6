"""Spark ML pipelines: purchase model, cross-validation, scoring with row errors, ablation."""

from __future__ import annotations

import statistics
import uuid
from collections.abc import Callable, Iterable, Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.features import split_stratified, stratified_folds, time_features
from tidewater.session import stored

FEATURES = ("category_id", "hour", "dayofweek")
MESSAGE = 50
#: Models that are fitted at a time.
FITS = 5
#: Trees of a forest that are grown at a time.
TREES = 8
#: The label's classes, so that a bag without one of them still has both.
BINARY = {"ml_attr": {"type": "nominal", "vals": ["0.0", "1.0"], "name": "label"}}


def purchase_features(df: DataFrame, value: str = "buy") -> DataFrame:
    out = time_features(df).withColumn("label", (F.col("behavior_type") == value).cast("double"))
    return out.withColumns({c: F.expr(f"try_cast({c} as double)") for c in FEATURES})


def _bagged(trees: int, seed: int):
    """Beside each group of ``n`` equal rows, how many of them each tree draws: the sum of ``n`` Poisson draws of mean 1, as Spark's bagging makes them by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys = batch.column("n").to_pylist(), batch.column("_key").to_pylist()
            draws = [np.random.default_rng([seed, k]).poisson(n, trees).tolist() for n, k in zip(counts, keys)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(draws, pa.list_(pa.int64()))], names=[*batch.schema.names[:-1], "draws"])

    return run


def _forest(trees: list, n_features: int, n_classes: int, **params) -> RandomForestClassificationModel:
    """The trees of several fits as one model; Spark's own class, whose constructor Python doesn't wrap."""
    sc = SparkContext._active_spark_context
    package = sc._jvm.org.apache.spark.ml.classification
    array = sc._gateway.new_array(package.DecisionTreeClassificationModel, len(trees))
    for i, tree in enumerate(trees):
        array[i] = tree._java_obj
    made = RandomForestClassificationModel(package.RandomForestClassificationModel(f"RandomForestClassifier_{uuid.uuid4().hex[:12]}", array, n_features, n_classes))
    made._resetUid(made._java_obj.uid())
    made._set(numTrees=len(trees), **params)
    made._transfer_params_to_java()
    return made


def train_purchase_model(df: DataFrame, trees: int = 100, depth: int = 10, seed: int = 42) -> PipelineModel:
    """Impute, assemble, scale, random forest.

    Rows that are equal in features and label are one row with a weight to a tree, so the
    forest is grown over the groups of such rows, of which there are at most as many as
    rows. Each tree's bag is drawn by group and its trees are fitted side by side; what
    grows with the rows are the scans that impute, scale and count.
    """
    known = df.filter(F.col("label").isNotNull()).select(*FEATURES, "label")
    filled = [f"{c}_filled" for c in FEATURES]
    steps = [Imputer(inputCols=list(FEATURES), outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="raw_features"), StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)]
    ready = Pipeline(stages=steps).fit(known)
    groups = known.groupBy(*FEATURES, "label").agg(F.count("*").alias("n")).withColumn("_key", F.crc32(F.to_json(F.struct(*FEATURES, "label"))))
    spec = ", ".join(f"{c} double" for c in (*FEATURES, "label"))
    drawn = groups.mapInArrow(_bagged(trees, seed), f"{spec}, n long, draws array<long>")
    bagged = stored(ready.transform(drawn).select("features", F.col("label").alias("label", metadata=BINARY), "n", "draws"))
    filled_bags = {r["t"] for r in bagged.select(F.posexplode("draws").alias("t", "k")).filter("k > 0").select("t").distinct().collect()}  # a row a tree

    def grown(i: int):
        weight = F.col("draws")[i] if i in filled_bags else F.col("n")  # few rows can leave a bag empty
        own = bagged.select("features", "label", weight.cast("double").alias("weight")).filter("weight > 0")
        one = RandomForestClassifier(numTrees=1, maxDepth=depth, seed=seed + i, bootstrap=False, featureSubsetStrategy="sqrt", weightCol="weight")
        return one.fit(own).trees[0]

    return PipelineModel([*ready.stages, _forest(side_by_side(grown, range(trees), TREES), len(FEATURES), 2, maxDepth=depth, seed=seed)])


def cross_validate(df: DataFrame, key: str, k: int = 5, hard_labels: bool = False, **options) -> list[tuple[str, float, float]]:
    """(fold, accuracy, AUC) of each of ``k`` stratified folds, then their mean and population deviation."""
    folded = stored(stratified_folds(df.filter(F.col("label").isNotNull()), "label", key, k))

    def fold(i: int) -> tuple[str, float, float]:
        scored = train_purchase_model(folded.filter(F.col("fold") != i), **options).transform(folded.filter(F.col("fold") == i))
        accuracy = scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0]
        return str(i), accuracy, BinaryClassificationEvaluator(rawPredictionCol="prediction" if hard_labels else "probability").evaluate(scored)

    out = side_by_side(fold, range(k))
    columns = list(zip(*out))[1:]
    return [*out, ("mean", *map(statistics.fmean, columns)), ("std", *map(statistics.pstdev, columns))]


def side_by_side(fit: Callable, args: Iterable, most: int = FITS) -> list:
    """The fits of ``args``, in their order, at most ``most`` at a time: a round of a tree is a short job, which leaves most cores idle.

    What they read should be ``stored``: its partitions go by its size. Those of a shuffle
    stay as many as the session has, and each round of each tree would have as many tasks.
    """
    args = list(args)
    with ThreadPool(min(most, len(args))) as pool:
        return pool.map(inheritable_thread_target(fit), args)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def row_error(strict: bool = False):
    """The reason why an event can't be scored, or null."""
    number = lambda c: F.expr(f"try_cast({c} as long)")
    error = F.when(F.col("category_id").isNull(), "missing category_id").when(F.col("timestamp").isNull(), "missing timestamp")
    error = error.when(number("category_id").isNull(), F.concat(F.lit("invalid category_id: "), F.col("category_id").cast("string"))).when(number("timestamp").isNull(), F.concat(F.lit("invalid timestamp: "), F.col("timestamp").cast("string")))
    if strict:
        for c in ("user_id", "item_id", "behavior_type"):
            error = error.when(F.col(c).isNull(), f"missing {c}")
        error = error.when(number("timestamp") < 0, "negative timestamp")
    return F.substring(error, 1, MESSAGE)


def split_dead_letters(df: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows that can be scored, and the others as (error, original_data)."""
    marked = df.withColumn("error", row_error(strict))
    return marked.filter("error is null").drop("error"), marked.filter("error is not null").select("error", F.to_json(F.struct(*df.columns)).alias("original_data"))


def score(df: DataFrame, model: PipelineModel, digits: int | None = None, strict: bool = False) -> DataFrame:
    """Adds predicted_label, buy_probability and error; a bad row gets -1, -1.0 and its reason."""
    marked = df.withColumn("error", row_error(strict))
    good = model.transform(purchase_features(marked.filter("error is null")))
    p = vector_to_array("probability")[1]
    good = good.select(*[F.col(c) for c in df.columns if c not in FEATURES], *[F.col(c).cast(df.schema[c].dataType) for c in df.columns if c in FEATURES], F.col("prediction").cast("int").alias("predicted_label"), (F.round(p, digits) if digits is not None else p).alias("buy_probability"), F.lit(None).cast("string").alias("error"))
    bad = marked.filter("error is not null").select(*df.columns, F.lit(-1).alias("predicted_label"), F.lit(-1.0).alias("buy_probability"), "error")
    return good.select(bad.columns).unionByName(bad)


def fuse(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def ablation(df: DataFrame, arms: dict[str, list[str]], key: str, label: str = "label", rounds: int = 100, depth: int = 5, seed: int = 42) -> list[tuple[str, float, float, PipelineModel]]:
    """(arm, accuracy, AUC, model) of boosted trees on each set of columns, on one stratified split for all."""
    train, test = (stored(x) for x in split_stratified(df, label, key, 0.2, seed))

    def fitted(arm: str) -> tuple[str, float, float, PipelineModel]:
        steps = [VectorAssembler(inputCols=arms[arm], outputCol="features"), GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed)]
        model = Pipeline(stages=steps).fit(train)
        scored = model.transform(test)
        accuracy = scored.agg(F.avg((F.col(label) == F.col("prediction")).cast("int"))).first()[0]
        return arm, accuracy, BinaryClassificationEvaluator(labelCol=label).evaluate(scored), model

    return side_by_side(fitted, arms)


def feature_ranking(model: PipelineModel, names: list[str], top: int = 15) -> list[tuple[str, float]]:
    weights = model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(names, weights), key=lambda x: (-x[1], x[0]))[:top]
