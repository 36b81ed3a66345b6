"""What each feature adds to a tree model's margin for a row: exact Shapley values over the trees' own paths."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import scratch

#: Rows whose values are worked out at a time.
ROWS = 1000


@dataclass
class Path:
    """A leaf: what it adds, and for each feature on the way the steps that a row must take and the share of training rows that takes them."""

    value: float
    steps: dict[int, list[tuple[bool, bool, tuple]]] = field(default_factory=dict)
    share: dict[int, float] = field(default_factory=dict)


def paths(model) -> list[Path]:
    """The leaves of a fitted tree ensemble, read from the form in which Spark stores it; as many as the model has."""
    spark = SparkSession.active()
    at = scratch(spark)
    model.write().save(at)
    weights = list(model.treeWeights)
    out: list[Path] = []
    trees: dict[int, dict] = {}
    for row in spark.read.parquet(f"{at}/data").collect():  # a row a node of the model
        node = row["nodeData"]
        trees.setdefault(row["treeID"], {})[node["id"]] = node
    for tree, nodes in sorted(trees.items()):

        def walk(node, steps: dict, share: dict, tree=tree, nodes=nodes) -> None:
            if node["leftChild"] < 0:
                out.append(Path(node["prediction"] * weights[tree], steps, share))
                return
            split = node["split"]
            f, continuous, left = split["featureIndex"], split["numCategories"] == -1, tuple(split["leftCategoriesOrThreshold"])
            for child, goes_left in ((nodes[node["leftChild"]], True), (nodes[node["rightChild"]], False)):
                part = child["rawCount"] / node["rawCount"]
                walk(child, steps | {f: [*steps.get(f, []), (continuous, goes_left, left)]}, share | {f: share.get(f, 1.0) * part})

        walk(nodes[0], {}, {})
    return out


def base(leaves: list[Path]) -> float:
    """The margin of a row of which nothing is known."""
    return sum(p.value * float(np.prod(list(p.share.values()))) for p in leaves)


def _taken(x: np.ndarray, steps: list[tuple[bool, bool, tuple]]) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for continuous, goes_left, left in steps:
        ok &= ((x <= left[0]) if continuous else np.isin(x, left)) == goes_left
    return ok


def shapley(leaves: list[Path], x: np.ndarray) -> np.ndarray:
    """(rows, features): the values, which with ``base`` sum to each row's margin.

    A leaf is a game of its own: a known feature counts 1 or 0 by the row's steps, an unknown
    one the share of rows that take them. Sums over subsets of a size are the coefficients
    of a product of one linear factor a feature.
    """
    out = np.zeros(x.shape)
    for leaf in leaves:
        names = list(leaf.steps)
        known = [_taken(x[:, f], leaf.steps[f]).astype(float) for f in names]
        n = len(names)
        for i, f in enumerate(names):
            sums = [np.ones(len(x))]  # by size of the subset
            for j in range(n):
                if j != i:
                    share = leaf.share[names[j]]
                    longer = [s * share for s in sums] + [np.zeros(len(x))]
                    for k, s in enumerate(sums):
                        longer[k + 1] = longer[k + 1] + s * known[j]
                    sums = longer
            # a subset of size k stands before the feature in k! (n - 1 - k)! of n! orders
            weight = [1.0 / n]
            for k in range(1, n):
                weight.append(weight[-1] * k / (n - k))
            out[:, f] += leaf.value * (known[i] - leaf.share[f]) * sum(w * s for w, s in zip(weight, sums))
    return out


def _explained(leaves: list[Path]):
    start = base(leaves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                vectors = batch.column(1)
                x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                values = shapley(leaves, x)
                row, feature = np.nonzero(values)
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
                lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v)) for v in (feature.astype(np.int32), values[row, feature])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(batch.num_rows, start)), pa.array(start + values.sum(axis=1)), *lists], names=["key", "base", "margin", "places", "parts"])

    return run


def attributions(df: DataFrame, model, key: str, features: str = "features") -> DataFrame:
    """(key, base, margin, places, parts) of each row: the features with a part in its margin, and the parts.

    ``model`` is a fitted ensemble of regression trees (boosted trees); its nodes go to the
    tasks. ``margin`` is what its rawPrediction holds for label 1.
    """
    given = df.select(F.col(key).alias("key"), vector_to_array(features).alias("x"))
    kind = df.schema[key].dataType.simpleString()
    out = given.mapInArrow(_explained(paths(model)), f"key {kind}, base double, margin double, places array<int>, parts array<double>")
    return out.withColumnRenamed("key", key)


def strongest(explained: DataFrame, names: list[str], top: int = 15) -> DataFrame:
    """(feature, weight): the mean absolute part of each feature over all rows, the largest first; features without a part aren't told."""
    spark = explained.sparkSession
    n = explained.agg(F.count("*").alias("rows"))
    parts = explained.select(F.explode(F.arrays_zip("places", "parts")).alias("e")).groupBy(F.col("e.places").alias("place")).agg(F.sum(F.abs("e.parts")).alias("all"))
    known = spark.createDataFrame(list(enumerate(names)), "place int, feature string")  # a row a feature
    means = parts.join(known, "place").crossJoin(F.broadcast(n)).select("feature", (F.col("all") / F.col("rows")).alias("weight"))  # n is one row
    return means.orderBy(F.desc("weight"), "feature").limit(top)
