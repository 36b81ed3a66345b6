"""Places and running sums in a global order, and exact order statistics, with even tasks."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.session import stored

#: Ranks that the sketch of the first scan may be off by, as one part in so many rows.
ACCURACY = 10_000
#: Row numbers have so many bits in the ids that Spark makes, above them stands the partition.
_BITS = 33


def _summed(places: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = dict.fromkeys(places, 0)
        for batch in batches:
            columns = list(batch.columns)
            for i in places:
                own = np.cumsum(columns[i].fill_null(0).to_numpy()) + last[i]
                columns[i] = pa.array(np.r_[last[i], own][:-1], pa.int64())
                last[i] = int(own[-1]) if len(own) else last[i]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def in_order(df: DataFrame, order: list[str | Column], sums: dict[str, str] | None = None, number: str = "number") -> DataFrame:
    """Adds ``number``, a row's place from 0 in the order, and for each (name, column) of ``sums`` the sum of the rows before.

    Rows are dealt by ranges of the order whose borders Spark samples, so tasks are even
    however the values are spread; they are numbered within their range, and what stands
    before each range is a sum over one row a range. Only rows equal in all of ``order``
    must be together, so it should tell rows apart. ``df`` is read twice (for the borders).
    """
    sums = sums or {}
    dealt = df.select("*", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(f"_run_{name}") for name, c in sums.items()])
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    runs = [f"_run_{name}" for name in sums]
    if runs:
        # the values go beside their running sums, which say what comes after a range's last row
        dealt = dealt.select("*", *[F.col(r).alias(f"{r}_own") for r in runs])
        dealt = dealt.mapInArrow(_summed([dealt.columns.index(r) for r in runs]), dealt.schema)
    kept = stored(dealt.withColumn("_part", F.shiftright("_at", _BITS)))
    ranges = kept.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(f"{r}_own").alias(f"{r}_all") for r in runs])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ranges = ranges.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), *[F.coalesce(F.sum(f"{r}_all").over(before), F.lit(0)).alias(f"{r}_0") for r in runs])
    own = F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1))
    return kept.join(ranges, "_part").select(*df.columns, (F.col("_n0") + own).alias(number), *[(F.col(f"{r}_0") + F.col(r)).alias(name) for name, r in zip(sums, runs)])


def sketches(cols: dict[str, Column], ps: list[float], accuracy: int = ACCURACY) -> list[Column]:
    """Aggregates for ``exact_quantiles``: the count of each column and, around each quantile, values that hold it between them."""
    around = [min(1.0, max(0.0, p + side / accuracy)) for p in ps for side in (-2.5, 2.5)]
    return [a for i, v in enumerate(cols.values()) for a in (F.count(v).alias(f"_n{i}"), F.percentile_approx(v, around, accuracy).alias(f"_around{i}"), F.min(v).alias(f"_min{i}"), F.max(v).alias(f"_max{i}"))]


def exact_quantiles(df: DataFrame, cols: dict[str, Column], ps: list[float], found: T.Row, accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """The exact interpolated quantiles ``ps`` of each double column, given the row of its ``sketches``.

    The one more scan counts the values below each bracket and how often each value in it
    occurs; so buffers hold a sketch or a count, never the values of a column. A bracket holds
    about 5 in ``accuracy`` of the rows; should one not hold its rank, it is widened.
    """
    spark = df.sparkSession
    wanted = []  # (bracket, column, rank from 0, low, high)
    for c, name in enumerate(cols):
        n = found[f"_n{c}"]
        for p, quantile in enumerate(ps):
            if n:
                low, high = found[f"_around{c}"][2 * p : 2 * p + 2]
                wanted.append((len(wanted), c, p, (n - 1) * quantile, low, high))
    values: dict[tuple[int, int], float] = {}
    open_ = wanted
    while open_:
        pieces = []
        for b, c, _, _, low, high in open_:
            v = list(cols.values())[c]
            pieces.append(F.when(v < low, F.struct(F.lit(b).alias("b"), F.lit(None).cast("double").alias("v"))).when(v <= high, F.struct(F.lit(b).alias("b"), v.alias("v"))))
        each = df.select(F.explode(F.filter(F.array(*pieces), lambda x: x.isNotNull())).alias("e")).groupBy("e.b", "e.v").agg(F.count("*").alias("n"))
        placed = in_order(each, ["b", F.col("v").asc_nulls_first()], {"run": "n"})
        starts = stored(placed.groupBy("b").agg(F.min("run").alias("start")))
        ranks = spark.createDataFrame([(b, float(k)) for b, _, _, at, *_ in open_ for k in {floor(at), ceil(at)}], "b int, rank double")  # two rows a quantile
        hits = placed.join(starts, "b").join(ranks, "b").filter("rank >= run - start and rank < run - start + n").select("b", "rank", "v").collect()  # two rows a quantile at most
        for b, rank, v in hits:
            if v is not None:
                values[b, int(rank)] = v
        missed = [w for w in open_ if any((w[0], k) not in values for k in (floor(w[3]), ceil(w[3])))]
        open_ = [(b, c, p, at, found[f"_min{c}"], found[f"_max{c}"]) for b, c, p, at, *_ in missed]
    out: dict[str, list[float | None]] = {name: [None] * len(ps) for name in cols}
    for b, c, p, at, *_ in wanted:
        low, high = values[b, floor(at)], values[b, ceil(at)]
        out[list(cols)[c]][p] = low + (high - low) * (at - floor(at))
    return out
