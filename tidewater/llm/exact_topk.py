"""Exact top-k search over vectors by distributed histogram selection.

Every query is scored against every row. Instead of sorting scores, the k-th largest
value of each query is located by global histograms: a pass counts scores in up to
``BINS`` equal bins, the counts of all tasks are summed by query and bin, and the bin that
holds the k-th value becomes the range of the next pass, until a bin is one integer wide.
A last pass lets through what isn't below that value, and ties at it are broken by id.

Queries go in blocks of bounded bytes (a block is what every task holds); candidates are
never moved, a pass is one scan of their two columns. A task leaves out bins below the one
that holds its own k-th score, since the global k-th can't be lower: so it sends at most k
counts a query, and, in the last pass, at most k rows a query, however many are equal.
Rows are scored by matrix products in the narrowest type in which all partial sums are
exact, as bounded by the vectors' lengths.

Defined results: a vector that is null or holds a null or non-finite component takes no
part, neither has a row a score with a query of another number of components; rows with a
null id are candidates and come last among equals, never queries; each row that has a
query's id is a query and a candidate of its own, a query's own row is left out once;
fewer than k candidates are all returned; an empty table gives no rows; vectors of no
components score 0; scores that don't fit 63 bits raise an error; columns besides id and
vector are not looked at, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import discard, scratch_dir, stored, table

K = 5
#: Each component x counts as floor(SCALE * x).
SCALE = 256
#: Bins of a pass, as a power of two.
BITS = 10
BINS = 1 << BITS
#: A block has as many queries as these bytes hold, and at most ``MOST``; what a task holds of it is bounded so.
BLOCK_BYTES = 8 << 20
MOST = 2048
#: Candidates scored at a time.
CHUNK = 1024
#: Rows that a task gathers before it throws away those beyond a query's k-th.
GATHERED = 1 << 20


def finite(vec: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _whole(batch: pa.RecordBatch, dim: int | None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The ids and the scaled components of the rows that take part, by number of components."""
    ids, vecs = batch.column(0), batch.column(1)
    sizes = pc.list_value_length(vecs)
    for d in [dim] if dim is not None else pc.unique(sizes.drop_null()).to_pylist():
        here = pc.fill_null(pc.equal(sizes, d), False)
        some = vecs.filter(here)
        x = some.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), d)
        good = np.isfinite(x).all(axis=1)
        with np.errstate(over="ignore"):
            yield ids.filter(here).filter(pa.array(good)), np.floor(SCALE * x[good])


def _extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, x in _whole(batch, None):
            if len(x):
                yield pa.RecordBatch.from_pydict({"dim": pa.array([x.shape[1]], pa.int32()), "longest": [float(np.sqrt((x * x).sum(axis=1)).max())]})


def _exact_type(bound: float) -> type:
    """The narrowest type in which sums up to ``bound`` are exact."""
    if not bound < 2.0**62:
        raise ValueError("scores of these vectors don't fit 63 bits")
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


def _scores(batches: Iterator[pa.RecordBatch], block: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, scores): a row a query, a column a candidate."""
    for batch in batches:
        for ids, x in _whole(batch, block.shape[1]):
            for at in range(0, len(x), CHUNK):
                yield ids.slice(at, CHUNK), block @ x[at : at + CHUNK].astype(block.dtype).T


def _counts(block: np.ndarray, low: np.ndarray, bins: int, shift: int, need: np.ndarray):
    """A task's histograms (q, bin, n, need), from each query's ``low`` on in ``bins`` bins of 2 ** ``shift``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = np.zeros((len(block), bins), np.int64)
        floor, own = low.copy(), np.zeros(len(block), np.int64)
        for turn, (_, s) in enumerate(_scores(batches, block)):
            q, c = np.nonzero(s >= floor[:, None])
            b = (s[q, c].astype(np.int64) - low[q]) >> shift
            inside = b < bins  # beyond are those that earlier passes have counted
            cell, n = np.unique(q[inside] * bins + b[inside], return_counts=True)
            hist.ravel()[cell] += n
            if turn < 4 or turn % 16 == 0:
                own = _own_bin(hist, need)
                floor = low + (own << shift)
        own = _own_bin(hist, need)
        q, b = np.nonzero(hist * (np.arange(bins) >= own[:, None]))
        yield pa.RecordBatch.from_pydict({"q": pa.array(q, pa.int32()), "bin": pa.array(b, pa.int32()), "n": hist[q, b], "need": need[q]})

    return run


def _own_bin(hist: np.ndarray, need: np.ndarray) -> np.ndarray:
    """The bin of each query's ``need``-th largest score that this task has seen, 0 if it has fewer."""
    above = np.cumsum(hist[:, ::-1], axis=1) >= need[:, None]
    return np.where(above[:, -1], hist.shape[1] - 1 - above.argmax(axis=1), 0).astype(np.int64)


def _passed(block: np.ndarray, kth: np.ndarray, k: int):
    """A task's rows (q, vec_id, score) that aren't below the k-th value, the first k of each query."""

    def best(parts: list) -> tuple:
        q, key, known, s = (np.concatenate(p) for p in zip(*parts))
        at = np.lexsort((key, ~known, -s, q))
        q, key, known, s = q[at], key[at], known[at], s[at]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        return tuple(x[place < k] for x in (q, key, known, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for ids, s in _scores(batches, block):
            q, c = np.nonzero(s >= kth[:, None])
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            key = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
            parts.append((q, key[c], known[c], s[q, c].astype(np.int64)))
            held += len(q)
            if held > GATHERED + k * len(block):
                parts = [best(parts)]
                held = len(parts[0][0])
        if held:
            q, key, known, s = best(parts)
            yield pa.RecordBatch.from_pydict({"q": pa.array(q, pa.int32()), "vec_id": pa.array(key, pa.int64(), mask=~known), "score": s})

    return run


def _kth_values(rows: DataFrame, block: np.ndarray, longest: float, k: int) -> np.ndarray:
    """The k-th largest score of each query of the block, or a value below all scores if there are fewer."""
    reach = int(np.ceil(np.sqrt((block.astype(np.float64) ** 2).sum(axis=1)).max() * longest)) + 1
    low, need = np.full(len(block), -reach, np.int64), np.full(len(block), k, np.int64)
    bins, shift = BINS, max(0, (2 * reach + 1).bit_length() - BITS)
    short = np.zeros(len(block), bool)
    while True:
        counts = rows.mapInArrow(_counts(block, low, bins, shift, need), "q int, bin int, n long, need long")
        down = Window.partitionBy("q").orderBy(F.desc("bin"))  # at most BINS rows
        summed = counts.groupBy("q", "bin").agg(F.sum("n").alias("n"), F.max("need").alias("need")).withColumn("upto", F.sum("n").over(down))
        found = summed.filter("upto >= need and upto - n < need").select("q", "bin", (F.col("upto") - F.col("n")).alias("above")).collect()  # a row a query of the block
        q, b, above = (np.array([r[i] for r in found], np.int64) for i in range(3))
        short |= ~np.isin(np.arange(len(block)), q)
        low[q] += b << shift
        need[q] -= above
        if shift == 0:
            return np.where(short, -reach, low)
        bins, shift = 1 << min(shift, BITS), max(0, shift - BITS)


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec: str = "embedding", k: int = K, leave_out_self: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products, ties to the smaller id."""
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    rows, asked = pick(vectors), pick(queries).filter(finite(F.col("v"))).withColumn("dim", F.size("v"))
    take = k + leave_out_self
    out = scratch_dir(spark)
    schema = "query_id long, self long, q int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(f"{out}/part=none")
    for dim, longest in rows.mapInArrow(_extent, "dim int, longest double").groupBy("dim").agg(F.max("longest")).collect():  # a row a number of components
        most = max(1, min(MOST, BLOCK_BYTES // (8 * max(dim, 1))))
        mine = stored(asked.filter(F.col("dim") == dim))
        blocks = scratch_dir(spark)
        mine.repartition(-(-mine.count() // most) or 1).write.option("maxRecordsPerFile", most).parquet(blocks)
        for i, file in enumerate(sorted(spark.read.schema(mine.schema).parquet(blocks).inputFiles())):
            given = spark.read.schema(mine.schema).parquet(file).collect()  # at most ``most`` queries
            if not given:
                continue
            exact = np.floor(SCALE * np.array([r["v"] for r in given], np.float64).reshape(len(given), dim))
            block = exact.astype(_exact_type(np.sqrt((exact**2).sum(axis=1)).max() * longest))
            own = (exact.astype(np.int64) ** 2).sum(axis=1).tolist()
            kth = _kth_values(rows, block, longest, take)
            names = spark.createDataFrame([(j, r["id"], s) for j, (r, s) in enumerate(zip(given, own))], "q int, query_id long, self long")
            passed = rows.mapInArrow(_passed(block, kth, take), "q int, vec_id long, score long")
            passed.join(F.broadcast(names), "q").select("query_id", "self", "q", "vec_id", "score").write.parquet(f"{out}/part={dim}-{i}")  # names: a row a query of the block
        discard(mine)
    found = spark.read.schema(schema + ", part string").option("basePath", out).parquet(out)
    # a query's own row is one of those with its id and its score with itself
    selves = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("self"))
    nth = F.row_number().over(Window.partitionBy("part", "q", selves).orderBy("vec_id"))
    others = found.withColumn("gone", F.lit(leave_out_self) & F.coalesce(selves, F.lit(False)) & (nth == 1)).filter(~F.col("gone"))
    best = Window.partitionBy("part", "q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return others.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


OP12_SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""
