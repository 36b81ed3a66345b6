"""Mixing sources to target weights by systematic sampling (built-in expressions only).

Every document of a source has the same number of expected copies, the source's target
over its size. Documents are put in order within their source, the expected copies are
summed along that order from one random offset, and a document is emitted once for each
whole number the sum crosses. Two sums that differ by ``e`` cross ``floor(e)`` or
``ceil(e)`` whole numbers, so with targets of at most twice the source no document is
taken more than twice.

The order runs through size classes (an eighth of an octave wide), so neighbours are of
like size and the words taken stay near the target. The running sum needs a document's
rank in its source. A source may hold a third of all rows, so ranks are made in two
levels: each (source, size class, hash digits) is a block that is contiguous in the order;
block counts are summed within the source first, and only the rank inside one block is
taken by sorting rows.

Defined results: a null text has size 0; a null source is a source of its own, last in
code point order; repeated rows count each for itself; null ids and ties in size are
ordered by digest; texts of any length are counted whole; columns named mix_* are
replaced, others pass through; an empty table gives no rows; a source of size 0 has
target 0 and none of its documents are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import WORD, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
#: Documents that a block of equal source, size class and hash digits may hold in the mean.
BLOCK_ROWS = 1 << 18


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 32 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Targets of sources: (mix_key, mix_source, mix_size) in, + mix_target, one row a source.

    Weights repeat along the sources in code point order, null last. ``share`` of all
    words is dealt in proportion to weight; a target stops at ``most`` times its source's
    size and the excess goes to the others. In the order of cap over weight the sources
    that stop come first, so the level is that of the first source that the rest of the
    budget doesn't lift over its cap. One row a source: the windows run over this table
    of sources alone.
    """
    by_name = Window.orderBy(F.col("mix_source").asc_nulls_last())
    pattern = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("mix_no", F.row_number().over(by_name)).withColumn(
        "mix_weight", F.get(pattern, (F.col("mix_no") - 1) % len(weights)).cast("long")
    )
    by_ratio = Window.orderBy("mix_ratio", "mix_no")
    every = Window.partitionBy()
    level = (
        ranked.withColumn("mix_cap", F.col("mix_size") * most)
        .withColumn("mix_ratio", F.col("mix_cap") / F.col("mix_weight").cast("double"))
        .withColumn("mix_before", F.sum("mix_cap").over(by_ratio) - F.col("mix_cap"))
        .withColumn("mix_left", F.sum("mix_weight").over(every) - F.sum("mix_weight").over(by_ratio) + F.col("mix_weight"))
        .withColumn(
            "mix_level",
            (F.lit(float(share)) * F.sum("mix_size").over(every).cast("double") - F.col("mix_before").cast("double")) / F.col("mix_left").cast("double"),
        )
        .withColumn("mix_place", F.row_number().over(by_ratio))
        .withColumn("mix_first", F.min(F.when(F.col("mix_level") <= F.col("mix_ratio"), F.col("mix_place"))).over(every))
        .withColumn("mix_at", F.max(F.when(F.col("mix_place") == F.col("mix_first"), F.col("mix_level"))).over(every))
    )
    capped = F.col("mix_place") < F.coalesce(F.col("mix_first"), F.col("mix_place") + 1)
    target = F.when(capped, F.col("mix_cap").cast("double")).otherwise(F.col("mix_at") * F.col("mix_weight").cast("double"))
    return level.select("mix_key", "mix_size", target.alias("mix_target"))


def with_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: str = SEED,
) -> DataFrame:
    """``docs`` with mix_doc_size, mix_size, mix_target and mix_copies (0 to ``most``).

    Columns of ``docs`` named mix_* are replaced. Reruns agree: order and offset come
    from digests of ids, sources and ``seed``.
    """
    own = [c for c in docs.columns if not c.startswith("mix_")]
    bits = F.bin("mix_doc_size")
    # so many digits that a block stays small also if all documents were of one source and size
    rows, digits = docs.count(), 1
    while rows > BLOCK_ROWS * 16**digits:
        digits += 1
    based = (
        docs.select(*own)
        .withColumn("mix_doc_size", word_count(text))
        .withColumn("mix_key", F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")))
        .withColumn("mix_class", F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.rpad(F.substring(bits, 2, 3), 3, "0")))
        .withColumn("mix_hash", F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))))
        .withColumn("mix_digit", F.substring("mix_hash", 1, digits))
    )
    block = ["mix_key", "mix_class", "mix_digit"]
    counts = based.groupBy(*block).agg(
        F.count("*").alias("mix_n"), F.sum("mix_doc_size").alias("mix_words"), F.max(source).alias("mix_source")
    )
    targets = source_targets(counts.groupBy("mix_key").agg(F.max("mix_source").alias("mix_source"), F.sum("mix_words").alias("mix_size")), weights, share, most)
    along = Window.partitionBy("mix_key").orderBy("mix_class", "mix_digit")
    before = counts.select(*block, (F.sum("mix_n").over(along) - F.col("mix_n")).alias("mix_before")).join(targets, "mix_key")
    inside = Window.partitionBy(*block).orderBy("mix_doc_size", "mix_hash", F.col(id_col).asc_nulls_first())
    ranked = based.join(before, block).withColumn("mix_rank", F.col("mix_before") + F.row_number().over(inside))
    each = F.when(F.col("mix_size") > 0, F.col("mix_target") / F.col("mix_size").cast("double")).otherwise(F.lit(0.0))
    offset = _uniform(F.col("mix_key"), seed)
    crossed = F.floor(each * F.col("mix_rank") + offset) - F.floor(each * (F.col("mix_rank") - 1) + offset)
    return ranked.withColumn("mix_copies", crossed.cast("long")).select(*own, "mix_doc_size", "mix_size", "mix_target", "mix_copies")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document repeated as often as it is taken, with mix_copy from 1."""
    own = [c for c in docs.columns if not c.startswith("mix_")]
    taken = with_copies(docs, **options).filter("mix_copies > 0")
    return taken.select(*own, F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))).alias("mix_copy"))


def op10_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return with_copies(docs).select(
        "doc_id",
        F.col("mix_doc_size").alias("size"),
        F.col("mix_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_doc_size")).alias("taken"),
    )


OP10_SQL = r"""
WITH base AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
sized AS (
  SELECT *, coalesce('s' || source, 'n') AS k, bin(size) AS b FROM base),
src AS (
  SELECT k, max(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY k),
named AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM src),
weighed AS (
  SELECT *, CAST([5, 2, 1][CAST((no - 1) % 3 AS INTEGER) + 1] AS BIGINT) AS w FROM named),
ratios AS (
  SELECT *, source_size * 2 AS cap, CAST(source_size * 2 AS DOUBLE) / CAST(w AS DOUBLE) AS ratio FROM weighed),
levels AS (
  SELECT *, row_number() OVER (ORDER BY ratio, no) AS place,
    (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE)
      - CAST(sum(cap) OVER (ORDER BY ratio, no) - cap AS DOUBLE))
    / CAST(sum(w) OVER () - sum(w) OVER (ORDER BY ratio, no) + w AS DOUBLE) AS level
  FROM ratios),
firsts AS (
  SELECT *, min(CASE WHEN level <= ratio THEN place END) OVER () AS first FROM levels),
targets AS (
  SELECT k, source_size,
    CASE WHEN place < coalesce(first, place + 1) THEN CAST(cap AS DOUBLE)
         ELSE max(CASE WHEN place = first THEN level END) OVER () * CAST(w AS DOUBLE) END AS target,
    CAST(CAST('0x' || substr(md5('mix-1|' || k), 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296.0 AS DOUBLE) AS u
  FROM firsts),
ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.u,
    CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS e,
    row_number() OVER (PARTITION BY s.k ORDER BY
      lpad(CAST(length(s.b) AS VARCHAR), 2, '0') || rpad(substr(s.b, 2, 3), 3, '0'),
      substr(s.h, 1, 1), s.size, s.h, s.doc_id NULLS FIRST) AS r
  FROM sized s JOIN targets t USING (k))
SELECT doc_id, size, source_size, target,
  CAST(floor(e * r + u) - floor(e * (r - 1) + u) AS BIGINT) * size AS taken
FROM ranked
"""
