"""Merkle fixity audit of replicas of an archive.

An archive is a table of records in order; each has a byte length and a digest. Records
are leaves of a tree: a node covers ``FANOUT`` ** level neighbouring record numbers, and
its hash is that of its children's lengths and hashes in order, and so of their offset
ranges relative to its own begin. A replica's root is one hash. Two replicas are compared
from the root down, and only children of nodes that differ are looked at on the next
level: a changed record costs a path, also if its length has changed.

Record numbers and offsets are running counts and sums over the whole archive, made in
ranges of ids whose borders Spark samples, so that ranges are even however ids are spread.
Levels are grouped aggregates by node; each shrinks its input by
``FANOUT``, and no node has more children than that.

Defined results: a null payload has length 0 and a digest of its own; whole-number ids
are in their order, others in that of a digest; null ids come first; records with the
same id are ordered by digest; if one replica lacks a record, those after it stand
elsewhere and are told as moved; payloads of any length are hashed whole; columns besides
id and payload are not looked at, and may have any name; empty replicas have equal roots
and no findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import stored, table
from tidewater.operators.ranks import in_order

FANOUT = 8


def records(df: DataFrame, id_col: str, parts: list[str]) -> DataFrame:
    """(fx_id, fx_len, fx_hash): the record of ``parts`` (columns in order, each with its length before it)."""
    framed = F.concat(*[F.coalesce(F.concat(F.octet_length(F.col(c)).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in parts])
    size = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in parts[1:]), F.coalesce(F.octet_length(F.col(parts[0])), F.lit(0)))
    return df.select(F.col(id_col).alias("fx_id"), size.cast("long").alias("fx_len"), F.sha2(framed, 256).alias("fx_hash"))


def placed(recs: DataFrame) -> DataFrame:
    """Adds fx_no (from 0) and fx_offset, in the order of ids, nulls first."""
    whole = isinstance(recs.schema["fx_id"].dataType, T.IntegralType)
    keyed = recs.withColumn("fx_key", F.col("fx_id").cast("long") if whole else F.when(F.col("fx_id").isNotNull(), F.xxhash64("fx_id")))
    order = [F.col("fx_key").asc_nulls_first(), F.col("fx_id").asc_nulls_first(), "fx_hash"]
    return in_order(keyed, order, {"fx_offset": "fx_len"}, "fx_no").select("fx_id", "fx_len", "fx_hash", "fx_no", "fx_offset")


def _node(children: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(children), lambda c: F.concat_ws(":", c["len"].cast("string"), c["hash"])), ","), 256)


def tree(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of (no, len, hash), the leaves first, the root's level last; each stored."""
    level = stored(leaves.select(F.col("fx_no").alias("no"), F.col("fx_len").alias("len"), F.col("fx_hash").alias("hash")))
    levels = [level]
    while level.filter("no > 0").limit(1).count():
        children = F.collect_list(F.struct("no", "len", "hash"))
        level = stored(level.groupBy(F.floor(F.col("no") / fanout).alias("no")).agg(F.sum("len").alias("len"), _node(children).alias("hash")).select("no", "len", "hash"))
        levels.append(level)
    return levels


def descent(a: list[DataFrame], b: list[DataFrame], fanout: int = FANOUT) -> list[DataFrame]:
    """The nodes that are compared on each level (no, differs), from the roots down to the leaves; each stored."""
    out = []
    for k in range(max(len(a), len(b)) - 1, -1, -1):
        side = lambda levels, name: (levels[k] if k < len(levels) else levels[-1].limit(0)).select("no", F.struct("len", "hash").alias(name))
        x, y = side(a, "x"), side(b, "y")
        if out:
            suspects = out[-1].filter("differs").select(F.col("no").alias("p"))
            x, y = (s.withColumn("p", F.floor(F.col("no") / fanout)).join(suspects, "p", "left_semi").drop("p") for s in (x, y))
        out.append(stored(x.join(y, "no", "full").select("no", (~F.col("x").eqNullSafe(F.col("y"))).alias("differs"))))
    return out


def differing(a: list[DataFrame], b: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(no) of the leaves that differ, found from the roots down."""
    found = descent(a, b, fanout)
    return stored(found[-1].filter("differs").select("no"), *a, *b, *found)


def audit(a: DataFrame, b: DataFrame, id_col: str, parts: list[str], fanout: int = FANOUT) -> DataFrame:
    """Where replica ``b`` isn't ``a``: (id, record_no, offset, length, status) in terms of ``a``.

    status: corrupt (same id, other bytes), missing or extra (the id is on one side only)
    or moved (the record is whole, but stands elsewhere since others are missing or extra).
    """
    # records are stored, as placing them reads them twice
    x, y = (stored(placed(stored(records(r, id_col, parts)))) for r in (a, b))
    bad = differing(tree(x, fanout), tree(y, fanout), fanout)
    mine = x.join(bad, x["fx_no"] == bad["no"], "left_semi").alias("x")
    other = y.join(bad, y["fx_no"] == bad["no"], "left_semi").alias("y")
    # equal ids are told apart by their order
    nth = lambda d: d.withColumn("k", F.row_number().over(Window.partitionBy("fx_id").orderBy("fx_no")))
    both = nth(mine).alias("x").join(nth(other).alias("y"), F.col("x.fx_id").eqNullSafe(F.col("y.fx_id")) & (F.col("x.k") == F.col("y.k")), "full")
    status = F.when(F.col("y.fx_hash").isNull(), "missing").when(F.col("x.fx_hash").isNull(), "extra").when(F.col("x.fx_hash") != F.col("y.fx_hash"), "corrupt").otherwise("moved")
    pick = lambda c: F.coalesce(F.col(f"x.{c}"), F.col(f"y.{c}"))
    return both.select(pick("fx_id").alias(id_col), pick("fx_no").alias("record_no"), pick("fx_offset").alias("offset"), pick("fx_len").alias("length"), status.alias("status"))


def replica(pages: DataFrame) -> DataFrame:
    """A second copy of ``pages`` with known faults: one page in 97 has a flipped character, one in 89 a cut end."""
    n = F.length("html")
    middle = F.floor(n / 2).cast("int")
    flipped = F.concat(F.substring("html", F.lit(1), middle), F.lit("¿"), F.substring("html", middle + 2, n))
    cut = F.substring("html", F.lit(1), n - 7)
    return pages.withColumn("html", F.when(F.col("page_id") % 97 == 5, flipped).when(F.col("page_id") % 89 == 7, cut).otherwise(F.col("html")))


def op8_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page whose record in the faulty replica differs, with its place in the first."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, replica(pages), "page_id", ["url", "html"])


OP8_SQL = r"""
WITH sized AS (
  SELECT page_id, html, coalesce(strlen(url), 0) + coalesce(strlen(html), 0) AS length FROM pages),
placed AS (
  SELECT *, row_number() OVER (ORDER BY page_id NULLS FIRST) - 1 AS record_no,
    CAST(sum(length) OVER (ORDER BY page_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS "offset"
  FROM sized)
SELECT page_id, record_no, "offset", CAST(length AS BIGINT) AS length, 'corrupt' AS status
FROM placed WHERE html IS NOT NULL AND html <> '' AND (page_id % 97 = 5 OR page_id % 89 = 7)
"""
