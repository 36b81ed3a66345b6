"""Ranked lexical search by the Best Position Algorithm.

The index has every term of every document, in shards of documents whose texts come to
about ``SHARD`` characters: a row is the posting list of a term in a shard (the documents'
numbers there and the occurrences), and a row of the term ``SIZES`` has each document's id
and number of terms. It is made in one scan and stored; texts are never shuffled.

For a search, items go in blocks. The lists of a block's terms are joined out of the index
and grouped by shards, so no list of a frequent term is ever together in one task. In a
shard each list is put in order of its impacts (the part of the score that a term gives a
document). Lists are read from the top, some positions at a time; a document that is seen
is looked up in all other lists at once (direct access), where its positions count as seen
too. A list's best position is the last one before which none is unseen. No unseen
document can score more than the impacts at all best positions together: a shard is done
when that sum is strictly below the k-th score found so far, in it or in the shards that
the task had before, so documents that equal the k-th are all found and ties go by id.
The best of the groups of shards are then merged.

Defined results: a null text has no terms; a document without terms isn't counted, an item
without terms, or whose terms are nowhere, has no rows; each row of the documents is
ranked, also if repeated (equal rows next to each other), rows with a null id come last
among equals; items of the same id and text are one, of the same id and other texts are
ranked each; texts of any length are indexed whole; empty tables give no rows; columns
besides ids and texts are not looked at, and may have any name.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import discard, stored, table, text_or_empty

K = 50
#: Contract: terms are runs of digits, letters A-Z and a-z, and all beyond ASCII; A-Z count as a-z.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Stands for the sizes of a shard's documents in the index; no term is empty.
SIZES = ""
#: Bytes of text in a shard (a document counts ``ROW`` more), shards that are searched in one group, and items in a block.
SHARD = 8 << 20
ROW = 256
SHARDS = 4
ITEMS = 256
#: Positions read from the top of each list at first; doubled each turn.
STEP = 32
INDEX = "shard long, term string, docs array<int>, tfs array<int>, ids array<long>"


def terms(text: str | Column = "text") -> Column:
    return F.regexp_extract_all(F.translate(text_or_empty(text), _UPPER, _UPPER.lower()), F.lit(TERM), F.lit(0))


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)].astype(np.int32)), pa.array(values.astype(np.int32)))


def _shard(name: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
    known: dict[bytes, int] = defaultdict(itertools.count().__next__)
    found, sizes = [], []
    for text in texts:
        words = text.translate(BYTES).split()
        sizes.append(len(words))
        found += map(known.__getitem__, words)
    term, doc = np.array(found, np.int64), np.repeat(np.arange(len(texts)), sizes)
    cell, tf = np.unique(term * (len(texts) + 1) + doc, return_counts=True)
    term, doc = np.divmod(cell, len(texts) + 1)
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
    n = len(first)
    one = lambda values: _lists(np.asarray(values), np.zeros(1, np.int64))
    none = pa.array([None] * n, pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([name] * (n + 1), pa.int64()),
            pa.array([w.decode() for w in known] + [SIZES], pa.string()),
            pa.concat_arrays([_lists(doc, first), one(np.arange(len(texts)))]),
            pa.concat_arrays([_lists(tf, first), one(sizes)]),
            pa.concat_arrays([none, pa.array([ids], pa.list_(pa.int64()))]),
        ],
        names=["shard", "term", "docs", "tfs", "ids"],
    )


def _index(shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                ids.append(key)
                texts.append(text.as_py())
                held += len(texts[-1]) + ROW
                if held >= shard:
                    yield _shard((task << 32) + n, ids, texts)
                    n, ids, texts, held = n + 1, [], [], 0
        if ids:
            yield _shard((task << 32) + n, ids, texts)

    return run


def inverted_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """The stored index of all terms of ``docs``, as ``INDEX``."""
    return stored(docs.select(F.col(id_col).cast("long"), text_or_empty(text)).mapInArrow(_index(shard), INDEX))


def _best(lists: list[tuple], n_docs: int, so_far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Local numbers and scores of the documents that may be among the best: (impacts, documents) in order of impacts for each list.

    ``so_far`` has the k best scores of other shards at most.
    """
    by_doc = []
    for impact, doc in lists:
        at = np.argsort(doc)
        by_doc.append((doc[at], at))
    seen = [np.zeros(len(doc) + 1, bool) for _, doc in lists]  # with one place behind the end
    got, scores, met = [], [], np.zeros(n_docs, bool)
    top, step = 0, STEP
    kth = so_far[0] if len(so_far) == k else None
    while True:
        new = np.unique(np.concatenate([doc[top : top + step] for _, doc in lists]))
        new = new[~met[new]]
        met[new] = True
        score = np.zeros(len(new), np.int64)
        for (impact, _), (docs, at), mark in zip(lists, by_doc, seen):
            place = np.searchsorted(docs, new)
            place[place == len(docs)] = 0
            here = docs[place] == new
            at_list = at[place[here]]
            score[here] += impact[at_list]
            mark[at_list] = True
        got.append(new)
        scores.append(score)
        top, step = top + step, step * 2
        so_far = np.concatenate([so_far, score])
        if len(so_far) >= k:
            so_far = np.partition(so_far, len(so_far) - k)[-k:]
            kth = so_far.min()
        best = [int(mark.argmin()) - 1 for mark in seen]  # the best positions, from 0
        if all(b == len(doc) - 1 for b, (_, doc) in zip(best, lists)):
            break
        # a list that is seen whole has nothing left to give
        bound = sum(int(impact[b]) for b, (impact, doc) in zip(best, lists) if b < len(doc) - 1)
        if kth is not None and bound < kth:
            break
    return np.concatenate(got), np.concatenate(scores)


def _search(n_docs: int, n_terms: int, k: int):
    def run(group: pa.Table) -> pa.Table:
        shards: dict = {}
        for row in range(group.num_rows):
            shards.setdefault(group["shard"][row].as_py(), []).append(row)
        best: dict[int, tuple] = {}
        term, docs, tfs, ids, weight, askers = (group[c].combine_chunks() for c in ("term", "docs", "tfs", "ids", "weight", "askers"))
        for _, rows in sorted(shards.items()):
            sizes = next(r for r in rows if term[r].as_py() == SIZES)
            doc_ids = ids[sizes].values
            known = doc_ids.is_valid().to_numpy(zero_copy_only=False)
            doc_ids = doc_ids.fill_null(0).to_numpy()
            m = 50 + 50 * tfs[sizes].values.to_numpy().astype(np.int64) * n_docs // n_terms
            by_item: dict[int, list] = {}
            for r in rows:
                if r != sizes:
                    doc, tf = docs[r].values.to_numpy(), tfs[r].values.to_numpy().astype(np.int64)
                    impact = weight[r].as_py() * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
                    order = np.argsort(-impact, kind="stable")
                    for item in askers[r].as_py():
                        by_item.setdefault(item, []).append((impact[order], doc[order]))
            for item, lists in by_item.items():
                old = best.get(item)
                doc, score = _best(lists, len(doc_ids), old[0] if old else np.zeros(0, np.int64), k)
                here = score > 0
                found = (score[here], ~known[doc[here]], doc_ids[doc[here]])
                if old:
                    found = tuple(np.concatenate(p) for p in zip(old, found))
                first = np.lexsort((found[2], found[1], -found[0]))[:k]
                # the k-th score stands first
                best[item] = tuple(x[first[::-1]] for x in found)
        out = [(item, *row) for item, found in best.items() for row in zip(found[2].tolist(), found[1].tolist(), found[0].tolist())]
        return pa.table({"item": pa.array([x[0] for x in out], pa.int64()), "doc_id": pa.array([None if x[2] else x[1] for x in out], pa.int64()), "score": pa.array([x[3] for x in out], pa.int64())})

    return run


def search(index: DataFrame, items: DataFrame, item: str = "item_id", text: str = "text", k: int = K) -> DataFrame:
    """(item, rank, doc_id, score): the ``k`` best documents of each item, by a stored index."""
    asked = items.select(F.col(item).alias("name"), text_or_empty(text).alias("text")).distinct().withColumn("item", F.xxhash64("name", "text"))
    asked = stored(asked.select("name", "item", F.array_distinct(terms("text")).alias("terms")).filter(F.size("terms") > 0))
    n_docs, n_terms, n_shards = index.filter(F.col("term") == SIZES).agg(F.sum(F.size(F.filter("tfs", lambda n: n > 0))), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, n: a + n)), F.count("*")).first()
    blocks, groups = -(-asked.count() // ITEMS) or 1, -(-n_shards // SHARDS) or 1
    wanted = asked.select("item", F.pmod("item", F.lit(blocks)).alias("block"), F.explode("terms").alias("term"))
    # document frequencies, of the items' terms only
    lists = index.join(wanted.select("term").distinct(), "term", "left_semi")
    counts = lists.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * (n_docs or 0) + 2.0) / (F.lit(2.0) * F.col("df") + F.lit(1.0)))).cast("long")
    askers = stored(wanted.join(counts, "term").groupBy("block", "term").agg(F.collect_list("item").alias("askers"), F.first(weight).alias("weight")).filter("weight > 0"))
    sizes = askers.select("block").distinct().withColumns({"term": F.lit(SIZES), "askers": F.expr("cast(array() as array<bigint>)"), "weight": F.lit(0).cast("long")})
    given = index.join(askers.unionByName(sizes), "term").withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(groups)))
    found = given.groupBy("block", "group").applyInArrow(_search(n_docs or 0, max(n_terms or 0, 1), k), "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("item", F.col("name").alias(item)), "item").select(item, "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = inverted_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = stored(search(index, table(spark, sf_dir, "benchmark")))
    discard(index)
    return found


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
q AS (
  SELECT DISTINCT i, item_id, unnest(w) AS term
  FROM (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM (SELECT DISTINCT item_id, text FROM benchmark))),
p AS (
  SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term),
f AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), t),
s AS (
  SELECT i, item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN f USING (term), t GROUP BY i, item_id, r, doc_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
