"""Benchmark decontamination over a distributed positional inverted index.

The index is a stored table with one row for each (term, document): the term's positions
in the document. A phrase is looked up from its rarest terms: the position lists of the
two rarest are moved back by the terms' offsets in the phrase and intersected, which
leaves few candidate places; these are then checked against the lists of all other terms.
Everything is a join on (document, term) or a grouped count, so no list of a frequent term
is ever gathered in one task, and texts are read once for the index and never shuffled.

The index is stored in buckets by document and term, so the join that checks candidates
finds the postings where they are: they are moved once, when the index is made, whatever
the number of candidates. Postings of terms that no item has are left out by a bitmap of
the terms' hashes, which has the same bounded size for any benchmark; the few that it lets
through are dropped by the joins.

Defined results: null and empty texts have no words; repeated rows are judged each and
alike (documents are keyed by a 96-bit hash of id and text); an item without words has no
windows, and an item without an id counts as the item ''; texts of any length are indexed
whole; an empty benchmark or table gives no hits or no rows; other columns of the tables
are not looked at, and those named dc_* are replaced.
"""

from __future__ import annotations

import itertools
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import stored, table, text_or_empty

WINDOW = 13
#: Hash values of terms that the bitmap tells apart; a power of two.
BITS = 1 << 24
#: What the index is in buckets by.
POSTING = ["dc_a", "dc_b", "dc_term"]
#: Contract: words are runs of digits, letters a-z and all beyond ASCII; A-Z count as a-z.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The same for UTF-8 bytes: what is no word becomes a space.
BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Stands for a document's number of words in the index; no word is empty.
SIZE = ""
#: Share of a document's words that must be hit: 1 in 20.
ONE_IN = 20


def words(text: str | Column = "text") -> Column:
    return F.regexp_extract_all(F.translate(text_or_empty(text), _UPPER, _UPPER.lower()), F.lit(WORDS), F.lit(0))


def keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``docs`` with dc_a and dc_b, which name a document by id and text."""
    t = text_or_empty(text)
    return docs.withColumn("dc_a", F.xxhash64(F.col(id_col), t)).withColumn("dc_b", F.hash(t, F.col(id_col)))


def _bitmap(terms: DataFrame) -> np.ndarray:
    """Which of ``BITS`` hash values the terms have; packed to 2 MB."""
    place = F.pmod(F.xxhash64("dc_term"), F.lit(BITS)) + 1  # places count from 1
    rows = terms.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()  # at most BITS / 32768 rows
    out = np.zeros(BITS, np.uint8)
    for r in rows:
        part = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        out[(r["k"] - 1) * len(part) :][: len(part)] = part
    return np.packbits(out)


def _post(bitmap: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(bitmap)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                own: dict[bytes, int] = defaultdict(itertools.count().__next__)
                ids, sizes = [], []
                for text in batch.column(2).cast(pa.binary()).to_pylist():
                    found = text.translate(BYTES).split()
                    sizes.append(len(found))
                    ids += map(own.__getitem__, found)
                names = list(own)
                # the hash that Spark gives, without its sign, which the number of bits divides out
                kept = wanted[np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in names), np.uint64, len(names)) % np.uint64(len(wanted))] > 0
                id_ = np.array(ids, np.int64)
                size = np.array(sizes, np.int64)
                doc = np.repeat(np.arange(len(size)), size)
                place = np.arange(len(id_)) - np.repeat(np.cumsum(size) - size, size)
                at = np.flatnonzero(kept[id_]) if len(id_) else np.zeros(0, np.int64)
                at = at[np.argsort(doc[at] * (len(own) + 1) + id_[at], kind="stable")]
                doc, id_, place = doc[at], id_[at], place[at].astype(np.int32)
                first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (id_[1:] != id_[:-1])]) if len(at) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(at)].astype(np.int32)), pa.array(place))
                shown = pa.array([w.decode() for w in names] + [SIZE], pa.string())
                # after the postings, the size of each document
                lists = pa.concat_arrays([lists, pa.array([[]] * len(size), lists.type)])
                row = pa.array(np.r_[doc[first], np.arange(len(size))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(row),
                        batch.column(1).take(row),
                        shown.take(pa.array(np.r_[id_[first], np.full(len(size), len(own))])),
                        pa.array(np.r_[np.diff(np.r_[first, len(at)]), size].astype(np.int32)),
                        lists,
                    ],
                    names=["dc_a", "dc_b", "dc_term", "dc_tf", "dc_at"],
                )

    return run


def positional_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(dc_a, dc_b, dc_term, dc_tf, dc_at): the postings of ``terms`` (dc_term), stored in buckets by document and term.

    Each document also has a row with the term ``SIZE``, whose dc_tf is its number of words.
    ``drop_index`` deletes the table.
    """
    spark = docs.sparkSession
    schema = T.StructType().add("dc_a", "long").add("dc_b", "integer").add("dc_term", "string").add("dc_tf", "integer").add("dc_at", T.ArrayType(T.IntegerType()))
    given = keyed(docs, id_col, text).select("dc_a", "dc_b", text_or_empty(text).alias("dc_text"))
    posted = given.mapInArrow(_post(_bitmap(terms)), schema)
    name, buckets = f"dc_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    posted.repartition(buckets, *POSTING).write.bucketBy(buckets, *POSTING).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out.named = name
    return out


def drop_index(index: DataFrame) -> None:
    index.sparkSession.sql(f"DROP TABLE IF EXISTS {index.named}")


def sizes(index: DataFrame) -> DataFrame:
    """(dc_a, dc_b, dc_words): the number of words of each document of the index."""
    return index.filter(F.col("dc_term") == SIZE).select("dc_a", "dc_b", F.col("dc_tf").cast("long").alias("dc_words")).distinct()


def windows(items: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The distinct windows' terms (dc_win, dc_len, dc_off, dc_term), and which items have them (dc_win, dc_item)."""
    found = (
        items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("dc_item"), words(text).alias("dc_words"))
        .filter(F.size("dc_words") > 0)
        .withColumn("dc_len", F.least(F.lit(size), F.size("dc_words")))
        .withColumn("dc_start", F.explode(F.sequence(F.lit(1), F.size("dc_words") - F.col("dc_len") + 1)))
        .withColumn("dc_words", F.slice("dc_words", F.col("dc_start"), F.col("dc_len")))
        .select("dc_item", "dc_words", "dc_len", F.xxhash64("dc_words").alias("dc_win"))
    )
    one = found.groupBy("dc_win").agg(F.min("dc_words").alias("dc_words"), F.min("dc_len").alias("dc_len"))
    return one.select("dc_win", "dc_len", F.posexplode("dc_words").alias("dc_off", "dc_term")), found.select("dc_win", "dc_item").distinct()


def _ranked(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """The terms of the phrases whose terms all occur, with dc_rank, from 1 for a phrase's rarest; stored.

    The counts are stored first: they are a row a term, so Spark knows from the table
    whether they can be broadcast, and can split a frequent term's phrases if not.
    """
    counts = stored(index.filter(F.col("dc_term") != SIZE).groupBy("dc_term").agg(F.sum(F.col("dc_tf").cast("long")).alias("dc_cf")))
    by_win = Window.partitionBy("dc_win")
    ranked = (
        phrases.join(counts, "dc_term")
        .withColumn("dc_known", F.count("*").over(by_win))
        .filter("dc_known = dc_len")  # a phrase with a term that is nowhere is nowhere
        .withColumn("dc_rank", F.row_number().over(by_win.orderBy("dc_cf", "dc_off")))
    )
    return stored(ranked.select("dc_win", "dc_len", "dc_off", "dc_term", "dc_rank"), counts)


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(dc_a, dc_b, dc_win, dc_start, dc_len): where the phrases of (dc_win, dc_len, dc_off, dc_term) occur."""
    ranked = _ranked(index, phrases)
    spot = ["dc_a", "dc_b", "dc_win", "dc_start", "dc_len"]
    rare = index.join(ranked.filter("dc_rank <= 2"), "dc_term").select("dc_a", "dc_b", "dc_win", "dc_len", "dc_rank", F.explode(F.transform("dc_at", lambda p: p - F.col("dc_off"))).alias("dc_start"))
    # a repeated row has its postings twice: which of the two terms are there, not how many rows
    candidates = stored(rare.filter("dc_start >= 0").groupBy(*spot).agg(F.bit_or("dc_rank").alias("dc_n")).filter("dc_n = if(dc_len = 1, 1, 3)").drop("dc_n"))
    others = candidates.join(ranked.filter("dc_rank > 2").drop("dc_len"), "dc_win")
    # the index is in buckets by these keys, so its side isn't moved
    checked = (
        others.join(index, POSTING)
        .filter("array_contains(dc_at, dc_start + dc_off)")
        .groupBy(*spot)
        .agg(F.size(F.collect_set("dc_off")).alias("dc_n"))
        .filter("dc_n = dc_len - 2")
        .drop("dc_n")
    )
    out = checked.union(candidates.filter("dc_len <= 2").select(*spot))
    out.needs = [ranked, candidates]
    return out


def proximity_matches(index: DataFrame, phrases: DataFrame, slop: int) -> DataFrame:
    """(dc_a, dc_b, dc_win, dc_start): places of the phrase's rarest term such that every
    other term stands within ``slop`` positions of where the phrase has it."""
    ranked = _ranked(index, phrases)
    rare = index.join(ranked.filter("dc_rank = 1"), "dc_term").select("dc_a", "dc_b", "dc_win", "dc_len", F.explode(F.transform("dc_at", lambda p: p - F.col("dc_off"))).alias("dc_start"))
    near = rare.join(ranked.filter("dc_rank > 1").select("dc_win", "dc_off", "dc_term"), "dc_win").join(index, POSTING)
    spot = ["dc_a", "dc_b", "dc_win", "dc_start", "dc_len"]
    ok = near.filter(F.exists("dc_at", lambda p: F.abs(p - F.col("dc_start") - F.col("dc_off")) <= slop)).groupBy(*spot).agg(F.size(F.collect_set("dc_off")).alias("dc_n")).filter("dc_n = dc_len - 1")
    return ok.drop("dc_n").union(rare.filter("dc_len = 1").select(*spot)).drop("dc_len")


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(dc_a, dc_b, dc_hit, dc_items) of the documents with hits: words hit, and the items, sorted
    as strings; and the ``sizes`` of all documents."""
    terms, owners = windows(items, item, item_text, size)
    terms, owners = stored(terms), stored(owners)
    index = positional_index(docs, terms.select("dc_term").distinct(), id_col, text)
    matches = phrase_matches(index, terms)
    found = stored(matches, terms, *matches.needs)
    counted = stored(sizes(index))
    drop_index(index)
    spans = F.array_sort(F.collect_set(F.struct(F.col("dc_start").alias("s"), (F.col("dc_start") + F.col("dc_len")).alias("e"))))
    covered = F.aggregate(
        "dc_spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(x["e"] - F.greatest(x["s"], acc["end"]), F.lit(0))).alias("n"), F.greatest(x["e"], acc["end"]).alias("end")),
        lambda acc: acc["n"].cast("long"),
    )
    hit = found.groupBy("dc_a", "dc_b").agg(spans.alias("dc_spans")).select("dc_a", "dc_b", covered.alias("dc_hit"))
    named = found.select("dc_a", "dc_b", "dc_win").distinct().join(owners, "dc_win").groupBy("dc_a", "dc_b").agg(F.array_sort(F.collect_set("dc_item")).alias("dc_items"))
    return hit.join(named, ["dc_a", "dc_b"]), counted


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (ONE_IN * n_hit >= n_words)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, size = hits(docs, table(spark, sf_dir, "benchmark"))
    counted = keyed(docs, "doc_id", "text").select("doc_id", "dc_a", "dc_b").join(size.withColumnRenamed("dc_words", "n_words"), ["dc_a", "dc_b"])
    n_hit = F.coalesce("dc_hit", F.lit(0)).cast("long")
    items = F.coalesce("dc_items", F.expr("cast(array() as array<string>)"))
    return counted.join(found, ["dc_a", "dc_b"], "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS p
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT dw.r, dw.s, dw.n, bw.item_id FROM dw JOIN bw ON dw.p = bw.p AND dw.n = bw.n),
cells AS (SELECT r, count(DISTINCT c) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS c FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), '') AS i FROM hit) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cells USING (r) LEFT JOIN its USING (r)
"""
