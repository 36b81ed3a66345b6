"""Spelling variants by PartEnum signatures.

A word's letters are a multiset, and so a binary vector: one dimension for each letter
and how often it has come before. One inserted or deleted letter changes one dimension,
a replaced one two, so near words are within a Hamming distance of 2. The dimensions are
dealt to ``PARTS`` parts; two differences leave at least ``PARTS`` - 2 parts alike, so for
every choice of ``PARTS`` - 2 parts a word gets a signature of its letters there, and near
words share at least one. Words are joined on equal signatures and then verified.

Many different words may share a signature, such as words of the same letters, or short
ones whose letters lie in the parts left out. A signature that more than ``CROWD`` words
have is split without losing a pair: one difference leaves the first or the second half of
the shorter word as it is, so there words are also joined on the length of the shorter
word, the half, and its letters.

Words are counted within documents first, then within tasks, so only different words are
shuffled; a word's form is found by pointers which are followed by doubling, as a form
occurs at least ``RATIO`` times as often as its word.

Defined results: a null text has no runs, a null id is the empty string in the digest;
repeated rows count each; texts and runs of any length are taken whole; a run from which a
code point is deleted may become the same as another or too short; no words give no rows;
columns besides id and text are not looked at, and may have any name.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import discard, stored, table

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
#: A run of a document loses a code point if this divides its digest.
SLIP = 199
PARTS = 7
CROWD = 24
#: Different words that a task gathers before it sends their counts.
GATHERED = 500_000
#: Texts as Latin-1 bytes: letters in lower case (A-Z only), all else a space. What isn't Latin-1 is "?" before.
LETTERS = bytes((c + 32 if 65 <= c <= 90 else c) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _counted(least: int, slip: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        send = lambda: pa.RecordBatch.from_pydict({"word": pa.array([w.decode("latin-1") for w in total], pa.string()), "n": pa.array(total.values(), pa.int64())})
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                begun = zlib.crc32(f"{key}:".encode())
                for w, n in Counter(text.as_py().encode("latin-1", "replace").translate(LETTERS).split()).items():
                    if len(w) >= least:
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), begun)
                        if h % slip == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]  # noqa: PLW2901
                        total[w] += n
                if len(total) > GATHERED:
                    yield send()
                    total.clear()
        yield send()

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of all documents, after the slips."""
    given = docs.filter(F.col(text).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    counts = given.mapInArrow(_counted(least_length, SLIP), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter((F.length("word") >= least_length) & (F.col("n") >= least_count))


def signatures(word: str, parts: int = PARTS) -> list[int]:
    """The PartEnum signatures of a word's letters for a Hamming distance of 2, as 64-bit hashes."""
    own, seen = [""] * parts, Counter()
    for c in sorted(word):
        own[(ord(c) * 31 + seen[c] * 17) % parts] += f"{c}{seen[c]} "
        seen[c] += 1
    return [xxhash.xxh64_intdigest(f"{i}|{'|'.join(some)}") - (1 << 63) for i, some in enumerate(itertools.combinations(own, parts - 2))]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            words = batch.column(0).slice(at, 2000)
            sigs = [signatures(w) for w in words.to_pylist()]
            rows = pa.array([i for i, s in enumerate(sigs) for _ in s], pa.int64())
            yield pa.RecordBatch.from_pydict({"word": words.take(rows), "sig": pa.array([x for s in sigs for x in s], pa.int64())})


def halves(word: Column) -> Column:
    """(side, length, half) for both lengths that the shorter of two near words may have."""
    keys = []
    for shorter in (F.length(word), F.length(word) - 1):
        front = F.floor(shorter / 2).cast("int")
        keys += [F.struct(F.lit(0).alias("side"), shorter.alias("length"), F.substring(word, F.lit(1), front).alias("half")), F.struct(F.lit(1).alias("side"), shorter.alias("length"), F.right(word, shorter - front).alias("half"))]
    return F.array(*keys)


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b), both ways: words that differ by exactly one code point."""
    signed = stored(words.select("word").mapInArrow(_signed, "word string, sig long"))
    crowds = stored(signed.groupBy("sig").agg(F.count("*").alias("c")).filter(F.col("c") > crowd).select("sig"))
    few = signed.join(crowds, "sig", "left_anti")
    many = signed.join(crowds, "sig", "left_semi").withColumn("h", F.explode(halves(F.col("word")))).select("word", "sig", "h.*")
    near = F.levenshtein(F.col("a"), F.col("b"), 1) == 1

    def pairs(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.withColumnRenamed("word", "a").join(df.withColumnRenamed("word", "b"), keys).filter(F.col("a") < F.col("b")).filter(near).select("a", "b")

    found = stored(pairs(few, ["sig"]).union(pairs(many, ["sig", "side", "length", "half"])).distinct(), signed, crowds)
    return found.union(found.select("b", "a"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of words with their counts."""
    words = stored(words)
    near = near_pairs(words).join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    # the most frequent near word, of equals the one that comes first: digits of the count are turned round by its sign
    best = near.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("top")).withColumnRenamed("a", "word")
    formed = words.join(best, "word", "left").withColumn("is_form", -F.col("top.m") >= ratio * F.col("n"))
    formed = stored(formed.select("word", "n", F.expr("if(is_form, top.b, null)").alias("form"), F.expr("if(is_form, -top.m, null)").alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")), words)
    # each turn doubles how far the pointers reach
    reach = stored(formed.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stored(reach.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), reach)
        if further.filter("moved").isEmpty():
            break
        reach = further.drop("moved")
        reach.stored_at = further.stored_at
    return formed.join(further.drop("moved"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants(word_counts(docs)).select("word", "form", "root", "n", "n_near", "form_n")


#: CRC-32 by its table, which is made by its rule; near words share a letter string that one deletion leaves.
OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(x AS BIGINT) FOR x IN range(8)]),
    lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d,
    translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM documents),
one AS (SELECT d, w, count(*) AS c FROM runs WHERE length(w) >= 6 GROUP BY d, w),
bytes AS (
  SELECT d, w, c, flatten([CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195::BIGINT, CAST(unicode(x) - 64 AS BIGINT)] END FOR x IN string_split(d || ':' || w, '')]) AS b
  FROM one),
hashed AS (
  SELECT d, w, c, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, b),
    lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)]))) AS h
  FROM bytes, crc),
slipped AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(w, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM slipped GROUP BY word HAVING length(word) >= 6 AND sum(c) >= 5),
dels AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS v FROM (SELECT word, unnest(range(CAST(length(word) AS BIGINT))) AS i FROM words)),
pairs AS (
  SELECT x.word AS a, y.word AS b FROM dels x JOIN dels y ON x.i = y.i AND x.v = y.v AND x.word <> y.word
  UNION SELECT x.word, w.word FROM dels x JOIN words w ON x.v = w.word
  UNION SELECT w.word, x.word FROM dels x JOIN words w ON x.v = w.word),
best AS (
  SELECT a, b, m, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY m DESC, b) AS k
  FROM (SELECT a, b, n AS m FROM pairs JOIN words ON b = word)),
formed AS (
  SELECT word, n, CASE WHEN m >= 5 * n THEN b END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
  FROM words LEFT JOIN best ON a = word AND k = 1),
chain AS (
  SELECT word, word AS tip FROM formed
  UNION ALL SELECT chain.word, form FROM chain JOIN formed ON chain.tip = formed.word WHERE form IS NOT NULL)
SELECT f.word, form, tip AS root, n, n_near, form_n
FROM formed f JOIN chain ON chain.word = f.word JOIN (SELECT word AS last FROM formed WHERE form IS NULL) ON last = tip
"""
