"""The corpus pipeline: five of the corpus operators over ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All stages but the last return the
columns of ``documents``; the last adds ``mix_copy``, from 1 for each time that a
document is taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, mixing, neardup, pii, quality
from tidewater.llm.common import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep (operator 9)."""
    return quality.judged(docs).filter("q_kept").select(*docs.columns)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class of near-duplicates (operator 5).

    Rows with the same id are one document, and the least of them in the order of all
    columns stays. Rows without an id can't be named in a class and all stay.
    """
    classes = neardup.with_classes(docs)
    kept = classes.filter("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("nd_rows"))
    named = docs.join(kept, "doc_id")
    several = named.filter("nd_rows > 1").groupBy("doc_id").agg(F.min(F.struct(*[c for c in docs.columns if c != "doc_id"])).alias("nd_row"))
    parts = [named.filter("nd_rows = 1"), several.select("doc_id", "nd_row.*"), docs.filter("doc_id is null")]
    return reduce(DataFrame.unionByName, [p.select(*docs.columns) for p in parts])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark (operator 4)."""
    key = ["dc_a", "dc_b"]
    keyed = decontaminate.keyed(docs, "doc_id", "text")
    hits, sizes = decontaminate.hits(docs, table(spark, sf_dir, "benchmark"))
    bad = hits.join(sizes, key).filter(decontaminate.contaminated(F.col("dc_hit"), F.col("dc_words"))).select(*key)
    return keyed.join(bad, key, "left_anti").select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data (operator 2)."""
    return pii.with_surrogates(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by target weights, a row for each time that a document is taken (operator 10)."""
    return mixing.mixed(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("near duplicates", keep_first_copies),
    ("decontamination", drop_contaminated),
    ("personal data", replace_personal_data),
    ("mixing", mix_sources),
]

#: SQL can express neither the EM of the first stage nor the signatures of the second.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), docs)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {}
