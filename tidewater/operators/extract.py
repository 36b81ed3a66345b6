"""Structured fields from free text: prompts, batch calls of a client, reply checks, a quality gate."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUMMARY = 15
#: Rows whose texts and replies Python holds at a time.
SLICE = 200
#: Fixed values of extracted fields, and words that stand for failed calls.
SENTIMENTS = ("正面", "负面", "中性")
CATEGORIES = ("物流", "质量", "价格", "服务", "综合")
ERROR_WORDS = ("格式错误", "API错误", "调用失败")
REPLY = "sentiment string, category string, summary string"


def render_prompt(template: str, text: str) -> Column:
    return F.replace(F.lit(template), F.lit("{review_text}"), F.coalesce(F.col(text), F.lit("")))


def extract(df: DataFrame, text: str, client: Callable[[str], str], out: str = "reply", retries: int = 3, wait: float = 0.5, parallel: int = 20) -> DataFrame:
    """Adds the client's reply to each text; calls of a task run side by side, failed ones wait and try again.

    The client is an external service, so this is the one place where rows pass through
    Python. Calls at a time over the cluster: partitions that run at once times ``parallel``.
    """

    def call(value: str) -> str:
        for k in range(retries):
            try:
                return client(value)
            except Exception as e:
                if k + 1 == retries:
                    return f"{ERROR_WORDS[2]}: {e}"[:200]
                time.sleep(wait * 2**k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(parallel) as pool:
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(at, SLICE)
                    replies = list(pool.map(call, batch.column(text).to_pylist()))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def _replies(spark: SparkSession, store: str) -> DataFrame:
    """(hash, reply) of a reply store; empty where nothing is stored."""
    found = spark.read.schema("hash string, reply string").option("recursiveFileLookup", True)
    spark.createDataFrame([], "hash string, reply string").write.mode("append").parquet(store)
    return found.parquet(store).dropDuplicates(["hash"])


def _asking(text: str, client: Callable[[str], str], run: str, retries: int, wait: float, parallel: int, size: int):
    """Calls that are stored ``size`` at a time, by the task itself: what a lost attempt has stored isn't asked again."""

    def call(value: str) -> str | None:
        for k in range(retries):
            try:
                return client(value)
            except Exception:
                if k + 1 < retries:
                    time.sleep(wait * 2**k)
        return None

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(run) if ":/" in run else (fs.LocalFileSystem(), run)
        own = f"{root}/part={TaskContext.get().partitionId()}"
        store.create_dir(own, recursive=True)
        done = [f.path for f in store.get_file_info(fs.FileSelector(own)) if f.path.endswith(".parquet")]
        known = {h for f in done for h in pq.read_table(f, filesystem=store, columns=["hash"])["hash"].to_pylist()}
        with ThreadPoolExecutor(parallel) as pool:
            for batch in batches:
                batch = batch[~batch["hash"].isin(known)]
                for at in range(0, len(batch), size):
                    part = batch[at : at + size]
                    replies = list(pool.map(call, part[text]))
                    kept = [(h, r) for h, r in zip(part["hash"], replies) if r is not None]
                    if kept:
                        name = f"{own}/{uuid.uuid4().hex}"
                        pq.write_table(pa.table({"hash": [h for h, _ in kept], "reply": [r for _, r in kept]}), f"{name}.part", filesystem=store)
                        store.move(f"{name}.part", f"{name}.parquet")
                    yield pd.DataFrame({"n": [len(part)]})

    return ask


def extract_stored(df: DataFrame, text: str, client: Callable[[str], str], store: str, out: str = "reply", retries: int = 3, wait: float = 0.5, parallel: int = 20, size: int = 100) -> DataFrame:
    """``extract`` with a reply store: equal texts are asked once, and texts whose reply is stored are not asked at all.

    ``store`` is a folder that all tasks can write to. A failed call isn't stored, so the
    next run asks again; here it gives the error word.
    """
    spark = df.sparkSession
    hashed = df.withColumn("_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    todo = hashed.select(F.col("_hash").alias("hash"), F.coalesce(F.col(text), F.lit("")).alias(text)).dropDuplicates(["hash"]).join(_replies(spark, store), "hash", "left_anti")
    todo.mapInPandas(_asking(text, client, f"{store}/run-{uuid.uuid4().hex}", retries, wait, parallel, size), "n long").agg(F.sum("n")).collect()  # one row
    replies = _replies(spark, store).select(F.col("hash").alias("_hash"), F.col("reply").alias(out))
    return hashed.join(replies, "_hash", "left").select(*df.columns, F.coalesce(out, F.lit(ERROR_WORDS[2])).alias(out))


def validate_reply(df: DataFrame, col: str, sentiments: tuple = SENTIMENTS, categories: tuple = CATEGORIES, most: int = SUMMARY) -> DataFrame:
    """Adds sentiment, category, summary (cut to ``most``) and format_valid."""
    parsed = F.from_json(F.col(col), REPLY)
    s, c, t = (parsed[k] for k in ("sentiment", "category", "summary"))
    valid = F.col(col).rlike(r"^\s*\{[\s\S]*\}\s*$") & s.isin(list(sentiments)) & c.isin(list(categories)) & (F.length(t) <= most)
    return df.withColumn("format_valid", F.coalesce(valid, F.lit(False))).withColumn("sentiment", s).withColumn("category", c).withColumn("summary", F.substring(t, 1, most))


def quality_gate(df: DataFrame, required: list[str], domains: dict[str, list], least: int = 1) -> DataFrame:
    """One row a rule: (rule, n_violations, passed)."""
    missing = [c for c in required if c not in df.columns]
    have = [c for c in required if c in df.columns]
    rules = {"row_count": F.when(F.count("*") < least, 1).otherwise(0).cast("long"), "required_columns": F.max(F.lit(len(missing))).cast("long")}
    rules |= {f"null_{c}": F.count_if(F.col(c).isNull()) for c in have}
    rules |= {f"domain_{c}": F.count_if(~F.col(c).isin(v)) for c, v in domains.items() if c in df.columns}
    row = df.agg(*[F.coalesce(v, F.lit(0)).alias(f"r{i}") for i, v in enumerate(rules.values())])
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"r{i}").cast("long").alias("n_violations")) for i, r in enumerate(rules)]))
    return row.select(each.alias("e")).select("e.rule", "e.n_violations", (F.col("e.n_violations") == 0).alias("passed"))


def ab_test(df: DataFrame, key: str, text: str, clients: dict[str, Callable[[str], str]], **options) -> DataFrame:
    """All clients' validated replies over the same rows, one row a model and key, with model_id."""
    runs = [validate_reply(extract(df.select(key, text), text, c, **options), "reply").withColumn("model_id", F.lit(m)) for m, c in clients.items()]
    return reduce(DataFrame.unionByName, runs)
