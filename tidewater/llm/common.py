"""Shared helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the size contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder of the cluster.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and all
    runs on one machine (local tests) a temporary folder is chosen once and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidewater.scratch.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("tidewater.scratch.dir", root)
    return f"{root.rstrip('/')}/tidewater-{uuid.uuid4().hex}"


def stored(df: DataFrame, *superseded: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by writing it to the shared folder as Parquet.

    A lost executor costs no recomputation: the rows are reread from there. Stored tables
    that only ``df`` still needed are deleted then.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    df.write.parquet(path)
    discard(*superseded)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more; other frames are left alone."""
    for df in tables:
        if path := vars(df).get("stored_at"):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, also where lambdas use it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
