"""Session defaults shared by tests, the bench and notebooks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    master: str | None = None,
    app: str = "tidewater",
    shuffle_partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    """A session with UTC time, AQE and skew-join handling on.

    ``extra`` takes configuration keys with dots written as double underscores,
    e.g. ``spark__driver__memory="8g"``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf |= {k.replace("__", "."): str(v) for k, v in extra.items()}
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidewater-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: its lineage is cut, and what it says stays the same."""
    df.write.parquet(path := scratch(df.sparkSession))
    return df.sparkSession.read.schema(df.schema).parquet(path)
