"""Readers, writers and reports on stored data. Paths may be in any store that Spark reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BEHAVIOR = "user_id long, item_id long, category_id long, behavior_type string, timestamp long"
CORRUPT = "_corrupt_record"
#: Folders that a task writes at a time; each open file holds a row group.
FOLDERS = 8


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = False) -> DataFrame:
    """CSV with a header (a byte order mark is dropped); types are inferred only without a schema."""
    r = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def read_behavior_csv(spark: SparkSession, path: str, keep_corrupt: bool = False) -> DataFrame:
    """CSV without a header, columns by place; malformed fields are null."""
    schema = f"{BEHAVIOR}, {CORRUPT} string" if keep_corrupt else BEHAVIOR
    return spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


read_partitioned = read_table  # partition columns are found by their folder names


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_first_available(candidates: list[Callable[[], DataFrame]]) -> DataFrame:
    """The first source that exists; the last one's error if none does."""
    for k, load in enumerate(candidates):
        try:
            return load()
        except AnalysisException:
            if k + 1 == len(candidates):
                raise


def cached_result(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """What is stored at ``path``, or, if that is missing, unreadable or empty, the result computed and stored there."""
    try:
        found = spark.read.parquet(path)
        if not found.isEmpty():
            return found
    except Exception as e:  # a damaged file shows when it is read
        if not isinstance(e, AnalysisException) and "CANNOT_READ" not in str(e) and "FAILED_READ_FILE" not in str(e):
            raise
    write_parquet(compute(), path)
    return spark.read.parquet(path)


def require_files(spark: SparkSession, path: str) -> int:
    """Number of files under ``path``; fails at once if there are none."""
    try:
        n = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").count()
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    if not n:
        raise FileNotFoundError(path)
    return n


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """Partitioned by ``by``; a rebalance keeps each folder to few, even files, also for hot values."""
    with _unsorted(df.sparkSession):
        df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).option("compression", "snappy").parquet(path)


def write_file_a_folder(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """Partitioned by ``by`` with one file in each folder: rows are dealt by ``by``, so the folders are written side by side and none is held in memory."""
    with _unsorted(df.sparkSession):
        df.repartition(*by).write.mode(mode).partitionBy(*by).option("compression", "snappy").parquet(path)


@contextmanager
def _unsorted(spark: SparkSession) -> Iterator[None]:
    """Inside, a task writes up to ``FOLDERS`` folders at a time as rows come and sorts only those rows that come after; else it would first sort, and so hold, all its rows."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, "0")
    spark.conf.set(key, str(FOLDERS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_bucketed(df: DataFrame, name: str, by: str, sort: list[str] = (), buckets: int = 64) -> DataFrame:
    """The table ``name``, in ``buckets`` by a key and sorted within each: grouping, windows and joins by the key need no exchange later.

    Rows are dealt by the key first, so a bucket is one file. Buckets should be few enough
    for files of a good size, and many enough for a bucket to fit a task.
    """
    (df.repartition(buckets, by).write.mode("overwrite").bucketBy(buckets, by).sortBy(by, *sort).format("parquet").saveAsTable(name))
    return df.sparkSession.table(name)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", header: bool = True, max_rows: int | None = None) -> None:
    """``max_rows``: rows of a file at most, which bounds what a stream takes of it at once."""
    w = df.write.mode(mode).option("header", header).option("escape", '"')
    (w.option("maxRecordsPerFile", max_rows) if max_rows else w).csv(path)


def register(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def storage_report(spark: SparkSession, before: str, after: str) -> DataFrame:
    """Bytes under two paths, their ratio and what is saved in per cent; file contents aren't read."""
    size = lambda p, n: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p).agg(F.coalesce(F.sum("length"), F.lit(0)).alias(n))
    both = size(before, "before_bytes").crossJoin(size(after, "after_bytes"))
    b, a = F.col("before_bytes"), F.col("after_bytes")
    return both.select("*", F.round(F.when(a > 0, b / a), 4).alias("ratio"), F.round(F.when(b > 0, (b - a) * 100.0 / b), 4).alias("pct_saved"))


def layout_report(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by, F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n")).groupBy(*by).agg(F.count("*").alias("n_files"), F.sum("n").alias("n_rows"))


def describe_schema(df: DataFrame) -> DataFrame:
    """One row a column: place, name, type, and the table's number of rows."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    spec = df.sparkSession.createDataFrame(rows, "position int, column string, type string")
    return spec.crossJoin(df.agg(F.count("*").alias("n_rows")))
