"""Behaviour streams: sources, windows, sessions, online scoring and progress."""

from __future__ import annotations

import threading
import time
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tidewater.operators.models import score, split_dead_letters
from tidewater.session import scratch

EVENT = "event_id string, event_time timestamp, user_id long, item_id long, behavior_type string, session_id string, _corrupt_record string"
PROGRESS = "run string, batch long, at string, rows long, rows_per_second double, batch_ms long, backlog long"
RAW = "user_id string, item_id string, category_id string, behavior_type string, timestamp string"


def stream_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """JSON lines as they come, malformed ones left out. Producers add whole files."""
    r = spark.readStream.schema(EVENT)
    r = r.option("maxFilesPerTrigger", max_files) if max_files else r
    return r.json(path).filter(F.col("_corrupt_record").isNull() & F.col("event_time").isNotNull()).drop("_corrupt_record")


def stream_behavior(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """Behaviour CSV as text columns; files per trigger bound what one batch takes (back-pressure)."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", max_files).csv(path)


def tumbling_counts(events: DataFrame, width: str = "10 seconds", ts: str = "event_time", kinds: tuple = ("view", "purchase"), delay: str = "30 seconds", kind: str = "behavior_type") -> DataFrame:
    """Counts by window and kind, over a batch or a stream (there with a watermark)."""
    source = events.withWatermark(ts, delay) if events.isStreaming else events
    counts = source.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), *[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds])
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", *[f"n_{k}" for k in kinds])


def stream_sessions(events: DataFrame, gap: str = "30 minutes", ts: str = "event_time", user: str = "user_id", delay: str = "10 minutes") -> DataFrame:
    """Sessions by inactivity; two events just ``gap`` apart are in one session."""
    source = events.withWatermark(ts, delay) if events.isStreaming else events
    found = source.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def stream_score(source: DataFrame, model: PipelineModel, good_path: str, dead_path: str, checkpoint: str, interval: str | None = None, strict: bool = False) -> StreamingQuery:
    """Scores each micro-batch and puts what can't be scored aside as JSON.

    A batch that runs again writes over its own folder, so results stay exact.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            good, bad = split_dead_letters(batch, strict)
            score(good, model, strict=strict).write.mode("overwrite").parquet(f"{good_path}/batch={number}")
            bad.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).write.mode("overwrite").json(f"{dead_path}/batch={number}")
        finally:
            batch.unpersist()

    w = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


class ProgressLog(StreamingQueryListener):
    """What every batch of the session's queries has told, from the first to the last.

    Add it before the queries start (``watching``). Spark itself keeps only the last 100
    batches of a query. Rows are held here until ``flush`` appends them to the stored table,
    which ``run_for`` does again and again, so a long run holds few at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark)
        self._rows: list[tuple] = []
        self._lock, self._ended = threading.Lock(), defaultdict(threading.Event)
        spark.createDataFrame([], PROGRESS).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        waiting = sum(int((s.metrics or {}).get("numFilesOutstanding", 0)) for s in p.sources)
        rate = p.processedRowsPerSecond
        row = (str(p.runId), p.batchId, p.timestamp, p.numInputRows, 0.0 if rate is None or rate != rate else float(rate), p.batchDuration, waiting)
        with self._lock:
            self._rows.append(row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended[str(event.runId)].set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until all that the stopped query has told is here; events come in order, its end last."""
        if not self._ended[str(query.runId)].wait(seconds):
            raise TimeoutError("the query's last event hasn't come; was the log added before it started?")

    def flush(self) -> None:
        with self._lock:
            rows, self._rows = self._rows, []
        if rows:
            self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(self.path)

    def table(self, query: StreamingQuery | None = None) -> DataFrame:
        """A row a batch, of all queries or of one run."""
        self.flush()
        out = self.spark.read.schema(PROGRESS).parquet(self.path)
        return out if query is None else out.filter(F.col("run") == str(query.runId))


@contextmanager
def watching(spark: SparkSession, path: str | None = None) -> Iterator[ProgressLog]:
    """A ``ProgressLog`` that listens inside the block."""
    log = ProgressLog(spark, path)
    spark.streams.addListener(log)
    try:
        yield log
    finally:
        log.flush()
        spark.streams.removeListener(log)


def run_for(query: StreamingQuery, seconds: float, log: ProgressLog, every: float = 30) -> dict:
    """Lets a query run for a time and stops it; its last progress, and the batches and rows of the whole run."""
    end = time.monotonic() + seconds
    while (left := end - time.monotonic()) > 0 and not query.awaitTermination(min(left, every)):
        log.flush()
    query.stop()
    log.wait(query)
    told = log.table(query).agg(F.count_if(F.col("rows") > 0).alias("b"), F.sum("rows").alias("r")).first()
    return dict(query.lastProgress or {}) | {"total_batches": told["b"], "total_rows": told["r"] or 0}


def tallies(spark: SparkSession, good_path: str, dead_path: str) -> DataFrame:
    """(status, n) of what a scoring stream has written: scored rows and dead letters by reason."""
    good = spark.read.parquet(good_path).select(F.lit("scored").alias("status"))
    dead = spark.read.schema("error string, original_data string, timestamp string").json(dead_path).select(F.col("error").alias("status"))
    return good.unionByName(dead).groupBy("status").agg(F.count("*").alias("n"))


def progress_frame(log: ProgressLog, query: StreamingQuery, capacity: int = 0) -> DataFrame:
    """(batch, rows, rows_per_second, batch_ms, elapsed_ms, load, backlog) of all batches of a run.

    elapsed_ms is the time since the run's first batch began, load is rows over capacity (0
    if unbounded), backlog the files that wait.
    """
    rows = log.table(query)
    began = rows.agg(F.min(F.to_timestamp("at")).alias("began"))  # one row
    load = F.col("rows") / F.lit(float(capacity)) if capacity else F.lit(0.0)
    elapsed = (F.unix_millis(F.to_timestamp("at")) - F.unix_millis("began") + F.col("batch_ms")).alias("elapsed_ms")
    return rows.crossJoin(F.broadcast(began)).select("batch", "rows", "rows_per_second", "batch_ms", elapsed, load.alias("load"), "backlog")
