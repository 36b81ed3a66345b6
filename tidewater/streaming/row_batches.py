"""A stream over the rows of a Parquet folder whose offsets count rows, so that a batch has at most so many.

A batch is what one call of a function (a model, say) gets: at most 50 rows, or what has
come within the trigger's interval. Spark's round of a stream is no such batch: it costs
tenths of a second whatever it holds, so ``stream_batches`` takes all batches that are
there in one round, many to a task, and ``by_batch`` calls the function for each of them.
``stream_rows`` has a round for each batch, for streams of few rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import PySparkNotImplementedError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import LongType, StructType

#: Rows that a batch has at most, and the column that tells a row's batch.
ROWS, NUMBER = 50, "row_batch"
#: Rows that a task decodes at a time.
DECODED = 10_000


class RowBatches(DataSource):
    """``spark.readStream.format("row_batches").option("rows", 50).load(folder)``.

    Rows come in the order of the files' times and names; files may be added while the
    stream runs. An offset is the number of rows before it and stands in the checkpoint, so
    a restarted query goes on with the next row. A round is one batch, whose few rows are
    read where the query is planned. With the option ``number`` a round is all rows that
    are there; tasks read a row group each, and the column of that name has the batch of a
    row: the place of the batch's first row in the stream.
    """

    @classmethod
    def name(cls) -> str:
        return "row_batches"

    def schema(self) -> StructType:
        store, files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no Parquet file in {self.options['path']}")
        schema = from_arrow_schema(pq.read_schema(files[0], filesystem=store))
        if (number := self.options.get("number")) in schema.names:
            raise ValueError(f"the files have a column {number} of their own")
        return schema.add(number, LongType()) if number else schema

    def streamReader(self, schema: StructType) -> BatchReader:
        if "number" not in self.options:
            raise PySparkNotImplementedError(errorClass="NOT_IMPLEMENTED", messageParameters={"feature": "streamReader"})
        return BatchReader(self.options["path"], int(self.options.get("rows", ROWS)), schema)

    def simpleStreamReader(self, schema: StructType) -> RowReader:
        return RowReader(self.options["path"], int(self.options.get("rows", ROWS)), schema.names)


class RowReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, rows: int, names: list[str]):
        self.path, self.rows, self.names = path, rows, names
        self.sizes: dict[str, list[int]] = {}
        self.last: tuple = (None, None)

    def initialOffset(self) -> dict:
        return {"row": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found = self._slice(start["row"], self.rows)
        return iter(found), {"row": start["row"] + len(found)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._slice(start["row"], end["row"] - start["row"]))

    def _slice(self, first: int, n: int) -> list[tuple]:
        """``n`` rows from row ``first`` on; only row groups that hold some of them are read."""
        store, files = _files(self.path)
        out, at = [], 0
        for file in files:
            for group, size in enumerate(_sizes(store, file, self.sizes)):
                low, high = max(first, at), min(first + n, at + size)
                if low < high:
                    if self.last[0] != (file, group):  # the next batches are of the same group
                        self.last = (file, group), pq.ParquetFile(file, filesystem=store).read_row_group(group, columns=self.names)
                    part = self.last[1].slice(low - at, high - low)
                    out += zip(*[part[c].to_pylist() for c in self.names])
                at += size
                if at >= first + n:
                    return out
        return out


@dataclass
class RowRange(InputPartition):
    """Rows ``low`` to ``high`` of a row group, the first of which is row ``first`` of the stream."""

    file: str
    group: int
    low: int
    high: int
    first: int


class BatchReader(DataSourceStreamReader):
    """Rounds of all rows that are there: a task reads what a row group has of them, in batches."""

    def __init__(self, path: str, rows: int, schema: StructType):
        self.path, self.rows, self.schema = path, rows, schema
        self.sizes: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        store, files = _files(self.path)
        return {"row": sum(sum(_sizes(store, file, self.sizes)) for file in files)}

    def partitions(self, start: dict, end: dict) -> list[RowRange]:
        store, files = _files(self.path)
        out, at = [], 0
        for file in files:
            for group, size in enumerate(_sizes(store, file, self.sizes)):
                low, high = max(start["row"], at), min(end["row"], at + size)
                if low < high:
                    out.append(RowRange(file, group, low - at, high - at, low))
                at += size
        return out

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        """A batch never goes on in another range, so all its rows are in one task; parts may be cut within one."""
        store, _ = _store(self.path)
        kinds, at = to_arrow_schema(self.schema), 0
        for part in pq.ParquetFile(partition.file, filesystem=store).iter_batches(DECODED, row_groups=[partition.group], columns=self.schema.names[:-1]):
            low, high = max(partition.low, at), min(partition.high, at + part.num_rows)
            if low < high:
                place = np.arange(low - partition.low, high - partition.low, dtype="int64")
                own = part.slice(low - at, high - low)
                columns = [own.column(c) for c in self.schema.names[:-1]] + [pa.array(partition.first + place // self.rows * self.rows)]
                yield pa.RecordBatch.from_arrays([c.cast(k.type) for c, k in zip(columns, kinds)], schema=kinds)
            at += part.num_rows
            if at >= partition.high:
                return


def _sizes(store: fs.FileSystem, file: str, known: dict[str, list[int]]) -> list[int]:
    """Rows of each row group of a file."""
    if file not in known:
        meta = pq.read_metadata(file, filesystem=store)
        known[file] = [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
    return known[file]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> tuple[fs.FileSystem, list[str]]:
    store, root = _store(path)
    found = [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(".parquet") and "/_" not in f.path]
    return store, [f.path for f in sorted(found, key=lambda f: (f.mtime_ns, f.path))]


def stream_rows(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    """The rows of a Parquet folder as a stream of batches of at most ``rows``."""
    spark.dataSource.register(RowBatches)
    return spark.readStream.format(RowBatches.name()).option("rows", rows).load(path)


def stream_batches(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    """The rows of a Parquet folder as a stream, with the batch of at most ``rows`` that each is in (``NUMBER``)."""
    spark.dataSource.register(RowBatches)
    return spark.readStream.format(RowBatches.name()).option("rows", rows).option("number", NUMBER).load(path)


def by_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType | str) -> DataFrame:
    """``f`` called once for each batch of ``stream_batches``, with all its rows and no others; its results in ``schema``."""
    number = df.columns.index(NUMBER)

    def whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Arrow hands over parts of any size, so the last batch of one may go on in the next."""
        held: pa.RecordBatch | None = None
        for part in parts:
            if not part.num_rows:
                continue
            part = pa.concat_batches([held, part]) if held is not None else part
            borders = np.flatnonzero(np.diff(part.column(number).to_numpy())) + 1
            for low, high in zip([0, *borders], borders):
                yield part.slice(low, high - low)
            last = borders[-1] if len(borders) else 0
            held = part.slice(last)
        if held is not None:
            yield held

    def called(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        results, n = [], 0
        for batch in whole(parts):
            results.append(f(batch))
            n += results[-1].num_rows
            if n >= DECODED:  # results go back together
                yield pa.concat_batches(results)
                results, n = [], 0
        if results:
            yield pa.concat_batches(results)

    return df.mapInArrow(called, schema)
