"""An ordered log of messages, and a streaming source that takes a counted number of them.

A log is made of segments; a segment's messages lie in files in order, and a record beside them names the files with
their numbers of messages. A message's offset is its place in the log, so intake starts and stops at any message, wherever files
end, and a stream gets messages in the order of the log.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ledgerline.sources.commits import CommitConflict, Files

#: Messages that one task reads, about.
TASK_MESSAGES = 100_000


def append_log(messages: DataFrame, path: str, order: tuple[str, ...] = ("receivedAt", "id"), files_of: int | None = None) -> int:
    """Add messages to a log as its next segment, in ``order`` (nulls first) and about ``files_of`` files; returns the log's length.

    Ordered by range partitioning, so no task holds the segment. Of two writers of one segment the later one
    fails with CommitConflict and its messages stay unseen.
    """
    spark = messages.sparkSession
    files = Files(spark)
    number = len(segments(spark, path))
    folder = f"{path}/data/{number:012d}"
    while files.exists(folder):  # what a stopped writer left
        folder += "-"
    laid = messages.repartitionByRange(files_of, *order) if files_of else messages.repartitionByRange(*order)
    laid.sortWithinPartitions(*order).write.parquet(folder)
    # One row a file; the first message tells where a file stands. Empty files name no row.
    written = spark.read.parquet(folder)
    first = F.min(F.struct(*order)).alias("first")
    rows = written.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), first).orderBy("first").select("file", "n").collect()
    record = json.dumps({"files": [[r["file"], r["n"]] for r in rows], "columns": written.schema.json()})
    if not files.create(f"{path}/segments/{number:012d}.json", record):
        raise CommitConflict(f"segment {number} of {path} is there already")
    return log_length(spark, path)


def segments(spark: SparkSession, path: str) -> list[str]:
    return sorted(n for n in Files(spark).names(f"{path}/segments") if n.endswith(".json"))


def log_files(spark: SparkSession, path: str) -> list[list]:
    """[file, messages] of the log, in order."""
    files = Files(spark)
    return [x for n in segments(spark, path) for x in json.loads(files.read(f"{path}/segments/{n}"))["files"]]


def log_length(spark: SparkSession, path: str) -> int:
    return sum(n for _, n in log_files(spark, path))


class _Slice(InputPartition):
    def __init__(self, file: str, first: int, last: int):
        self.file, self.first, self.last = file, first, last


class _LogReader(DataSourceStreamReader):
    """Offsets count messages. Files are those that the log had when the stream began."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.files = schema, json.loads(options["files"])
        self.ends = list(accumulate((n for _, n in self.files), initial=0))
        self.until = min(self.ends[-1], int(options.get("until", self.ends[-1])))
        self.most = int(options.get("most", 0))
        self.at = 0

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        end = min(self.until, self.at + self.most) if self.most else self.until
        return {"at": max(self.at, end)}

    def partitions(self, start: dict, end: dict) -> list[_Slice]:
        self.at = end["at"]
        out, at = [], start["at"]
        while at < end["at"]:
            i = bisect_right(self.ends, at) - 1
            upto = min(end["at"], self.ends[i + 1], at + TASK_MESSAGES)
            out.append(_Slice(self.files[i][0], at - self.ends[i], upto - self.ends[i]))
            at = upto
        return out

    def read(self, partition: _Slice) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema, timestamp_utc=True)
        system, path = fs.FileSystem.from_uri(partition.file)
        with system.open_input_file(path) as f:
            at = 0
            for batch in pq.ParquetFile(f).iter_batches(columns=schema.names):
                a, b = max(partition.first - at, 0), min(partition.last - at, len(batch))
                at += len(batch)
                if a < b:
                    taken = pa.Table.from_batches([batch.slice(a, b - a)]).select(schema.names).cast(schema, safe=False)
                    yield from taken.to_batches()
                if at >= partition.last:
                    return

    def commit(self, end: dict) -> None:
        pass


class MessageLog(DataSource):
    """Source ``message_log``. Options: files, as JSON; until, the offset to stop at; most, messages a trigger takes."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return self.options["columns"]

    def streamReader(self, schema: StructType) -> _LogReader:
        return _LogReader(schema, dict(self.options))


def log_stream(spark: SparkSession, path: str, until: int | None = None, most: int | None = None) -> DataFrame:
    """The log's messages as a stream, in order: up to offset ``until``, at most so many a trigger. Its columns are those of the first segment."""
    spark.dataSource.register(MessageLog)
    files, names = log_files(spark, path), segments(spark, path)
    if not names:
        raise ValueError(f"there is no log at {path}")
    columns = StructType.fromJson(json.loads(json.loads(Files(spark).read(f"{path}/segments/{names[0]}"))["columns"]))
    reader = spark.readStream.format("message_log").schema(columns).option("columns", columns.json()).option("files", json.dumps(files))
    for name, value in (("until", until), ("most", most)):
        reader = reader if value is None else reader.option(name, value)
    return reader.load()


def consumed(spark: SparkSession, checkpoint: str) -> int:
    """The offset up to which a stream of one log has planned its batches; 0 before its first."""
    files = Files(spark)
    batches = [int(n) for n in files.names(f"{checkpoint}/offsets") if n.isdigit()]
    return json.loads(files.read(f"{checkpoint}/offsets/{max(batches)}").strip().split("\n")[-1])["at"] if batches else 0
