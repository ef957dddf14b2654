"""An append-only event log with sequence ids: appends are whole or absent, and streams resume at the id that they have come to."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

NAME = "marginalia_event_log"
#: Events that a task of a stream or of a read has, unless the option rows_per_task says otherwise.
ROWS_PER_TASK = 1_000_000
_SEGMENT = re.compile(r"segment-(\d+)-(\d+)$")


def _segments(path: str) -> list[tuple[int, int, str]]:
    """(first, last, folder) of the segments of a log, in order."""
    files, root = pyarrow.fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (pyarrow.fs.LocalFileSystem(), path)
    found = files.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
    return sorted((int(m[1]), int(m[2]), x.path) for x in found if (m := _SEGMENT.search(x.path)))


def append_events(rows: DataFrame, path: str, order: list[Column]) -> tuple[int, int]:
    """Append rows in the given order (which tells rows apart); returns the first and the last of their sequence ids (seq).

    Rows are dealt by range of the order and sorted there; a task's first id follows from how many rows the tasks before it
    have, one row a task. The segment is written under another name and then renamed, so that readers see all of it or
    nothing. One writer appends at a time: of two, the rename of one fails. No rows change nothing.
    """
    spark = rows.sparkSession
    hidden = f"{path}/_{uuid.uuid4().hex}"
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row_", F.monotonically_increasing_id())
    dealt.write.parquet(f"{hidden}/rows")
    placed = spark.read.schema(dealt.schema).parquet(f"{hidden}/rows").withColumn("part_", F.shiftright("row_", 33))
    counts = {r["part_"]: (r["n"], r["least"]) for r in placed.groupBy("part_").agg(F.count(F.lit(1)).alias("n"), F.min("row_").alias("least")).collect()}  # one row a task
    start = next((last + 1 for _, last, _ in reversed(_segments(path))), 0)
    if not counts:
        return start, start - 1
    shifts, at = [], start
    for part, (n, least) in sorted(counts.items()):
        shifts.append((part, at - least))
        at += n
    shift = F.broadcast(spark.createDataFrame(shifts, "part_ long, shift_ long"))
    out = placed.join(shift, "part_").withColumn("seq", F.col("row_") + F.col("shift_")).drop("row_", "part_", "shift_")
    out.write.parquet(f"{hidden}/segment")
    jvm = spark.sparkContext._jvm
    source, target = (jvm.org.apache.hadoop.fs.Path(x) for x in (f"{hidden}/segment", f"{path}/segment-{start:020d}-{at - 1:020d}"))
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(target) or not store.rename(source, target):
        raise OSError(f"another writer has appended from {start} on")
    store.delete(jvm.org.apache.hadoop.fs.Path(hidden), True)
    return start, at - 1


class _Range(InputPartition):
    def __init__(self, first: int, stop: int, folders: list[str]):
        self.first, self.stop, self.folders = first, stop, folders


class _Log:
    """What the batch and the stream reader share: ranges of sequence ids over the segments that hold them."""

    def __init__(self, schema: StructType, options: dict):
        self.path, self.columns = options["path"], schema.fieldNames()
        self.rows = int(options.get("rows_per_task", ROWS_PER_TASK))
        self.kept: pyarrow.dataset.Expression | None = None

    def ranges(self, first: int, stop: int) -> list[_Range]:
        held = [(a, b, folder) for a, b, folder in _segments(self.path) if a < stop and b >= first]
        return [_Range(x, min(x + self.rows, stop), [f for a, b, f in held if a < x + self.rows and b >= x]) for x in range(first, stop, self.rows)]

    def rows_of(self, part: _Range) -> Iterator[pa.RecordBatch]:
        files = pyarrow.fs.FileSystem.from_uri(self.path)[0] if re.match(r"\w+:/", self.path) else pyarrow.fs.LocalFileSystem()
        seq = pyarrow.dataset.field("seq")
        wanted = (seq >= part.first) & (seq < part.stop)
        if self.kept is not None:
            wanted = wanted & self.kept
        for folder in part.folders:
            yield from pyarrow.dataset.dataset(folder, format="parquet", filesystem=files, exclude_invalid_files=False).to_batches(columns=self.columns, filter=wanted)


class _Batch(_Log, DataSourceReader):
    """All events, or those that pushed filters on any column leave; filters on seq choose segments, too."""

    def __init__(self, schema: StructType, options: dict):
        super().__init__(schema, options)
        self.first, self.stop = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        forms = {EqualTo: lambda c, v: c == v, GreaterThan: lambda c, v: c > v, GreaterThanOrEqual: lambda c, v: c >= v, LessThan: lambda c, v: c < v, LessThanOrEqual: lambda c, v: c <= v, In: lambda c, v: c.isin(list(v))}
        for x in filters:
            if type(x) not in forms or len(x.attribute) != 1 or not isinstance(x.value, (int, str, tuple, list)):
                yield x
                continue
            one = forms[type(x)](pyarrow.dataset.field(x.attribute[0]), x.value)
            self.kept = one if self.kept is None else self.kept & one
            if x.attribute[0] == "seq":
                if isinstance(x, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, x.value + isinstance(x, GreaterThan))
                if isinstance(x, (EqualTo, LessThan, LessThanOrEqual)):
                    stop = x.value + (not isinstance(x, LessThan))
                    self.stop = stop if self.stop is None else min(stop, self.stop)

    def partitions(self) -> list[_Range]:
        end = max((b + 1 for _, b, _ in _segments(self.path)), default=0)
        return self.ranges(self.first, end if self.stop is None else min(end, self.stop))

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return self.rows_of(partition)


class _Stream(_Log, DataSourceStreamReader):
    """Events from the option `after` on (an id that has been seen; none: from the first). The offset is the next sequence id."""

    def __init__(self, schema: StructType, options: dict):
        super().__init__(schema, options)
        self.start = int(options.get("after", -1)) + 1

    def initialOffset(self) -> dict:
        return {"seq": self.start}

    def latestOffset(self) -> dict:
        return {"seq": max((b + 1 for _, b, _ in _segments(self.path)), default=self.start)}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return self.ranges(start["seq"], end["seq"])

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return self.rows_of(partition)


class EventLog(DataSource):
    """The log as a source for spark.read and spark.readStream; the schema is given by the caller and has seq."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError("give the log's schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(schema, self.options)


def read_log(spark: SparkSession, path: str, schema: StructType | str, **options) -> DataFrame:
    """The log's events as a table, which filters are pushed to; the session's setting for such sources is turned on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EventLog)
    return spark.read.format(NAME).schema(schema).options(path=path, **options).load()


def stream_log(spark: SparkSession, path: str, schema: StructType | str, after: int | None = None, **options) -> DataFrame:
    """The log's events as a stream, from after a sequence id on; a restarted query goes on at its checkpoint's id."""
    spark.dataSource.register(EventLog)
    options |= {} if after is None else {"after": str(after)}
    return spark.readStream.format(NAME).schema(schema).options(path=path, **options).load()
