"""Record files and replay files read in byte ranges: every row has its file and line, and time that runs backwards ends the job."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .bars import OPTIONAL, SCHEMAS, parse_micros, parse_number

#: A record: time in nanoseconds, instrument, size, and price in units of 1e-9, little-endian and packed.
RECORD = np.dtype([("ts", "<u8"), ("instrument", "<u4"), ("size", "<u4"), ("price", "<i8")])
#: What names the files of a finished run, with the number of records in each.
MANIFEST = "_records.json"
FIELDS = "file string, line long, ts long, instrument long, size long, price long"


def _store(path: str):
    """A file system and the path in it; also stores that are named by a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Range(InputPartition):
    """The records first <= line < last of one file (lines count from 0)."""

    def __init__(self, file: str, first: int, last: int) -> None:
        super().__init__(None)
        self.file, self.first, self.last = file, first, last


class RecordReader(DataSourceReader):
    """Splits files into ranges of whole records. A range looks at the record before its first one, so order is checked across ranges too."""

    def __init__(self, options: dict) -> None:
        self.path, self.rows = options["path"], int(options.get("rows", 1 << 20))

    def partitions(self) -> Sequence[Range]:
        store, root = _store(self.path)
        with store.open_input_stream(f"{root}/{MANIFEST}") as f:
            known = json.loads(f.read())
        out = []
        for name, n in sorted(known.items()):
            size = store.get_file_info(f"{root}/{name}").size
            if size != n * RECORD.itemsize:
                raise ValueError(f"{name}: {n} records were written, the file has {size} bytes of {RECORD.itemsize} each")
            out += [Range(name, i, min(n, i + self.rows)) for i in range(0, n, self.rows)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.first == part.last:
            return
        store, root = _store(self.path)
        with store.open_input_file(f"{root}/{part.file}") as f:
            at = max(0, part.first - 1)
            before = None
            while at < part.last:
                n = min(100_000, part.last - at)
                rows = np.frombuffer(f.read_at(n * RECORD.itemsize, at * RECORD.itemsize), RECORD)
                ts = rows["ts"] if before is None else np.append(before, rows["ts"])
                back = np.flatnonzero(ts[1:] < ts[:-1])
                if len(back):
                    raise ValueError(f"{part.file}: line {at + int(back[0]) + (before is None)}: time runs backwards")
                before = rows["ts"][-1]
                skip = part.first - at if at < part.first else 0
                if skip < n:
                    kept = rows[skip:]
                    line = np.arange(at + skip, at + n)
                    yield pa.RecordBatch.from_arrays([pa.array([part.file] * len(kept)), pa.array(line), *(pa.array(kept[c].astype(np.int64)) for c in ("ts", "instrument", "size", "price"))], names=[c.split()[0] for c in FIELDS.split(", ")])
                at += n


class Written(WriterCommitMessage):
    def __init__(self, name: str, n: int) -> None:
        self.name, self.n = name, n


class RecordWriter(DataSourceArrowWriter):
    """Each task writes a file of its own in the rows' order; a run counts only once its manifest is there."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        name, n = f"part-{task.partitionId():05}-{task.taskAttemptId()}.rec", 0
        with store.open_output_stream(f"{root}/{name}") as f:
            for batch in batches:
                rows = np.zeros(batch.num_rows, RECORD)
                for c in RECORD.names:
                    column = batch.column(batch.schema.get_field_index(c))
                    if column.null_count:
                        raise ValueError(f"a record without {c}")
                    rows[c] = column.to_numpy(zero_copy_only=False)
                f.write(rows.tobytes())
                n += len(rows)
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        with store.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps({m.name: m.n for m in messages if m and m.n}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files of a run that failed are in no manifest, so no reader sees them."""


class RecordFiles(DataSource):
    """``spark.read.format("records").load(folder)`` and ``df.write.format("records")``; option rows: records of a split."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options)


def write_records(df: DataFrame, folder: str) -> None:
    """Writes ts (nanoseconds), instrument, size and price (1e-9) as a folder of record files; a null ends the job."""
    df.sparkSession.dataSource.register(RecordFiles)
    df.select(*[F.col(c).cast("long") for c in RECORD.names]).write.format("records").mode("append").save(folder)


def read_records(spark: SparkSession, folder: str, rows: int = 1 << 20) -> DataFrame:
    """The records of a folder with file and line, in splits of ``rows``.

    Files whose size does not meet the manifest are refused before anything is read; in each file time must not run
    backwards, or the job ends with the file and line.
    """
    spark.dataSource.register(RecordFiles)
    return spark.read.format("records").option("rows", rows).load(folder)


# -- replay files ------------------------------------------------------------------------------------------


def replay_lines(spark: SparkSession, paths: list[str], columns: list[str], split: int = 64 << 20) -> DataFrame:
    """Lines of CSV files as text columns: file, line (from 1, the header's), the columns, and ``previous``, the first column of the line before.

    Files are cut at every ``split`` bytes; a split owns the lines that begin in it. One pass counts line ends so
    that lines have their number in the file (one number a split comes to the driver), the other reads. Quoted line ends are not
    supported; a header that differs from ``columns`` ends the job.
    """
    ranges = []
    for path in paths:
        store, inner = _store(path)
        size = store.get_file_info(inner).size
        ranges += [(path, i, min(size, i + split), size) for i in range(0, size, split)]
    splits = spark.createDataFrame(ranges, "file string, start long, stop long, size long").repartition(max(1, len(ranges)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = []
            for path, start, stop, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, inner = _store(path)
                with store.open_input_file(inner) as f:
                    n, at = int(start == 0), max(start - 1, 0)
                    while at < stop - 1:
                        piece = f.read_at(min(1 << 20, stop - 1 - at), at)
                        n, at = n + piece.count(b"\n"), at + len(piece)
                begin.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(begin, pa.int64())], names=["file", "start", "n"])

    numbered, first = [], {}
    for path, start, n in sorted(map(tuple, splits.mapInArrow(count, "file string, start long, n long").collect())):
        numbered.append((path, start, first.get(path, 1)))
        first[path] = first.get(path, 1) + n
    known = {(path, start): (stop, size) for path, start, stop, size in ranges}
    work = spark.createDataFrame([(p, s, *known[p, s], line) for p, s, line in numbered], "file string, start long, stop long, size long, line long").repartition(max(1, len(ranges)))
    names = ["file", "line", *columns, "previous"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop, size, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, inner = _store(path)
                with store.open_input_file(inner) as f:
                    back = max(0, start - (1 << 16))
                    data, end = f.read_at(stop - back, back), stop
                    while end < size and not data.endswith(b"\n"):  # the last line may end behind the split
                        piece = f.read_at(1 << 16, end)
                        cut = piece.find(b"\n") + 1
                        data, end = data + (piece[:cut] if cut else piece), end + (cut or len(piece))
                begin = 0 if start == 0 else data.find(b"\n", start - 1 - back) + 1
                if start and (not begin or begin >= stop - back):
                    continue  # no line begins here
                before = data[:begin].rstrip(b"\r\n").rsplit(b"\n", 1)[-1].decode().split(",")[0] if begin else None
                rows = [x.rstrip("\r").split(",") for x in data[begin:].decode().split("\n")]
                if rows and rows[-1] == [""]:
                    rows.pop()
                if start == 0:
                    if rows and rows[0] != columns:
                        raise ValueError(f"{path}: line 1: the header is {','.join(rows[0])}")
                    rows, line = rows[1:], line + 1
                elif line == 2:
                    before = None  # the header
                for i, r in enumerate(rows):
                    if len(r) != len(columns):
                        raise ValueError(f"{path}: line {line + i}: {len(r)} fields")
                for lo in range(0, len(rows), 10_000):
                    part = rows[lo : lo + 10_000]
                    previous = [before if lo == 0 else rows[lo - 1][0], *(r[0] for r in part[:-1])]
                    made = [pa.array([path] * len(part)), pa.array(range(line + lo, line + lo + len(part)), pa.int64()), *(pa.array([r[k] for r in part], pa.string()) for k in range(len(columns))), pa.array(previous, pa.string())]
                    yield pa.RecordBatch.from_arrays(made, names=names)

    return work.mapInArrow(read, ", ".join(f"{n} {'long' if n == 'line' else 'string'}" for n in names))


def read_replay(spark: SparkSession, paths: list[str], schema: str, split: int = 64 << 20) -> DataFrame:
    """Bars, trades or top_of_book files, strictly typed: file, line, at (epoch microseconds) and the columns.

    A time without an offset, a bad number, or a time before that of the line above ends the job with the file and line.
    Equal times are in order.
    """
    columns = [c.split()[0] for c in SCHEMAS[schema].split(", ")]
    raw = replay_lines(spark, paths, columns, split)
    where = F.concat("file", F.lit(": line "), F.col("line").cast("string"), F.lit(": "))
    at = parse_micros(F.col("observed_at"), where)
    checked = F.when(F.col("previous").isNotNull() & (parse_micros(F.col("previous"), where) > at), F.raise_error(F.concat(where, F.lit("time runs backwards"))).cast("long")).otherwise(at)
    cols = ["file", "line", checked.alias("at")]
    for name in columns[1:]:
        kind = "string" if name == "aggressor" else "bigint" if name in ("volume", "size", "bid_size", "ask_size", "trade_count", "sequence") else "decimal(18,9)"
        cols.append((F.col(name) if kind == "string" else parse_number(F.col(name), kind, name in OPTIONAL, where)).alias(name))
    return raw.select(*cols)
