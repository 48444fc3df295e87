"""Binary telemetry logs: a magic line, a JSON header, then framed histogram and progress records.

`LogRecords` is a Spark data source over them, for batch and for streams.  It plans byte ranges from
the sizes of a listing; a range's records are those that end in it, and a task finds its first
one through the log's index, a sidecar of record offsets at every INDEX_BYTES (a log
without one is one range).  As a stream its offset is the size of each log, so logs
that are still written are tailed: a record cut off at the end is read once it is whole.
Tasks read a log in pieces of READ_BYTES, so its size does not matter.

Logs are written one to a run, with their index, by the task that has the run's records in order.
"""

from __future__ import annotations

import fnmatch
import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from fileledger.sources.scratch import written

INDEX = ".index"
INDEX_BYTES, RANGE_BYTES, READ_BYTES, BATCH_RECORDS = 1 << 20, 64 << 20, 4 << 20, 1000
# Fixed values of the format: sides and operations by their codes, and the caps on lengths.
SIDES = ("source", "destination")
OPERATIONS = ("stat", "read-link", "mkdir", "rmdir", "unlink", "hard-link", "symlink", "chmod", "open-create")
LONGEST_HEADER = 1 << 20
LONGEST_RECORD = 1 << 20
FORMAT_VERSION = 2
# Fixed values of the public histogram encoding: the cookie of version 2 and its header's length.
COOKIE = 0x1C849303
COOKIE_WORD_BITS = 0xF0
HEADER_BYTES = 40


def _leb(data: bytes, at: int) -> tuple[int, int]:
    """A zig-zag LEB128 number of at most nine bytes, and where it ends."""
    value = shift = 0
    for k in range(9):
        b = data[at]
        at += 1
        if k == 8:
            value |= b << shift
            break
        value |= (b & 0x7F) << shift
        if not b & 0x80:
            break
        shift += 7
    return (value >> 1) ^ -(value & 1), at


def decode_histogram(blob: bytes) -> list[tuple[int, int]]:
    """(lowest value of the bucket, count) of an uncompressed version 2 histogram."""
    cookie, length, _, figures, lowest, _, _ = struct.unpack_from(">iiiiqqd", blob)
    if cookie & ~COOKIE_WORD_BITS != COOKIE & ~COOKIE_WORD_BITS:
        raise ValueError("not a version 2 histogram")
    half_bits = max(1, (2 * 10**figures - 1).bit_length()) - 1
    unit = max(0, lowest.bit_length() - 1)
    out, index, at, end = [], 0, HEADER_BYTES, HEADER_BYTES + length
    while at < end:
        count, at = _leb(blob, at)
        if count < 0:
            index -= count
            continue
        if count:
            bucket, sub = (index >> half_bits) - 1, (index & ((1 << half_bits) - 1)) + (1 << half_bits)
            if bucket < 0:
                bucket, sub = 0, sub - (1 << half_bits)
            out.append((sub << (bucket + unit), count))
        index += 1
    return out


def _to_leb(value: int) -> bytes:
    """A number zig-zag encoded as LEB128 of at most nine bytes."""
    n = (value << 1) ^ (value >> 63)
    out = bytearray()
    while len(out) < 8 and n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def encode_histogram(buckets: list[tuple[int, int]], highest: int = 3_600_000_000) -> bytes:
    """The uncompressed version 2 histogram, of three figures and from 1 up, of (lowest value of the bucket, count) in order of value."""
    body, at = bytearray(), 0
    for low, count in buckets:
        shift = max(0, low.bit_length() - 11)
        index = low if not shift else ((shift + 1) << 10) + (low >> shift) - 1024
        if index > at:
            body += _to_leb(at - index)
        body += _to_leb(count)
        at = index + 1
    return struct.pack(">iiiiqqd", COOKIE | 0x10, len(body), 0, 3, 1, highest, 1.0) + bytes(body)


def write_histogram_logs(buckets: DataFrame, progress: DataFrame, folder: str, magic: bytes) -> None:
    """Writes folder/<run>.log and its index of buckets (run, tick, side, op, bucket_low, count) and progress (run, ts, json), in order of time.

    A run is written as its records stream by, and a task that is run again writes
    the same file.
    """
    h = buckets.groupBy("run", F.unix_micros("tick").alias("at"), "side", "op").agg(F.sum("count").alias("n"), F.array_sort(F.collect_list(F.struct("bucket_low", "count"))).alias("buckets"))  # as many as a histogram has buckets
    none = F.lit(None)
    rows = h.select("run", "at", F.lit(0).alias("kind"), "side", "op", "n", F.transform("buckets", lambda b: b["bucket_low"]).alias("lows"), F.transform("buckets", lambda b: b["count"]).alias("counts"), none.cast("string").alias("json"))
    p = progress.select("run", F.unix_micros("ts").alias("at"), F.lit(1).alias("kind"), none.cast("string").alias("side"), none.cast("string").alias("op"), none.cast("bigint").alias("n"), none.cast("array<bigint>").alias("lows"), none.cast("array<bigint>").alias("counts"), "json")
    header = json.dumps({"format_version": FORMAT_VERSION}).encode()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, done = None, []
        for b in batches:
            for r in b.itertuples(index=False):
                if not done or r.run != done[-1]:
                    if out is not None:
                        out.close()
                    done.append(r.run)
                    out = _LogWriter(fs, f"{root}/{r.run}.log", magic + struct.pack("<I", len(header)) + header)
                if r.kind == 0:
                    out.write(struct.pack("<BQBBQ", 0, r.at, SIDES.index(r.side), OPERATIONS.index(r.op), int(r.n)) + encode_histogram([(int(x), int(c)) for x, c in zip(r.lows, r.counts)]))
                else:
                    out.write(struct.pack("<BQ", 1, r.at) + r.json.encode())
        if out is not None:
            out.close()
        yield pd.DataFrame({"run": done})

    rows.unionByName(p).repartition("run").sortWithinPartitions("run", "at", "kind", "side", "op").mapInPandas(run, "run string").count()


class _LogWriter:
    """A log and its index: entry k is the offset of the first record that begins at k * INDEX_BYTES or later."""

    def __init__(self, fs: pafs.FileSystem, path: str, head: bytes):
        self.log, self.index = fs.open_output_stream(path), fs.open_output_stream(path + INDEX)
        self.log.write(head)
        self.at, self.entries = len(head), 0

    def write(self, body: bytes) -> None:
        while self.entries * INDEX_BYTES <= self.at:
            self.index.write(struct.pack("<Q", self.at))
            self.entries += 1
        self.log.write(struct.pack("<I", len(body)) + body)
        self.at += 4 + len(body)

    def close(self) -> None:
        self.log.close()
        self.index.close()


@dataclass
class LogRange(InputPartition):
    """Records of a log that end after start and not after end; a log that may still grow need not have its whole header."""

    path: str
    start: int
    end: int
    indexed: bool
    growing: bool = False


class _Bytes:
    """A file read forward in pieces of READ_BYTES, up to an end."""

    def __init__(self, file, end: int):
        self.file, self.end, self.at, self.held = file, end, 0, b""

    def take(self, at: int, n: int) -> bytes | None:
        """The n bytes at a place, None where they do not all lie before the end."""
        if at + n > self.end:
            return None
        if not self.at <= at or at + n > self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(min(max(n, READ_BYTES), self.end - at))
            if len(self.held) < n:
                return None
        return self.held[at - self.at : at - self.at + n]


def _u32(data: bytes) -> int:
    return struct.unpack("<I", data)[0]


def read_range(fs: pafs.FileSystem, part: LogRange, magic: bytes) -> Iterator[tuple]:
    """(path, seq, kind, unix_micros, side, op, samples, buckets, json) of a range; seq is where a record begins, and the header's is -1."""
    with fs.open_input_file(part.path) as file:
        data = _Bytes(file, file.size())
        said = data.take(0, min(len(magic), data.end))
        if said is not None and not magic.startswith(said):
            raise ValueError(f"bad magic in {part.path}")
        length = data.take(len(magic), 4)
        if length is not None and _u32(length) > LONGEST_HEADER:
            raise ValueError(f"header of {_u32(length)} bytes in {part.path}")
        header = data.take(len(magic) + 4, _u32(length)) if length is not None else None
        if header is None:
            if part.growing:
                return
            raise ValueError(f"header of {part.path} ends too early")
        if json.loads(header).get("format_version") != FORMAT_VERSION:
            raise ValueError(f"unknown format version in {part.path}")
        first = at = len(magic) + 4 + len(header)
        data.end = part.end
        if part.start < first <= part.end:
            yield part.path, -1, "header", None, None, None, None, None, header.decode()
        if part.indexed and part.start > first:
            at = max(first, _indexed(fs, part))
        while (head := data.take(at, 4)) is not None:
            n = _u32(head)
            if n > LONGEST_RECORD:
                raise ValueError(f"record of {n} bytes in {part.path}")
            if n < 9 or at + 4 + n > part.end:
                return
            if at + 4 + n > part.start:
                body = data.take(at + 4, n)
                record = _record(body, part.path) if body is not None else None
                if record is None:
                    return
                yield part.path, at, *record
            at += 4 + n


def _indexed(fs: pafs.FileSystem, part: LogRange) -> int:
    """Where a record begins, not after the one that part.start lies in: two entries back, as a record can be as long as their distance."""
    with fs.open_input_file(part.path + INDEX) as file:
        k = min(part.start // INDEX_BYTES - 2, file.size() // 8 - 1)
        return struct.unpack("<Q", file.read_at(8, 8 * k))[0] if k >= 0 else 0


def _record(body: bytes, path: str) -> tuple | None:
    """(kind, unix_micros, side, op, samples, buckets, json) of a record's bytes; None where they are too few."""
    kind, micros = body[0], struct.unpack_from("<Q", body, 1)[0]
    if kind == 0:
        if len(body) < 19:
            return None
        side, op, samples = struct.unpack_from("<BBQ", body, 9)
        if side >= len(SIDES) or op >= len(OPERATIONS):
            raise ValueError(f"unknown side {side} or operation {op} in {path}")
        return "histogram", micros, SIDES[side], OPERATIONS[op], samples, [{"bucket_low": low, "count": n} for low, n in decode_histogram(body[19:])], None
    if kind == 1:
        return "progress", micros, None, None, None, None, body[9:].decode()
    raise ValueError(f"unknown record kind {kind} in {path}")


RECORDS = "path string, seq bigint, kind string, unix_micros bigint, side string, op string, samples bigint, buckets array<struct<bucket_low: bigint, count: bigint>>, json string"
_BUCKETS = pa.list_(pa.struct([("bucket_low", pa.int64()), ("count", pa.int64())]))
_ARROW = pa.schema([("path", pa.string()), ("seq", pa.int64()), ("kind", pa.string()), ("unix_micros", pa.int64()), ("side", pa.string()), ("op", pa.string()), ("samples", pa.int64()), ("buckets", _BUCKETS), ("json", pa.string())])


class _Logs:
    """What both readers share.  Options: path (a log, a folder, or a glob), magic (in hex), rangeBytes."""

    def __init__(self, options: dict):
        self.fs_path, self.magic = options["path"], bytes.fromhex(options["magic"])
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))

    def listed(self) -> dict[str, tuple[int, bool]]:
        """Size and whether there is an index, by log."""
        wild = re.search(r"[*?\[]", self.fs_path)
        base = self.fs_path[: wild.start()].rpartition("/")[0] if wild else self.fs_path
        fs, root = pafs.FileSystem.from_uri(base)
        info = fs.get_file_info(root)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        sizes = {f.path: f.size for f in files if f.type == pafs.FileType.File}
        wanted = f"{root}{self.fs_path[len(base) :]}" if wild else "*"
        return {p: (n, p + INDEX in sizes) for p, n in sizes.items() if not p.endswith(INDEX) and fnmatch.fnmatchcase(p, wanted)}

    def ranges(self, path: str, start: int, end: int, indexed: bool, growing: bool) -> list[LogRange]:
        step = self.range_bytes if indexed else max(1, end - start)
        return [LogRange(path, s, min(s + step, end), indexed, growing) for s in range(start, end, step)] or [LogRange(path, 0, 0, indexed, growing)]

    def read(self, partition: LogRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs = pafs.FileSystem.from_uri(self.fs_path.split("*")[0])[0]
        rows = []
        for row in read_range(fs, partition, self.magic):
            rows.append(row)
            if len(rows) == BATCH_RECORDS:
                yield _arrow(rows)
                rows = []
        if rows:
            yield _arrow(rows)


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class _BatchReader(_Logs, DataSourceReader):
    def partitions(self) -> list[LogRange]:
        return [r for path, (size, indexed) in sorted(self.listed().items()) for r in self.ranges(path, 0, size, indexed, False)] or [LogRange("", 0, 0, False)]


class _StreamReader(_Logs, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: size for path, (size, _) in self.listed().items()}

    def partitions(self, start: dict, end: dict) -> list[LogRange]:
        indexed = {path: has for path, (_, has) in self.listed().items()}
        return [r for path, size in sorted(end.items()) if size > start.get(path, 0) for r in self.ranges(path, start.get(path, 0), size, indexed.get(path, False), True)] or [LogRange("", 0, 0, False)]


class LogRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "telemetry_logs"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> _BatchReader:
        return _BatchReader(self.options)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options)


def read_log_records(spark: SparkSession, path: str, magic: bytes, **options) -> DataFrame:
    """(path, seq, kind, unix_micros, side, op, samples, buckets, json): every record of all logs under a path or glob, and each log's header; magic is the first line of the writer's format."""
    spark.dataSource.register(LogRecords)
    return spark.read.format("telemetry_logs").options(magic=magic.hex(), **options).load(path)


def tail_log_records(spark: SparkSession, path: str, magic: bytes, **options) -> DataFrame:
    """The same as a stream, which goes on as logs grow and new ones come."""
    spark.dataSource.register(LogRecords)
    return spark.readStream.format("telemetry_logs").options(magic=magic.hex(), **options).load(path)


def log_headers(records: DataFrame) -> DataFrame:
    return records.where("kind = 'header'").select("path", F.col("json").alias("header"))


def log_buckets(records: DataFrame) -> DataFrame:
    """(run, tick, side, op, bucket_low, count); run is the log's path."""
    h = records.where("kind = 'histogram'").select(F.col("path").alias("run"), F.timestamp_micros("unix_micros").alias("tick"), "side", "op", F.explode("buckets").alias("b"))
    return h.select("run", "tick", "side", "op", "b.*")


def log_progress(records: DataFrame) -> DataFrame:
    """(run, ts, seq, json)"""
    return records.where("kind = 'progress'").select(F.col("path").alias("run"), F.timestamp_micros("unix_micros").alias("ts"), "seq", "json")


def read_histogram_logs(spark: SparkSession, path: str, magic: bytes) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, buckets, progress) of all logs under a path or glob, which are decoded once for all three."""
    records = written(read_log_records(spark, path, magic), "log-records")
    return log_headers(records), log_buckets(records), log_progress(records)
