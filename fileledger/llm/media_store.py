"""Media columns: payloads as images in archives, and a data source that reads them back by byte range.

A payload is bytes padded with spaces to whole rows of 64 RGB pixels, stored as an
8-bit PNG (lossless; the unpadded length stands in a text chunk).  Tasks write the
images of their rows as members of ZIP archives of bounded size under unique
names; the archives of tasks that ended well are listed in a manifest, so what a
lost task left behind is never read.  The data source plans one partition for
each byte range of each listed archive.  A partition reads the archive's
directory, takes the members that begin in its range, and reads each by its own
offset, so that a failed read is tried again for that member alone.

Rules.  Null text is an empty payload (one row of spaces); texts of any length are
one image each; repeated rows are stored each on its own; a null id is read back
as null; an empty table makes no archive and reads back as an empty table.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fileledger.sources.scratch import new_path

ROW_BYTES = 192
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
ATTEMPTS = 4
#: Partitions that are planned at most, whatever the bytes and however many archives.
MOST_RANGES = 100_000
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_image(text: bytes) -> bytes:
    rows = max(1, -(-len(text) // ROW_BYTES))
    lines = np.zeros((rows, ROW_BYTES + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(text.ljust(rows * ROW_BYTES, b" "), np.uint8).reshape(rows, ROW_BYTES)
    head = struct.pack(">IIBBBBB", ROW_BYTES // 3, rows, 8, 2, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0%d" % len(text)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_image(media: bytes) -> tuple[bytes, int]:
    """The payload (samples in order) and the unpadded length."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, length, size = 8, [], None, None
    while at < len(media):
        n = struct.unpack_from(">I", media, at)[0]
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"tEXt" and body.startswith(b"Length\0"):
            length = int(body[7:])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(size[1], 3 * size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return lines[:, 1:].tobytes(), length


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; the schemes by which Spark names object stores are understood too."""
    scheme, colon, rest = uri.partition("://")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + colon + rest)


class _Stream(io.RawIOBase):
    """What zipfile writes to: a pyarrow output stream that only goes forward."""

    def __init__(self, to):
        self.to, self.at = to, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.to.write(bytes(data))
        self.at += len(data)
        return len(data)


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Writes every row's image to archives under folder and the manifest of those archives; returns the number of archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        stream = archive = name = None
        n = 0

        def close() -> pa.RecordBatch:
            archive.close()
            stream.to.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([stream.at]), pa.array([n])], names=["archive", "bytes", "members"])

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                if archive is None:
                    name, n = f"{uuid.uuid4().hex}.zip", 0
                    stream = _Stream(fs.open_output_stream(f"{root}/{name}"))
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                media = encode_image(text.as_buffer().to_pybytes() if text.is_valid else b"")
                archive.writestr(zipfile.ZipInfo(f"{n}/{'' if key is None else key}.png"), media)
                n += 1
                if stream.at >= ARCHIVE_BYTES:
                    yield close()
                    archive = None
        if archive is not None:
            yield close()

    listed = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, "archive string, bytes bigint, members bigint")
    listed.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest").count()


@dataclass
class ByteRange:
    archive: str
    size: int
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    """Ranges of archives that one task reads, one after the other."""

    parts: list[ByteRange]


class _Ranged(io.RawIOBase):
    """A seekable view of a file for zipfile's directory reader."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at = file, size, 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = self.size - self.at if n < 0 else min(n, self.size - self.at)
        out = self.file.read_at(n, self.at)
        self.at += len(out)
        return out


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.attempts = int(options.get("attempts", ATTEMPTS))

    def partitions(self) -> list[Ranges]:
        """Ranges of the archives in the manifest; where there would be more than MOST_RANGES, longer ones, and those of small archives together.  The archives' directories are left to the tasks."""
        import pyarrow.parquet as pq

        fs, root = filesystem(self.folder)
        found = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/manifest")) if f.base_name.endswith(".parquet")]
        listed = [r for f in sorted(found) for r in pq.read_table(f, filesystem=fs).to_pylist()]
        # Two neighbours together are more than a step, so with steps of twice the share there are no more than MOST_RANGES.
        step = max(self.range_bytes, -(-2 * sum(r["bytes"] for r in listed) // MOST_RANGES))
        out, held = [Ranges([])], 0
        for r in sorted(listed, key=lambda r: r["archive"]):
            for s in range(0, r["bytes"], step):
                part = ByteRange(f"{root}/{r['archive']}", r["bytes"], s, min(s + step, r["bytes"]))
                if held and held + part.end - s > step:
                    out.append(Ranges([]))
                    held = 0
                out[-1].parts.append(part)
                held += part.end - s
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for part in partition.parts:
            yield from self._read(part)

    def _read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        with _Archive(filesystem(self.folder)[0], partition.archive, self.attempts) as archive:
            listed = archive.tried(lambda file: zipfile.ZipFile(_Ranged(file, partition.size)).infolist(), "directory")[0]
            for info in listed:
                if not partition.start <= info.header_offset < partition.end:
                    continue
                media, tries = archive.tried(lambda file: _member(file, info), f"member {info.filename} at {info.header_offset}")  # noqa: B023
                rows.append((partition.archive.rpartition("/")[2], info.filename, info.header_offset, media, tries))
                size += len(media)
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


class _Archive:
    """An open archive of which each read is tried by itself; a failed one opens the archive anew, and later reads keep that handle."""

    def __init__(self, fs: pafs.FileSystem, path: str, attempts: int):
        self.fs, self.path, self.attempts, self.file = fs, path, attempts, None

    def __enter__(self) -> _Archive:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None

    def tried(self, read: Callable, what: str) -> tuple:
        """What read(file) gives, and the number of tries."""
        for k in range(1, self.attempts + 1):
            try:
                if self.file is None:
                    self.file = self.fs.open_input_file(self.path)
                return read(self.file), k
            except (OSError, zipfile.BadZipFile) as e:
                self.close()
                if k == self.attempts:
                    raise OSError(f"{self.path}, {what}: {e}") from e
                time.sleep(0.05 * 2**k)
        raise AssertionError


def _member(file, info: zipfile.ZipInfo) -> bytes:
    """A member's bytes by its offset, checked."""
    head = file.read_at(30, info.header_offset)
    if head[:4] != b"PK\x03\x04":
        raise OSError("no member at this offset")
    names, extra = struct.unpack("<HH", head[26:30])
    media = file.read_at(info.compress_size, info.header_offset + 30 + names + extra)
    if len(media) != info.file_size or zlib.crc32(media) != info.CRC:
        raise OSError("checksum differs")
    return media


_FIELDS = [("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("tries", pa.int32())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows), _FIELDS)], names=[n for n, _ in _FIELDS])


class MediaArchives(DataSource):
    """spark.read.format("media_archives").load(folder): archive, member, offset, media, tries."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "archive string, member string, offset bigint, media binary, tries int"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def load(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Members of the archives under folder; options: rangeBytes, attempts."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(**options).load(folder)


def feature_of(payload: bytes) -> str:
    """Size in pixels, then mean and spread of the samples and the share of each eighth of their range."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    level = np.arange(256)
    mean = (counts * level).sum() / len(payload)
    spread = np.sqrt((counts * (level - mean) ** 2).sum() / len(payload))
    return f"{ROW_BYTES // 3}x{len(payload) // ROW_BYTES};{mean:.3f};{spread:.3f};" + ",".join(f"{x:.4f}" for x in counts.reshape(8, 32).sum(axis=1) / len(payload))


def features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and features of stored images, from their stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            rows = []
            for member, stored in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                payload, length = decode_image(stored)
                key = member.rpartition("/")[2].removesuffix(".png")
                rows.append((int(key) if key else None, length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(payload)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    return media.select("member", "media").mapInArrow(run, f"`{id_col}` bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Every row stored in the shared folder and read back through the data source (options as of load)."""
    spark = docs.sparkSession
    folder = new_path(spark, "media")
    store(docs, folder, id_col, text_col)
    return features(load(spark, folder, **options), id_col)
