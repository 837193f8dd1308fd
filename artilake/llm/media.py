"""Media columns: payloads stored as images in archives, and a Spark data source that reads them.

A payload is a byte string whose length is a positive multiple of 192. It is stored losslessly as
an 8-bit grey PNG image 192 samples wide. A writing task fills archives in a directory of the shared
folder, each closed at ARCHIVE_BYTES: members one after another, then a directory of (key, offset, size, CRC-32), then a footer. The data
source `media_archive` takes the path of the list of archives and plans byte ranges over them, at most
MOST_RANGES partitions of several ranges where there are more, without listing members on the driver. A task reads the directory entries of its range and streams the members as Arrow
batches; a member that can't be read is tried again by itself, at its own offset, and one that
stays unreadable becomes a row with an error, so that the others are kept.

Null and empty texts give a payload of 192 spaces; a very long text is one member. Repeated rows are stored once for each row and
come back as often. Equal texts give equal values. An empty table gives an empty result. Other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import documents, scratch_fs, shared_dir, stored
from .tokens import small_batches

WIDTH = 192
#: Bytes after which an archive is closed, of a range, and partitions of a read.
ARCHIVE_BYTES, RANGE_BYTES, MOST_RANGES = 64 << 20, 8 << 20, 100_000
#: Fixed values of the PNG format.
PNG, IEND = b"\x89PNG\r\n\x1a\n", b"\x00\x00\x00\x00IEND\xaeB`\x82"
ENTRY = np.dtype([("key", "<i8"), ("null", "<u4"), ("crc", "<u4"), ("at", "<u8"), ("size", "<u8")])
FOOT = struct.Struct("<8sQQI")
MAGIC = b"MEDIAARC"


class BadMember(ValueError):
    """Stored bytes that don't fit their checksum or format."""


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    n = len(data)
    return n, data + b" " * (-n % WIDTH if n else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter, 0
    lines[:, 1:] = rows
    return PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + IEND


def from_png(png: bytes) -> bytes:
    """The samples of an image as to_png() writes it; checks each part."""
    if png[:8] != PNG:
        raise BadMember("not a PNG image")
    at, data, shape = 8, [], None
    while at < len(png):
        if at + 12 > len(png):
            raise BadMember("the image is cut off")
        (n,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if len(png) < at + 12 + n or struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise BadMember("a chunk's checksum differs")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise BadMember("not an 8-bit grey image")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise BadMember("an unknown filter")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """mean:deviation:entropy of the samples, and a 64-bit difference hash of the image's 8 x 9
    block means, in hexadecimal."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    values = np.arange(256.0)
    mean = float(share @ values)
    deviation = float(max(0.0, share @ (values * values) - mean * mean)) ** 0.5
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum()) + 0.0
    cells = np.add.reduceat(x.astype(np.int64), np.arange(72) * len(x) // 72)
    bits = (cells[1:65] > cells[:64]).astype(np.uint8)
    return f"{mean:.4f}:{deviation:.4f}:{abs(entropy):.4f}:{np.packbits(bits).tobytes().hex()}"


def ending(entries: list[tuple], at: int) -> bytes:
    """An archive's directory, which begins at `at`, and its footer."""
    directory = np.array(entries, ENTRY).tobytes()
    return directory + FOOT.pack(MAGIC, at, len(entries), zlib.crc32(directory))


def write_archives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives; rows (path, members, directory_at, size)."""
    root = shared_dir(docs.sparkSession, "media")

    def run(batches):
        out, entries, at, uri = None, [], 0, ""

        def closed():
            nonlocal out, entries, at
            tail = ending(entries, at)
            out.write(tail)
            out.close()
            row = pa.RecordBatch.from_pylist([{"path": uri, "members": len(entries), "directory_at": at, "size": at + len(tail)}])
            out, entries, at = None, [], 0
            return row

        for batch in small_batches(batches, 500):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    uri = f"{root}/{uuid.uuid4().hex}.arc"  # a repeated task writes files of its own
                    files, name = scratch_fs(uri)
                    files.create_dir(name.rpartition("/")[0], recursive=True)
                    out = files.open_output_stream(name)
                n, payload = padded(text)
                member = struct.pack("<Q", n) + to_png(payload)
                out.write(member)
                entries.append((key or 0, key is None, zlib.crc32(member), at, len(member)))
                at += len(member)
                if at >= archive_bytes:
                    yield closed()
        if out is not None:
            yield closed()

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return stored(source.mapInArrow(run, "path string, members bigint, directory_at bigint, size bigint"), "media-archives")


class Ranges(InputPartition):
    """(archive, first, last): the members of the archive that begin in [first, last); several of them."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


SCHEMA = "id bigint, n_bytes bigint, media binary, payload binary, path string, at bigint, error string"


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.archives = options.get("archives")
        self.range_bytes, self.most = int(options.get("rangebytes", RANGE_BYTES)), int(options.get("mostranges", MOST_RANGES))
        self.tries, self.batch_bytes = int(options.get("tries", 3)), int(options.get("batchbytes", 4 << 20))

    def partitions(self):
        import pyarrow.dataset as ds

        files, name = scratch_fs(self.archives)
        listed = ds.dataset(name, filesystem=files, format="parquet", exclude_invalid_files=False, ignore_prefixes=["_", "."]).to_table(columns=["path", "directory_at"])  # one row per archive
        out = []
        for path, size in sorted(zip(listed["path"].to_pylist(), listed["directory_at"].to_pylist(), strict=True)):
            cuts = max(1, -(-size // self.range_bytes))
            out += [(path, size * k // cuts, size * (k + 1) // cuts) for k in range(cuts)]
        each = max(1, -(-len(out) // self.most))
        return [Ranges(out[k : k + each]) for k in range(0, len(out), each)] or [Ranges([])]

    def read(self, partition):
        for path, first, last in partition.ranges:
            yield from self.read_range(path, first, last)

    def read_range(self, path: str, first: int, last: int):
        files, name = scratch_fs(path)
        with files.open_input_file(name) as f:
            total = f.size()
            f.seek(total - FOOT.size)
            magic, at, n, crc = FOOT.unpack(f.read(FOOT.size))
            f.seek(at)
            directory = f.read(n * ENTRY.itemsize)  # an archive is closed at a size, so its directory is small
            if magic != MAGIC or zlib.crc32(directory) != crc:
                raise BadMember(f"{path}: the directory's checksum differs")
            entries = np.frombuffer(directory, ENTRY)
            entries = entries[(entries["at"] >= first) & (entries["at"] < last)]
            rows, held = [], 0
            for e in entries:
                rows.append(self.member(files, name, f, path, e))
                held += len(rows[-1]["payload"] or b"") + int(e["size"])
                if held >= self.batch_bytes:
                    yield self.batch(rows)
                    rows, held = [], 0
            if rows:
                yield self.batch(rows)

    def batch(self, rows):
        kinds = [("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("path", pa.string()), ("at", pa.int64()), ("error", pa.string())]
        return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    def member(self, files, name, f, path, e) -> dict:
        row = {"id": None if e["null"] else int(e["key"]), "n_bytes": None, "media": None, "payload": None, "path": path, "at": int(e["at"]), "error": None}
        for attempt in range(self.tries):
            try:
                if attempt:  # by a handle of its own
                    time.sleep(0.05 * 2**attempt)
                    with files.open_input_file(name) as again:
                        data = self.bytes_of(again, e)
                else:
                    data = self.bytes_of(f, e)
                return row | {"n_bytes": struct.unpack_from("<Q", data)[0], "media": data[8:], "payload": from_png(data[8:]), "error": None}
            except (OSError, ValueError, zlib.error, struct.error) as problem:
                row["error"] = f"{type(problem).__name__}: {problem}"
        return row

    @staticmethod
    def bytes_of(f, e) -> bytes:
        f.seek(int(e["at"]))
        data = f.read(int(e["size"]))
        if len(data) != e["size"] or zlib.crc32(data) != e["crc"]:
            raise BadMember("the member's checksum differs")
        return data


class MediaArchives(DataSource):
    """Options: archives (path of the list of archives), rangeBytes, mostRanges, batchBytes, tries."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return MediaReader({k.lower(): v for k, v in self.options.items()})


def read_archives(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """id, n_bytes, media, payload, path, at, error: one row per member of the archives that write_archives() lists."""
    spark = archives.sparkSession
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archive").option("archives", archives.stored_at).option("rangeBytes", range_bytes).load()


def features(members: DataFrame) -> DataFrame:
    """id, n_bytes, payload facts, media facts, the feature string and the error, from the bytes read
    back. A member that could not be read keeps its row: its facts are null, its error says why."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["error"]:
                    out.append((r["id"], *[None] * 7, f"{r['path']} at {r['at']}: {r['error']}"))
                    continue
                p, m = r["payload"], r["media"]
                out.append((r["id"], r["n_bytes"], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(p), None))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return members.mapInArrow(run, "id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, error string")


def op2_media_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(read_archives(write_archives(documents(spark, sf_dir)))).withColumnRenamed("id", "doc_id")
